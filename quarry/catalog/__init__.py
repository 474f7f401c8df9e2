"""Registered queries (one per operator) and their SQL oracles."""
