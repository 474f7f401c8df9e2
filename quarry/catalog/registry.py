"""All registered queries and oracles, gathered from the catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.catalog import (
    document_queries, prep_queries, profile_queries, query_queries, source_queries, stream_queries,
)
from quarry.catalog.inputs import lineitem_skewed
from quarry.operators.profile import TableProfile


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TableProfile(lineitem_skewed(spark, sf_dir))
    return p.columns().select(
        "position", "column_name", "kind", "populated", "missing", "numeric_n", "mean",
        "median", "q1", "q3", "sd", "outliers", "skew", "variability", "distinct_n",
        "cardinality", "concentration").orderBy("position")


def queries():
    q = {}
    q.update(profile_queries.QUERIES)
    q.update(query_queries.QUERIES)
    q.update(document_queries.QUERIES)
    q.update(source_queries.QUERIES)
    q.update(stream_queries.QUERIES)
    q.update(prep_queries.QUERIES)
    return q


def oracle_sql():
    o = {}
    o.update(profile_queries.sql())
    o.update(query_queries.sql())
    o.update(document_queries.sql())
    o.update(source_queries.sql())
    o.update(stream_queries.sql())
    o.update(prep_queries.sql())
    return {k: v for k, v in o.items() if k in queries()}
