"""A corpus pipeline: toxic documents go, near-duplicate lines go, one document
of each near-duplicate group stays, and the rest is packed into sequences.

Every stage takes the rows that its predecessor kept and is written to the
shared folder, so that a lost executor costs a re-read of that stage only.

Cases. All but the last stage return the columns of their input, whatever their
names: names that differ in case only, hold dots or quotes, or are those of a
stage's own columns don't clash. A null text has no words, lines or shingles: it is
never toxic by its words, stays null in the line stage, links with nothing, and is
packed as the end token alone, as an empty text is. Texts are worked on whole,
however long. Rows with a null ``doc_id`` take part in every stage; of equal
documents the smallest id stays, null last. Rows that repeat id and text get one
result in the line stage, and one of them stays in the next. Ties go to the earlier
line and the smaller id. An empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import line_dedup, ngram_join, packing, toxicity
from quarry.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are predicted toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated and nearly repeated lines out of the texts, but for the
    earliest; a document that loses all its lines stays with an empty text."""
    return line_dedup.dedup_lines(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return ngram_join.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage),
          ("ngram_join", ngram_join_stage), ("packing", packing_stage)]

#: the classifier and the tokenizer can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
