"""Keyword test of every document against a table of questions.

A document is a hit of a question if its lower-cased text contains one of the
question's keywords, the words of more than three letters of the lower-cased
question. The distinct keywords of all questions are put into Aho-Corasick
automata of at most ``AUTOMATON_WORDS`` words each; a pass over the texts finds all
keywords of an automaton at once and emits hits only. So no text meets a question
that it shares nothing with, a broadcast is bounded whatever the number of
questions, and the passes grow with the distinct keywords alone.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.cells import WS_CLASS
from quarry.operators.documents import KEYWORD_MIN_LEN
from quarry.session import scratch_path

AUTOMATON_WORDS = 200_000


def question_keywords(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``question_id, word``: the distinct keywords of every question."""
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WS_CLASS + "+")
    return (questions.select(F.col(id_col).alias("question_id"), F.explode(words).alias("word"))
            .where(F.length("word") >= KEYWORD_MIN_LEN).distinct())


def text_hits(docs: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, word``: the given words (a bounded list) that each text holds."""
    given = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in given.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            found = [list({w for _, w in automaton.iter(t)}) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["row", "doc_id", "words"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    schema = rows.select("row", "doc_id").withColumn("words", F.lit(None).cast("array<string>")).schema
    return rows.mapInArrow(work, schema).select("row", "doc_id", F.explode("words").alias("word"))


def keyword_hits(docs: DataFrame, questions: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 question_id_col: str = "question_id", question_col: str = "question",
                 automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """``doc_id, question_id, keywords_found`` for every document and every question
    of which it holds at least one keyword; rows that repeat a document count apart."""
    spark = docs.sparkSession
    asked = question_keywords(questions, question_id_col, question_col)
    path = scratch_path(spark, "keywords")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    distinct = asked.select("word").distinct()
    parts = max(1, math.ceil(distinct.count() / automaton_words))
    hits = []
    for i in range(parts):
        some = distinct.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == i)
        hits.append(text_hits(docs, sorted(r["word"] for r in some.collect()), id_col, text_col))
    return (reduce(DataFrame.unionByName, hits).join(asked, "word").groupBy("row", "doc_id", "question_id")
            .agg(F.count(F.lit(1)).cast("int").alias("keywords_found")).drop("row"))
