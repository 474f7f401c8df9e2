"""Keyword tables against the one-question operator and a plain loop."""

import random
import re

import pytest

from quarry.functions.cells import WS_CHARS
from quarry.operators import documents as D
from quarry.operators import keywords as K

WS = "[" + re.escape(WS_CHARS) + "]+"


@pytest.mark.parametrize("automaton_words", [K.AUTOMATON_WORDS, 7])
def test_hits_of_a_table_of_questions(spark, automaton_words):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcÉ", k=rng.randint(1, 6)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(7, "abca abcb"), (7, "abca abcb"), (99, None)]
    asks = [(i, "  ".join(word() for _ in range(rng.randint(0, 5)))) for i in range(40)] + [(50, None), (51, "abca\tabca ABCA")]
    got = sorted(map(tuple, K.keyword_hits(spark.createDataFrame(docs, "doc_id long, text string"),
                                           spark.createDataFrame(asks, "question_id long, question string"),
                                           automaton_words=automaton_words).collect()))
    want = []
    for d, text in docs:
        for q, ask in asks:
            words = {w for w in re.split(WS, (ask or "").lower()) if len(w) >= 4}
            n = sum(w in (text or "").lower() for w in words)
            if n:
                want.append((d, q, n))
    assert got == sorted(want) and len(got) > 100


def test_equals_the_operator_of_one_question(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ask = "the lytionat erenan ouan"
    one = {(r["doc_id"], r["keywords_found"]) for r in D.keyword_hits(docs, ask).collect()}
    many = K.keyword_hits(docs, spark.createDataFrame([(1, ask)], "question_id int, question string"))
    assert {(r["doc_id"], r["keywords_found"]) for r in many.collect()} == one and one


def test_no_text_is_joined_with_a_question(spark):
    from tests.test_plans import plan

    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    text = plan(K.keyword_hits(docs, spark.createDataFrame([(1, "some words")], "question_id int, question string")))
    assert "Cartesian" not in text and "BroadcastNestedLoop" not in text
