"""Document operators against literal Python models of the reference rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions.cells import WS_CHARS
from quarry.operators import documents as D

WS = "[" + re.escape(WS_CHARS) + "]"


def model_tables(text):
    tables, cur = [], []
    for line in text.split("\n"):
        if "  " in line or "\t" in line:
            cells = [c for c in re.split(WS + "{2,}|\t", line) if c.strip(WS_CHARS)]
            if len(cells) > 1:
                cur.append("|".join(cells))
        elif cur:
            tables.append(cur)
            cur = []
    if cur:
        tables.append(cur)
    return tables


def model_chunks(text, mx):
    chunks, cur = [], ""
    for p in re.split(r"\n\n+", text):
        if len(cur + p) > mx and len(cur) > 0:
            chunks.append(cur.strip(WS_CHARS))
            cur = p
        else:
            cur += ("\n\n" if cur else "") + p
    if cur.strip(WS_CHARS):
        chunks.append(cur.strip(WS_CHARS))
    return chunks


def model_search(text, q):
    lq = q.lower()
    sents = [s for s in re.split(r"[.!?]+", text) if s.strip(WS_CHARS)]
    kws = [w for w in re.split(WS + "+", lq) if len(w) > 3]
    out = []
    for i, s in enumerate(sents):
        low = s.lower()
        if lq in low or any(k in low for k in kws):
            ctx = [sents[i - 1] if i > 0 else "", s, sents[i + 1] if i + 1 < len(sents) else ""]
            out.append(". ".join(c for c in ctx if c.strip(WS_CHARS)))
    return out


PIECES = ["ab", "cd", "  ", " ", "\t", "\n", "\n\n", "\n\n\n", ".", "!", "?", "x y", "data", "the",
          " ", "qq  rr", "1  2\t3", "zz"]


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    out = ["", "\n\nlead", "a\n\n\nb", "x" * 60, "  lone\nA  B\n  lone\nC\tD\nplain\nE  F"]
    for _ in range(n):
        out.append("".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = random_texts(300)
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")


def test_tables_match_model(docs):
    texts, df = docs
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", D.tables_in_text("text").alias("t")).collect()}
    for i, t in enumerate(texts):
        assert [list(x) for x in got[i]] == model_tables(t), repr(t)


@pytest.mark.parametrize("mx", [5, 20, 500])
def test_chunks_match_model(docs, mx):
    texts, df = docs
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", D.chunks_of("text", mx).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]) == model_chunks(t, mx), repr(t)


def test_chunks_rejoin(docs):
    """Chunking only drops white space: the chunks, in order, hold every
    other character of the text."""
    texts, df = docs
    got = {}
    for r in D.chunk_text(df, 10).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    squeeze = lambda t: re.sub(r"\s", "", t)
    for i, t in enumerate(texts):
        assert squeeze("".join(got.get(i, []))) == squeeze(t), repr(t)


@pytest.mark.parametrize("q", ["data", "the qq", "x y zz data"])
def test_search_matches_model(docs, q):
    texts, df = docs
    got = {r["doc_id"]: r["h"] for r in df.select("doc_id", D.sentence_hits("text", q).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]) == model_search(t, q), repr(t)


def test_keywords():
    assert D.keywords("What is the Data quality?") == ["what", "data", "quality?"]


def test_qa_context_shape(spark):
    df = spark.createDataFrame([(1, "A  B\nC  D\n\nplain text")], "doc_id LONG, text STRING")
    ctx = D.qa_context(df, "Why?", max_chars=5).collect()[0]["context"]
    assert ctx.startswith("You are analyzing a PDF document with unknown pages and 21 characters.")
    assert "--- Chunk 1/2 ---" in ctx and "--- Chunk 2/2 ---" in ctx
    assert "Table 1:\nA|B\nC|D\n" in ctx and ctx.endswith("exact text from the PDF.")


def test_doc_stats(spark):
    df = spark.createDataFrame([(1, "A  B\nx\nC\tD"), (2, None)], "doc_id LONG, text STRING")
    got = {r["doc_id"]: (r["text_length"], r["tables_found"]) for r in D.doc_stats(df).collect()}
    assert got == {1: (10, 2), 2: (0, 0)}


def test_many_tables_and_chunks(spark):
    big_table = "\n".join(f"r{i}  c{i}" for i in range(200))
    many_tables = "\n".join(f"a{i}  b{i}\nplain" for i in range(130))
    many_chunks = "\n\n".join(f"p{i}" for i in range(200))
    texts = [big_table, many_tables, many_chunks, big_table + "\n\n" + many_chunks]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    rows = df.select("doc_id", D.tables_in_text("text").alias("t"), D.chunks_of("text", 4).alias("c")).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        assert [list(x) for x in r["t"]] == model_tables(t)
        assert list(r["c"]) == model_chunks(t, 4)


@pytest.mark.parametrize("mx", [1, 2, 3, 6])
def test_chunks_at_the_limit(spark, mx):
    """Blank paragraphs, lengths around the limit and text ends of every kind."""
    rnd = random.Random(mx)
    texts = ["".join(rnd.choice(["\n\n", "\n\n\n", "\n", " ", "  ", "a", "bb", "é", "\U0001f600"]) for _ in range(rnd.randint(0, 12)))
             for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = {r["doc_id"]: list(r["c"]) for r in df.select("doc_id", D.chunks_of("text", mx).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == model_chunks(t, mx), repr(t)


def test_time_grows_with_the_text_alone(spark):
    """Three times the lines cost about three times as much."""
    import time

    def seconds(n, column):
        text = "\n".join(f"r{i}  c{i}" if i % 3 else "plain" for i in range(n)) + "\n\n" + "\n\n".join(["p q"] * n)
        df = spark.createDataFrame([(text,)], "text STRING")
        best = 1e9
        for _ in range(3):
            t0 = time.time()
            df.select(F.size(column)).collect()
            best = min(best, time.time() - t0)
        return best

    for column in (D.tables_in_text("text"), D.chunks_of("text", 20)):
        seconds(3000, column)
        assert seconds(90_000, column) < 6 * seconds(30_000, column) + 1
