"""The registered queries over whole small tables, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import queries

SF = "/root/testdata/sf0.001"
ROWS = {"op1": "pages", "op5": "pages", "op7": "embeddings", "op10": "pages"}


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.split("_")[0] not in ("op6", "op11", "op12")])
def test_one_row_for_every_input_row(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    t = ROWS.get(name.split("_")[0], "documents")
    assert len(rows) == spark.read.parquet(f"{SF}/{t}.parquet").count()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_pipeline_stages_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        n.append(docs.count())
    assert n[1] < n[0] and n[2] == n[1] and n[3] < n[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, last.select(key).collect()))
    assert whole.schema == last.schema


CLASHING = "Score int, Row int, `__id` int, `a.b` int, TEXT string, c0 int, point int, gone int, `q``t` int"

EXTRA = (1, 2, 3, 4, "upper", 5, 6, 7, 8)


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns
    whose names differ from the stages' own in case only, or hold dots and quotes."""
    line = "a line of words that stands in many of the documents here"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, line, "en", "s", 5), (2, line, "en", "s", 5),
            (3, f"{line}\n" + " ".join(f"w{i}" for i in range(3000)), None, "s", 5),
            (4, f"{line} too\n" + " ".join(f"w{i}" for i in range(3000)), "en", None, 5), (None, "one two three", "x", "y", 1),
            (5, " \t\n ", "", "", None)]
    rows = [(None if r[0] is None else r[0] + 10**9, *r[1:], *EXTRA) for r in rows]  # ids that have no label
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


def test_stages_keep_every_column_and_row_they_should(spark):
    odd = odd_documents(spark)
    # the classifier learns from documents that have labels
    real = spark.createDataFrame([(*r, *EXTRA) for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()], odd.schema)
    n, left = odd.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = odd.union(real) if name == "toxicity" else odd
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = out.collect()
        left[name] = sum(r["doc_id"] is None or r["doc_id"] >= 10**9 for r in rows)
        assert all(tuple(r)[5:] == EXTRA for r in rows), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert left == {"toxicity": n, "line_dedup": n, "ngram_join": n - 2}
    docs = odd
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == 6


def test_pipeline_equals_its_rules_by_brute_force(spark):
    """Every stage against a plain model of its rule: what the classifier flags is
    gone, no line repeats an earlier one, one document of each near-duplicate group
    is left, and every token is in one piece."""
    import re
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    flagged = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    clean = corpus_pipeline.written(stage["toxicity"](spark, docs, SF), "clean")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {i: t for i, t in texts.items() if i not in flagged}

    lined = corpus_pipeline.written(stage["line_dedup"](spark, clean, SF), "lined")
    got = {r["doc_id"]: r["text"] for r in lined.collect()}
    earlier: list[list[str]] = []
    exact, by_less = set(), {}
    for i in sorted(got):
        kept = []
        for line in texts[i].split("\n"):
            w = tuple(re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            counted = len(w) >= 3 or sum(len(x.encode()) for x in w) >= 12
            less = [(w[:k] + w[k + 1:], k) for k in range(len(w))]
            near = len(w) >= 8 and (any((v, k) in by_less for v, k in less) or any(v in exact and len(v) >= 8 for v, _ in less)
                                    or (w, None) in by_less)
            if not (counted and (w in exact or near)):
                kept.append(line)
            if counted:
                exact.add(w)
                if len(w) >= 8:
                    by_less |= dict.fromkeys(less) | {(v, None): None for v, _ in less}
        assert got[i] == "\n".join(kept), i

    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in got.items()}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    single = corpus_pipeline.written(stage["ngram_join"](spark, lined, SF), "single")
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert left == {i: got[i] for i in sets if find(i) == i}

    pieces = stage["packing"](spark, single, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    have, used = Counter(), Counter()
    for p in pieces:
        have[p["doc_id"]] += p["length"]
        used[p["sequence_id"]] += p["length"]
    assert dict(have) == want and max(used.values()) <= 2048
