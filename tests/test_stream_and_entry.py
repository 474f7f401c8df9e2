import tempfile

from pyspark.sql import functions as F

from quarry.operators.profile import TableProfile
from quarry.streaming.profile_stream import StreamingProfile


def test_stream_equals_batch(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    root = tempfile.mkdtemp(dir="/tmp")
    src.repartition(3).write.parquet(f"{root}/landing")
    sp = StreamingProfile(spark, f"{root}/landing", src.schema, f"{root}/state", files_per_batch=1)
    sp.run()
    keep = ["position", "kind", "populated", "numeric_n", "distinct_n", "q1", "median", "q3"]
    a = sorted(tuple(r) for r in sp.profile().columns().select(*keep).collect())
    b = sorted(tuple(r) for r in TableProfile(src).columns().select(*keep).collect())
    assert a == b
    sp.run()  # nothing new: the state must stay the same
    c = sorted(tuple(r) for r in sp.profile().columns().select(*keep).collect())
    assert c == b


def test_state_is_compacted_and_replays_change_nothing(spark, monkeypatch):
    from quarry.streaming import state

    monkeypatch.setattr(state, "FAN", 3)
    added = F.sum("k").cast("long").alias("k")
    s = state.SegmentedState(spark, tempfile.mkdtemp(dir="/tmp") + "/s", {"t": lambda df: df.groupBy("v").agg(added)})
    schema = "v BIGINT, k BIGINT"
    assert s.read("t", schema).count() == 0
    want, most = {}, 0
    for batch in range(14):
        rows = [(batch % 4, 1 + batch), (100 + batch, 1)]
        frame = spark.createDataFrame(rows, schema)
        s.add(batch, {"t": frame})
        for v, k in rows:
            want[v] = want.get(v, 0) + k
        before = s.manifest()
        s.add(batch, {"t": frame})  # a replay after the manifest
        assert s.manifest() == before
        most = max(most, len(before["segments"]))
        if batch == 5:  # a batch that failed before its manifest: its replay overwrites what it left
            spark.createDataFrame([(7, 7)], schema).write.parquet(s.folder("t", [0, 6, 6]))
        assert {r["v"]: r["k"] for r in s.read("t", schema).collect()} == want
    assert most <= 6 and [x[0] for x in s.manifest()["segments"]] == [2, 1, 0, 0]
    spans = sorted((x[1], x[2]) for x in s.manifest()["segments"])
    assert spans == [(0, 8), (9, 11), (12, 12), (13, 13)]


def test_stream_keeps_duplicates_and_the_report(spark):
    from quarry.plans import report

    rows = [("a", 1.0, None), (" a", 1.0, ""), ("a", -0.0, "x"), ("a", 0.0, "x"), ("b", None, "x"), (None, None, None), ("", None, " ")]
    src = spark.createDataFrame(rows, "c STRING, x DOUBLE, d STRING")
    root = tempfile.mkdtemp(dir="/tmp")
    src.repartition(7).write.parquet(f"{root}/landing")
    sp = StreamingProfile(spark, f"{root}/landing", src.schema, f"{root}/state", files_per_batch=1)
    sp.run()
    batch, stream = TableProfile(src), sp.profile()
    assert tuple(stream.duplicate_count().first()) == tuple(batch.duplicate_count().first()) == (7, 4, 3)
    assert report.render(stream) == report.render(batch)


def test_landing_files_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from quarry.catalog import stream_queries
    from quarry.streaming.state import SegmentedState

    root = tempfile.mkdtemp(dir="/tmp")
    src = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    src.unionByName(src).write.parquet(f"{root}/in/lineitem.parquet")
    rows = 2 * src.count()
    monkeypatch.setattr(stream_queries, "ROWS_PER_FILE", 500, raising=False)
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, name: f"{root}/{name}")
    got = stream_queries.stream_profile(spark, f"{root}/in").collect()
    files = spark.read.parquet(f"{root}/landing").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == rows == got[0]["populated"]
    assert max(r["count"] for r in files) <= 500 + 16  # dealt in turn, from every split
    state = SegmentedState(spark, f"{root}/stream-state/segments", {}).manifest()
    assert state["last"] == 3  # a larger table makes larger batches, not more


def test_row_digests_tell_cells_apart(spark):
    rows = [("a", None), (None, "a"), ("a1:", "b"), ("a", "1:b"), ("", "aa"), ("aa", "")]
    d = TableProfile(spark.createDataFrame(rows, "x STRING, y STRING")).duplicate_count().first()
    assert (d["rows"], d["duplicates"]) == (6, 0)


def test_entry_survives_a_missing_optional_package():
    import importlib
    import sys

    import __spark_entry__ as entry

    kept = {k: v for k, v in sys.modules.items() if k.startswith(("quarry.llm", "corpus_pipeline", "public_tokenizers"))}
    for k in kept:
        del sys.modules[k]
    sys.modules["public_tokenizers"] = None
    try:
        without = importlib.reload(entry).queries()
    finally:
        del sys.modules["public_tokenizers"]
        sys.modules.update(kept)
        importlib.reload(entry)
    assert "profile_overview" in without and not any(k.startswith("op") and k[2].isdigit() for k in without)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "kind" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 58
    assert qs["filter_gt"](spark, "/root/testdata/sf0.001").where(F.col("l_quantity") <= 45).count() == 0
