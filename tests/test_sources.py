import os
import tempfile

from pyspark.sql import functions as F

from quarry.sources.delimited import grid_to_table, read_delimited
from quarry.sources.files import file_check, file_inventory
from quarry.sources.snapshots import SnapshotStore, latest_per_key, older_than_newest, version_id

CSV = ('﻿ id , name,name\n'
       '1,"Smith, J",a\n'
       '\n'
       '2,"multi\nline",b\n'
       '3,"say ""hi""",c,extra\n'
       '4\n'
       '   \n')


def test_read_delimited_traps(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    with open(os.path.join(d, "t.csv"), "w", encoding="utf-8") as f:
        f.write(CSV)
    t = read_delimited(spark, d)
    assert t.columns == ["id", "name", "name_1"]
    rows = sorted(tuple(r) for r in t.collect())
    assert rows == [("", "", ""), ("1", "Smith, J", "a"), ("2", "multi\nline", "b"), ('3', 'say "hi"', "c"),
                    ("4", "", "")]


def test_grid_to_table(spark):
    cells = [("f", 1, 0, 0, " a "), ("f", 1, 0, 1, "b"), ("f", 1, 1, 0, "1"), ("f", 1, 2, 0, " "),
             ("f", 1, 3, 1, "x"), ("f", 2, 0, 0, "other")]
    g = spark.createDataFrame(cells, "file STRING, sheet_no INT, row_no INT, col_no INT, value STRING")
    t = grid_to_table(g)
    assert t.columns == ["file", "row_no", "a", "b"]
    assert sorted((r["row_no"], r["a"], r["b"]) for r in t.collect()) == [(1, "1", ""), (3, "", "x")]


def test_inventory_and_check(spark):
    inv = {r["name"]: r for r in file_inventory(spark, "/root/testdata/sf0.001").collect()}
    assert inv["region.parquet"]["type"] == "PARQUET" and inv["region.parquet"]["format"] == "unsupported"
    chk = {r["name"]: r["exists"] for r in file_check(spark, "/root/testdata/sf0.001", ["region.parquet", "no.csv"]).collect()}
    assert chk == {"region.parquet": True, "no.csv": False}


def test_snapshots(spark):
    base = tempfile.mkdtemp(dir="/tmp") + "/store"
    store = SnapshotStore(spark, base)
    df = spark.range(10).withColumn("g", F.col("id") % 3)
    for v in ["2026-01-01T00-00-00-000Z", "2026-01-02T00-00-00-000Z"]:
        store.save("table_data", df, v)
    store.save("pdf_data", df.limit(2), "2026-01-03T00-00-00-000Z")
    lst = [(r["name"], r["version"]) for r in store.list().orderBy("snapshot_no").collect()]
    assert lst[0] == ("table_data", "2026-01-02T00-00-00-000Z") and lst[-1][0] == "pdf_data"
    assert store.latest("table").count() == 10 and store.latest("pdf").count() == 2
    assert store.latest("nothing") is None
    assert store.apply_retention(keep=1) == 2
    assert store.list().count() == 1
    assert len(version_id()) == len("2026-01-01T00-00-00-000Z")


def test_latest_and_retention_per_key(spark):
    rows = [("a", t, i) for i, t in enumerate([5, 1, 9, 3, 7, 2, 8])] + [("b", 1, 100)]
    df = spark.createDataFrame(rows, "k STRING, ts INT, id INT")
    latest = {r["k"]: (r["ts"], r["id"]) for r in latest_per_key(df, "k", ["ts", "id"]).collect()}
    assert latest == {"a": (9, 2), "b": (1, 100)}
    old = sorted(r["ts"] for r in older_than_newest(df, "k", ["ts", "id"], keep=5).collect())
    assert old == [1, 2]


def test_read_delimited_requires_rows(spark):
    import pytest

    d = tempfile.mkdtemp(dir="/tmp")
    with open(os.path.join(d, "h.csv"), "w") as f:
        f.write("a,b\n")
    assert read_delimited(spark, d).count() == 0
    with pytest.raises(ValueError):
        read_delimited(spark, d, require_rows=True)


def test_package_exports():
    import quarry

    assert quarry.TableProfile and quarry.report.render and quarry.query.filter_rows


def test_snapshots_of_different_schemas_and_odd_versions(spark):
    store = SnapshotStore(spark, tempfile.mkdtemp(dir="/tmp") + "/store")
    store.save("table_data", spark.createDataFrame([(1, 2)], "a INT, b INT"), "2026-01-01T00:00:00")
    store.save("pdf_data", spark.createDataFrame([("t",)], "text STRING"), "1")
    store.save("pdf_data", spark.createDataFrame([("u",), ("v",)], "text STRING"), "001")
    store.save_many(spark.createDataFrame([("m", "a:b%c", 5)], "n STRING, v STRING, x INT"), F.col("n"), F.col("v"))
    assert {(r["name"], r["version"]) for r in store.list().collect()} == {
        ("table_data", "2026-01-01T00:00:00"), ("pdf_data", "1"), ("pdf_data", "001"), ("m", "a:b%c")}
    assert store.load("table_data", "2026-01-01T00:00:00").columns == ["a", "b"]
    assert store.load("pdf_data", "1").count() == 1 and store.latest("pdf_data_0").count() == 2
    assert store.load("m", "a:b%c").first()["x"] == 5


def test_retention_keeps_exactly_so_many_rows_on_ties_and_nulls(spark):
    rows = [("a", 1, "p"), ("a", 1, "q"), ("a", 1, "q"), ("a", 0, "z"), (None, None, "x"), (None, None, "x"),
            (None, 3, "y"), ("b", 5, "w")]
    df = spark.createDataFrame(rows, "k STRING, ts INT, v STRING")
    old = sorted(older_than_newest(df, "k", ["ts"], keep=2).collect(), key=repr)
    assert sorted(map(tuple, old), key=repr) == sorted([("a", 0, "z"), ("a", 1, "p"), (None, None, "x")], key=repr)


def test_headers_never_collide():
    from quarry.sources.delimited import unique_headers

    assert unique_headers(["a", "a", "a_1", "A"]) == ["a", "a_2", "a_1", "A_3"]


def test_a_grid_of_many_workbooks(spark):
    cells = [("a", 1, 0, 0, "x"), ("a", 1, 0, 1, " y "), ("a", 1, 1, 0, "1"), ("a", 1, 1, 1, "2"), ("a", 1, 2, 5, "beyond"),
             ("b", 3, 0, 0, "Y"), ("b", 3, 0, 1, "z"), ("b", 3, 0, 2, "z"), ("b", 3, 4, 0, "3"), ("b", 3, 4, 2, " 5"),
             ("b", 3, 5, 0, "  "), ("b", 4, 0, 0, "other"), ("b", 4, 1, 0, "sheet"), ("c", 1, 1, 0, "no header")]
    g = spark.createDataFrame(cells, "file STRING, sheet_no INT, row_no INT, col_no INT, value STRING")
    t = grid_to_table(g)
    assert t.columns == ["file", "row_no", "x", "y", "z", "z_1"]
    assert sorted(map(tuple, t.collect())) == [("a", 1, "1", "2", "", ""), ("a", 2, "", "", "", ""),
                                               ("b", 4, "", "3", "", "5"), ("c", 1, "", "", "", "")]
