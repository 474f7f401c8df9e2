import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.profile import TableProfile


def model_quartiles(xs):
    s = sorted(xs)
    n = len(s)
    med = (s[n // 2 - 1] + s[n // 2]) / 2 if n % 2 == 0 else s[n // 2]
    return s[math.floor(n * 0.25)], med, s[math.floor(n * 0.75)]


def test_quartiles_small_n(spark):
    rnd = random.Random(3)
    rows, expect = [], {}
    for n in range(1, 13):
        xs = [float(rnd.randint(0, 9)) for _ in range(n)]
        expect[n] = model_quartiles(xs)
        rows += [(f"c{n}", x) for x in xs]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    wide = df.groupBy().pivot("g").agg(F.collect_list("x"))  # not used for stats; build per column below
    del wide
    for n in range(1, 13):
        one = df.where(F.col("g") == f"c{n}").select("x")
        p = TableProfile(one, bracket_rows=2, accuracy=20)
        r = p.order_stats().collect()[0]
        assert (r["q1"], r["median"], r["q3"]) == expect[n], n


def test_text_column_kinds_and_labels(spark):
    data = [("12abc", "a", "", "5", "x"), ("7", "b", " ", "5", "y"), ("3 cm", "a", None, "5", "z"),
            ("n/a", "a", "", "5", "w")]
    df = spark.createDataFrame(data, "num STRING, cat STRING, empty STRING, const STRING, ident STRING")
    p = TableProfile(df)
    cols = {r["column_name"]: r for r in p.columns().collect()}
    assert cols["num"]["kind"] == "numeric" and cols["num"]["numeric_n"] == 3
    assert cols["cat"]["kind"] == "text"        # 2 distinct of 4 is not < 0.5 x 4
    assert cols["empty"]["kind"] == "empty" and cols["empty"]["missing"] == 4
    assert cols["const"]["kind"] == "numeric"
    assert cols["const"]["skew"] == "left"      # sd = 0: the reference calls it left-skewed
    assert cols["ident"]["cardinality"] == "identifier"
    ov = p.overview().collect()[0]
    assert ov["empty_cells"] == 4 and ov["total_cells"] == 20
    assert ov["completeness"] == pytest.approx(80.0) and ov["quality"] == "good"


def test_moments_match_python(spark):
    rnd = random.Random(11)
    xs = [rnd.gauss(10, 3) for _ in range(500)] + [100.0, -50.0]
    df = spark.createDataFrame([(x, str(x)) for x in xs], "d DOUBLE, s STRING")
    cols = {r["column_name"]: r for r in TableProfile(df).columns().collect()}
    n = len(xs)
    mean = sum(xs) / n
    var = sum((x - mean) ** 2 for x in xs) / n
    q1, med, q3 = model_quartiles(xs)
    iqr = q3 - q1
    outl = sum(1 for x in xs if x < q1 - 1.5 * iqr or x > q3 + 1.5 * iqr)
    for c in ("d", "s"):
        r = cols[c]
        assert r["mean"] == pytest.approx(mean) and r["var_pop"] == pytest.approx(var)
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3))
        assert r["outliers"] == outl


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaccd"], "c STRING")
    top = [(r["value"], r["k"]) for r in TableProfile(df).top_values().orderBy("rank").collect()]
    assert top == [("a", 2), ("b", 2), ("c", 2), ("d", 1)]


def test_duplicates_compare_tuples(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", "b|c"), (" a", "b|c ")], "x STRING, y STRING")
    d = TableProfile(df).duplicate_count().collect()[0]
    assert (d["rows"], d["distinct_rows"], d["duplicates"]) == (4, 2, 2)


def test_digest_counts_sum_to_populated(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    p = TableProfile(df)
    pops = {r["position"]: r["populated"] for r in p.stats_rows}
    sums = {r["position"]: r["s"] for r in p.digests.groupBy("position").agg(F.sum("k").alias("s")).collect()}
    assert sums and all(s == pops[pos] for pos, s in sums.items())


@pytest.mark.parametrize("accuracy,rows", [(5, 3), (20, 10), (200, 50)])
def test_quartiles_by_narrow_brackets(spark, accuracy, rows):
    """Brackets are narrowed in many rounds, and widened where the summary is off."""
    rnd = random.Random(accuracy)
    data = [(rnd.gauss(0, 1), float(rnd.randint(0, 3)), rnd.choice([0.0, -0.0, 1e300, -1e300, math.inf, -math.inf]),
             math.exp(rnd.gauss(0, 20)), None if rnd.random() < 0.4 else rnd.random()) for _ in range(1501)]
    df = spark.createDataFrame(data, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE").repartition(5)
    p = TableProfile(df, bracket_rows=rows, accuracy=accuracy)
    got = {r["position"]: (r["q1"], r["median"], r["q3"]) for r in p.order_stats().collect()}
    for i in range(5):
        want = model_quartiles([r[i] for r in data if r[i] is not None])
        assert all(x == y or (x != x and y != y) for x, y in zip(got[i], want)), i


def test_nan_is_a_missing_cell(spark):
    df = spark.createDataFrame([(x,) for x in [3.0, math.nan, 1.0, math.nan, 2.0, math.nan]], "x DOUBLE")
    r = TableProfile(df, bracket_rows=1).columns().first()
    assert (r["populated"], r["q1"], r["median"], r["q3"]) == (3, 1.0, 2.0, 3.0)


def test_constant_and_two_valued_columns(spark):
    df = spark.range(5000).selectExpr("7 a", "if(id < 1250, 1, 2) b", "if(id < 1251, 1, 2) c")
    rows = {r["position"]: (r["q1"], r["median"], r["q3"]) for r in TableProfile(df, bracket_rows=10, accuracy=50).order_stats().collect()}
    assert rows == {0: (7.0, 7.0, 7.0), 1: (2.0, 2.0, 2.0), 2: (1.0, 2.0, 2.0)}


def model_top(values, k=5):
    counts = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    return sorted(((v, n) for v, n in counts.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("hitters", [64, 3])
def test_top_values_of_every_shape(spark, hitters, monkeypatch):
    """Few values, heavy ones among many, all equal counts, and ties in long prefixes."""
    from quarry.operators import profile as module

    monkeypatch.setattr(module, "HITTERS", hitters)
    rnd = random.Random(hitters)
    long = "the same first letters of a long text "
    data = [(rnd.choice("abc"), rnd.choice(["x", "y", f"rare{i}"]), f"id{i:05d}", long + str(rnd.randint(0, 400)),
             "twice" + str(i // 2)) for i in range(2000)]
    df = spark.createDataFrame(data, "a STRING, b STRING, c STRING, d STRING, e STRING").repartition(6)
    p = TableProfile(df)
    got = {}
    for r in p.top_values().orderBy("position", "rank").collect():
        got.setdefault(r["position"], []).append((r["value"], r["k"]))
    assert got == {i: model_top([r[i] for r in data]) for i in range(5)}
    card = {r["position"]: (r["distinct_n"], r["top_k"]) for r in p.cardinality().collect()}
    assert card == {i: (len({r[i] for r in data}), model_top([r[i] for r in data])[0][1]) for i in range(5)}


def test_no_text_and_no_column_of_numbers_is_shuffled(spark):
    """Exchanges carry digests and bracketed numbers only; nothing else is written."""
    from tests.test_plans import plan  # noqa: PLC0415

    df = spark.range(100).selectExpr("id", "cast(id as string) || ' a text' t", "id * 1.5 x")
    p = TableProfile(df)
    rows = p._texts(p.text_positions).select("position", *_digest_columns())
    text = plan(rows.groupBy("position", "d1", "d2").count())
    assert "hashpartitioning(position" in text
    assert not any("value" in line for line in text.splitlines() if "Exchange" in line)
    assert set(p.digests.columns) == {"position", "d1", "d2", "k", "prefix"}


def _digest_columns():
    from quarry.operators.profile import _digest

    return _digest(F.col("value"))


def test_zero_rows_and_null_column(spark):
    z = TableProfile(spark.createDataFrame([], "c1 STRING, n DOUBLE"))
    kinds = {r["column_name"]: (r["kind"], r["rows"]) for r in z.columns().collect()}
    assert kinds == {"c1": ("empty", 0), "n": ("empty", 0)}
    ov = z.overview().collect()[0]
    assert ov["completeness"] is None and ov["quality"] == "no data"
    p = TableProfile(spark.createDataFrame([(1, None), (2, None)], "k INT, e DOUBLE"))
    kinds = {r["column_name"]: r["kind"] for r in p.columns().collect()}
    assert kinds == {"k": "numeric", "e": "empty"}


def test_column_names_with_spaces_and_dots(spark):
    from quarry import query

    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "a")], "`unit price` STRING, `seg.name` STRING")
    cols = {r["column_name"]: (r["kind"], r["median"]) for r in TableProfile(df).columns().collect()}
    assert cols == {"unit price": ("numeric", 2.0), "seg.name": ("text", None)}
    assert query.filter_rows(df, "price", "1", ">").count() == 2
    got = {r["group_key"]: r["value"] for r in query.group_by(df, "seg", "unit", "sum").collect()}
    assert got == {"a": 3.0, "b": 2.0}


def test_infinite_cells_compare_as_in_a_script(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("Infinity",)], "x STRING")
    r = TableProfile(df).columns().collect()[0]
    assert (r["skew"], r["variability"], r["distribution"]) == ("right", "low", "higher")


def test_names_that_differ_in_case_or_hold_quotes(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x")], "a STRING, b STRING, c STRING").toDF(
        "Name", "name", "q`t")
    p = TableProfile(df)
    assert [r["kind"] for r in p.columns().orderBy("position").collect()] == ["numeric", "text", "text"]
    assert p.duplicate_count().first()["duplicates"] == 0
    assert p.outlier_rows("Name").columns == df.columns
