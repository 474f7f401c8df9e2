"""Preparation operators on small tables, missing and constant columns."""

import pytest

from quarry.operators import prep


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "4", " a "), (2, None, "b"), (3, "6", "a"), (4, " ", None), (5, "8x", "c")],
                                 "id INT, n STRING, c STRING")


def values(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_imputing(df):
    assert values(prep.impute_mean(df, "n"), "n") == [4, 6, 6, 6, 8]
    assert values(prep.impute_median(df, "n"), "n") == [4, 6, 6, 6, 8]
    assert values(prep.impute_mode(df, "c"), "c") == ["a", "b", "a", "a", "c"]
    assert values(prep.missing_category(df, "c"), "c")[3] == prep.MISSING


def test_scaling_of_a_constant_column(spark):
    one = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id INT, x DOUBLE")
    assert values(prep.standard_scale(one, ["x"]), "x") == [0, 0, None]
    assert values(prep.robust_scale(one, "x"), "x") == [0, 0, None]
    assert values(prep.winsorize(one, "x"), "x") == [5, 5, None]
    assert prep.histogram(one, "x").collect()[0]["rows"] == 2
    empty = one.limit(0)
    assert prep.histogram(empty, "x").count() == 0 and prep.winsorize(empty, "x").count() == 0


def test_encodings(df, spark):
    hot = prep.one_hot(df, "c").orderBy("id").collect()
    assert [r["c_a"] for r in hot] == [1, 0, 1, 0, 0]
    assert values(prep.frequency_encode(df, "c"), "c_freq") == [.5, .25, .5, None, .25]
    assert values(prep.target_encode(df, "c", "n"), "c_target") == [5, None, 5, None, 8]
    assert values(prep.group_rare(df, "c", 0.3), "c") == ["a", prep.OTHER, "a", "", prep.OTHER]
    assert values(prep.interactions(df, "c", "n"), "a_x_n") == [4, 0, 6, 0, 0]
    with pytest.raises(ValueError):
        prep.one_hot(spark.range(20).selectExpr("id", "cast(id as string) c"), "c")


def test_transforms(spark):
    x = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 4.0)], "id INT, x DOUBLE")
    assert values(prep.log_transform(x, "x"), "x")[:2] == [None, 0.0]
    assert values(prep.sqrt_transform(x, "x"), "x") == [None, 0.0, 2.0]


def test_splits_are_stratified_and_independent_of_the_ranges(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id key", "if(id % 3 = 0, 'x', 'y') s")
    whole = {r["key"]: r["part"] for r in prep.split_stratified(df, "key", "s").collect()}
    monkeypatch.setattr(prep, "ROWS_PER_RANGE", 100)
    assert whole == {r["key"]: r["part"] for r in prep.split_stratified(df, "key", "s").collect()}
    for s in (0, 1):
        part = [v for k, v in whole.items() if (k % 3 == 0) == bool(s)]
        assert abs(part.count("train") / len(part) - .7) < .01 and abs(part.count("valid") / len(part) - .15) < .01
    folds = prep.kfold(df, "key", "s", 4).groupBy("fold").count().collect()
    assert len(folds) == 4 and all(abs(r["count"] - 500) <= 2 for r in folds)


def test_patterns_and_correlations(df, spark):
    assert {r["pattern"]: r["rows"] for r in prep.missing_patterns(df).collect()} == {"000": 3, "010": 1, "011": 1}
    x = spark.range(50).selectExpr("id a", "id * 2 b", "id % 7 c")
    strong = {(r["a"], r["b"]) for r in prep.correlations(x).where("strong").collect()}
    assert strong == {("a", "b")}
    assert prep.correlations(x.select("a")).count() == 0


def test_duplicates(spark):
    d = spark.createDataFrame([("a ", 1), ("a", 1), ("b", 1)], "t STRING, n INT")
    assert prep.drop_duplicates(d).count() == 2


def test_histogram_of_infinite_cells(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "2", "5", "Infinity", "-Infinity", "Infinity", "x")], "x STRING")
    got = {r["bucket"]: (r["rows"], r["low"], r["high"]) for r in prep.histogram(df, "x", 4).collect()}
    inf = float("inf")
    assert got == {0: (1, -inf, -inf), 1: (1, 1.0, 2.0), 2: (1, 2.0, 3.0), 4: (1, 4.0, 5.0), 5: (2, inf, inf)}
    only = prep.histogram(df.where("x = 'Infinity'"), "x", 4).collect()
    assert [(r["bucket"], r["rows"]) for r in only] == [(5, 2)]
