"""Preparation operators that the report advises: duplicates, missing values,
scaling, encoding, splits, patterns, histograms and interactions.

Every operator takes a DataFrame and returns a DataFrame. Statistics of a
column are one row per column, found by an aggregate (or the profile's exact
order statistics) and used as literals; joins with value frequencies are left
to the optimizer, since their size grows with the data.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.cells import as_cell, as_number, is_numeric_type
from quarry.operators.profile import IQR_FENCE, TableProfile
from quarry.session import scratch_path

MISSING = "(missing)"
OTHER = "(other)"
ONE_HOT_LIMIT = 10   # fixed value: one-hot below this many categories
STRONG_CORRELATION = 0.9
ROWS_PER_RANGE = 1_000_000


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _field(df: DataFrame, name: str):
    return df.schema[name]


def _cell(df: DataFrame, name: str) -> Column:
    return as_cell(quoted(name), _field(df, name).dataType)


def _number(df: DataFrame, name: str) -> Column:
    return as_number(quoted(name), _field(df, name).dataType)


def _put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column replaced, in place."""
    return df.select(*[value.alias(c) if c == name else quoted(c) for c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Rows that differ in some cell, text compared trimmed."""
    return df.select(*[(_cell(df, c) if _field(df, c).dataType.simpleString() == "string"
                        else quoted(c)).alias(c) for c in df.columns]).distinct()


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    x = _number(df, column)
    return _put(df, column, F.coalesce(x, F.lit(df.agg(F.avg(x)).first()[0])))


def quartiles(df: DataFrame, column: str) -> dict:
    """Exact q1, median and q3 of one column, by the profile's rank pick."""
    one = df.select(_number(df, column).alias("x"))
    rows = TableProfile(one).order_stats().collect()
    return rows[0].asDict() if rows else {"q1": None, "median": None, "q3": None}


def impute_median(df: DataFrame, column: str) -> DataFrame:
    return _put(df, column, F.coalesce(_number(df, column), F.lit(quartiles(df, column)["median"])))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """``value, k`` of the cells that aren't blank."""
    return (df.select(_cell(df, column).alias("value")).where(F.col("value") != "")
            .groupBy("value").agg(F.count(F.lit(1)).alias("k")))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Blank cells become the most frequent value, ties the smallest."""
    top = frequencies(df, column).orderBy(F.desc("k"), "value").limit(1).collect()
    cell = _cell(df, column)
    return _put(df, column, F.when(cell == "", F.lit(top[0]["value"] if top else "")).otherwise(cell))


def missing_category(df: DataFrame, column: str) -> DataFrame:
    cell = _cell(df, column)
    return _put(df, column, F.when(cell == "", F.lit(MISSING)).otherwise(cell))


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population sd; 0 where the sd is 0."""
    stats = df.agg(*[f(_number(df, c)) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    for i, c in enumerate(columns):
        mean, sd = stats[2 * i], stats[2 * i + 1]
        x = _number(df, c)
        df = _put(df, c, (x - F.lit(mean)) / F.lit(sd) if sd else F.when(x.isNotNull(), F.lit(0.0)))
    return df


def robust_scale(df: DataFrame, column: str) -> DataFrame:
    """(x - median) / (q3 - q1); 0 where the quartiles are equal."""
    q, x = quartiles(df, column), _number(df, column)
    width = q["q3"] - q["q1"] if q["median"] is not None else 0
    return _put(df, column, (x - F.lit(q["median"])) / F.lit(width) if width
                else F.when(x.isNotNull(), F.lit(0.0)))


def winsorize(df: DataFrame, column: str) -> DataFrame:
    """Values beyond the interquartile fences move to the fence."""
    q, x = quartiles(df, column), _number(df, column)
    if q["median"] is None:
        return _put(df, column, x)
    reach = IQR_FENCE * (q["q3"] - q["q1"])
    return _put(df, column, F.when(x.isNotNull(), F.greatest(F.lit(q["q1"] - reach),
                                                             F.least(F.lit(q["q3"] + reach), x))))


def log_transform(df: DataFrame, column: str) -> DataFrame:
    """log(1 + x); null for negative values."""
    x = _number(df, column)
    return _put(df, column, F.when(x >= 0, F.log1p(x)))


def sqrt_transform(df: DataFrame, column: str) -> DataFrame:
    x = _number(df, column)
    return _put(df, column, F.when(x >= 0, F.sqrt(x)))


def categories(df: DataFrame, column: str) -> list[str]:
    """The values of a column with few of them, sorted (schema-bounded)."""
    rows = frequencies(df, column).select("value").orderBy("value").limit(ONE_HOT_LIMIT).collect()
    if len(rows) >= ONE_HOT_LIMIT:
        raise ValueError(f"{column} has {ONE_HOT_LIMIT} values or more")
    return [r["value"] for r in rows]


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column ``<column>_<value>`` for every value."""
    cell = _cell(df, column)
    return df.select("*", *[(cell == v).cast("int").alias(f"{column}_{v}") for v in categories(df, column)])


def interactions(df: DataFrame, category: str, number: str) -> DataFrame:
    """A column ``<value>_x_<number>`` for every value: the number where the
    row has the value, else 0."""
    cell, x = _cell(df, category), _number(df, number)
    return df.select("*", *[F.when(cell == v, x).otherwise(F.lit(0.0)).alias(f"{v}_x_{number}")
                            for v in categories(df, category)])


def _encoded(df: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """Join a value per category; the optimizer picks the join by size."""
    key = "__cell"
    return (df.withColumn(key, _cell(df, column))
            .join(values.select(F.col("value").alias(key), F.col("code").alias(name)), key, "left").drop(key))


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """``<column>_freq``: the value's share of the cells that aren't blank."""
    freq = frequencies(df, column)
    total = freq.agg(F.sum("k")).first()[0] or 1
    return _encoded(df, column, freq.withColumn("code", F.col("k") / F.lit(float(total))), f"{column}_freq")


def target_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    """``<column>_target``: the mean of the target over the value's rows."""
    means = (df.select(_cell(df, column).alias("value"), _number(df, target).alias("x"))
             .where(F.col("value") != "").groupBy("value").agg(F.avg("x").alias("code")))
    return _encoded(df, column, means, f"{column}_target")


def group_rare(df: DataFrame, column: str, share: float) -> DataFrame:
    """Values with less than ``share`` of the cells become one category."""
    freq = frequencies(df, column)
    total = freq.agg(F.sum("k")).first()[0] or 1
    rare = freq.where(F.col("k") < F.lit(share * total)).withColumn("code", F.lit(True))
    marked = _encoded(df, column, rare, "__rare")
    cell = _cell(df, column)
    return _put(marked, column, F.when(F.col("__rare"), F.lit(OTHER)).otherwise(cell)).drop("__rare")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``a, b, r, strong`` of every pair of numeric columns, from one aggregate."""
    names = columns or [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, strong boolean")
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                    F.corr(_number(df, a), _number(df, b)).alias("r")) for a, b in pairs])
                 .alias("pairs"))
    return one.select(F.inline("pairs")).withColumn("strong", F.coalesce(
        F.abs("r") > STRONG_CORRELATION, F.lit(False)))


def stratum_ranks(df: DataFrame, key: str, stratum: str) -> DataFrame:
    """``key, stratum, rank, size``: a fixed random order of each stratum by
    (md5(key), key). Rows are dealt by range, ranked inside their range, and
    lifted by the counts of the ranges before, so that a stratum with a third
    of all rows is many tasks."""
    spark = df.sparkSession
    rows = df.select(quoted(key).alias("key"), _cell(df, stratum).alias("stratum"),
                     F.md5(quoted(key).cast("string").cast("binary")).alias("order"))
    total = rows.count()
    path = scratch_path(spark, "strata")
    (rows.repartitionByRange(max(1, math.ceil(total / ROWS_PER_RANGE)), "stratum", "order", "key")
     .withColumn("range", F.spark_partition_id()).write.parquet(path))
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum")
    lifts = counts.select("stratum", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lift"),
                          F.sum("n").over(whole).alias("size"))
    inside = Window.partitionBy("stratum", "range").orderBy("order", "key")
    return (dealt.withColumn("place", F.row_number().over(inside)).join(lifts, ["stratum", "range"])
            .select("key", "stratum", (F.col("place") + F.col("lift")).cast("long").alias("rank"), "size"))


def split_stratified(df: DataFrame, key: str, stratum: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """``key, stratum, part``: train, valid or test, in the same shares in every stratum."""
    share = (F.col("rank") - 1) / F.col("size")
    part = F.when(share < train, "train").when(share < train + valid, "valid").otherwise("test")
    return stratum_ranks(df, key, stratum).select(F.col("key").alias(key), F.col("stratum").alias(stratum),
                                                  part.alias("part"))


def kfold(df: DataFrame, key: str, stratum: str, folds: int = 5) -> DataFrame:
    """``key, fold``: folds of equal share in every stratum."""
    return stratum_ranks(df, key, stratum).select(
        F.col("key").alias(key), ((F.col("rank") - 1) % folds).cast("int").alias("fold"))


def missing_patterns(df: DataFrame) -> DataFrame:
    """``pattern, rows``: which cells are blank together (1: blank), in column order."""
    flags = F.concat(*[F.when(_cell(df, c) == "", "1").otherwise("0") for c in df.columns])
    return df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """``bucket, rows, low, high`` of equal widths from the smallest to the largest
    finite value; the largest belongs to the last bucket. Infinite cells are rows of
    their own, bucket 0 below and ``buckets`` + 1 above."""
    x = _number(df, column)
    inf = F.lit(float("inf"))
    lo, hi = df.where(F.abs(x) < inf).agg(F.min(x), F.max(x)).first()
    low, width = (0.0, 0.0) if lo is None else (lo, (hi - lo) / buckets)
    inside = F.least(F.floor((x - F.lit(low)) / F.lit(width)) + 1, F.lit(buckets)) if width else F.lit(1)
    place = F.when(x == -inf, 0).when(x == inf, buckets + 1).otherwise(inside)
    at = F.col("bucket")
    edge = lambda i, outer: F.when((at == 0) | (at == buckets + 1), outer).otherwise(F.lit(low) + i * F.lit(width))
    outer = F.when(at == 0, -inf).otherwise(inf)
    return (df.where(x.isNotNull()).groupBy(place.cast("int").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("bucket", "rows", edge(at - 1, outer).alias("low"), edge(at, outer).alias("high")))
