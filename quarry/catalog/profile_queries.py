"""Registered profile queries (flagship) and their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalog import report_sql
from quarry.catalog.inputs import PROFILED, sql_cell, sql_lit, sql_num
from quarry.operators.profile import TableProfile
from quarry.plans import report

R = 4  # decimals compared with the oracle


def _r(c):
    return F.round(F.col(c), R).alias(c)


def _profiles(spark: SparkSession, sf_dir: str, names: list[str], compute) -> list[tuple[str, TableProfile]]:
    """Profiles of several tables, computed concurrently: their jobs are
    independent, so submitting them from threads lets them share the
    cluster instead of queueing one table after another."""
    from concurrent.futures import ThreadPoolExecutor

    profs = [(n, TableProfile(PROFILED[n][0](spark, sf_dir))) for n in names]
    with ThreadPoolExecutor(max_workers=min(4, len(profs))) as pool:
        list(pool.map(lambda np: compute(np[1]), profs))
    return profs


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _per_table(spark, sf_dir, names, fn, compute=lambda p: p.columns()) -> DataFrame:
    return _union([fn(p).select(F.lit(n).alias("table_name"), "*")
                   for n, p in _profiles(spark, sf_dir, names, compute)])


# --- Spark side -----------------------------------------------------------------
def profile_overview(spark, sf_dir):
    return _per_table(spark, sf_dir, ["customer_nulled", "lineitem_skewed"],
                      lambda p: p.overview().select(
                          "rows", "columns", "empty_cells", "total_cells", "populated_cells",
                          _r("completeness"), "quality", "dimensionality"), compute=lambda p: p.stats_rows)


KIND_TABLES = ["customer_nulled", "part_text", "orders", "documents", "lineitem_skewed"]


def column_kinds(spark, sf_dir):
    return _per_table(spark, sf_dir, KIND_TABLES, lambda p: p.columns(False).select(
        "position", "column_name", "populated", "numeric_n", "distinct_n", "kind"), compute=lambda p: p.columns(False))


def column_missing(spark, sf_dir):
    return _per_table(spark, sf_dir, ["customer_nulled"], lambda p: p.columns(False, False).select(
        "position", "column_name", "missing", _r("missing_pct"), "missing_pct_1dp",
        (F.col("missing_pct_1dp") > 5).alias("missing_over_5")), compute=lambda p: p.columns(False, False))


NUM_TABLES = ["lineitem_skewed", "part_text", "customer_nulled"]


def _numeric(spark, sf_dir, *cols, order_stats: bool = True) -> DataFrame:
    return _per_table(spark, sf_dir, NUM_TABLES, lambda p: p.columns(order_stats, False).where(
        F.col("kind") == "numeric").select("position", "column_name", *cols), compute=lambda p: p.columns(order_stats, False))


def numeric_moments(spark, sf_dir):
    return _numeric(spark, sf_dir, "numeric_n", _r("sum"), _r("mean"), _r("min"), _r("max"), _r("range"), _r("sd"),
                    order_stats=False)


def numeric_median(spark, sf_dir):
    return _numeric(spark, sf_dir, _r("median"))


def numeric_quartiles(spark, sf_dir):
    return _numeric(spark, sf_dir, _r("q1"), _r("q3"), _r("iqr"))


def iqr_outliers(spark, sf_dir):
    return _numeric(spark, sf_dir, "outliers", _r("outlier_pct"), _r("lower_fence"), _r("upper_fence"))


def outlier_rows(spark, sf_dir):
    """Rows of lineitem whose l_qty_pow4 lies outside the IQR fences."""
    p = TableProfile(PROFILED["lineitem_skewed"][0](spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_qty_pow4"))
    return p.outlier_rows("l_qty_pow4").select("l_orderkey", "l_linenumber", "l_qty_pow4")


def skew_labels(spark, sf_dir):
    return _numeric(spark, sf_dir, _r("skew_score"), "skew", "variability", "distribution")


CARD_TABLES = ["customer_nulled", "part_text", "documents", "orders", "lineitem_skewed"]


def column_cardinality(spark, sf_dir):
    return _per_table(spark, sf_dir, CARD_TABLES, lambda p: p.columns(False).where(
        F.col("kind").isin("categorical", "text")).select(
        "position", "column_name", "populated", "distinct_n", _r("cardinality_ratio"),
        "cardinality", _r("top_share"), "concentration"), compute=lambda p: p.columns(False))


def top_values(spark, sf_dir):
    return _per_table(spark, sf_dir, CARD_TABLES, lambda p: p.top_values_named().select(
        "position", "column_name", "rank", "value", "k", _r("share")), compute=lambda p: p.text_positions)


def duplicate_rows(spark, sf_dir):
    """Duplicates among some columns, where there are many, and among whole rows."""
    docs = PROFILED["documents"][0](spark, sf_dir).select("text", "lang")
    flags = PROFILED["lineitem_skewed"][0](spark, sf_dir).select("l_returnflag", "l_linestatus")
    cust = PROFILED["customer_nulled"][0](spark, sf_dir).select("c_nationkey", "c_mktsegment")
    frames = []
    whole = [(n, PROFILED[n][0](spark, sf_dir)) for n in ("customer_blank", "lineitem_skewed", "part_text")]
    for name, df in (("documents", docs), ("lineitem_flags", flags), ("customer_nulled", cust), *whole):
        d = TableProfile(df).duplicate_count()
        frames.append(d.select(F.lit(name).alias("table_name"), "rows", "distinct_rows",
                               "duplicates",
                               F.round(F.try_divide(F.col("duplicates") * 100.0, F.col("rows")), R)
                               .alias("duplicate_pct")))
    return _union(frames)


FLAG_TABLES = ["lineitem_skewed", "customer_nulled", "part_text"]


def column_flags(spark, sf_dir):
    return _per_table(spark, sf_dir, FLAG_TABLES, lambda p: report.flags(p))


def preprocessing_steps(spark, sf_dir):
    return _per_table(spark, sf_dir, FLAG_TABLES, lambda p: report.fired_rules(p, "preprocessing"))


def algorithm_rules(spark, sf_dir):
    return _per_table(spark, sf_dir, FLAG_TABLES, lambda p: report.fired_rules(p, "algorithm"))


def advice_rules(spark, sf_dir):
    return _per_table(spark, sf_dir, FLAG_TABLES, lambda p: report.fired_rules(p, "advice"))


REPORT_TABLES = ["customer_nulled", "lineitem_skewed", "customer_blank", "part_text"]


def report_lines(spark, sf_dir):
    """The whole printed report of four tables; one has a column without values, a
    constant one and repeated rows."""
    return _per_table(spark, sf_dir, REPORT_TABLES, lambda p: report.report_frame(p))


def report_sink(spark, sf_dir):
    """The customer report written as a text file in the shared folder and
    read back (one row per line)."""
    from quarry.session import scratch_path

    path = scratch_path(spark, "report")
    report.write_report(TableProfile(PROFILED["customer_nulled"][0](spark, sf_dir)), path)
    return spark.read.text(path).withColumnRenamed("value", "text")


# --- DuckDB oracle ----------------------------------------------------------------
def _sql_unpivot(tbl: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (name, kind) in enumerate(cols):
        if kind == "str":
            cell, num, pop = sql_cell(name), sql_num(name), f"{sql_cell(name)} <> ''"
        elif kind == "dbl":
            num = f"CASE WHEN isnan({name}) THEN NULL ELSE CAST({name} AS DOUBLE) END"
            cell, pop = "''", f"({num}) IS NOT NULL"
        elif kind == "num":
            cell, num, pop = "''", f"CAST({name} AS DOUBLE)", f"{name} IS NOT NULL"
        else:  # typed dates and times: text, never numeric
            cell = f"coalesce(CAST({name} AS VARCHAR), '')"
            num, pop = "CAST(NULL AS DOUBLE)", f"{name} IS NOT NULL"
        parts.append(f"SELECT {i} AS position, {sql_lit(name)} AS column_name, {cell} AS cell, "
                     f"{num} AS num, ({pop}) AS pop FROM {tbl} t")
    return "\nUNION ALL ".join(parts)


def sql_columns(name: str) -> str:
    """SELECT producing one row per column with every measure, for one table."""
    _, tbl, cols = PROFILED[name]
    return f"""(WITH u AS ({_sql_unpivot(tbl, cols)}),
st AS (SELECT position, any_value(column_name) AS column_name, count(*) AS rows,
         count(*) FILTER (WHERE pop) AS populated, count(num) AS numeric_n,
         sum(num) AS sum, min(num) AS min, max(num) AS max, var_pop(num) AS var_pop,
         percentile_disc(0.75) WITHIN GROUP (ORDER BY num DESC) AS q1s,
         percentile_disc(0.25) WITHIN GROUP (ORDER BY num DESC) AS q3s,
         median(num) AS median_s
       FROM u GROUP BY position),
fr AS (SELECT position, cell AS value, count(*) AS k FROM u WHERE cell <> '' GROUP BY 1, 2),
card AS (SELECT position, count(*) AS card_n, max(k) AS top_k FROM fr GROUP BY 1),
kd AS (SELECT st.*, card.card_n, card.top_k,
         CASE WHEN populated = 0 THEN 'empty' WHEN numeric_n > 0.5 * populated THEN 'numeric'
              WHEN card_n < 0.5 * populated AND card_n > 1 THEN 'categorical'
              ELSE 'text' END AS kind
       FROM st LEFT JOIN card USING (position)),
nm AS (SELECT kd.*,
         CASE WHEN kind = 'numeric' THEN sum / numeric_n END AS mean,
         CASE WHEN kind = 'numeric' THEN sqrt(var_pop) END AS sd,
         CASE WHEN kind = 'numeric' THEN q1s END AS q1,
         CASE WHEN kind = 'numeric' THEN q3s END AS q3,
         CASE WHEN kind = 'numeric' THEN median_s END AS median,
         CASE WHEN kind IN ('categorical', 'text') THEN card_n END AS distinct_n
       FROM kd),
fe AS (SELECT nm.*, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
         q3 + 1.5 * (q3 - q1) AS upper_fence FROM nm),
ol AS (SELECT fe.position, count(u.num) AS outliers FROM fe JOIN u ON u.position = fe.position
         AND (u.num < fe.lower_fence OR u.num > fe.upper_fence) GROUP BY fe.position)
SELECT fe.*, CASE WHEN kind = 'numeric' THEN coalesce(ol.outliers, 0) END AS outliers
FROM fe LEFT JOIN ol USING (position))"""


def _sql_per_table(names: list[str], select: str, where: str = "TRUE") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {sql_lit(n)} AS table_name, {select} FROM {sql_columns(n)} c WHERE {where}"
        for n in names)


def _rs(expr: str, alias: str) -> str:
    return f"round({expr}, {R}) AS {alias}"


NUMERIC_WHERE = "kind = 'numeric'"


def sql() -> dict[str, str]:
    q = {}
    q["profile_overview"] = "\nUNION ALL\n".join(f"""SELECT {sql_lit(n)} AS table_name,
  max(rows) AS rows, CAST(count(*) AS BIGINT) AS columns,
  CAST(sum(rows - populated) AS BIGINT) AS empty_cells,
  max(rows) * count(*) AS total_cells, max(rows) * count(*) - sum(rows - populated) AS populated_cells,
  round((max(rows) * count(*) - sum(rows - populated)) * 100.0 / (max(rows) * count(*)), {R}) AS completeness,
  CASE WHEN (max(rows) * count(*) - sum(rows - populated)) * 100.0 / (max(rows) * count(*)) >= 95 THEN 'excellent'
       WHEN (max(rows) * count(*) - sum(rows - populated)) * 100.0 / (max(rows) * count(*)) >= 80 THEN 'good'
       WHEN (max(rows) * count(*) - sum(rows - populated)) * 100.0 / (max(rows) * count(*)) >= 60 THEN 'moderate'
       ELSE 'limited' END AS quality,
  CASE WHEN count(*) * 1.0 / max(rows) < 0.01 THEN 'low'
       WHEN count(*) * 1.0 / max(rows) < 0.1 THEN 'moderate' ELSE 'high' END AS dimensionality
FROM {sql_columns(n)} c""" for n in ["customer_nulled", "lineitem_skewed"])
    q["column_kinds"] = _sql_per_table(
        KIND_TABLES, "position, column_name, populated, numeric_n, distinct_n, kind")
    q["column_missing"] = _sql_per_table(
        ["customer_nulled"],
        f"position, column_name, rows - populated AS missing, "
        f"{_rs('(rows - populated) * 100.0 / rows', 'missing_pct')}, "
        f"round((rows - populated) * 100.0 / rows, 1) AS missing_pct_1dp, "
        f"round((rows - populated) * 100.0 / rows, 1) > 5 AS missing_over_5")
    q["numeric_moments"] = _sql_per_table(
        NUM_TABLES, "position, column_name, numeric_n, " + ", ".join(
            _rs(e, a) for e, a in [("sum", "sum"), ("mean", "mean"), ("min", "min"), ("max", "max"),
                                   ("max - min", "range"), ("sd", "sd")]),
        NUMERIC_WHERE)
    q["numeric_median"] = _sql_per_table(
        NUM_TABLES, f"position, column_name, {_rs('median', 'median')}", NUMERIC_WHERE)
    q["numeric_quartiles"] = _sql_per_table(
        NUM_TABLES, f"position, column_name, {_rs('q1', 'q1')}, {_rs('q3', 'q3')}, "
                    f"{_rs('iqr', 'iqr')}", NUMERIC_WHERE)
    q["iqr_outliers"] = _sql_per_table(
        NUM_TABLES, f"position, column_name, outliers, {_rs('outliers * 100.0 / numeric_n', 'outlier_pct')}, "
                    f"{_rs('lower_fence', 'lower_fence')}, {_rs('upper_fence', 'upper_fence')}",
        NUMERIC_WHERE)
    q["outlier_rows"] = """WITH f AS (
  SELECT percentile_disc(0.75) WITHIN GROUP (ORDER BY l_quantity * l_quantity * l_quantity * l_quantity DESC) AS q1,
         percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity * l_quantity * l_quantity * l_quantity DESC) AS q3
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity * l_quantity * l_quantity * l_quantity AS l_qty_pow4
FROM lineitem, f
WHERE l_quantity * l_quantity * l_quantity * l_quantity < q1 - 1.5 * (q3 - q1)
   OR l_quantity * l_quantity * l_quantity * l_quantity > q3 + 1.5 * (q3 - q1)"""
    q["skew_labels"] = _sql_per_table(
        NUM_TABLES, f"""position, column_name, {_rs('(mean - median) / (sd + 0.0001)', 'skew_score')},
  CASE WHEN abs(mean - median) < sd * 0.1 THEN 'symmetric' WHEN mean > median THEN 'right' ELSE 'left' END AS skew,
  CASE WHEN mean = 0 THEN CASE WHEN sd > 0 THEN 'high' ELSE 'low' END
       WHEN sd / mean > 0.5 THEN 'high' WHEN sd / mean > 0.2 THEN 'moderate' ELSE 'low' END AS variability,
  CASE WHEN mean > median THEN 'higher' WHEN mean < median THEN 'lower' ELSE 'similar' END AS distribution""",
        NUMERIC_WHERE)
    q["column_cardinality"] = _sql_per_table(
        CARD_TABLES, f"""position, column_name, populated, distinct_n,
  {_rs('distinct_n * 1.0 / populated', 'cardinality_ratio')},
  CASE WHEN distinct_n = populated THEN 'identifier' WHEN distinct_n > 0.8 * populated THEN 'high'
       WHEN distinct_n < 10 THEN 'low' ELSE 'moderate' END AS cardinality,
  {_rs('top_k * 1.0 / populated', 'top_share')},
  CASE WHEN top_k * 1.0 / populated > 0.9 THEN 'severe' WHEN top_k * 1.0 / populated > 0.5 THEN 'moderate'
       ELSE 'balanced' END AS concentration""", "kind IN ('categorical', 'text')")
    q["top_values"] = "\nUNION ALL\n".join(_sql_top_values(n) for n in CARD_TABLES)
    q["duplicate_rows"] = "\nUNION ALL\n".join(
        f"""SELECT {sql_lit(n)} AS table_name, CAST(sum(k) AS BIGINT) AS rows, count(*) AS distinct_rows,
  CAST(sum(k) - count(*) AS BIGINT) AS duplicates, round((sum(k) - count(*)) * 100.0 / sum(k), {R}) AS duplicate_pct
FROM (SELECT count(*) AS k FROM {tbl} t GROUP BY ALL_COLS) g""".replace("ALL_COLS", cols)
        for n, tbl, cols in [
            ("documents", "documents", "text, lang"),
            ("lineitem_flags", "lineitem", "l_returnflag, l_linestatus"),
            ("customer_nulled", f"(SELECT c_nationkey, {sql_cell('c_mktsegment')} AS seg FROM "
                                f"{PROFILED['customer_nulled'][1]})", "c_nationkey, seg"),
            *[(n, f"(SELECT {', '.join(sql_cell(c) + ' AS ' + c if k == 'str' else c for c, k in PROFILED[n][2])} FROM {PROFILED[n][1]} s)",
               ", ".join(c for c, _ in PROFILED[n][2])) for n in ("customer_blank", "lineitem_skewed", "part_text")]])
    q.update(report_sql.rules(FLAG_TABLES, sql_columns))
    printed = lambda n: report_sql.report(n, sql_columns, _sql_unpivot(*PROFILED[n][1:]))
    q["report_lines"] = "\nUNION ALL\n".join(f"SELECT {sql_lit(n)} AS table_name, * FROM {printed(n)} r" for n in REPORT_TABLES)
    q["report_sink"] = f"SELECT text FROM {printed('customer_nulled')} r"
    return q


def _sql_top_values(n: str) -> str:
    _, tbl, cols = PROFILED[n]
    return f"""SELECT {sql_lit(n)} AS table_name, position, column_name, rank, value, k, {_rs('k * 1.0 / populated', 'share')}
FROM (SELECT c.position, c.column_name, c.populated, f.value, f.k,
        CAST(row_number() OVER (PARTITION BY f.position ORDER BY f.k DESC, f.value) AS INTEGER) AS rank
      FROM (SELECT position, cell AS value, count(*) AS k FROM ({_sql_unpivot(tbl, cols)}) u
            WHERE cell <> '' GROUP BY 1, 2) f
      JOIN {sql_columns(n)} c ON c.position = f.position AND c.kind IN ('categorical', 'text')) x
WHERE rank <= 5"""


QUERIES = {
    "profile_overview": profile_overview,
    "column_kinds": column_kinds,
    "column_missing": column_missing,
    "numeric_moments": numeric_moments,
    "numeric_median": numeric_median,
    "numeric_quartiles": numeric_quartiles,
    "iqr_outliers": iqr_outliers,
    "outlier_rows": outlier_rows,
    "skew_labels": skew_labels,
    "column_cardinality": column_cardinality,
    "top_values": top_values,
    "duplicate_rows": duplicate_rows,
    "column_flags": column_flags,
    "preprocessing_steps": preprocessing_steps,
    "algorithm_rules": algorithm_rules,
    "advice_rules": advice_rules,
    "report_lines": report_lines,
    "report_sink": report_sink,
}
