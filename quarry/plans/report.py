"""Flags, rule tables and the text report built on a :class:`TableProfile`.

The rules run as Spark expressions over one row of facts aggregated from the
per-column profile (a frame with one row per column). Only the report's prose
is rendered on the driver, from that small profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numbers import locale, to_fixed

# --- fixed values: rule order and conditions of the reference's report ---------
# Each rule: (id, condition over the facts). Facts: rows, completeness,
# duplicates, n_numeric, n_categorical, n_skewed, n_outlier.
RULES = {
    "preprocessing": [
        ("impute_missing", "completeness < 95"),
        ("remove_duplicates", "duplicates > 0"),
        ("transform_skewed", "n_skewed > 0"),
        ("treat_outliers", "n_outlier > 0"),
        ("scale_numeric", "n_numeric > 0"),
        ("encode_categorical", "n_categorical > 0"),
    ],
    "algorithm": [
        ("deep_learning", "rows >= 10000 AND n_numeric > 5"),
        ("gradient_boosting", "n_numeric > 0 AND n_categorical > 0"),
        ("random_forest", "rows >= 1000"),
        ("linear_models", "completeness >= 95 AND n_numeric > 2"),
        ("support_vector_machines", "n_numeric > 0"),
        ("decision_trees", "n_categorical > n_numeric"),
    ],
    "advice": [
        ("correlation_analysis", "n_numeric > 2"),
        ("cross_validation", "rows >= 5000"),
        ("interaction_features", "n_categorical > 0 AND n_numeric > 0"),
        ("exploratory_plots", "n_skewed > 0 OR n_outlier > 0"),
        ("stratified_split", "TRUE"),
        ("missing_patterns", "completeness < 90"),
        ("feature_selection", "n_numeric > 5"),
        ("hyperparameter_tuning", "TRUE"),
        ("baseline_models", "TRUE"),
    ],
}
# -------------------------------------------------------------------------------


def _names(cond, label=None):
    item = F.col("column_name") if label is None else label
    arr = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("position"), item.alias("n")))))
    return F.concat_ws(", ", F.transform(arr, lambda x: x["n"]))


def flags(p) -> DataFrame:
    """Numeric, categorical, skewed (with side) and outlier column lists in
    column order, and their counts."""
    c = F.col
    skewed = c("skew").isin("right", "left")
    side = F.concat(c("column_name"), F.lit(" ("), c("skew"), F.lit("-skewed)"))
    return p.columns().agg(
        _names(c("kind") == "numeric").alias("numeric_columns"),
        _names(c("kind") == "categorical").alias("categorical_columns"),
        _names(skewed, side).alias("skewed_columns"),
        _names(c("outliers") > 0).alias("outlier_columns"),
        F.count(F.when(c("kind") == "numeric", 1)).alias("n_numeric"),
        F.count(F.when(c("kind") == "categorical", 1)).alias("n_categorical"),
        F.count(F.when(skewed, 1)).alias("n_skewed"),
        F.count(F.when(c("outliers") > 0, 1)).alias("n_outlier"))


def facts(p) -> DataFrame:
    """One row: rows, completeness, duplicates and the flag counts."""
    dup = p.duplicate_count().collect()[0]["duplicates"]
    ncols = len(p.specs)
    c = F.col
    return p.columns().agg(
        F.max("rows").alias("rows"),
        F.try_divide((F.max("rows") * ncols - F.sum(c("rows") - c("populated"))) * F.lit(100.0),
                     F.max("rows") * ncols).alias("completeness"),
        F.lit(dup).cast("long").alias("duplicates"),
        F.count(F.when(c("kind") == "numeric", 1)).alias("n_numeric"),
        F.count(F.when(c("kind") == "categorical", 1)).alias("n_categorical"),
        F.count(F.when(c("skew").isin("right", "left"), 1)).alias("n_skewed"),
        F.count(F.when(c("outliers") > 0, 1)).alias("n_outlier"))


def fired_rules(p, group: str, fact_row: DataFrame | None = None) -> DataFrame:
    """``(rule_no, rule_id)`` of the rules of ``group`` that fire, numbered
    in the report's order."""
    f = fact_row if fact_row is not None else facts(p)
    cands = F.array(*[F.struct(F.lit(rid).alias("rule_id"),
                               F.coalesce(F.expr(cond), F.lit(False)).alias("fires"))
                      for rid, cond in RULES[group]])
    fired = F.filter(cands, lambda x: x["fires"])
    return f.select(F.posexplode(fired).alias("i", "r")).select(
        (F.col("i") + 1).cast("int").alias("rule_no"), F.col("r.rule_id").alias("rule_id"))


# --- the text report --------------------------------------------------------------
def report_frame(p) -> DataFrame:
    """The report as ``(line_no, section, text)`` rows."""
    lines = render(p)
    return p.spark.createDataFrame(
        [(i + 1, s, t) for i, (s, t) in enumerate(lines)],
        "line_no INT, section STRING, text STRING")


def write_report(p, path: str) -> None:
    """Sink: the report as a text file (one line per row, in order)."""
    report_frame(p).orderBy("line_no").select("text").coalesce(1).write.mode(
        "errorifexists").text(path)


def render(p) -> list[tuple[str, str]]:
    """Render the report on the driver from the collected profile (one row
    per column plus the top values of the text columns)."""
    from quarry.plans import report_text

    cols = [r.asDict() for r in p.columns().orderBy("position").collect()]
    tops = {}
    for r in p.top_values_named().orderBy("position", "rank").collect():
        tops.setdefault(r["position"], []).append((r["value"], r["k"]))
    fact_df = facts(p)
    fact = fact_df.collect()[0].asDict()
    fired = {g: [r["rule_id"] for r in fired_rules(p, g, fact_df).orderBy("rule_no").collect()]
             for g in RULES}
    return report_text.render_lines(p.row_count, [s.name for s in p.specs], cols, tops, fact, fired,
                                    locale=locale, to_fixed=to_fixed)
