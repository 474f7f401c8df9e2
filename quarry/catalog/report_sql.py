"""DuckDB oracles of the flag lists, the rules and the whole printed report.

The conditions are written out here, apart from the code that they check. Only
the sentences, which are fixed values, are taken from ``report_text``.
"""

from __future__ import annotations

import re

from quarry.catalog.inputs import PROFILED, SQL_WS, sql_lit
from quarry.plans import report_text as T

SKEWED = "kind = 'numeric' AND NOT abs(mean - median) < sd * 0.1"
SIDE = "CASE WHEN mean > median THEN 'right' ELSE 'left' END"

PREPROCESSING = (
    "SELECT 1, 'impute_missing' WHERE completeness < 95", "SELECT 2, 'remove_duplicates' WHERE duplicates > 0",
    "SELECT 3, 'transform_skewed' WHERE n_skewed > 0", "SELECT 4, 'treat_outliers' WHERE n_outlier > 0",
    "SELECT 5, 'scale_numeric' WHERE n_numeric > 0", "SELECT 6, 'encode_categorical' WHERE n_categorical > 0")
ALGORITHM = (
    "SELECT 1, 'deep_learning' WHERE rows >= 10000 AND n_numeric > 5",
    "SELECT 2, 'gradient_boosting' WHERE n_numeric > 0 AND n_categorical > 0", "SELECT 3, 'random_forest' WHERE rows >= 1000",
    "SELECT 4, 'linear_models' WHERE completeness >= 95 AND n_numeric > 2",
    "SELECT 5, 'support_vector_machines' WHERE n_numeric > 0", "SELECT 6, 'decision_trees' WHERE n_categorical > n_numeric")
ADVICE = (
    "SELECT 1, 'correlation_analysis' WHERE n_numeric > 2", "SELECT 2, 'cross_validation' WHERE rows >= 5000",
    "SELECT 3, 'interaction_features' WHERE n_categorical > 0 AND n_numeric > 0",
    "SELECT 4, 'exploratory_plots' WHERE n_skewed > 0 OR n_outlier > 0", "SELECT 5, 'stratified_split'",
    "SELECT 6, 'missing_patterns' WHERE completeness < 90", "SELECT 7, 'feature_selection' WHERE n_numeric > 5",
    "SELECT 8, 'hyperparameter_tuning'", "SELECT 9, 'baseline_models'")


def facts(name: str, columns: str) -> str:
    """One row: the facts that the rules read, from the rows of ``columns``."""
    _, tbl, cols = PROFILED[name]
    norm = ", ".join(f"coalesce(trim({c}, {SQL_WS}), '')" if k == "str" else c for c, k in cols)
    names = lambda cond, what="column_name": f"coalesce(string_agg({what}, ', ' ORDER BY position) FILTER (WHERE {cond}), '')"
    side = f"column_name || ' (' || {SIDE} || '-skewed)'"
    return f"""SELECT max(rows) AS rows, count(*) AS cols, CAST(max(rows) * count(*) AS BIGINT) AS total,
  CAST(sum(populated) AS BIGINT) AS populated, CAST(sum(populated) AS DOUBLE) / (max(rows) * count(*)) * 100 AS completeness,
  (SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {norm} FROM {tbl} t) d) AS BIGINT) FROM {tbl} t2) AS duplicates,
  count(*) FILTER (WHERE kind = 'numeric') AS n_numeric, count(*) FILTER (WHERE kind = 'categorical') AS n_categorical,
  count(*) FILTER (WHERE {SKEWED}) AS n_skewed, count(*) FILTER (WHERE outliers > 0) AS n_outlier,
  {names('TRUE')} AS names, {names("kind = 'numeric'")} AS numeric_columns, {names("kind = 'categorical'")} AS categorical_columns,
  {names(SKEWED, side)} AS skewed_columns, {names('outliers > 0')} AS outlier_columns
FROM {columns} c"""


def rules(tables: list[str], sql_columns) -> dict[str, str]:
    out = {}
    for key, arms in (("preprocessing_steps", PREPROCESSING), ("algorithm_rules", ALGORITHM), ("advice_rules", ADVICE)):
        out[key] = "\nUNION ALL\n".join(
            f"""SELECT {sql_lit(n)} AS table_name, CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS rule_no, rule_id
FROM ({facts(n, sql_columns(n))}) f, LATERAL ({' UNION ALL '.join(arms)}) r(ord, rule_id)""" for n in tables)
    out["column_flags"] = "\nUNION ALL\n".join(
        f"""SELECT {sql_lit(n)} AS table_name, numeric_columns, categorical_columns, skewed_columns, outlier_columns,
  n_numeric, n_categorical, n_skewed, n_outlier FROM ({facts(n, sql_columns(n))}) f""" for n in tables)
    return out


# -- the printed report -----------------------------------------------------------------

def _fill(template: str, **parts: str) -> str:
    """The sentence as a SQL expression, with expressions in its places."""
    pieces = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(f"CAST({parts[p]} AS VARCHAR)" if i % 2 else sql_lit(p) for i, p in enumerate(pieces) if p) + ")"


def _choice(value: str, words: dict) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {sql_lit(k)} THEN {sql_lit(v)}" for k, v in words.items()) + " END"


def _banded(value: str, bands: list) -> str:
    arms = " ".join(f"WHEN {value} >= {b} THEN {sql_lit(w)}" for b, w in bands if b is not None)
    return f"CASE {arms} ELSE {sql_lit(bands[-1][1])} END"


def _fixed1(x: str) -> str:
    """One decimal, exact ties (fractions of a quarter) away from zero."""
    x = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN abs({x} * 4) % 2 = 1 THEN printf('%.1f', {x} + sign({x}) * 0.01) ELSE printf('%.1f', {x}) END"


def _whole(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _two(x: str) -> str:
    """At most two decimals with grouped thousands, exact ties away from zero."""
    x = f"CAST({x} AS DOUBLE)"
    text = f"CASE WHEN abs({x} * 8) % 2 = 1 THEN printf('%.2f', {x} + sign({x}) * 0.001) ELSE printf('%.2f', {x}) END"
    digits = f"regexp_replace({text}, '\\.?0+$', '')"
    whole, rest = f"regexp_extract({digits}, '^-?([0-9]+)', 1)", f"regexp_extract({digits}, '(\\.[0-9]+)$', 1)"
    signed = f"CASE WHEN starts_with({digits}, '-') AND {digits} <> '-0' THEN '-' ELSE '' END"
    return f"({signed} || format('{{:,}}', CAST({whole} AS BIGINT)) || {rest})"


def _plural(n: str) -> str:
    return f"CASE WHEN {n} > 1 THEN 's' ELSE '' END"


def _lines(order: int, section: str, texts: list[str]) -> str:
    items = ", ".join(texts)
    return f"SELECT {order} AS a, 0 AS b, unnest(range({len(texts)})) AS k, {sql_lit(section)} AS section, unnest([{items}]) AS text FROM f"


def report(name: str, sql_columns, unpivot: str) -> str:
    """``line_no, section, text`` of one table's report."""
    lit = lambda lines: [sql_lit(x) for x in lines]
    comp, missing = "completeness", "(rows - populated)"
    pct = _fixed1(comp)
    dim = _choice("CASE WHEN cols * 1.0 / rows < 0.01 THEN 'low' WHEN cols * 1.0 / rows < 0.1 THEN 'moderate' ELSE 'high' END", T.DIMENSIONALITY)
    missing_pct = _fixed1(f"{missing} / CAST(rows AS DOUBLE) * 100")
    variability = _choice("CASE WHEN mean = 0 THEN CASE WHEN sd > 0 THEN 'high' ELSE 'low' END WHEN sd / mean > 0.5 THEN 'high' "
                          "WHEN sd / mean > 0.2 THEN 'moderate' ELSE 'low' END", T.VARIABILITY)
    numeric = "list_concat([" + ", ".join([
        "'Variable: ' || column_name || ' (Numeric)'",
        _fill(T.NUMERIC_SUMMARY, min=_two("min"), max=_two("max"), range=_two("max - min"), mean=_two("mean"),
              median=_two("median"), sd=_two("sd"), variability=variability), "''",
        _fill(T.DISTRIBUTION, skew=_choice(f"CASE WHEN {SKEWED} THEN {SIDE} ELSE 'symmetric' END", T.SKEW),
              note=_choice("CASE WHEN mean > median THEN 'higher' WHEN mean < median THEN 'lower' ELSE 'similar' END", T.DISTRIBUTION_NOTE)),
        "''"]) + "], CASE WHEN outliers > 0 THEN [" + _fill(
            T.OUTLIERS, q1=_two("q1"), q3=_two("q3"), n=_whole("outliers"), lo=_two("lower_fence"), hi=_two("upper_fence"),
            pct=_fixed1("outliers / CAST(numeric_n AS DOUBLE) * 100")) + f", ''] ELSE [] END, CASE WHEN {missing} > 0 THEN [" + _fill(
            T.NUMERIC_MISSING, n=_whole(missing), pct=missing_pct,
            advice=f"CASE WHEN CAST({missing_pct} AS DOUBLE) > 5 THEN {sql_lit(T.NUMERIC_MISSING_HIGH)} ELSE {sql_lit(T.NUMERIC_MISSING_LOW)} END"
        ) + f", ''] ELSE [{sql_lit(T.NUMERIC_COMPLETE)}, ''] END)"
    share = "top_k / CAST(populated AS DOUBLE)"
    category = "list_concat([" + ", ".join([
        "'Variable: ' || column_name || ' (Categorical)'",
        _fill(T.CARDINALITY, card=_whole("distinct_n"), n=_whole("populated"), pct=_fixed1("distinct_n / CAST(populated AS DOUBLE) * 100"),
              note=_choice("CASE WHEN distinct_n = populated THEN 'identifier' WHEN distinct_n > 0.8 * populated THEN 'high' "
                           "WHEN distinct_n < 10 THEN 'low' ELSE 'moderate' END", T.CARDINALITY_NOTE)), "''",
        _fill(T.CATEGORY_DISTRIBUTION, tops="tops", note=_choice(
            f"CASE WHEN {share} > 0.9 THEN 'severe' WHEN {share} > 0.5 THEN 'moderate' ELSE 'balanced' END", T.CONCENTRATION)),
        "''"]) + f"], CASE WHEN {missing} > 0 THEN [" + _fill(T.CATEGORICAL_MISSING, n=_whole(missing), pct=missing_pct) + ", ''] ELSE [] END)"
    empty = f"['Variable: ' || column_name, {sql_lit(T.EMPTY_VARIABLE)}, '']"
    item = _fill(T.CATEGORY_ITEM, value="value", count=_whole("k"), pct=_fixed1("k / CAST(populated AS DOUBLE) * 100"))
    dups = (f"CASE WHEN duplicates > 0 THEN {_fill(T.DUPLICATES, n=_whole('duplicates'), pct=_fixed1('duplicates / CAST(rows AS DOUBLE) * 100'))} "
            f"ELSE {sql_lit(T.NO_DUPLICATES)} END")
    both = "n_numeric + n_categorical"
    values = {"dups": _whole("duplicates"), "skewed": "skewed_columns", "outliers": "outlier_columns", "rows": _whole("rows"), "n_numeric": "n_numeric"}
    arms = []
    for order, (section, head, group) in enumerate((("preprocessing", T.ML_HEAD, PREPROCESSING), ("algorithm", T.ALGORITHMS_HEAD, ALGORITHM),
                                                    ("advice", T.ADVICE_HEAD, ADVICE)), 5):
        said = "CASE rule_id " + " ".join(f"WHEN {sql_lit(r)} THEN {_fill(t, **values)}" for r, t in T.RULE_TEXT.items()) + " END"
        arms.append(_lines(order, section, lit(head)))
        arms.append(f"""SELECT {order}, no, unnest([1, 2]), {sql_lit(section)}, unnest([no || '. ' || said, ''])
FROM (SELECT row_number() OVER (ORDER BY ord) AS no, {said} AS said FROM f, LATERAL ({' UNION ALL '.join(group)}) r(ord, rule_id)) x""")
    body = "\nUNION ALL ".join([
        _lines(0, "title", lit(T.TITLE)),
        _lines(1, "summary", lit(T.SUMMARY_HEAD) + [_fill(T.SUMMARY, rows=_whole("rows"), cols="cols", pct=pct, populated=_whole("populated"), total=_whole("total"), quality=_banded(comp, T.SUMMARY_QUALITY)), "''", "''"]),
        _lines(2, "structure", lit(T.STRUCTURE_HEAD) + [_fill(T.STRUCTURE, cols="cols", names="names", rows=_whole("rows"), dim=dim), "''", "''"]),
        _lines(3, "variables", lit(T.VARIABLES_HEAD)),
        f"""SELECT 3, position + 1, unnest(range(len(ls))), 'variables', unnest(ls) FROM (
SELECT position, CASE kind WHEN 'empty' THEN {empty} WHEN 'numeric' THEN {numeric} ELSE {category} END AS ls FROM c LEFT JOIN top USING (position)) x""",
        _lines(4, "quality", lit(T.QUALITY_HEAD) + [_fill(T.QUALITY, word=_banded(comp, T.QUALITY_WORD), pct=pct, dups=dups), "''"]),
        "SELECT 4, 1, unnest([1, 2]), 'quality', unnest([" + _fill(T.SKEWNESS, cols="skewed_columns") + ", '']) FROM f WHERE n_skewed > 0",
        "SELECT 4, 2, unnest([1, 2]), 'quality', unnest([" + _fill(
            T.OUTLIER_PRESENCE, n="n_outlier", s=_plural("n_outlier"), cols="outlier_columns") + ", '']) FROM f WHERE n_outlier > 0",
        *arms,
        _lines(8, "conclusion", lit(T.CONCLUSION_HEAD) + [_fill(
            T.CONCLUSION, rows=_whole("rows"), cols="cols", found=_banded(comp, T.CONCLUSION_FOUNDATION),
            n_num="n_numeric", num_word="CASE WHEN n_numeric = 1 THEN 'variable' ELSE 'variables' END",
            n_cat="n_categorical", cat_word="CASE WHEN n_categorical = 1 THEN 'variable' ELSE 'variables' END",
            space=f"CASE WHEN {both} >= 10 THEN 'rich' ELSE 'sufficient' END",
            outl=f"CASE WHEN n_outlier > 0 THEN {_fill(T.CONCLUSION_OUTLIERS, n='n_outlier', s=_plural('n_outlier'))} ELSE '' END",
            skew=f"CASE WHEN n_skewed > 0 THEN {_fill(T.CONCLUSION_SKEW, n='n_skewed', s=_plural('n_skewed'))} ELSE '' END")]),
    ])
    return f"""(WITH c AS {sql_columns(name)},
f AS ({facts(name, 'c')}),
ranked AS (SELECT position, cell AS value, count(*) AS k, row_number() OVER (PARTITION BY position ORDER BY count(*) DESC, cell) AS place
           FROM ({unpivot}) u WHERE cell <> '' GROUP BY position, cell),
top AS (SELECT position, string_agg({item}, ', ' ORDER BY place) AS tops FROM ranked JOIN c USING (position) WHERE place <= 5 GROUP BY position),
l AS ({body})
SELECT CAST(row_number() OVER (ORDER BY a, b, k) AS INTEGER) AS line_no, section, text FROM l)"""
