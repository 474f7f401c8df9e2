"""Registered preparation operators, over whole tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.inputs import CUSTOMER_NULLED_SQL, customer_nulled, sql_cell, table
from quarry.operators import prep as P

R = 4
LINE = ("l_orderkey", "l_linenumber")
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lines(spark, d):
    return table(spark, d, "lineitem").select(*LINE, *NUMBERS)


def _rounded(df, *names):
    return df.select(*[F.round(c, R).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def _customer(spark, d, *names):
    return customer_nulled(spark, d).select("c_custkey", *names)


def prep_dedupe(spark, d):
    return P.drop_duplicates(table(spark, d, "documents").select("text", "lang", "source", "n_chars"))


def prep_impute_mean(spark, d):
    return _rounded(P.impute_mean(_customer(spark, d, "c_acctbal"), "c_acctbal"), "c_acctbal")


def prep_impute_median(spark, d):
    return _rounded(P.impute_median(_customer(spark, d, "c_acctbal"), "c_acctbal"), "c_acctbal")


def prep_impute_mode(spark, d):
    return P.impute_mode(_customer(spark, d, "c_mktsegment"), "c_mktsegment")


def prep_missing_category(spark, d):
    return P.missing_category(_customer(spark, d, "c_mktsegment"), "c_mktsegment")


def prep_standard_scale(spark, d):
    return _rounded(P.standard_scale(_lines(spark, d), list(NUMBERS)), *NUMBERS)


def prep_robust_scale(spark, d):
    return _rounded(P.robust_scale(_lines(spark, d).select(*LINE, "l_extendedprice"), "l_extendedprice"),
                    "l_extendedprice")


def prep_winsorize(spark, d):
    q = _lines(spark, d).select(*LINE, F.pow("l_quantity", F.lit(4.0)).alias("q4"))
    return _rounded(P.winsorize(q, "q4"), "q4")


def prep_log(spark, d):
    return _rounded(P.log_transform(_customer(spark, d, "c_acctbal"), "c_acctbal"), "c_acctbal")


def prep_sqrt(spark, d):
    return _rounded(P.sqrt_transform(_customer(spark, d, "c_acctbal"), "c_acctbal"), "c_acctbal")


def prep_one_hot(spark, d):
    return P.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


def prep_freq_encode(spark, d):
    return _rounded(P.frequency_encode(_customer(spark, d, "c_mktsegment"), "c_mktsegment"),
                    "c_mktsegment_freq").drop("c_mktsegment")


def prep_target_encode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return _rounded(P.target_encode(o, "o_orderpriority", "o_totalprice"), "o_orderpriority_target")


def prep_rare_group(spark, d):
    return P.group_rare(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 0.04)


def corr_pairs(spark, d):
    li = table(spark, d, "lineitem").select(*NUMBERS, (F.col("l_quantity") * 2 + 1).alias("q2"))
    return _rounded(P.correlations(li), "r")


def split_stratified(spark, d):
    return P.split_stratified(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")


def kfold_assign(spark, d):
    return P.kfold(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", 5)


def missing_patterns(spark, d):
    return P.missing_patterns(customer_nulled(spark, d))


def histogram(spark, d):
    return _rounded(P.histogram(table(spark, d, "lineitem"), "l_extendedprice"), "low", "high")


def prep_interactions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return P.interactions(o, "o_orderstatus", "o_totalprice")


QUERIES = {f.__name__: f for f in (
    prep_dedupe, prep_impute_mean, prep_impute_median, prep_impute_mode, prep_missing_category,
    prep_standard_scale, prep_robust_scale, prep_winsorize, prep_log, prep_sqrt, prep_one_hot, prep_freq_encode,
    prep_target_encode, prep_rare_group, corr_pairs, split_stratified, kfold_assign, missing_patterns, histogram,
    prep_interactions)}


def _q(x: str, n: str, source: str) -> str:
    """Value of rank floor(n * share), counted from 0."""
    return f"(SELECT {x} FROM (SELECT {x}, row_number() OVER (ORDER BY {x}) - 1 AS i, count(*) OVER () AS c " \
           f"FROM {source} WHERE {x} IS NOT NULL) z WHERE i = CAST(floor(c * {n}) AS BIGINT))"


def sql():
    seg = sql_cell("c_mktsegment")
    cust = CUSTOMER_NULLED_SQL
    mode = (f"(SELECT v FROM (SELECT {seg} AS v, count(*) AS k FROM {cust} t GROUP BY 1) f WHERE v <> '' "
            "ORDER BY k DESC, v LIMIT 1)")
    scaled = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), {R}) AS {c}" for c in NUMBERS)
    price_q1, price_q3 = (_q("l_extendedprice", s, "lineitem") for s in ("0.25", "0.75"))
    q4 = "(SELECT l_orderkey, l_linenumber, pow(l_quantity, 4) AS q4 FROM lineitem)"
    q4_q1, q4_q3 = (_q("q4", s, q4 + " y") for s in ("0.25", "0.75"))
    names = [*NUMBERS, "q2"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    corr = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), {R}) AS r, "
        f"coalesce(abs(corr({a}, {b})) > 0.9, false) AS strong FROM src" for a, b in pairs)
    ranked = ("(SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
              "md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n "
              "FROM orders)")
    status = ("F", "O", "P")
    flag = lambda c: f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END"
    return {
        "prep_dedupe": f"SELECT DISTINCT {sql_cell('text')} AS text, {sql_cell('lang')} AS lang, "
                       f"{sql_cell('source')} AS source, n_chars FROM documents",
        "prep_impute_mean": f"SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {cust} u)), {R}) "
                            f"AS c_acctbal FROM {cust} t",
        "prep_impute_median": f"SELECT c_custkey, round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {cust} u)), "
                              f"{R}) AS c_acctbal FROM {cust} t",
        "prep_impute_mode": f"SELECT c_custkey, CASE WHEN {seg} = '' THEN {mode} ELSE {seg} END AS c_mktsegment "
                            f"FROM {cust} t",
        "prep_missing_category": f"SELECT c_custkey, CASE WHEN {seg} = '' THEN '(missing)' ELSE {seg} END "
                                 f"AS c_mktsegment FROM {cust} t",
        "prep_standard_scale": f"SELECT l_orderkey, l_linenumber, {scaled} FROM lineitem",
        "prep_robust_scale": f"SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT median(l_extendedprice) "
                             f"FROM lineitem)) / ({price_q3} - {price_q1}), {R}) AS l_extendedprice FROM lineitem",
        "prep_winsorize": f"WITH f AS (SELECT {q4_q1} AS a, {q4_q3} AS b) SELECT l_orderkey, l_linenumber, "
                          f"round(greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), q4)), {R}) AS q4 FROM {q4} t, f",
        "prep_log": f"SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END, {R}) AS c_acctbal "
                    f"FROM {cust} t",
        "prep_sqrt": f"SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, {R}) AS c_acctbal "
                     f"FROM {cust} t",
        "prep_one_hot": "SELECT o_orderkey, o_orderstatus, " + ", ".join(
            f"CAST(o_orderstatus = '{s}' AS INTEGER) AS o_orderstatus_{s}" for s in status) + " FROM orders",
        "prep_freq_encode": f"SELECT c_custkey, round(CASE WHEN v <> '' THEN count(*) OVER (PARTITION BY v) / "
                            f"CAST(sum(CASE WHEN v <> '' THEN 1 ELSE 0 END) OVER () AS DOUBLE) END, {R}) "
                            f"AS c_mktsegment_freq FROM (SELECT c_custkey, {seg} AS v FROM {cust} t) s",
        "prep_target_encode": f"SELECT o_orderkey, o_orderpriority, o_totalprice, round(avg(o_totalprice) OVER "
                              f"(PARTITION BY o_orderpriority), {R}) AS o_orderpriority_target FROM orders",
        "prep_rare_group": "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) < 0.04 * count(*) OVER () "
                           "THEN '(other)' ELSE p_brand END AS p_brand FROM part",
        "corr_pairs": f"WITH src AS (SELECT *, l_quantity * 2 + 1 AS q2 FROM lineitem) {corr}",
        "split_stratified": f"SELECT o_orderkey, o_orderstatus, CASE WHEN CAST(i AS DOUBLE) / n < 0.70 THEN 'train' "
                            f"WHEN CAST(i AS DOUBLE) / n < 0.70 + 0.15 THEN 'valid' ELSE 'test' END AS part "
                            f"FROM {ranked} t",
        "kfold_assign": f"SELECT o_orderkey, CAST(i % 5 AS INTEGER) AS fold FROM {ranked} t",
        "missing_patterns": f"SELECT '000' || {flag('c_acctbal')} || CASE WHEN {seg} = '' THEN '1' ELSE '0' END AS pattern, "
                            f"count(*) AS rows FROM {cust} t GROUP BY 1",
        "histogram": f"WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) "
                     f"SELECT bucket, rows, round(lo + (bucket - 1) * (hi - lo) / 10, {R}) AS low, "
                     f"round(lo + bucket * (hi - lo) / 10, {R}) AS high FROM (SELECT CAST(least(10, "
                     "floor((l_extendedprice - lo) / ((hi - lo) / 10)) + 1) AS INTEGER) AS bucket, count(*) AS rows "
                     "FROM lineitem, m GROUP BY 1) b, m",
        "prep_interactions": "SELECT o_orderkey, o_orderstatus, o_totalprice, " + ", ".join(
            f"CASE WHEN o_orderstatus = '{s}' THEN o_totalprice ELSE 0.0 END AS {s}_x_o_totalprice" for s in status)
            + " FROM orders",
    }
