"""Registered table-query operators (filters, search, preview, aggregates)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.catalog.inputs import (
    CUSTOMER_NULLED_SQL, PART_TEXT_SQL, customer_nulled, part_text, sql_cell, sql_num, table,
)
from quarry.operators import query as Q

R = 4


def _lineitem(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")


LINEITEM_SQL = "(SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem)"
CUST_COLS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def filter_fuzzy(spark, d):
    return Q.filter_fuzzy(customer_nulled(spark, d), "mktsegment", "HOUSEHOLD goods")


def filter_equals(spark, d):
    return Q.filter_rows(customer_nulled(spark, d), "C_MKTSEGMENT ", "  building", "equals")


def filter_contains(spark, d):
    return Q.filter_rows(part_text(spark, d), "name", "RING", "contains")


def filter_gt(spark, d):
    return Q.filter_rows(_lineitem(spark, d), "quantity", "45", ">")


def filter_lt(spark, d):
    return Q.filter_rows(part_text(spark, d), "p_size_cm", "10cm", "less")


def filter_gte(spark, d):
    return Q.filter_rows(part_text(spark, d), "p_mixed", "25", ">=")


def filter_lte(spark, d):
    return Q.filter_rows(_lineitem(spark, d), "l_discount", "0.02", "<=")


def filter_not(spark, d):
    return Q.filter_rows(customer_nulled(spark, d), "c_mktsegment", "Machinery", "!=")


def filter_unknown_op(spark, d):
    return Q.filter_rows(part_text(spark, d), "brand", "#1", "LIKE")


def search_rows(spark, d):
    return Q.search_rows(table(spark, d, "part"), "  RING ")


def preview_rows(spark, d):
    return Q.preview(table(spark, d, "orders"), ["o_orderkey"], "Which orders are urgent?")


def _cases(df_cases):
    return reduce(lambda a, b: a.unionByName(b),
                  [df.select(F.lit(name).alias("case_name"), F.round("value", R).alias("value"))
                   for name, df in df_cases])


def _agg(op):
    def run(spark, d):
        li, pt = _lineitem(spark, d), part_text(spark, d)
        return _cases([
            ("quantity", Q.aggregate_column(li, "l_quantity", op)),
            ("size_cm", Q.aggregate_column(pt, "size_cm", op)),
            ("odd_prefix", Q.aggregate_column(pt, "p_odd_prefix", op)),
            ("name", Q.aggregate_column(pt, "p_name", op)),
            ("unknown", Q.aggregate_column(pt, "no_such_column", op)),
        ])
    return run


def distinct_values(spark, d):
    o = Q.distinct_values(table(spark, d, "orders"), "orderpriority")
    c = Q.distinct_values(customer_nulled(spark, d), "c_mktsegment")
    return (o.select(F.lit("orders").alias("table_name"), "value")
            .unionByName(c.select(F.lit("customer_nulled").alias("table_name"), "value")))


def _group(op, value_column="c_acctbal"):
    def run(spark, d):
        g = Q.group_by(customer_nulled(spark, d), "mktsegment", value_column, op)
        return g.select("group_key", F.round("value", R).alias("value"))
    return run


QUERIES = {
    "filter_fuzzy": filter_fuzzy, "filter_equals": filter_equals,
    "filter_contains": filter_contains, "filter_gt": filter_gt, "filter_lt": filter_lt,
    "filter_gte": filter_gte, "filter_lte": filter_lte, "filter_not": filter_not,
    "filter_unknown_op": filter_unknown_op, "search_rows": search_rows,
    "preview_rows": preview_rows,
    "agg_sum": _agg("sum"), "agg_avg": _agg("avg"), "agg_count": _agg("count"),
    "agg_min": _agg("min"), "agg_max": _agg("max"),
    "distinct_values": distinct_values,
    "group_sum": _group("sum"), "group_avg": _group("avg"), "group_count": _group("count"),
    "group_rows": _group("sum", "no_such_column"),
}


def sql():
    cell = sql_cell("c_mktsegment")
    q = {
        "filter_fuzzy": f"SELECT {CUST_COLS} FROM {CUSTOMER_NULLED_SQL} t WHERE "
                        f"contains(lower({cell}), 'household goods') OR contains('household goods', lower({cell}))",
        "filter_equals": f"SELECT {CUST_COLS} FROM {CUSTOMER_NULLED_SQL} t WHERE lower({cell}) = 'building'",
        "filter_contains": f"SELECT * FROM {PART_TEXT_SQL} t WHERE contains(lower({sql_cell('p_name')}), 'ring')",
        "filter_gt": f"SELECT * FROM {LINEITEM_SQL} t WHERE l_quantity > 45",
        "filter_lt": f"SELECT * FROM {PART_TEXT_SQL} t WHERE {sql_num(sql_cell('p_size_cm'))} < 10",
        "filter_gte": f"SELECT * FROM {PART_TEXT_SQL} t WHERE {sql_num(sql_cell('p_mixed'))} >= 25",
        "filter_lte": f"SELECT * FROM {LINEITEM_SQL} t WHERE l_discount <= 0.02",
        "filter_not": f"SELECT {CUST_COLS} FROM {CUSTOMER_NULLED_SQL} t WHERE lower({cell}) <> 'machinery'",
        "filter_unknown_op": f"SELECT * FROM {PART_TEXT_SQL} t WHERE contains(lower({sql_cell('p_brand')}), '#1')",
        "search_rows": "SELECT * FROM part WHERE " + " OR ".join(
            f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), 'ring')"
            for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        "preview_rows": """SELECT 'Table Data (' || (SELECT count(*) FROM orders) || ' rows):' || chr(10)
  || 'Headers: o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority'
  || chr(10) || chr(10) || 'First 10 rows:' || chr(10)
  || string_agg('Row ' || rn || ': ' || line, chr(10) ORDER BY rn)
  || chr(10) || chr(10) || 'Query: Which orders are urgent?' || chr(10) || chr(10)
  || 'Analyze this data and answer the query.' AS prompt
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn,
        concat_ws(' | ', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
                  CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority) AS line
      FROM orders ORDER BY o_orderkey LIMIT 10) f""",
        "distinct_values": f"""SELECT DISTINCT 'orders' AS table_name, {sql_cell('o_orderpriority')} AS value
  FROM orders WHERE {sql_cell('o_orderpriority')} <> ''
UNION ALL SELECT DISTINCT 'customer_nulled', {cell} FROM {CUSTOMER_NULLED_SQL} t WHERE {cell} <> ''""",
    }
    for op, fn in (("sum", "sum"), ("avg", "avg"), ("count", "count"), ("min", "min"), ("max", "max")):
        def agg(x):
            e = f"{fn}({x})"
            return f"round(coalesce(CAST({e} AS DOUBLE), 0.0), {R})"
        q[f"agg_{op}"] = f"""SELECT 'quantity' AS case_name, {agg('l_quantity')} AS value FROM lineitem
UNION ALL SELECT 'size_cm', {agg(sql_num(sql_cell('p_size_cm')))} FROM {PART_TEXT_SQL} t
UNION ALL SELECT 'odd_prefix', {agg(sql_num(sql_cell('p_odd_prefix')))} FROM {PART_TEXT_SQL} t
UNION ALL SELECT 'name', {agg(sql_num(sql_cell('p_name')))} FROM {PART_TEXT_SQL} t
UNION ALL SELECT 'unknown', 0.0"""
    for op, fn in (("sum", "sum"), ("avg", "avg"), ("count", "count")):
        q[f"group_{op}"] = f"""SELECT {cell} AS group_key, round(coalesce(CAST({fn}(c_acctbal) AS DOUBLE), 0.0), {R}) AS value
FROM {CUSTOMER_NULLED_SQL} t WHERE {cell} <> '' GROUP BY 1"""
    q["group_rows"] = f"""SELECT {cell} AS group_key, round(CAST(count(*) AS DOUBLE), {R}) AS value
FROM {CUSTOMER_NULLED_SQL} t WHERE {cell} <> '' GROUP BY 1"""
    return q
