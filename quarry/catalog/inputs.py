"""Inputs derived from the given tables, in Spark and as DuckDB SQL.

The driver's tables hold no nulls, blanks, padded cells or numeric-prefix
text, so the queries derive such columns from the data itself. Every
derivation exists twice: as a DataFrame and as the SQL text the oracle runs,
and both read the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.cells import WS_CHARS

# DuckDB spelling of the cell primitives --------------------------------------
SQL_WS = " || ".join(f"chr({ord(c)})" for c in WS_CHARS)
SQL_WS_CLASS = (r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")
SQL_NUM = (r"^" + SQL_WS_CLASS + r"*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
           r"(?:[eE][+-]?[0-9]+)?))")


def sql_trim(x: str) -> str:
    return f"trim({x}, {SQL_WS})"


def sql_cell(x: str) -> str:
    return f"coalesce({sql_trim(x)}, '')"


def sql_num(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, '{SQL_NUM}', 1), '') AS DOUBLE)"


def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# customer with missing and padded cells ---------------------------------------
def customer_nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = (F.when(k % 14 == 0, F.lit(None).cast("string"))
           .when(k % 7 == 0, F.lit("  "))
           .when(k % 2 == 0, F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")))
           .otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", "c_name", "c_nationkey",
                    F.when(k % 11 == 0, F.lit(None).cast("double"))
                    .otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    seg.alias("c_mktsegment"))


CUSTOMER_NULLED_SQL = """(SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 14 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  '
       WHEN c_custkey % 2 = 0 THEN '  ' || lower(c_mktsegment) || ' '
       ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""

CUSTOMER_NULLED_COLS = [("c_custkey", "num"), ("c_name", "str"), ("c_nationkey", "num"),
                        ("c_acctbal", "dbl"), ("c_mktsegment", "str")]


# customers by nation and segment alone, so that rows repeat, with a column without
# values, one of blanks and two constant ones
def customer_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_nationkey", F.lower("c_mktsegment").alias("c_segment"), F.lit(None).cast("double").alias("c_none"),
        F.lit("  ").alias("c_blank"), F.lit(7).alias("c_seven"), F.lit("same").alias("c_same"))


CUSTOMER_BLANK_SQL = """(SELECT c_nationkey, lower(c_mktsegment) AS c_segment, CAST(NULL AS DOUBLE) AS c_none,
  '  ' AS c_blank, 7 AS c_seven, 'same' AS c_same FROM customer)"""
CUSTOMER_BLANK_COLS = [("c_nationkey", "num"), ("c_segment", "str"), ("c_none", "dbl"), ("c_blank", "str"),
                       ("c_seven", "num"), ("c_same", "str")]


# part as an all-text table (numeric prefixes, a mixed column) -----------------
def part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return p.select(
        F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_brand", "p_type",
        F.concat(size, F.lit(" cm")).alias("p_size_cm"),
        F.when(F.col("p_partkey") % 3 != 0, size).otherwise(F.col("p_name")).alias("p_mixed"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("$"), size))
        .otherwise(F.concat(size, F.lit("abc"))).alias("p_odd_prefix"),
    )


PART_TEXT_SQL = """(SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
  CAST(p_size AS VARCHAR) || ' cm' AS p_size_cm,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS p_mixed,
  CASE WHEN p_partkey % 5 = 0 THEN '$' || CAST(p_size AS VARCHAR)
       ELSE CAST(p_size AS VARCHAR) || 'abc' END AS p_odd_prefix
  FROM part)"""

PART_TEXT_COLS = [(n, "str") for n in ("p_partkey", "p_name", "p_brand", "p_type",
                                        "p_size_cm", "p_mixed", "p_odd_prefix")]


# lineitem numbers with a right- and a left-skewed column -------------------------
def lineitem_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", (q * q * q * q).alias("l_qty_pow4"),
                     (F.lit(2500.0) - q * q).alias("l_qty_left"),
                     "l_returnflag", "l_linestatus", "l_shipdate")


LINEITEM_SKEWED_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_quantity * l_quantity * l_quantity * l_quantity AS l_qty_pow4,
  2500.0 - l_quantity * l_quantity AS l_qty_left, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""

LINEITEM_SKEWED_COLS = [("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"), ("l_linenumber", "num"), ("l_quantity", "dbl"),
                        ("l_extendedprice", "dbl"), ("l_discount", "dbl"), ("l_tax", "dbl"),
                        ("l_qty_pow4", "dbl"), ("l_qty_left", "dbl"),
                        ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "ts")]


def documents_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


DOCUMENTS_META_SQL = "(SELECT doc_id, text, lang, source, n_chars FROM documents)"
DOCUMENTS_META_COLS = [("doc_id", "num"), ("text", "str"), ("lang", "str"),
                       ("source", "str"), ("n_chars", "num")]

ORDERS_COLS = [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "str"),
               ("o_totalprice", "dbl"), ("o_orderdate", "ts"), ("o_orderpriority", "str")]

PROFILED = {
    "customer_nulled": (customer_nulled, CUSTOMER_NULLED_SQL, CUSTOMER_NULLED_COLS),
    "customer_blank": (customer_blank, CUSTOMER_BLANK_SQL, CUSTOMER_BLANK_COLS),
    "part_text": (part_text, PART_TEXT_SQL, PART_TEXT_COLS),
    "lineitem_skewed": (lineitem_skewed, LINEITEM_SKEWED_SQL, LINEITEM_SKEWED_COLS),
    "documents": (documents_meta, DOCUMENTS_META_SQL, DOCUMENTS_META_COLS),
    "orders": (lambda s, d: table(s, d, "orders"), "orders", ORDERS_COLS),
}
