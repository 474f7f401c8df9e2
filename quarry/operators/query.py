"""Forgiving table queries: fuzzy and comparison filters, search in any
column, preview, whole-column and grouped aggregates, distinct values.

Column names are resolved on the driver (metadata only, no job). An unknown
column gives no rows, or 0 for an aggregate. Numbers are the longest numeric
prefix of a cell; typed numeric columns are compared as numbers directly, so
their filters reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.cells import (
    _py_trim, as_cell, as_number, is_numeric_type, py_parse_number, resolve_column,
)

# --- fixed values: operator names the reference accepts ------------------------
EQUALS = ("equals", "=", "==")
CONTAINS = ("contains",)
GREATER = ("greater", ">")
LESS = ("less", "<")
GREATER_EQ = (">=",)
LESS_EQ = ("<=",)
NOT_EQUALS = ("not", "!=")
COLUMN_AGGREGATES = ("sum", "avg", "count", "min", "max")
GROUP_AGGREGATES = ("sum", "avg", "count")
PREVIEW_ROWS = 10
# -------------------------------------------------------------------------------


def _field(df: DataFrame, name: str) -> T.StructField | None:
    i = resolve_column(df.columns, name)
    return None if i < 0 else df.schema.fields[i]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _cell(f: T.StructField) -> Column:
    return as_cell(_quoted(f.name), f.dataType)


def _num(f: T.StructField) -> Column:
    return as_number(_quoted(f.name), f.dataType)


def _none(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def filter_fuzzy(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose cell contains the value, or is contained in it (both
    lower-cased and trimmed). A blank cell is contained in every value."""
    f = _field(df, column)
    if f is None:
        return _none(df)
    v = _py_trim(value.lower())
    c = F.lower(_cell(f))
    return df.where(c.contains(F.lit(v)) | F.lit(v).contains(c))


def filter_rows(df: DataFrame, column: str, value: str, operator: str = "equals") -> DataFrame:
    """Comparison filter. Text operators compare lower-cased trimmed cells;
    numeric operators need both sides to parse as numbers."""
    f = _field(df, column)
    if f is None:
        return _none(df)
    op = operator.lower()
    text = F.lower(_cell(f))
    v = _py_trim(value.lower())
    if op in EQUALS:
        return df.where(text == F.lit(v))
    if op in NOT_EQUALS:
        return df.where(text != F.lit(v))
    numeric = {GREATER: "__gt__", LESS: "__lt__", GREATER_EQ: "__ge__", LESS_EQ: "__le__"}
    for names, method in numeric.items():
        if op in names:
            x = py_parse_number(value)
            if x is None:
                return _none(df)
            if is_numeric_type(f.dataType):
                # plain comparison on the column reaches the Parquet scan;
                # NaN (which compares above every number) is excluded apart
                c = _quoted(f.name)
                cond = getattr(c, method)(F.lit(x))
                if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                    cond = cond & ~F.isnan(c)
                return df.where(cond)
            return df.where(F.coalesce(getattr(_num(f), method)(F.lit(x)), F.lit(False)))
    return df.where(text.contains(F.lit(v)))  # contains, and any unknown operator


def search_rows(df: DataFrame, term: str) -> DataFrame:
    """Rows where any cell, lower-cased, contains the trimmed lower-cased
    term. An empty term keeps every row."""
    t = _py_trim(term.lower())
    if not df.columns:
        return df
    hits = [F.coalesce(F.lower(_cell(f)).contains(F.lit(t)), F.lit(False)) for f in df.schema.fields]
    return df.where(reduce(lambda a, b: a | b, hits))


def preview(df: DataFrame, order_by: list[str], query: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The preview prompt as one row: row count, headers, the first ``n``
    rows by ``order_by`` as ``Row i: a | b``, and the query text."""
    rows = df.count()
    cells = [_cell(f) for f in df.schema.fields]
    first = (df.orderBy(*order_by).limit(n)
             .select(F.struct(*[_quoted(c) for c in order_by]).alias("key"),
                     F.concat_ws(" | ", *cells).alias("line")))
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))),
                           lambda x, i: F.concat(F.lit("Row "), (i + 1).cast("string"),
                                                 F.lit(": "), x["line"]))
    head = (f"Table Data ({rows} rows):\nHeaders: {', '.join(df.columns)}\n\nFirst {n} rows:\n")
    return first.agg(F.concat(F.lit(head), F.array_join(numbered, "\n"),
                              F.lit(f"\n\nQuery: {query}\n\nAnalyze this data and answer the query."))
                     .alias("prompt"))


def aggregate_column(df: DataFrame, column: str, operation: str) -> DataFrame:
    """One row: sum, avg, count, min or max of the numeric cells; 0 when
    the column is unknown or holds no number."""
    f = _field(df, column)
    op = operation.lower()
    if f is None or op not in COLUMN_AGGREGATES:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("value"))
    x = _num(f)
    agg = {"sum": F.sum(x), "avg": F.avg(x), "count": F.count(x).cast("double"),
           "min": F.min(x), "max": F.max(x)}[op]
    return df.agg(F.coalesce(agg, F.lit(0.0)).alias("value"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-blank trimmed values of a column."""
    f = _field(df, column)
    if f is None:
        return df.sparkSession.range(0).select(F.lit("").alias("value"))
    return (df.select(_cell(f).alias("value")).where(F.col("value") != "")
            .distinct().orderBy("value"))


def group_by(df: DataFrame, group_column: str, value_column: str, operation: str) -> DataFrame:
    """``(group_key, value)``: sum, avg or count of the numeric cells of the
    value column per trimmed, non-blank group key (case-sensitive). A group
    with no number gives 0. With an unknown value column every row counts
    as 1. With an unknown group column there are no groups."""
    g = _field(df, group_column)
    op = operation.lower()
    if g is None or op not in GROUP_AGGREGATES:
        return df.sparkSession.range(0).select(F.lit("").alias("group_key"), F.lit(0.0).alias("value"))
    v = _field(df, value_column)
    x = F.lit(1.0) if v is None else _num(v)
    agg = {"sum": F.sum("x"), "avg": F.avg("x"), "count": F.count("x").cast("double")}[op]
    return (df.select(_cell(g).alias("group_key"), x.alias("x")).where(F.col("group_key") != "")
            .groupBy("group_key").agg(F.coalesce(agg, F.lit(0.0)).alias("value")))

