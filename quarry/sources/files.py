"""File inventory, file checks, format routing and load summaries.

The inventory is Spark's ``binaryFile`` source with only ``path``, ``length``
and ``modificationTime`` selected: the file bodies are pruned from the scan,
so listing a folder of any size reads metadata only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.numbers import fixed_value

# --- fixed values: format routing by lower-cased extension ------------------------
FORMATS = {"csv": "csv", "xlsx": "excel", "xls": "excel", "pdf": "pdf"}
# ------------------------------------------------------------------------------------


def _name(path):
    return F.element_at(F.split(path, "/"), -1)


def _ext(name):
    return F.lower(F.element_at(F.split(name, "\\."), -1))


def file_format(ext) -> "F.Column":
    out = F.lit("unsupported")
    for e, fmt in reversed(list(FORMATS.items())):
        out = F.when(ext == e, F.lit(fmt)).otherwise(out)
    return out


def file_inventory(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``(path, name, bytes, size_kb, type, format, modified)`` per file."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
             .load(folder).select("path", "length", "modificationTime"))
    name = _name(F.col("path"))
    return files.select(
        "path", name.alias("name"), F.col("length").alias("bytes"),
        fixed_value(F.col("length") / 1024.0, 2).alias("size_kb"),
        F.upper(_ext(name)).alias("type"), file_format(_ext(name)).alias("format"),
        F.col("modificationTime").alias("modified"))


def file_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, rows)`` of the Parquet files of a folder, whatever their schemas: no
    column is read, and files are grouped by name in each task first."""
    files = (spark.read.schema("none INT").option("pathGlobFilter", "*.parquet").parquet(folder)
             .select(_name(F.col("_metadata.file_path")).alias("name")))
    return files.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


def file_check(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``(name, exists, bytes, type)`` for requested file names in a folder:
    the requests left-joined to the inventory, so a missing file gives
    ``exists = false``."""
    wanted = spark.createDataFrame([(n,) for n in names], "name STRING")
    inv = file_inventory(spark, folder).select("name", "bytes", "type")
    return (wanted.join(inv, "name", "left")
            .select("name", F.col("bytes").isNotNull().alias("exists"), "bytes",
                    F.coalesce("type", F.upper(_ext(F.col("name")))).alias("type")))


def load_summary(df: DataFrame, order_by: list[str], sample: int = 5) -> DataFrame:
    """Headers, row and column counts and the first ``sample`` rows by
    ``order_by``: one output row per sample row. The count is one
    distributed action; the sample is a top-k by the order key."""
    rows = df.count()
    head = df.orderBy(*order_by).limit(sample)
    w_cols = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    return head.select(
        F.lit(", ".join(df.columns)).alias("headers"), F.lit(rows).cast("long").alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"), *w_cols)
