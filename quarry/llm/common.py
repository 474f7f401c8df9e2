"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it
    back, so a lost executor costs a re-read and not a re-run."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, taken by place, so that other columns whose
    names differ only in case, hold dots or repeat a name don't matter."""
    at = [df.columns.index(n) for n in names]
    placed = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return placed.select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names)))


def as_text(col) -> F.Column:
    """The column as a string, null as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def utf8_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[bytes, list[int]]:
    """All strings of an Arrow column as one UTF-8 buffer and n + 1 offsets;
    nulls are empty."""
    parts = [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
    offsets, at = [0], 0
    for p in parts:
        at += len(p)
        offsets.append(at)
    return b"".join(parts), offsets


def text_chunks(values: list[bytes], limit: int):
    """Group consecutive values into runs of about ``limit`` bytes, as
    (first index, values); a longer value stands alone."""
    start, size, run = 0, 0, []
    for i, v in enumerate(values):
        if run and size + len(v) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(v)
        size += len(v)
    if run:
        yield start, run


def bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """``2 ** bits`` bits, of which those of the numbers in the one column of
    ``numbers`` (modulo the size) are set. Its size doesn't depend on the rows."""
    bit = F.pmod(F.col(numbers.columns[0]), F.lit(1 << bits)) + 1  # Spark numbers the bits from 1
    words = (numbers.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit"))
             .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    out = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
    for r in words.collect():
        out[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def has_bit(marks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers & (len(marks) * 8 - 1)
    return (marks[at >> 3] >> (at & 7)) & 1 == 1
