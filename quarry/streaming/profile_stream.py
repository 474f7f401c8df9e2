"""Keep a data profile current while files land in a folder.

Structured Streaming reads the landing folder; each micro-batch is reduced to two
mergeable tables, the counts of its cells ``(position, value, v, k)`` and of its
rows by 128-bit digest ``(d1, d2, k)``, which go into a compacted state (see
``state``) exactly once, also if a batch is replayed. The current profile adds up
the few segments of the state and runs the ordinary profile logic on them, so it
equals the profile of all files read at once, with duplicate rows and report.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.profile import IQR_FENCE, STATS_SCHEMA, TOP_K, TableProfile, _written
from quarry.streaming.state import SegmentedState

ROWS_PER_RANGE = 1_000_000  # numbers per range, at any size
CELLS = "position INT, value STRING, v DOUBLE, k BIGINT"


class StreamingProfile:
    def __init__(self, spark: SparkSession, source: str, schema: T.StructType, state: str,
                 fmt: str = "parquet", files_per_batch: int | None = None):
        self.spark, self.source, self.schema = spark, source, schema
        self.state, self.fmt, self.files_per_batch = state.rstrip("/"), fmt, files_per_batch

    def run(self) -> None:
        """Process every file available now, then stop."""
        reader = self.spark.readStream.schema(self.schema).format(self.fmt)
        if self.files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
        q = (reader.load(self.source).writeStream.foreachBatch(self._merge)
             .option("checkpointLocation", f"{self.state}/_checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        # read once: both tables come from the same rows
        batch = batch.persist()
        try:
            p = TableProfile(batch)
            segments(self.spark, self.state).add(batch_id, {"cells": p.cell_counts(), "rows": p.row_counts()})
        finally:
            batch.unpersist()

    def profile(self) -> TableProfile:
        return MergedProfile(self.spark, self.schema, self.state)


def segments(spark: SparkSession, state: str) -> SegmentedState:
    added = F.sum("k").cast("long").alias("k")
    return SegmentedState(spark, f"{state}/segments", {
        "cells": lambda df: df.groupBy("position", "value", "v").agg(added),
        "rows": lambda df: df.groupBy("d1", "d2").agg(added)})


class MergedProfile(TableProfile):
    """A profile of the state's counts; every measure is derived exactly as for a
    batch."""

    def __init__(self, spark: SparkSession, schema: T.StructType, state: str):
        super().__init__(spark.createDataFrame([], schema))
        self.state = state

    @cached_property
    def cell_freq(self) -> DataFrame:
        """The counts of all batches, written once for the plans that read them. A
        state that isn't there yet has no rows; any error in reading it is an error."""
        return _written(segments(self.spark, self.state).read("cells", CELLS), "stream-cells")

    def stats_frame(self) -> DataFrame:
        """Counts and moments from the cell frequencies. The variance is taken
        about the exact mean in a second aggregate (one mean per column)."""
        f = self.cell_freq
        pop = (F.col("value").isNotNull() & (F.col("value") != "")) | (
            F.col("value").isNull() & F.col("v").isNotNull())
        counted = lambda cond: F.sum(F.when(cond, F.col("k")).otherwise(F.lit(0)))
        base = f.groupBy("position").agg(
            F.sum("k").alias("rows"), counted(pop).alias("populated"),
            counted(F.col("v").isNotNull()).alias("numeric_n"),
            F.sum(F.col("k") * F.col("v")).alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"))
        mean = base.where(F.col("numeric_n") > 0).select(
            "position", (F.col("sum") / F.col("numeric_n")).alias("mean"))
        var = (f.where(F.col("v").isNotNull()).join(F.broadcast(mean), "position").groupBy("position")
               .agg((F.sum(F.col("k") * (F.col("v") - F.col("mean")) ** 2) / F.sum("k")).alias("var_pop")))
        # every column appears, also when nothing has landed
        every = self.spark.createDataFrame([(s.position, s.name) for s in self.specs], "position INT, column_name STRING")
        zero = {"rows", "populated", "numeric_n"}
        return (every.join(base, "position", "left").join(var, "position", "left")
                .select("position", "column_name",
                        *[(F.coalesce(F.col(x.name), F.lit(0)) if x.name in zero else F.col(x.name))
                          .cast(x.dataType).alias(x.name) for x in STATS_SCHEMA.fields[2:]]))

    # The state is a table of frequencies already: ranks and top values come from it.

    @cached_property
    def text_freq(self) -> DataFrame:
        return (self.cell_freq.where(F.col("position").isin(self.text_positions) & (F.col("value") != ""))
                .select("position", "value", "k"))

    def cardinality(self) -> DataFrame:
        return self.text_freq.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_n"), F.max("k").alias("top_k"))

    def top_values(self, k: int = TOP_K) -> DataFrame:
        """The row-number filter keeps a partial top-k per task before the shuffle."""
        w = Window.partitionBy("position").orderBy(F.col("k").desc(), F.col("value").asc())
        return self.text_freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    @cached_property
    def numeric_freq(self) -> DataFrame:
        """``(position, v, k, pid)`` range partitioned on ``(position, v)``; ``pid`` is
        the range, so ``(pid, v)`` orders each column. Written, so that the ranges
        stay the same for every reader."""
        freq = (self.cell_freq.where(F.col("position").isin(self.numeric_positions) & F.col("v").isNotNull())
                .groupBy("position", "v").agg(F.sum("k").cast("long").alias("k")))
        total = sum(r["numeric_n"] for r in self.stats_rows if r["position"] in set(self.numeric_positions))
        return _written(freq.repartitionByRange(max(1, math.ceil(total / ROWS_PER_RANGE)), "position", "v")
                        .withColumn("pid", F.spark_partition_id()), "numeric-freq")

    def _at_ranks(self, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """By running counts over the ranges, of which only those that hold a wanted
        rank are sorted, each once."""
        if not wanted:
            return {}
        targets = self.spark.createDataFrame(wanted, "position INT, rank BIGINT")  # 4 rows per column
        ranges = self.numeric_freq.groupBy("position", "pid").agg(F.sum("k").alias("pk"))
        upto = Window.partitionBy("position").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        located = (ranges.withColumn("end", F.sum("pk").over(upto)).withColumn("start", F.col("end") - F.col("pk"))
                   .join(F.broadcast(targets), "position")
                   .where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
                   .select("position", "pid", "rank", (F.col("rank") - F.col("start")).alias("local")))
        inside = Window.partitionBy("position", "pid").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = (self.numeric_freq.join(F.broadcast(located.select("position", "pid").distinct()), ["position", "pid"], "left_semi")
               .withColumn("cum", F.sum("k").over(inside)).join(F.broadcast(located), ["position", "pid"])
               .where((F.col("cum") - F.col("k") <= F.col("local")) & (F.col("local") < F.col("cum"))))
        return {(r["position"], r["rank"]): r["v"] for r in hit.select("position", "rank", "v").collect()}

    def outlier_counts(self, quartiles: DataFrame) -> DataFrame:
        fences = quartiles.select(
            "position", (F.col("q1") - IQR_FENCE * (F.col("q3") - F.col("q1"))).alias("lower"),
            (F.col("q3") + IQR_FENCE * (F.col("q3") - F.col("q1"))).alias("upper"))
        return (self.numeric_freq.join(F.broadcast(fences), "position").groupBy("position")
                .agg(F.sum(F.when((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper")), F.col("k"))
                           .otherwise(F.lit(0))).cast("long").alias("outliers")))

    def row_counts(self) -> DataFrame:
        return segments(self.spark, self.state).read("rows", "d1 BIGINT, d2 BIGINT, k BIGINT")
