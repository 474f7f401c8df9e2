"""Versioned dataset snapshots in a shared folder.

A snapshot is the Parquet table ``base/name=<name>/version=<version>``. Many
snapshots are written by one distributed ``partitionBy`` write; listing uses
the ``binaryFile`` source with the file bodies pruned; loading reads the one
folder. Names and versions are escaped as ``partitionBy`` does, and back. Version ids are passed in, never read from the clock inside a task.
Order follows the reference: snapshot keys ``<name>_<version>`` sorted
descending, newest first for one name.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path

KEEP_RECENT = 5  # fixed value: the reference's default retention


def version_id(at: datetime | None = None) -> str:
    """ISO time with ':' and '.' as '-' (the reference's snapshot stamp)."""
    t = (at or datetime.now(timezone.utc)).astimezone(timezone.utc)
    iso = t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"
    return iso.replace(":", "-").replace(".", "-")


#: fixed value: characters that Spark escapes in the folder names of partitions
ESCAPED = frozenset(chr(c) for c in range(1, 32)) | frozenset('"#%\'*/:=?\\\x7f{[]^')


def encode(value: str) -> str:
    """A name or version as a folder name, in the spelling of ``partitionBy``."""
    return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value)


def decoded(folder: Column) -> Column:
    """The name or version of a folder name."""
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))


class SnapshotStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def _path(self, name: str, version: str) -> str:
        return f"{self.base}/name={encode(name)}/version={encode(version)}"

    def save(self, name: str, df: DataFrame, version: str) -> str:
        """Write one snapshot; an existing one is never overwritten."""
        path = self._path(name, version)
        df.write.mode("errorifexists").parquet(path)
        return path

    def save_many(self, df: DataFrame, name: Column, version: Column) -> None:
        """Write one snapshot per distinct ``(name, version)`` of the rows,
        in a single distributed write."""
        (df.withColumn("name", name.cast("string")).withColumn("version", version.cast("string"))
         .write.mode("append").partitionBy("name", "version").parquet(self.base))

    def _pairs(self) -> DataFrame:
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", "*.parquet").load(self.base).select("path"))
        return files.select(
            decoded(F.regexp_extract("path", r"/name=([^/]*)/", 1)).alias("name"),
            decoded(F.regexp_extract("path", r"/version=([^/]*)/", 1)).alias("version")).distinct()

    def list(self) -> DataFrame:
        """``(snapshot_no, name, version)``, newest first. Ranges of the sorted
        list are numbered apart and lifted by the counts before them."""
        path = scratch_path(self.spark, "snapshot-list")
        (self._pairs().withColumn("key", F.concat_ws("_", "name", "version"))
         .repartitionByRange(F.col("key").desc(), "name").withColumn("range", F.spark_partition_id())
         .write.parquet(path))
        dealt = self.spark.read.parquet(path)
        counts = sorted((r["range"], r["count"]) for r in dealt.groupBy("range").count().collect())
        lifts, lift = [], 0
        for part, n in counts:  # a row per range
            lifts.append((part, lift))
            lift += n
        inside = Window.partitionBy("range").orderBy(F.col("key").desc(), "name")
        return (dealt.withColumn("place", F.row_number().over(inside))
                .join(self.spark.createDataFrame(lifts, "range INT, lift INT"), "range")
                .select((F.col("place") + F.col("lift")).alias("snapshot_no"), "name", "version"))

    def load(self, name: str, version: str) -> DataFrame:
        """One snapshot, from its own folder, with its own schema."""
        return self.spark.read.parquet(self._path(name, version))

    def latest(self, prefix: str) -> DataFrame | None:
        """The newest snapshot whose key starts with ``prefix``, or None."""
        key = F.concat_ws("_", "name", "version")
        keys = self._pairs().where(key.startswith(prefix)).orderBy(key.desc(), "name").limit(1).collect()
        if not keys:
            return None
        return self.load(keys[0]["name"], keys[0]["version"])

    def retention_plan(self, keep: int = KEEP_RECENT) -> DataFrame:
        """Snapshots to drop: all but the ``keep`` newest keys."""
        return self.list().where(F.col("snapshot_no") > keep)

    def apply_retention(self, keep: int = KEEP_RECENT) -> int:
        """Delete the snapshots of :meth:`retention_plan` (an explicit step)."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        dropped = 0
        for r in self.retention_plan(keep).select("name", "version").toLocalIterator():
            p = jvm.org.apache.hadoop.fs.Path(self._path(r["name"], r["version"]))
            p.getFileSystem(conf).delete(p, True)
            dropped += 1
        return dropped


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key by ``order`` (descending), as one grouped max of a
    struct: partial aggregation keeps one row per key per task, so a key
    holding a third of the rows is no hot spot."""
    others = [c for c in df.columns if c not in (key, *order)]
    best = F.max(F.struct(*[F.col(c) for c in order + others])).alias("best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in order + others])


def older_than_newest(df: DataFrame, key: str, order: list[str], keep: int = KEEP_RECENT) -> DataFrame:
    """Rows beyond the ``keep`` newest per key (a null key is a key). Ties in
    ``order`` go by the other columns, so that exactly ``keep`` rows of a key
    are left out.

    The newest rows come from a row-number filter (a partial top-k per task
    before the shuffle); the last of them is the key's cut-off. Rows below it
    are returned, and of rows equal to it as many as are too many."""
    others = [c for c in df.columns if c not in (key, *order)]
    ranked = order + others
    place = F.struct(*[F.col(c) for c in ranked])
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in ranked])
    kept = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= keep)
    # all in the partitions of the row numbers: the cut-off, and how many kept rows equal it
    cut = (kept.withColumn("__last", F.min(place).over(Window.partitionBy(key)))
           .groupBy(F.col(key).alias("__key"))
           .agg(F.first("__last").alias("__last"), F.count_if(place.eqNullSafe(F.col("__last"))).alias("__kept")))
    joined = df.join(cut, F.col(key).eqNullSafe(F.col("__key")))
    below = joined.where(place < F.col("__last")).select(*df.columns)
    equal = (joined.where(place.eqNullSafe(F.col("__last"))).groupBy(*df.columns, "__kept")
             .agg(F.count(F.lit(1)).alias("__all")).where(F.col("__all") > F.col("__kept")))
    extra = equal.withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("__all") - F.col("__kept")).cast("int"))))
    return below.unionByName(extra.select(*df.columns))
