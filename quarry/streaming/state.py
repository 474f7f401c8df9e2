"""A state of mergeable counts on a shared folder, compacted level by level.

Every micro-batch adds one segment per table, a folder of Parquet. When a level
has ``FAN`` segments they are added up into one segment of the next level, so
after n batches there are some ``FAN`` log(n) segments, and every count has been
rewritten log(n) times. A manifest names the segments that hold and the last
batch; manifests are numbered, written whole, and never changed, so a reader sees
one consistent state and a batch that is replayed after its manifest changes
nothing. A batch that failed before its manifest leaves folders that nothing names;
its replay overwrites them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

FAN = 8


class SegmentedState:
    def __init__(self, spark: SparkSession, path: str, merges: dict[str, Callable[[DataFrame], DataFrame]]):
        """``merges``: per table, how the union of segments becomes one."""
        self.spark, self.path, self.merges = spark, path.rstrip("/"), merges

    # -- files -----------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> dict:
        """``last``: the last batch that is in; ``segments``: [level, first, last];
        ``gone``: segments that the manifest before this one still names."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "last": -1, "segments": [], "gone": []}
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{versions[-1]}").collect()
        return json.loads(rows[0]["value"])

    def _write_manifest(self, manifest: dict) -> None:
        fs, p = self._fs(f"{self.path}/manifest/.{manifest['version']}.new")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest/{manifest['version']}")
        if not fs.rename(p, final):
            raise RuntimeError(f"manifest {manifest['version']} of {self.path} is there already")

    def folder(self, table: str, segment: list[int]) -> str:
        return f"{self.path}/{table}/" + "-".join(map(str, segment))

    # -- batches -----------------------------------------------------------------
    def add(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """Put a batch in, once."""
        old = self.manifest()
        if batch_id <= old["last"]:
            return
        new = [0, batch_id, batch_id]
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(self.folder(name, new))
        segments, gone = [*old["segments"], new], []
        level = 0
        while len(full := [s for s in segments if s[0] == level]) >= FAN:
            merged = [level + 1, min(s[1] for s in full), max(s[2] for s in full)]
            for name, frame in tables.items():
                self._merged(name, full, frame.schema).write.mode("overwrite").parquet(self.folder(name, merged))
            segments = [s for s in segments if s[0] != level] + [merged]
            gone += full
            level += 1
        self._write_manifest({"version": old["version"] + 1, "last": batch_id, "segments": segments, "gone": gone})
        # what the manifest before the last still named has no reader to come
        for s in old["gone"]:
            for name in tables:
                fs, p = self._fs(self.folder(name, s))
                fs.delete(p, True)

    def _merged(self, name: str, segments: list[list[int]], schema) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(self.folder(name, s)) for s in segments]
        return self.merges[name](reduce(DataFrame.unionByName, parts))

    def read(self, name: str, schema) -> DataFrame:
        """The table of all batches that are in."""
        segments = self.manifest()["segments"]
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self._merged(name, segments, schema)
