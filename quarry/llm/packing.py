"""Best-fit decreasing packing of tokenized documents into windows.

Method. Every document's ids (with the closing id) are cut into full windows
and one rest. A full window is a sequence of its own. The rests are dealt
evenly over shards of about ``SHARD_PIECES`` pieces (lengths and digests only,
no ids); in a shard the pieces are taken from the longest to the shortest, and
a segment tree indexed by remaining capacity finds the open window with the
least room that still holds the piece. Only each shard's last windows can stay
open, so padding is a small share whatever the size of the input. The pieces
are written to the shared folder before they are dealt out, so that a re-run
of a lost task reads the same rows and gives the same sequence ids.

Cases: a null or empty text has the closing id only and is packed as a piece of
length 1. A text of any length is cut; pieces of a document may lie in any
sequences. Repeated rows are packed each. A null ``doc_id`` stays null. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.byte_bpe import loaded, vocabulary
from quarry.llm.common import pick, written

WINDOW = 2048
CLOSING_ID = 1
SHARD_PIECES = 20_000
ROWS = 1000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Windows:
    """Open windows, found by remaining capacity: leaf c of a binary tree
    counts the windows with room c, an inner node those below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def add(self, room: int, window: int) -> None:
        if room:
            self.open[room].append(window)
            self._change(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``length``."""
        node = length + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every piece; the order of equal lengths is
    their order in ``lengths``."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = Windows(capacity)
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        found = room.tightest(size)
        if found is None:
            found, n = (capacity, n), n + 1
        left, window[i] = found
        offset[i] = capacity - left
        room.add(left - size, window[i])
    return window, offset


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW, closing_id: int = CLOSING_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize and cut: one row per piece (with ``ids``, little-endian unsigned
    32-bit, if ``keep_ids``)."""
    vocab = vocabulary(df, path)

    def work(batches):
        bpe = loaded(vocab.value, special=True)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            keys = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = []
            for i, parts in bpe.encode_many(texts):
                ids = np.concatenate([*parts, [closing_id]]).astype("<u4")
                for at in range(0, len(ids), window):
                    raw = ids[at:at + window].tobytes()
                    rows.append((keys[i], at, len(raw) // 4, zlib.crc32(raw), len(ids)) + (raw,) * keep_ids)
            names = [f.split()[0] for f in PIECE.split(", ")] + ["ids"] * keep_ids
            types = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    narrow = pick(df, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(work, PIECE + ", ids binary" * keep_ids)


def pack(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces."""
    cut = written(cut, "pieces")
    rests = cut.where(F.col("length") < window)
    shards = max(1, math.ceil(rests.count() / shard_pieces))

    def work(frames):
        part = [x for x in frames if len(x)]
        if not part:
            return
        x = pd.concat(part, ignore_index=True)
        x = x.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        number, offset = best_fit_decreasing(x["length"].to_numpy(np.int64), window)
        # rests have the odd sequence ids, full windows the even ones
        x["sequence_id"] = ((TaskContext.get().partitionId() << 32) + number) * 2 + 1
        x["offset"] = offset
        yield x

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    packed = rests.repartition(shards).mapInPandas(work, schema)
    full = (cut.where(F.col("length") >= window)
            .withColumn("sequence_id", F.monotonically_increasing_id() * 2)
            .withColumn("offset", F.lit(0).cast("long")))
    return full.unionByName(packed)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The token sequences of packed pieces that carry ``ids``: ``sequence_id,
    n_tokens, ids`` padded to the window unless the length is a power of two."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    n = F.col("n_tokens")
    short = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n).cast("int")
    pad = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', {window})"))
    return out.select("sequence_id", "n_tokens", F.concat(joined, F.substring(pad, F.lit(1), short * 4)).alias("ids"))


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, closing_id: int = CLOSING_ID, keep_ids: bool = False) -> DataFrame:
    return pack(pieces(df, path, id_col, text_col, window, closing_id, keep_ids), window)
