"""Near-duplicate lines by a join of deletion neighbourhoods.

Rule. A line's words are the runs without white space, A-Z lower-cased; in
scripts without spaces between words (Chinese, Japanese, Thai and so on) every
code point is a word. A line of at least ``MIN_WORDS`` words, or whose words
have at least ``MIN_BYTES`` bytes, is dropped if an earlier line has the same
words. Of lines with at least ``NEAR_WORDS`` words, one is also dropped if an
earlier one is at word edit distance 1 (one word put in, left out or
exchanged). Earlier is the smaller ``doc_id``, then the smaller line number.
All other lines stay.

Method. Equal lines are grouped to their earliest one, merged in each task
first. The lines left emit variants as hashed keys: themselves, and themselves
without one word. Lines that share a variant with the same place left out
differ in that place only; a line that equals another's variant lacks one of
its words. So the earliest partner of a line is a minimum per key, which is
merged in each task and never gathers a group, however many lines share a key.
The partner found is verified on the words themselves.

Only lines that can have a partner emit variants: one edit leaves the first or
the second half of a line whole, so lines none of whose halves occurs in
another line are set aside first (no line is lost by this).

Cases: null text has no lines and stays null; blank and short lines stay. Lines
end at a line feed. Rows with one ``doc_id`` are told apart by a hash of the
text; rows that repeat both are one document in the rule and get the same
result. A null id comes last. All columns are kept. An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bitmap, has_bit, pick, written
from quarry.llm.words import Runs, batches_of, units_of

MIN_WORDS = 3
MIN_BYTES = 12
NEAR_WORDS = 8
MARK_BITS = 26
LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """``id, row, text`` of every row with a text."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return pick(docs, "doc_id", "text").where(text.isNotNull()).select(
        F.coalesce(doc_id, F.lit(LAST)).alias("id"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))


def _place(line="line"):
    return F.struct("id", "row", F.col(line).alias("line"))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _lines(texts: list[bytes], least: int, least_bytes: int | None = None):
    """Of every line with at least ``least`` words, or ``least_bytes`` bytes in
    its words: text, number, first word, end, and the hashed runs of the words."""
    for start, w in batches_of(texts, units=True):
        owner, number, a, b = w.lines()
        ok = b - a >= least
        if least_bytes is not None:
            sizes = np.concatenate([[0], np.cumsum(w.end - w.start)])
            ok |= sizes[b] - sizes[a] >= least_bytes
        yield start + owner[ok], number[ok], a[ok], b[ok], Runs(w.hash)


def line_table(keyed: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``id, row, line, n, h, halves``: every line with its hash and, as far as
    it may have near partners, the hashes of its halves."""

    def work(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for owner, number, a, b, runs in _lines(texts, min_words, min_bytes):
                n = b - a
                keys = []
                # the halves of an own-length line, and of one that is a word shorter
                for size in (n, n - 1):
                    half = size // 2
                    keys += [runs.hashes(a, a + half) ^ (size.astype(np.uint64) * np.uint64(4)),
                             runs.hashes(b - (size - half), b) ^ (size.astype(np.uint64) * np.uint64(4) + np.uint64(1))]
                flat = np.stack(keys, axis=1).ravel() if len(n) else np.zeros(0, np.uint64)
                halves = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 4), _signed(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner]), pa.array(rows[owner]), pa.array(number.astype(np.int32)),
                     pa.array(n.astype(np.int32)), _signed(runs.hashes(a, b)), halves],
                    names=["id", "row", "line", "n", "h", "halves"])

    return keyed.mapInArrow(work, "id long, row long, line int, n int, h long, halves array<long>")


def numbered(wanted: DataFrame) -> DataFrame:
    """``id, row, line, no``: numbers in the order of the lines, from ranges
    that are sorted apart; written, so that they stay."""
    return written(wanted.repartitionByRange("id", "row", "line").sortWithinPartitions("id", "row", "line")
                   .withColumn("no", F.monotonically_increasing_id()), "numbered-lines")


def _bit(row, line):
    """A number for a line's place, the same in SQL and in numpy."""
    return (row ^ (line * 40503)) & (2 ** MARK_BITS - 1)


def wanted_lines(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``no, id, row, line, words``: the wanted lines (``id, row, line, no``) with
    their text. The texts are read once more, where they are; a bitmap of fixed size
    lets through the wanted lines and, the fuller it is, others, which the join then
    leaves out."""
    place = wanted.select(F.col("row").bitwiseXOR(F.col("line").cast("long") * 40503).bitwiseAND(2 ** MARK_BITS - 1).alias("bit"))
    marks = keyed.sparkSession.sparkContext.broadcast(bitmap(place, MARK_BITS))

    def work(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for owner, number, _, _, _ in _lines(texts, NEAR_WORDS):
                some = has_bit(marks.value, _bit(rows[owner], number.astype(np.int64)))
                owner, number = owner[some], number[some]
                split = {o: texts[o].split(b"\n") for o in np.unique(owner).tolist()}
                words = [split[o][n] for o, n in zip(owner.tolist(), number.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner]), pa.array(rows[owner]), pa.array(number.astype(np.int32)),
                     pa.array(words, pa.binary()).cast(pa.string())], names=["id", "row", "line", "words"])

    found = keyed.mapInArrow(work, "id long, row long, line int, words string")
    # rows that repeat id and text give a line twice
    return written(found.join(wanted, ["id", "row", "line"]).dropDuplicates(["no"]), "wanted-lines")


def variants(lines: DataFrame) -> DataFrame:
    """``at, key, gone``: the variants of lines (``no, words``) by their numbers;
    ``gone`` is the place of the word left out, -1 for the line itself."""

    def work(batches):
        for batch in batches:
            nos = batch.column(0).to_numpy()
            for start, w in batches_of(batch.column(1).cast(pa.binary()).to_pylist(), units=True):
                runs, a, b = Runs(w.hash), w.text[:-1], w.text[1:]
                no = nos[start:start + len(a)]
                n = b - a
                which = np.repeat(np.arange(len(n)), n)
                gone = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                keys = np.concatenate([runs.without(a[which], b[which], a[which] + gone), runs.hashes(a, b)])
                which = np.concatenate([which, np.arange(len(n))])
                gone = np.concatenate([gone, np.full(len(n), -1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(no[which]), _signed(keys), pa.array(gone.astype(np.int32))], names=["at", "key", "gone"])

    return lines.select("no", "words").mapInArrow(work, "at long, key long, gone int")


def _earlier(found: DataFrame) -> DataFrame:
    """The earliest partner of each line, if it is earlier than the line."""
    return (found.where("to < at").groupBy("at").agg(F.min("to").alias("to")))


def near_partners(near: DataFrame) -> DataFrame:
    """``at, to``: every line's number with that of the earliest earlier line at
    distance 1."""
    # one word exchanged: the same variant with the same place left out
    first = near.where("gone >= 0").groupBy("key", "gone").agg(F.min("at").alias("to"), F.max("at").alias("most"))
    swapped = near.join(first.where("to < most"), ["key", "gone"]).select("at", "to")
    # one word more or less: a line that equals a variant of another
    whole = near.where("gone < 0").select("key", F.col("at").alias("short"))
    longer = near.where("gone >= 0").groupBy("key").agg(F.min("at").alias("to"))
    less = near.where("gone >= 0").join(whole, "key").select("at", F.col("short").alias("to"))
    more = whole.join(longer, "key").select(F.col("short").alias("at"), "to")
    return _earlier(swapped.unionByName(less).unionByName(more))


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two word lists are at edit distance 1 at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _verified(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of numbers whose lines are at distance 1 word by word, as places."""
    side = lambda c: lines.select(F.col("no").alias(c), _place().alias(f"{c}_place"), F.col("words").alias(f"{c}_words"))
    both = pairs.join(side("at"), "at").join(side("to"), "to")
    same = F.pandas_udf(lambda a, b: _check(a, b), "boolean")
    return (both.where(same("at_words", "to_words"))
            .select(F.col("at_place").alias("at"), F.col("to_place").alias("to")).distinct())


def _check(a, b):
    import pandas as pd
    return pd.Series([within_one(units_of(x), units_of(y)) for x, y in zip(a, b)], dtype=bool)


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """``at, to, distance``: every line that the rule drops, with the line that
    stands for it (``id, row, line``)."""
    keyed = _keyed(docs)
    lines = written(line_table(keyed), "lines")
    first = lines.groupBy("h", "n").agg(F.min(_place()).alias("to"), F.count(F.lit(1)).alias("copies"))
    first = written(first, "distinct-lines")
    repeated = (lines.join(first.where("copies > 1"), ["h", "n"]).select(_place().alias("at"), "to")
                .where("to < at").withColumn("distance", F.lit(0)))
    # only the earliest of equal lines looks for near partners
    heads = (lines.where(F.col("n") >= NEAR_WORDS)
             .join(first.select("h", "n", "to"), ["h", "n"]).where(_place() == F.col("to"))
             .dropDuplicates(["id", "row", "line"])
             .select("id", "row", "line", "h", F.explode("halves").alias("half")))
    shared = heads.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    wanted = numbered(heads.join(shared, "half", "left_semi").select("id", "row", "line").distinct())
    texts = wanted_lines(keyed, wanted)
    near = written(variants(texts), "line-variants")
    pairs = written(near_partners(near), "line-pairs")
    return repeated.unionByName(_verified(texts, pairs).withColumn("distance", F.lit(1)))


def dedup_lines(docs: DataFrame, count_col: str | None = None) -> DataFrame:
    """``docs`` with the lines that the rule drops taken out of ``text``; all
    rows and columns stay. ``count_col`` adds the number of lines dropped."""
    gone = (duplicate_lines(docs).select("at.*").groupBy("id", "row")
            .agg(F.collect_set("line").alias("gone")))
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_col, text_col = (names[docs.columns.index(n)] for n in ("doc_id", "text"))
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    left = docs.toDF(*names)  # by place: no name can clash
    left = left.withColumn("id", F.coalesce(doc_id, F.lit(LAST))).withColumn("row", F.xxhash64(doc_id, text))
    joined = left.join(gone, ["id", "row"], "left").withColumn("all", F.when(F.col("gone").isNotNull(), F.split(text, "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.col("all")[i]), "\n")
    count = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return (joined.withColumn(text_col, F.when(F.col("gone").isNull(), text).otherwise(rest))
            .select(*names, *[count.alias("count") for c in [count_col] if c])
            .toDF(*docs.columns, *[c for c in [count_col] if c]))
