"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame only).

Method. Every row is reduced to the SHA-256 of its normalised text, a second
hash and the normalised length that verify it, its length, id and row number.
Each input partition is one run, in which rows of equal text are merged into
one entry: the entry that stays and the number of rows. Then runs are merged in
binomial rounds: in round r the runs that agree in their number without the
last ``3 r`` bits exchange entries by digest, and entries of equal text merge.
A text holds at most one entry per run at each level, so a group of copies of
any size shrinks with the runs and is never gathered. After the last round one
run is left, dealt by digest over all tasks; its entries are joined back to the
slim rows. Texts are read once and never shuffled.

Cases: null text counts as empty; empty texts are equal. Among equal texts the
row with the most code points stays, then the smallest ``doc_id`` (null last),
then the first row; so of rows repeated with the same id exactly one has
``kept``. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_text, pick, written

#: runs merged into one per round, as a power of two
FAN_BITS = 3
#: groups with over one part in so many of all rows
HOT_GROUPS = 1000
#: fixed value: the characters that don't count, tab to carriage return and blank
WHITE = "[\\x20\\x09-\\x0D]+"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The slim row of every document, with the number of its run."""
    text = as_text(F.col(text_col))
    bare = F.regexp_replace(text, WHITE, "")
    return (pick(df, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), bare.alias("b"))
            .select("doc_id", F.unhex(F.sha2("b", 256)).alias("digest"),
                    F.xxhash64(F.length("b"), "b").alias("proof"), F.length("t").cast("long").alias("n"),
                    F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run")))


def _order():
    """Smaller stays: more code points, then the smaller id (null last), then the earlier row."""
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"),
                    F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))


def merge_runs(slim: DataFrame, runs: int) -> DataFrame:
    """``digest, proof, best, size`` for every distinct text."""
    entries = (slim.groupBy("run", "digest", "proof")
               .agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("size")))
    left = max(1, runs)
    while left > 1:
        left = -(-left // (1 << FAN_BITS))
        entries = (entries.withColumn("run", F.shiftright("run", FAN_BITS))
                   .groupBy("run", "digest", "proof")
                   .agg(F.min("best").alias("best"), F.sum("size").alias("size")))
    return entries.groupBy("digest", "proof").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    slim = written(digests(df, id_col, text_col), "digests")
    last, total = slim.agg(F.max("run"), F.count(F.lit(1))).first()
    groups = written(merge_runs(slim, (last or 0) + 1), "distinct-texts")
    # groups of so many rows are HOT_GROUPS at most: their rows are looked up where they
    # are, and get a key of their own in the join that finds the others
    hot = groups.where(F.col("size") > total / HOT_GROUPS).select("digest", "proof", F.struct("best", "size").alias("hot"))
    rows = slim.join(F.broadcast(hot), ["digest", "proof"], "left")
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.col("row").cast("string"))))
    found = groups.select(F.col("digest").alias("found_key"), F.col("proof").alias("check"), F.struct("best", "size").alias("cold"))
    group = F.coalesce("hot", "cold")
    return rows.withColumn("key", key).join(
        found, (F.col("key") == F.col("found_key")) & (F.col("proof") == F.col("check")), "left").select(
        "doc_id", group["best"]["doc_id"].alias("keep_id"), group["size"].alias("group_size"),
        (F.col("row") == group["best"]["row"]).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
