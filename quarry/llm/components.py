"""Connected components of a distributed graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """From ``u long, v long`` to ``node, component`` (the smallest node that it
    reaches) for every node with an edge to another. Null ends are left out.

    A large star links each node's larger neighbours to its smallest one, a
    small star its smaller neighbours; the two alternate until nothing changes,
    after about the logarithm of the longest path rounds. Every round is
    written to the shared folder. A node's neighbours are never gathered: only
    their minimum is, merged in each task first.
    """
    down = written(edges.where("u is not null and v is not null and u <> v")
                   .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    told = _state(down)
    while told[0]:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = (pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        down = written(small, "small-star")
        now = _state(down)
        if now == told:
            break
        told = now
    ends = down.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    """A number of edges and an order-free checksum of them."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.max("u"), F.max("v")).first()
    return tuple(r)
