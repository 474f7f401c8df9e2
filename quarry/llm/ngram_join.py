"""Exact Jaccard self-join of documents on five-word shingles, by pivots.

Two documents link when 100 |A & B| >= 80 |A | B| for their sets of shingles;
the result is every document's connected component.

Method. The Jaccard distance 1 - |A & B| / |A | B| is a metric, and linked
documents are at most 0.2 apart. Equal sets are one point. Most other points
are at distance 1 from each other, and there a bisector between two pivots
leaves nothing out; so regions are opened where distances below 1 can be:

* A point belongs to the region of each of its first floor(0.2 n) + 1 shingles
  in a fixed order. Linked points share a region: if none of these were common,
  the points would be more than 0.2 apart. The order puts rare shingles first, by
  a table of bucket counts from all sets, so that passages shared by unlike
  documents open hardly any region. The table is of a fixed size; any order gives
  the same links.
* The smallest point of a region is its pivot. All members' distances to the
  pivot are found exactly. A member within 0.2 of its pivot links to it; the
  members of that ball are in one component and need no comparison.
* Regions whose members aren't all in one component by then are joined again,
  without their pivots. The number of a set's shingles is its distance from the
  empty set, and the triangle inequality keeps linked sets in one window of sizes
  or in neighbouring ones: members go to the window of their size, and as guests to
  the next one. A window of over ``BLOCK`` members is dealt to parts by hash; every
  two parts meet in a task's group of their own. Near copies share many regions, and
  a pair becomes a row in the first of them only, as told by each point's
  ``FIRST_KEYS`` smallest keys.
* Triangle inequality again: the numbers of a point's shingles in 256 fixed cells
  of the hash space are its distances from 256 fixed pivots up to a constant, so
  the L1 distance of two such vectors bounds |A ^ B| from below, and a pair is
  compared on its sets only if this bound leaves a link possible.

So no pair is dropped, and all distances are exact. Sets and shingles are
identified by 64-bit hashes.

Cases: null or empty texts, or texts of white space, have no shingles
(``n_shingles`` 0) and link with nothing. A text with one to four words is one
shingle. Rows with a null ``doc_id`` take part; ``component_id`` is the smallest
id that isn't null in the component, the row's own id if there is none. Rows
that repeat an id are separate points. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import as_text, bitmap, has_bit, pick, written
from quarry.llm.components import connected_components
from quarry.llm.words import Runs, batches_of, mix

SHINGLE = 5
PERCENT = 80
CELLS = 256
ORDER_BITS = 22
SAMPLE = 1  # the rarity of shingles is counted in every set
OFTEN = 3
HOT_LEVEL = 13
RARITY_BLOCK = 1 << 12
MARK_BITS = 26
BLOCK = 256
PAIR_CELLS = 1 << 14
FIRST_KEYS = 8


def outer_size(n):
    """The number of first shingles, in any order, of which a set shares one
    with every set that it links with: n - ceil(0.8 n) + 1."""
    return n - -(-n * PERCENT // 100) + 1


def inner_size(n):
    """The same for the smaller of two linked sets, against the larger one's
    outer ones: n - ceil(8 / 9 n) + 1."""
    return n - -(-n * 2 * PERCENT // (100 + PERCENT)) + 1


def sets_of(texts: list[bytes], shingle: int = SHINGLE):
    """Yield (first text, owner, hash, bounds) of runs of texts: all distinct
    shingles, sorted by text and hash, with the bounds of each text."""
    for start, w in batches_of(texts):
        runs = Runs(w.hash)
        a, b = w.text[:-1], w.text[1:]
        count = np.where(b - a >= shingle, b - a - shingle + 1, np.minimum(b - a, 1))
        owner = np.repeat(np.arange(len(a)), count)
        at = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(len(owner))
        h = runs.hashes(at, np.minimum(at + shingle, b[owner]))
        order = np.lexsort((h.view(np.int64), owner))
        owner, h = owner[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        owner, h = owner[new], h[new]
        yield start, owner, h, np.searchsorted(owner, np.arange(len(a) + 1))


def identity(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, equal for equal sets."""
    n = np.diff(ends)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends[1:]] - sums[ends[:-1]]) ^ mix(n.astype(np.uint64)))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), as_text(F.col("text"))
    return pick(docs, "doc_id", "text").select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))


def points(docs: DataFrame) -> DataFrame:
    """``doc_id, row, point, n, cells`` of every row; ``row`` identifies id and
    text, ``point`` the set."""

    def work(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for start, owner, h, ends in sets_of(texts):
                n = np.diff(ends)
                point = identity(h, ends)
                cells = np.bincount(owner * CELLS + (h & np.uint64(CELLS - 1)).astype(np.int64),
                                    minlength=len(n) * CELLS).reshape(len(n), CELLS)
                cells = np.minimum(cells, 255).astype(np.uint8)  # the bound holds of capped numbers too
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(n)), batch.column(1).slice(start, len(n)),
                     pa.array(point.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([c.tobytes() for c in cells], pa.binary())],
                    names=["doc_id", "row", "point", "n", "cells"])

    return keyed(docs).mapInArrow(work, "doc_id long, row long, point long, n long, cells binary")


def rarity(docs: DataFrame) -> np.ndarray:
    """A class of frequency for each of ``2 ** ORDER_BITS`` buckets of shingles, from
    all shingles of all sets: 0 for what is rare. It only puts the shingles in an
    order, and any order gives all links. A task adds its sets up in one table, whose
    blocks that aren't empty are exchanged."""
    size = 1 << ORDER_BITS
    block = min(size, RARITY_BLOCK)

    def count(batches):
        table = np.zeros(size, np.uint32)
        for batch in batches:
            for _, owner, h, ends in sets_of(batch.column(0).cast(pa.binary()).to_pylist()):
                # copies in one run of texts count once
                first = np.zeros(len(ends) - 1, bool)
                first[np.unique(identity(h, ends), return_index=True)[1]] = True
                np.add.at(table, h[first[owner]] >> np.uint64(64 - ORDER_BITS), np.uint32(1))
        blocks = table.reshape(-1, block)
        some = np.flatnonzero(blocks.any(1))
        for at in np.array_split(some, -(-len(some) // 64)) if len(some) else []:
            rows = [packed(blocks[i]) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(x, pa.binary()) for x in zip(*rows)]],
                                             names=["block", "places", "counts"])

    def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
        """Places, none if there are many, and counts, in a byte each if they fit."""
        places = np.flatnonzero(counts).astype(np.uint16)
        small = counts.astype(np.uint8) if counts.max() < 256 else counts
        return (places.tobytes(), small[places].tobytes()) if 3 * len(places) < block else (b"", small.tobytes())

    def often(at: int, total: np.ndarray) -> pa.RecordBatch:
        found = np.flatnonzero(total >= OFTEN)
        levels = np.frexp(total[found].astype(np.float64))[1]  # the binary digits of the counts
        return pa.RecordBatch.from_arrays([pa.array((at * block + found).astype(np.int32)), pa.array(levels.astype(np.int8))],
                                          names=["bucket", "level"])

    def add(batches):
        now, total = None, None
        for batch in batches:
            for at, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now:
                    if now is not None:
                        yield often(now, total)
                    now, total = at, np.zeros(block, np.int64)
                places = np.frombuffer(places, np.uint16) if places else np.arange(block)
                total[places] += np.frombuffer(counts, np.uint8 if len(counts) == len(places) else np.uint32)
        if now is not None:
            yield often(now, total)

    counts = pick(docs, "text").select(as_text(F.col("text")).alias("text")).mapInArrow(count, "block int, places binary, counts binary")
    levels = counts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "bucket int, level byte")
    table = np.zeros(size, np.uint8)
    found = written(levels, "rarity").toArrow()
    table[found.column("bucket").to_numpy()] = found.column("level").to_numpy()
    return table


def members(docs: DataFrame, order: np.ndarray, hot: bool) -> DataFrame:
    """``key, point, n``: the first ``outer_size(n)`` shingles of every document in
    the order of rarity, those of hot buckets or the others. ``n`` is the size of the
    set, negative for the first ``inner_size(n)`` shingles."""
    table = docs.sparkSession.sparkContext.broadcast(order)  # 2 ** ORDER_BITS bytes

    def work(batches):
        for batch in batches:
            for _, owner, h, ends in sets_of(batch.column(0).cast(pa.binary()).to_pylist()):
                n = np.diff(ends)
                point = identity(h, ends)
                level = table.value[h >> np.uint64(64 - ORDER_BITS)]
                # by owner and level; hashes are in order already
                ranked = np.argsort(owner * 256 + level, kind="stable")
                place = np.arange(len(h)) - ends[owner]
                some = (place < outer_size(n)[owner]) & ((level[ranked] >= HOT_LEVEL) == hot)
                of = owner[some]
                size = np.where(place[some] < inner_size(n)[of], -n[of], n[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[ranked][some].view(np.int64)), pa.array(point.view(np.int64)[of]), pa.array(size.astype(np.int32))],
                    names=["key", "point", "n"])

    rows = pick(docs, "text").select(as_text(F.col("text")).alias("text"))
    return rows.mapInArrow(work, "key long, point long, n int")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row, shingles`` (sorted hashes) of the wanted rows (``row``), from their texts.
    A bitmap of fixed size tells the rows apart where the texts are read, so that neither
    texts nor sets are moved here; it may let some rows through besides."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, MARK_BITS))

    def work(batches):
        for batch in batches:
            some = np.flatnonzero(has_bit(bits.value, batch.column(0).to_numpy()))
            rows = batch.column(0).take(pa.array(some))
            for start, _, h, ends in sets_of(batch.column(1).take(pa.array(some)).cast(pa.binary()).to_pylist()):
                n = np.diff(ends)
                yield pa.RecordBatch.from_arrays([rows.slice(start, len(n)), _lists(h, n)], names=["row", "shingles"])

    # rows that repeat id and text give a set twice; pairs are made distinct after
    return written(keyed(docs).select("row", "text").mapInArrow(work, "row long, shingles array<long>"), "shingle-sets")


def among(known: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of ``known`` (``point`` and more) whose point may be in the one column of
    ``some``: all that are, and what a bitmap of fixed size lets through besides. The join
    that leaves that out moves few rows then."""
    bits = known.sparkSession.sparkContext.broadcast(bitmap(some, MARK_BITS))

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits.value, batch.column(0).to_numpy())))

    return known.mapInArrow(work, known.schema)


def cells_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(np.int16).reshape(-1, CELLS)


def may_link(n: np.ndarray, cells: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the sizes and cells of sets leave a link possible: |A ^ B| <=
    0.2 |A | B|, where |A | B| = (|A| + |B| + |A ^ B|) / 2."""
    apart = np.abs(cells - others).sum(-1, dtype=np.int64)
    return ((np.minimum(n, m).astype(np.int64) * 100 >= np.maximum(n, m).astype(np.int64) * PERCENT)
            & (apart * (200 - (100 - PERCENT)) <= (100 - PERCENT) * (n.astype(np.int64) + m)))


def near(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct pairs ``a, b`` whose sizes and cells leave a link possible."""

    def work(batches):
        for batch in batches:
            n = [batch.column(i).to_numpy() for i in (2, 4)]
            ok = may_link(n[0], cells_of(batch.column(3)), n[1], cells_of(batch.column(5)))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    def side(p, *cols):
        return known.select(F.col("point").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in cols])

    # sizes first: they alone rule out most pairs
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    pairs = written(pairs.distinct().join(side("a", "n"), "a").join(side("b", "n"), "b").where(fits), "sized-pairs")
    known = among(known.select("point", "cells"), ends_of(pairs))
    return (pairs.join(side("a", "cells"), "a").join(side("b", "cells"), "b")
            .select("a", "b", "n_a", "cells_a", "n_b", "cells_b")
            .mapInArrow(work, "a long, b long"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("point")).unionByName(pairs.select(F.col("b").alias("point"))).distinct()


def verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets. ``rows``: the ``point, row`` of their
    ends, ``sets``: ``row, shingles``."""

    def side(p, of):
        return rows.select(F.col("point").alias(p), F.col("row").alias(of))

    placed = pairs.join(side("a", "row_a"), "a").join(side("b", "row_b"), "b")
    both = (placed.join(sets.select(F.col("row").alias("row_b"), F.col("shingles").alias("y")), "row_b")
            .join(sets.select(F.col("row").alias("row_a"), F.col("shingles").alias("x")), "row_a"))

    common = F.size(F.array_intersect("x", "y"))
    ok = 100 * common >= PERCENT * (F.size("x") + F.size("y") - common)
    return written(both.where(ok).select("a", "b"), "jaccard-links")


def _bounds() -> list:
    """Of a region: its pivot, and its smallest and largest member."""
    point = F.col("point")
    return [(F.min(F.when(F.col("n") < 0, point)), "pivot"), (F.min(point), "lo"), (F.max(point), "hi")]


def regions_of(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """``key, point, n, pivot`` of the members whose region has another point as
    pivot, the smallest of its inner ones. A key that one point alone has opens no
    region. Rare keys are brought together once and looked through in place; hot ones,
    which may be any number of rows, are grouped in each task first, and their join is
    one that Spark can split."""
    of = W.partitionBy("key")
    rows = members(docs, order, False).select("*", *[c.over(of).alias(x) for c, x in _bounds()])
    if (order >= HOT_LEVEL).any():
        hot = written(members(docs, order, True), "hot-members")
        groups = hot.groupBy("key").agg(*[c.alias(x) for c, x in _bounds()])
        rows = rows.unionByName(hot.join(groups.where("lo < hi"), "key"))
    # without a pivot no member is inner, and no pair depends on the region
    return written(rows.where("pivot is not null and lo < hi and point <> pivot")
                   .select("key", "point", F.abs("n").alias("n"), "pivot").distinct(), "regions")


def others(regions: DataFrame) -> DataFrame:
    """``key, point, n`` of the regions that have several members besides the pivot,
    which is compared with all, and done."""
    several = regions.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    return regions.select("key", "point", "n").join(several, "key")


def star(regions: DataFrame) -> DataFrame:
    """The pairs of pivots and members that their sizes allow to link."""
    return regions.select(F.col("pivot").alias("a"), F.col("point").alias("b"))


def several_parts(marked: DataFrame) -> DataFrame:
    """The members, with their component, of regions that hold several. Of regions
    with the same members one is kept."""
    several = marked.groupBy("key").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("size"),
        F.min("point").alias("first"), F.max("point").alias("last"),
        F.bit_xor(F.xxhash64("point")).alias("told")).where("lo <> hi")
    one = several.groupBy("size", "first", "last", "told").agg(F.min("key").alias("key")).select("key", "size")
    return written(marked.join(one, "key"), "open-regions")


def open_regions(members: DataFrame, links: DataFrame) -> DataFrame:
    """The same, after the components of ``links`` are found."""
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    marked = (members.join(parts, members["point"] == parts["node"], "left")
              .withColumn("part", F.coalesce("component", "point")).drop("node", "component"))
    return several_parts(marked)


def window(n) -> F.Column:
    """The size window of a set; linked sets are in one window or in neighbours."""
    return F.floor(F.log(n) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")


def window_pairs(rest: DataFrame) -> DataFrame:
    """``a, b``: the pairs of members of a region (``key, point, n, part, cells``) that
    are in different components and whose sizes and cells leave a link possible."""
    return window_meetings(rest).distinct()


def window_meetings(rest: DataFrame) -> DataFrame:
    """The same, before they are made distinct; only pairs that may link become rows, and
    those of near copies, which meet in many regions, once. A member goes to its own window
    and, as a guest, to the next one; a window of over ``BLOCK`` members is dealt to parts by
    hash, and each pair of parts meets in a group of its own."""
    homes = rest.select("key", "point", "n", "part", window(F.col("n")).alias("w"))
    counted = homes.groupBy("key", "w").agg(F.count(F.lit(1)).alias("k")).select(
        "key", "w", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts"))
    slot = F.pmod(F.xxhash64("point", F.lit(7)), F.col("parts")).cast("int")
    home = homes.join(counted, ["key", "w"]).withColumn("own", slot)
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    member = ["point", "n", "part"]
    # a part meets itself and every later one: it goes to the groups (own, x) and (x, own)
    rows = home.select("key", "w", F.explode(F.transform(each, lambda x: F.struct(
        F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))).alias("g"), F.lit(False).alias("guest"), "own", *member)
    guests = (homes.withColumn("w", F.col("w") + 1).join(counted, ["key", "w"])
              .select("key", "w", F.explode(F.transform(each, lambda x: F.struct(x.alias("i"), x.alias("j")))).alias("g"),
                      F.lit(True).alias("guest"), F.lit(-1).alias("own"), *member))
    # a point's keys are at most as many as its shingles
    told = rest.groupBy("point").agg(F.first("cells").alias("cells"), F.slice(
        F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("first"))

    def work(batches):
        held, key = [], None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)] + [cells_of(batch.column(9)), first_keys(batch.column(10))]
            group = np.stack([cols[i].astype(np.int64) for i in range(4)], 1)
            cut = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(group)]):
                if x == y:
                    continue
                now = tuple(group[x].tolist())
                if now != key:
                    yield from _pairs(held)
                    held, key = [], now
                held.append([c[x:y] for c in cols])
        yield from _pairs(held)

    both = rows.unionByName(guests).select("key", "w", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "guest", "own", *member)
    both = both.join(told, "point").select("key", "w", "i", "j", "guest", "own", *member, "cells", "first")
    return (both.repartition("key", "w", "i", "j").sortWithinPartitions("key", "w", "i", "j")
            .mapInArrow(work, "a long, b long"))


def first_keys(column: pa.Array) -> np.ndarray:
    """Lists of up to ``FIRST_KEYS`` keys as a matrix, filled up with the largest number."""
    out = np.full((len(column), FIRST_KEYS), np.iinfo(np.int64).max)
    out[np.arange(FIRST_KEYS) < column.value_lengths().to_numpy()[:, None]] = column.flatten().to_numpy()
    return out


def met_before(key: np.ndarray, first: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether pairs meet in a region of a smaller key too, by the smallest keys of both."""
    return ((first[:, :, None] == others[:, None, :]) & (first < key[:, None])[:, :, None]).any((1, 2))


def _pairs(held: list):
    """The pairs of one group: a member of its first part with one of its second,
    or with a guest."""
    if not held:
        return
    key, _, i, j, guest, own, point, n, part, cells, firsts = (np.concatenate(c) for c in zip(*held))
    first = np.flatnonzero(~guest & (own == i[0]))
    second = np.flatnonzero(~guest & (own == j[0]))
    visitors = np.flatnonzero(guest)
    for left, right in ((first, second), (first, visitors)):
        if not len(right):
            continue
        step = max(1, PAIR_CELLS // len(right))
        for at in range(0, len(left), step):
            l = left[at:at + step]
            fits = part[l][:, None] != part[right]
            if right is second and i[0] == j[0]:
                fits &= point[l][:, None] < point[right]
            x, y = np.nonzero(fits)
            x, y = l[x], right[y]
            ok = may_link(n[x], cells[x], n[y], cells[y])
            x, y = x[ok], y[ok]
            ok = ~met_before(key[x], firsts[x], firsts[y])
            a, b = point[x[ok]], point[y[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def jaccard_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: links between different points that give the components.
    ``rows``: as from ``points``."""
    known = written(rows.select("point", "row", "n", "cells").dropDuplicates(["point"]), "distinct-points")

    def verify(pairs):
        pairs = written(pairs, "jaccard-pairs")
        rows = written(known.select("point", "row").join(ends_of(pairs), "point"), "wanted")
        return verified(pairs, rows, shingle_sets(docs, rows.select("row")))

    regions = regions_of(docs, rarity(docs))
    links = verify(near(star(regions), known))
    rest = open_regions(others(regions), links)
    cells = among(known.select("point", "cells"), rest.select("point"))
    return links.unionByName(verify(window_pairs(written(rest.join(cells, "point"), "open-members"))))


def jaccard_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``points`` of all rows, and ``point, part`` with the component of
    every point that has shingles."""
    rows = written(points(docs), "points")
    full = rows.where("n > 0")
    links = jaccard_links(docs, full)
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    some = full.select("point").distinct()
    named = some.join(parts, some["point"] == parts["node"], "left").select(
        "point", F.coalesce("component", "point").alias("part"))
    return rows, written(named, "components")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    rows, parts = jaccard_parts(docs)
    # copies of a text are one row of their point before anything is joined
    first = rows.where("n > 0").groupBy("point").agg(F.min("doc_id").alias("first_id"))
    named = first.join(parts, "point")
    least = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    ids = written(named.join(least, "part").select("point", "component_id"), "component-ids")
    return (rows.join(ids, "point", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component, that of the smallest ``doc_id``
    (null last); rows without shingles stay. All columns are kept."""
    rows, parts = jaccard_parts(docs)
    slim = rows.where("n > 0").groupBy("row", "point", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    slim = written(slim.join(parts, "point"), "rows-of-components")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = slim.groupBy("part").agg(F.min(order).alias("best")).select("part", F.col("best.row").alias("best"))
    marked = written(slim.join(best, "part").select("row", "copies", (F.col("row") == F.col("best")).alias("stays")),
                     "marked-rows")
    gone = written(marked.where(~F.col("stays") | (F.col("copies") > 1)).select("row"), "gone-rows")
    names = [f"c{i}" for i in range(len(docs.columns))]
    placed = docs.toDF(*names)  # by place: no name can clash
    doc_id, text = (F.col(names[docs.columns.index(n)]) for n in ("doc_id", "text"))
    placed = placed.withColumn("row", F.xxhash64(doc_id.cast("long"), as_text(text)))
    left = placed.join(gone, "row", "left_anti").select(*names)
    again = marked.where(F.col("stays") & (F.col("copies") > 1)).select("row")
    if not again.isEmpty():
        # rows that repeat id and text: one of them stays
        left = left.unionByName(placed.join(again, "row", "left_semi").dropDuplicates(["row"]).select(*names))
    return left.toDF(*docs.columns)
