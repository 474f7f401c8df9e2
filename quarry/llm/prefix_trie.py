"""Trie of conversation prefixes, built as a Z-fast trie in tables.

Strings. Every conversation is rebuilt (see ``rebuilt``) and becomes the list of
the chained 128-bit digests of its prefixes: entry d tells its first d turns
from all others. Equal conversations are one string with a count.

Trie. Only compacted nodes are stored, one row per edge: the depths it covers
(``top``, ``ext``], the digests and byte sums along it. A node is found by the
digest of its *handle*, the prefix at the depth in (top, ext] that is divisible
by the highest power of two. A string's exit node is located by fat binary
search: look up the handle at the two-fattest depth of the open interval, go on
below the node if its whole extent is a prefix of the string, leave at it if
not, and above that depth if there is none. That is one hash join a step, and
about the logarithm of the longest conversation's steps. A batch then enters at
once: of the strings that would open the same new edge the first (in digest
order, so a random one) is inserted, edges are cut where strings leave them, and
the others are located again in the next batch. The expected number of batches
is logarithmic.

Sums over subtrees follow by pointer doubling over the compacted nodes (merged
in each task before the shuffle), and edges are expanded to one row per depth at
the end. A node's members are never gathered; ``ends_sha256`` is streamed over
blocks of ids that were joined in id order by range, so the largest group is
some long texts, not rows. One conversation's turns are one row of digests (24
bytes a turn), as a document's text is one row.

Cases: a null role or text is empty; rows without conv_id are in no conversation;
null turns come first, ties and repeated rows are all turns, in the order of a
digest of role and text. Long texts enter by digest and length. Other columns,
whatever their names, aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_text, pick, written

ROOT = bytes(16)
BLOCK_IDS = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
STRING = "end binary, depth long, path array<binary>, cum array<long>"


# -- strings ---------------------------------------------------------------------

def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns`` array<struct<digest, bytes>>: the first h turns of
    conversation ``c - c % 5``, then the conversation's own after its first h."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    role, text = as_text(F.col("role")), as_text(F.col("text"))
    own = (rows.where("conv_id is not null")
           .select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                   F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
                   F.octet_length(text).cast("long").alias("bytes"))
           .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "bytes"))).alias("own")))
    heads = own.select(F.col("conv_id").alias("head"), F.slice("own", 1, 8).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    both = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "head", "left")
    none = F.slice("own", 1, 0)
    turns = F.when(h == 0, F.col("own")).otherwise(
        F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))))
    return both.select("conv_id", turns.alias("turns"))


def _chain(batches):
    """Chained prefix digests and byte sums of each row's turns."""
    for batch in batches:
        ids, all_turns = batch.column(0), batch.column(1)
        path, cum = [], []
        for turns in all_turns.to_pylist():
            at, total, ps, cs = ROOT, 0, [], []
            for t in turns:
                at = hashlib.blake2b(at + t["digest"], digest_size=16).digest()
                total += t["bytes"]
                ps.append(at)
                cs.append(total)
            path.append(ps)
            cum.append(cs)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([p[-1] if p else ROOT for p in path], pa.binary()),
             pa.array([len(p) for p in path], pa.int64()),
             pa.array(path, pa.list_(pa.binary())), pa.array(cum, pa.list_(pa.int64()))],
            names=["conv_id", "end", "depth", "path", "cum"])


# -- Z-fast trie ------------------------------------------------------------------

def fattest(a: str, b: str) -> str:
    """The number in (a, b] divisible by the highest power of two, a < b."""
    return f"({b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1))"


def handles(edges: DataFrame) -> DataFrame:
    f = fattest("top", "ext")
    return edges.select(F.expr(f"element_at(path, cast({f} - top as int))").alias("handle"),
                        F.col("top").alias("v_top"), F.col("ext").alias("v_ext"),
                        F.element_at("path", -1).alias("v_id"))


def locate(strings: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """``end, depth, a, lcp, branch, e_ext, key`` of every string: the depth of the
    deepest node on its way, of the point where it leaves the trie, the edge that
    it leaves (by its first digest; null: none) with its end, and the digest that
    would open its new edge (null: the string ends at a node already)."""
    found = strings.selectExpr("end", "depth", "path", "0L as a", "depth as b")
    marks = handles(edges)
    for _ in range(steps):
        probe = found.withColumn("probe", F.expr(f"if(a < b, element_at(path, cast({fattest('a', 'b')} as int)), null)"))
        j = probe.join(marks, F.col("probe") == F.col("handle"), "left")
        through = "(v_ext <= depth and element_at(path, cast(least(v_ext, depth) as int)) = v_id)"
        found = j.selectExpr(
            "end", "depth", "path",
            f"case when v_id is null then a when {through} then v_ext else v_top end as a",
            # an interval is closed where the string leaves the node's edge
            f"case when v_id is not null and not {through} then v_top when probe is null then b "
            f"when v_id is null then {fattest('a', 'b')} - 1 else b end as b")
    opened = found.withColumn("out", F.expr("if(a < depth, element_at(path, cast(a + 1 as int)), null)"))
    table = edges.select(F.element_at("path", 1).alias("branch"), F.col("path").alias("edge"), F.col("ext").alias("e_ext"))
    j = opened.join(table, F.col("out") == F.col("branch"), "left")
    same = "coalesce(aggregate(zip_with(slice(path, cast(a + 1 as int), size(edge)), edge, (x, y) -> " \
           "if(x = y, 1L, 0L)), 0L, (s, x) -> s + coalesce(x, 0L)), 0L)"
    return (j.selectExpr("end", "depth", "path", "a", f"a + {same} as lcp", "branch", "e_ext")
            .selectExpr("end", "depth", "a", "lcp", "branch", "e_ext",
                        "case when a = depth then null when lcp = depth then end "
                        "else element_at(path, cast(lcp + 1 as int)) end as key"))


def inserted(edges: DataFrame | None, strings: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges with the chosen strings put in and cut where those leave them."""
    new = (chosen.join(strings.select("end", "path", "cum"), "end").where("lcp < depth").selectExpr(
        "lcp as top", "depth as ext",
        "if(lcp = 0, 0L, element_at(cum, cast(greatest(lcp, 1L) as int))) as base",
        "if(lcp = 0, cast(unhex(repeat('00', 16)) as binary), element_at(path, cast(greatest(lcp, 1L) as int))) as parent",
        "slice(path, cast(lcp + 1 as int), size(path)) as path",
        "slice(cum, cast(lcp + 1 as int), size(cum)) as cum"))
    if edges is None:
        return new
    cuts = (chosen.where("branch is not null and lcp > a and lcp < e_ext")
            .groupBy("branch").agg(F.array_sort(F.collect_set("lcp")).alias("cuts")))
    marked = (edges.withColumn("branch", F.element_at("path", 1)).join(cuts, "branch", "left").drop("branch")
              .withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>"))))
    pieces = marked.withColumn(
        "piece", F.explode(F.arrays_zip(F.expr("concat(array(top), cuts)").alias("lo"),
                                        F.expr("concat(cuts, array(ext))").alias("hi"))))
    old = pieces.selectExpr(
        "piece.lo as top", "piece.hi as ext",
        "if(piece.lo = top, base, element_at(cum, cast(greatest(piece.lo - top, 1L) as int))) as base",
        "if(piece.lo = top, parent, element_at(path, cast(greatest(piece.lo - top, 1L) as int))) as parent",
        "slice(path, cast(piece.lo - top + 1 as int), cast(piece.hi - piece.lo as int)) as path",
        "slice(cum, cast(piece.lo - top + 1 as int), cast(piece.hi - piece.lo as int)) as cum")
    return old.unionByName(new)


def build(strings: DataFrame) -> DataFrame:
    """The edges ``top, ext, base, parent, path, cum`` of the trie over distinct
    ``strings`` (``STRING`` columns)."""
    deepest = strings.agg(F.max("depth")).first()[0] or 0
    steps = int(deepest).bit_length() + 1
    edges = None
    waiting = strings.where("depth > 0")
    while True:
        if edges is None:
            at = waiting.selectExpr("end", "depth", "0L as a", "0L as lcp", "cast(null as binary) as branch",
                                    "cast(null as bigint) as e_ext", "element_at(path, 1) as key")
        else:
            at = locate(waiting, edges, steps)
        at = written(at.where("key is not null"), "trie-located")
        first = at.groupBy("key").agg(F.min(F.struct("end", "depth", "a", "lcp", "branch", "e_ext")).alias("s"))
        chosen = written(first.select("s.*"), "trie-chosen")
        edges = written(inserted(edges, strings, chosen), "trie-edges")
        left = written(at.join(chosen.select("end"), "end", "left_anti").select("end"), "trie-left")
        if left.isEmpty():
            return edges
        waiting = strings.join(left, "end")


# -- figures of the nodes ---------------------------------------------------------

SUMS = ("n", "leaves", "kb", "eb")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``id`` with the sums of ``SUMS`` and the least ``conv`` over its subtree,
    by pointer doubling; ``nodes`` has ``id, parent`` and the nodes' own values."""
    own = written(nodes, "trie-sums")
    while not own.where("parent is not null").isEmpty():
        up = (own.where("parent is not null").groupBy(F.col("parent").alias("id"))
              .agg(*(F.sum(c).alias(f"up_{c}") for c in SUMS), F.min("conv").alias("up_conv")))
        jump = own.select(F.col("id").alias("parent"), F.col("parent").alias("next")).where("next is not null")
        own = written(
            own.join(up, "id", "left").join(jump, "parent", "left")
            .select("id", F.col("next").alias("parent"),
                    *((F.col(c) + F.coalesce(f"up_{c}", F.lit(0))).alias(c) for c in SUMS),
                    F.least("conv", "up_conv").alias("conv")), "trie-sums")
    return own


def ends_digests(convs: DataFrame) -> DataFrame:
    """``end, sha``: SHA-256 of the ascending, comma-joined ids of each end."""

    def blocks(batches):
        key, first, ids = None, None, []
        for batch in batches:
            out = []
            for end, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end != key or len(ids) >= BLOCK_IDS:
                    if ids:
                        out.append((key, first, ",".join(map(str, ids))))
                    key, first, ids = end, c, []
                ids.append(c)
            yield _rows(out)
        if ids:
            yield _rows([(key, first, ",".join(map(str, ids)))])

    def _rows(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()),
             pa.array([r[2] for r in out], pa.string())], names=["end", "first", "ids"])

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            ends, shas = [], []
            for end, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end != key:
                    if sha:
                        ends.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = end, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(shas, pa.string())], names=["end", "sha"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["end", "sha"])

    joined = (convs.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
              .mapInArrow(blocks, "end binary, first long, ids string"))
    return (joined.repartition("end").sortWithinPartitions("end", "first").select("end", "ids")
            .mapInArrow(digest, "end binary, sha string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``."""
    convs = written(rebuilt(conversations).mapInArrow(_chain, "conv_id long, " + STRING), "trie-convs")
    groups = convs.groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    strings = written(convs.join(groups.select("conv_id", "n"), "conv_id").withColumnRenamed("conv_id", "conv"),
                      "trie-strings")
    edges = build(strings)
    ends = strings.selectExpr("end as id", "n", "conv", "n * if(depth = 0, 0L, element_at(cum, cast(greatest(depth, 1L) as int))) as kb")
    zero = "cast(unhex(repeat('00', 16)) as binary)"
    root = (strings.agg(F.count(F.lit(1)).alias("c")).where("c > 0").selectExpr(
        "-1L as top", "0L as ext", "0L as base", "cast(null as binary) as parent", f"array({zero}) as path", "array(0L) as cum"))
    nodes = edges.unionByName(root).withColumn("id", F.element_at("path", -1))
    children = edges.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "id", "left").fillna(0, ["n_children"]), "trie-nodes")
    own = (nodes.join(ends, "id", "left")
           .selectExpr("id", "parent", "coalesce(n, 0L) as n", "if(n_children = 0, 1L, 0L) as leaves",
                       "coalesce(kb, 0L) as kb", "element_at(cum, -1) - base as eb", "conv"))
    sums = subtree_sums(own).drop("parent")
    above = sums.select(F.col("id").alias("parent"), F.col("conv").alias("up"))
    shas = ends_digests(convs).withColumnRenamed("end", "id")
    full = nodes.join(sums, "id").join(shas, "id", "left").join(above, "parent", "left")
    return (full.select("*", F.posexplode("cum").alias("i", "here"))
            .withColumn("before", F.expr("if(i = 0, base, element_at(cum, cast(greatest(i, 1) as int)))"))
            .withColumn("last", F.expr("top + i + 1 = ext"))
            .selectExpr("conv as conv_id", "top + i + 1 as depth", "if(i = 0, up, conv) as parent_conv_id", "n as n_convs",
                        "if(last, n_children, 1L) as n_children", "leaves as n_leaves",
                        "kb - n * before - eb + (before - base) as saved_tokens",
                        f"if(last, coalesce(sha, '{EMPTY_SHA}'), '{EMPTY_SHA}') as ends_sha256"))
