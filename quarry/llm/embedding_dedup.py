"""Near-duplicate vectors by an inverted multi-index.

Method. Vectors are scaled to length 1; equal ones are one point with a count.
Each half of the components gets its own codebook (k-means on about
``SAMPLE_ROWS`` points, the operator's parameter), and a point lies in the cell
of the product grid that its two nearest codewords name. All points are in the
index, and every point is a query: it visits cells in the order of the
multi-sequence traversal, the sum of the two halves' squared distances to the
codewords. The number of visits is the least at which partners just at the
threshold, in random directions from sampled points, are met with a recall of
``TARGET``; a pair has two chances, as either end may visit the other's cell.

Queries and cells meet in blocks of at most ``BLOCK`` rows: a block of a cell's
members joins each block of queries that visit the cell, one matrix product
verifies all pairs in double precision, and only counts and a spanning forest of
the links leave it. A cell or group of any size is dealt out over its blocks.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing. Vectors of different lengths are indexed apart. Rows with a
null ``vec_id`` link too and take the smallest id of their component (null if
all are). Rows that repeat an id are separate vectors. An empty table gives no
rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.components import connected_components

COSINE = 0.95
TARGET = 0.97
SAMPLE_ROWS = 10_000
CELL_ROWS = 500
BLOCK = 512
ROUNDS = 10
PROBES = 1000


def units(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, point, d, unit``: the vector at length 1 as doubles, null if it
    can't link; equal vectors have one ``point``."""

    def work(batches):
        for batch in batches:
            out, dims = [], []
            for v in batch.column(2):
                x = np.array(v.as_py() or [], dtype=object)
                x = np.zeros(0) if any(c is None for c in x) else x.astype(float)
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(x).max() if len(x) else 0.0
                    ok = len(x) > 0 and np.isfinite(x).all() and top > 0
                    x = x / top if ok else x  # no overflow of the squares
                out.append((x / np.sqrt((x * x).sum())).tobytes() if ok else None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                names=["vec_id", "point", "d", "unit"])

    vector = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(vector).alias("point"),
                     vector.alias("v"))
    return rows.mapInArrow(work, "vec_id long, point long, d int, unit binary")


def squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k codewords of the rows, by Lloyd's iteration."""
    rng = np.random.default_rng(7)
    words = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = squares(x, words).argmin(1)
        count = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        full = count > 0
        words[full] = sums[full] / count[full][:, None]
    return words


def traverse(a: np.ndarray, b: np.ndarray, visits: int) -> list[int]:
    """Multi-sequence traversal: the first cells (i * len(b) + j) in the order of
    a[i] + b[j], from the two sorted sequences."""
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(float(a[first[0]] + b[second[0]]), 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(first[i]) * len(b) + int(second[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(a[first[p]] + b[second[q]]), p, q))
    return out


class Index:
    """Codebooks of the two halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, rows: int, cell_rows: int = CELL_ROWS, cosine: float = COSINE,
                 target: float = TARGET):
        self.half = sample.shape[1] // 2
        k = max(1, math.ceil(math.sqrt(rows / cell_rows)))
        self.books = [codebook(part, k) for part in (sample[:, :self.half], sample[:, self.half:])]
        self.visits = self._visits(sample[:PROBES], cosine, target)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(x[:, :self.half], self.books[0]), squares(x[:, self.half:], self.books[1])

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def _visits(self, x: np.ndarray, cosine: float, target: float) -> int:
        """Cells to visit so that partners just at the threshold, in random
        directions, are met with the target recall."""
        rng = np.random.default_rng(11)
        aside = rng.standard_normal(x.shape)
        aside -= (aside * x).sum(1)[:, None] * x
        size = np.linalg.norm(aside, axis=1)[:, None]
        other = cosine * x + math.sqrt(1 - cosine * cosine) * np.divide(aside, size, where=size > 0,
                                                                        out=np.zeros_like(aside))
        a, b = self.distances(x)
        at = self.home(other)
        ranks = []
        for p, q, cell in zip(a, b, at):
            i, j = divmod(int(cell), len(q))
            # cells before this one: for each first code, the second codes below the rest
            ranks.append(int(np.searchsorted(np.sort(q), p[i] + q[j] - p, side="left").sum()) + 1)
        ranks.sort()
        return ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)))]

    def cells(self, x: np.ndarray) -> list[list[int]]:
        return [traverse(p, q, self.visits) for p, q in zip(*self.distances(x))]


def fit(points: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> dict[int, Index]:
    """An index for every vector length, from a hash sample of its points."""
    found = {}
    for d, n in [(r["d"], r["count"]) for r in points.groupBy("d").count().collect()]:
        some = points.where(F.col("d") == d)
        if n > sample_rows:
            some = some.where(F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
        rows = sorted((r["point"], bytes(r["unit"])) for r in some.select("point", "unit").collect())
        found[d] = Index(np.array([np.frombuffer(u) for _, u in rows]).reshape(-1, d), n, **options)
    return found


def placed(points: DataFrame, index: dict[int, Index]) -> DataFrame:
    """Add ``home``, the point's cell, and ``visits``, the cells that it visits."""

    def work(batches):
        for batch in batches:
            home, visits = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            dims = batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.array([np.frombuffer(raw[i]) for i in at])
                home[at] = index[int(d)].home(x)
                for i, cells in zip(at, index[int(d)].cells(x)):
                    visits[i] = cells
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(home),
                 pa.array(visits, pa.list_(pa.int64()))], names=["point", "d", "unit", "weight", "home", "visits"])

    return points.select("point", "d", "unit", "weight").mapInArrow(
        work, "point long, d int, unit binary, weight long, home long, visits array<long>")


def blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a cell (``d, cell``) packed into lists of about ``BLOCK`` rows."""
    sizes = rows.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("size"))
    dealt = rows.join(sizes, ["d", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("point", F.lit(name)), F.ceil(F.col("size") / BLOCK)))
    cols = [c for c in rows.columns if c not in ("d", "cell")]
    return dealt.groupBy("d", "cell", "block").agg(
        *[F.collect_list(F.struct(*cols)).alias(name)]).drop("block")


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the smallest point of each component of a block's links."""
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(rows):
        return []
    small = links[np.ix_(rows, cols)]
    a, b = left[rows].copy(), right[cols].copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(small, b, top).min(1))
        nb = np.minimum(b, np.where(small, na[:, None], top).min(0))
        if (na == a).all() and (nb == b).all():
            break
        a, b = na, nb
    return list(zip(left[rows].tolist(), a.tolist())) + list(zip(right[cols].tolist(), b.tolist()))


def found_links(cells: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``u, v, n``: edges that span the links of all pairs of blocks (``n`` null),
    and shares of a point's number of links (``v`` null)."""
    members = blocks(cells.select("d", F.col("home").alias("cell"), "point", "unit", "weight", "visits"), "members")
    queries = blocks(cells.select("d", F.explode("visits").alias("cell"), "point", "unit", "weight", "home"),
                     "queries")

    def work(batches):
        for batch in batches:
            out: list[tuple] = []
            for m, q in zip(batch.column(0), batch.column(1)):
                m, q = m.values, q.values
                ids = [x.field("point").to_numpy() for x in (q, m)]
                weight = [x.field("weight").to_numpy() for x in (q, m)]
                x, y = (np.frombuffer(b"".join(v.field("unit").to_pylist())).reshape(len(v), -1) for v in (q, m))
                links = (x @ y.T >= cosine) & (ids[0][:, None] != ids[1])
                i, j = np.nonzero(links)
                if not len(i):
                    continue
                # a pair that both ends find is counted for each by its own visit
                visits = np.array(m.field("visits").to_pylist())
                home = q.field("home").to_numpy()
                back = np.zeros(len(i), bool)
                for at in range(0, len(i), 100_000):
                    s = slice(at, at + 100_000)
                    back[s] = (visits[j[s]] == home[i[s]][:, None]).any(1)
                n = np.bincount(i, weight[1][j], minlength=len(q)), np.bincount(
                    j[~back], weight[0][i[~back]], minlength=len(m))
                for k in (0, 1):
                    out += [(p, None, int(c)) for p, c in zip(ids[k].tolist(), n[k].tolist()) if c]
                out += [(u, v, None) for u, v in forest(links, *ids) if u != v]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v", "n"])

    return members.join(queries, ["d", "cell"]).select("members", "queries").mapInArrow(
        work, "u long, v long, n long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                    **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = written(units(df, id_col, vec_col), "units")
    points = written(rows.where("unit is not null").groupBy("point", "d").agg(
        F.first("unit").alias("unit"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id")),
        "vector-points")
    index = fit(points, cosine=cosine, **options)
    found = written(found_links(placed(points, index), cosine), "vector-links")
    parts = connected_components(found.where("v is not null"))
    counts = found.where("v is null").groupBy(F.col("u").alias("point")).agg(F.sum("n").alias("n"))
    named = written(points.join(parts, points["point"] == parts["node"], "left")
                    .select("point", "weight", "first_id", F.coalesce("component", "point").alias("part")), "parts")
    least = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    told = (named.join(least, "part").join(counts, "point", "left")
            .select("point", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    linked = rows.where("unit is not null").join(told, "point").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id",
                                            F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
