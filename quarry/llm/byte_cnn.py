"""Document quality by a convolutional network over bytes, in numpy.

Method. A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap
by ``OVERLAP``, so that they cover the whole document and no window is lost at a
cut. In a chunk every byte has a learned vector; ``FILTERS`` learned filters,
``2 * STRIDE`` bytes wide, move in steps of ``STRIDE``; rectified, their largest
values over the chunk are its features. The mean and the maximum of the chunks'
features and the logarithm of the length go through a hidden layer into one
probability. Long texts are taken some chunks at a time, with running sums.

The fit sees about ``SAMPLE_ROWS`` labelled rows, a hash sample of the ids whose
crc32 isn't held out (``FOLDS``), with at most ``SAMPLE_CHUNKS`` chunks of each,
spread over the whole text; these bounds are parameters, and of them the driver
gets some 25 MB. It takes ``STEPS`` Adam steps over shuffled rows; the rarer
label counts more, by the root of the classes' ratio. Scoring reads every byte
of every text on the executors. Labels, ids, language and source are never
inputs of a score.

Cases: a null or empty text has no chunk, zero features and the score of that;
a null id counts as the empty text for ``held_out``. Of several labels of one id
the largest counts; null labels and others than 0 and 1 don't. If one of the
classes is missing, the score is the smoothed share of label 1. Repeated rows
get equal scores; other columns, whatever their names, aren't read. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_text, pick

SAMPLE_ROWS = 8000
SAMPLE_CHUNKS = 6
FOLDS = 5
THRESHOLD = 0.3
CHUNK, OVERLAP = 512, 32
STRIDE = 4
WIDTH = 8
FILTERS = 48
HIDDEN = 24
STEPS = 700
BATCH = 48
RATE = 3e-3
L2 = 1e-4
BLOCK_CHUNKS = 256
SEED = 13


def chunk_starts(size: int) -> np.ndarray:
    """Of chunks that cover ``size`` bytes."""
    step = CHUNK - OVERLAP
    return np.arange(0, max(1, size - OVERLAP), step) if size else np.zeros(0, np.int64)


def chunks_of(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Chunks as rows of byte values, 256 beyond the end of the text."""
    data = np.full(int(starts[-1]) + CHUNK - int(starts[0]) if len(starts) else 0, 256, np.int16)
    if len(starts):
        part = np.frombuffer(text[int(starts[0]):int(starts[-1]) + CHUNK], np.uint8)
        data[:len(part)] = part
    return data[(starts - starts[:1])[:, None] + np.arange(CHUNK)]


@dataclass
class Network:
    """The weights; some 30 kB, whatever the data."""

    p: dict[str, np.ndarray]
    share: float | None = None  # the score of all texts, if there was nothing to learn

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        embed = normal(257, WIDTH, scale=0.5)
        embed[256] = 0
        inputs = 2 * FILTERS + 1
        return cls({"embed": embed, "conv": normal(2, STRIDE * WIDTH, FILTERS, scale=(2 * STRIDE * WIDTH) ** -0.5),
                    "bias": np.zeros(FILTERS, np.float32), "hidden": normal(inputs, HIDDEN, scale=inputs ** -0.5),
                    "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=HIDDEN ** -0.5),
                    "out_bias": np.zeros(1, np.float32)})

    def filtered(self, chunks: np.ndarray) -> np.ndarray:
        """Rectified filters at every place: (chunks, places, filters)."""
        x = self.p["embed"][chunks].reshape(len(chunks), CHUNK // STRIDE, STRIDE * WIDTH)
        y = x[:, :-1] @ self.p["conv"][0]
        y += x[:, 1:] @ self.p["conv"][1]
        y += self.p["bias"]
        return np.maximum(y, 0, out=y)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum of the chunks' features and the length, per text."""
        out = np.zeros((len(texts), 2 * FILTERS + 1), np.float32)
        count = np.zeros(len(texts), np.int64)

        def add(owners, chunks):
            z = self.filtered(np.concatenate(chunks)).max(1)
            owner = np.repeat(owners, [len(c) for c in chunks])
            np.add.at(out[:, :FILTERS], owner, z)
            np.maximum.at(out[:, FILTERS:-1], owner, z)

        owners, chunks, held = [], [], 0
        for i, text in enumerate(texts):
            starts = chunk_starts(len(text))
            count[i] = len(starts)
            for a in range(0, len(starts), BLOCK_CHUNKS):
                owners.append(i)
                chunks.append(chunks_of(text, starts[a:a + BLOCK_CHUNKS]))
                held += len(chunks[-1])
                if held >= BLOCK_CHUNKS:
                    add(owners, chunks)
                    owners, chunks, held = [], [], 0
        if held:
            add(owners, chunks)
        out[:, :FILTERS] /= np.maximum(count, 1)[:, None]
        out[:, -1] = length_feature(np.array([len(t) for t in texts], float))
        return out

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(features @ self.p["hidden"] + self.p["hidden_bias"], 0)
        return h, h @ self.p["out"] + self.p["out_bias"][0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        margin = self.head(self.pooled(texts))[1].astype(float)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted logistic loss over a batch; ``owner`` ascends and has
        every text."""
        n = len(y)
        places = self.filtered(chunks)
        at = places.argmax(1)
        z = np.take_along_axis(places, at[:, None], 1)[:, 0]
        first = np.searchsorted(owner, np.arange(n))
        count = np.diff(np.append(first, len(owner)))[:, None].astype(np.float32)
        top = np.maximum.reduceat(z, first, 0)
        features = np.concatenate([np.add.reduceat(z, first, 0) / count, top, length_feature(sizes)[:, None]], 1)
        h, margin = self.head(features)
        d = ((1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) * weight / n).astype(np.float32)
        dh = d[:, None] * self.p["out"] * (h > 0)
        df = dh @ self.p["hidden"].T
        is_top = z == top[owner]
        ties = np.add.reduceat(is_top.astype(np.float32), first, 0)
        dz = (df[:, :FILTERS] / count)[owner] + is_top * (df[:, FILTERS:-1] / ties)[owner]
        dz = np.where(z > 0, dz, 0).astype(np.float32)
        # only the place of the maximum learns: its bytes are gathered
        window = np.arange(2 * STRIDE) + at[:, :, None] * STRIDE
        bytes_ = chunks[np.arange(len(chunks))[:, None, None], window]
        x = self.p["embed"][bytes_].reshape(len(chunks), FILTERS, 2 * STRIDE * WIDTH)
        dconv = np.einsum("ncw,nc->wc", x, dz, optimize=True)
        w = self.p["conv"].reshape(2 * STRIDE * WIDTH, FILTERS).T.reshape(FILTERS, 2 * STRIDE, WIDTH)
        dx = dz[:, :, None, None] * w
        flat = bytes_.ravel()
        dembed = np.stack([np.bincount(flat, dx[..., k].ravel(), 257) for k in range(WIDTH)], 1)
        dembed[256] = 0
        return {"embed": dembed, "conv": dconv.reshape(self.p["conv"].shape), "bias": dz.sum(0), "hidden": features.T @ dh,
                "hidden_bias": dh.sum(0), "out": h.T @ d, "out_bias": d.sum(keepdims=True)}


def length_feature(sizes: np.ndarray) -> np.ndarray:
    return (np.log2(1 + sizes) / 8).astype(np.float32)


def spread(text: bytes, most: int = SAMPLE_CHUNKS) -> np.ndarray:
    """At most ``most`` chunks of a text, spread over all of it."""
    starts = chunk_starts(len(text))
    if len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(int)]
    if not len(starts):
        return np.full((1, CHUNK), 256, np.int16)
    return np.concatenate([chunks_of(text, starts[i:i + 1]) for i in range(len(starts))])


def fit(rows: list[tuple[np.ndarray, int, int]], steps: int = STEPS, seed: int = SEED) -> Network:
    """From (chunks, length in bytes, label) of every sampled row."""
    n1 = sum(r[2] for r in rows)
    n0 = len(rows) - n1
    if not n0 or not n1:
        return Network({}, (n1 + 1) / (len(rows) + 2))
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    weight = np.array([(n1 / n0) ** 0.5, 1.0] if n1 >= n0 else [1.0, (n0 / n1) ** 0.5])
    m = {k: np.zeros_like(v, dtype=np.float64) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    order, at = rng.permutation(len(rows)), 0
    for t in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(rows)), 0
        batch = [rows[i] for i in order[at:at + BATCH]]
        at += BATCH
        y = np.array([r[2] for r in batch])
        g = net.gradients(np.concatenate([r[0] for r in batch]), np.repeat(np.arange(len(batch)), [len(r[0]) for r in batch]),
                          np.array([r[1] for r in batch], float), y, weight[y])
        rate = RATE * min(1.0, 2.0 * (1 - t / (steps + 1)))
        for k, d in g.items():
            if k in ("conv", "hidden", "out"):
                d = d + L2 * net.p[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            net.p[k] -= (rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(as_text(F.col(id_col)).cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, chunks, size, quality`` of a hash sample of the labelled rows
    that aren't held out."""
    lab = (pick(labels, "doc_id", "quality")
           .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .where("doc_id is not null and quality in (0, 1)").where(~held_out())
           .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    share = min(1.0, sample_rows / max(1, lab.count()))
    few = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    @F.pandas_udf("binary")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spread(t.encode("utf-8", "replace")).tobytes())

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), as_text(F.col("text")).alias("text"))
    # about sample_rows rows, by the parameter
    return (rows.join(F.broadcast(few), "doc_id")
            .select("doc_id", parts("text").alias("chunks"), F.octet_length("text").alias("size"), "quality"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Network:
    rows = training_rows(docs, labels, sample_rows).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["size"], r["chunks"]))
    return fit([(np.frombuffer(bytes(r["chunks"]), np.int16).reshape(-1, CHUNK), r["size"], r["quality"]) for r in rows], steps)


def score_of(net: Network, text_col: str = "text") -> F.Column:
    """The score of each row's whole text."""
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(net.scores([t.encode("utf-8", "replace") for t in texts]))

    return F.pandas_udf(score, "double")(as_text(F.col(text_col)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    net = train(docs, labels)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (rows.select("doc_id", held_out().alias("held_out"), score_of(net).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
