"""The byte-level network: gradients, cover of whole texts, held-out accuracy, odd input."""

import random
import zlib

import numpy as np

from quarry.llm import byte_cnn


def corpus(n=500, seed=1):
    """Label 0 has a mark after every word; the rest is the same."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.8)
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 200))]
        rows.append((i, ("! " if y == 0 else " ").join(words), "x", 1))
        labels.append((i, y, 0))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, "doc_id long, text string, Score string, `a.b` int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_chunks_cover_every_byte_and_every_window():
    for size in (0, 1, 30, 511, 512, 513, 992, 993, 5000):
        starts = byte_cnn.chunk_starts(size)
        covered = {b for s in starts for b in range(s, s + byte_cnn.CHUNK)}
        assert set(range(size)) <= covered
        windows = {w for s in starts for w in range(s, s + byte_cnn.CHUNK - 2 * byte_cnn.STRIDE + 1)}
        assert set(range(max(0, size - 2 * byte_cnn.STRIDE + 1))) <= windows
        text = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
        rows = byte_cnn.chunks_of(text, starts)
        for s, row in zip(starts, rows):
            assert row.tolist() == list(text[s:s + byte_cnn.CHUNK]) + [256] * max(0, s + byte_cnn.CHUNK - size)


def test_long_texts_are_pooled_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    net = byte_cnn.Network.fresh(rng)
    texts = [b"", bytes(rng.integers(0, 256, 40_000, dtype=np.uint8)), b"ab", bytes(rng.integers(0, 256, 3000, dtype=np.uint8))]
    want = net.pooled(texts)
    monkeypatch.setattr(byte_cnn, "BLOCK_CHUNKS", 5)
    assert np.allclose(net.pooled(texts), want, atol=1e-4)
    assert np.allclose(np.concatenate([net.pooled([t]) for t in texts]), want, atol=1e-4)
    assert not want[0].any()


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = byte_cnn.Network.fresh(rng)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (700, 100, 2000)]
    chunks = [byte_cnn.spread(t) for t in texts]
    owner = np.repeat(np.arange(3), [len(c) for c in chunks])
    sizes, y, weight = np.array([len(t) for t in texts], float), np.array([0, 1, 1]), np.array([2.0, 1.0, 1.0])

    def loss():
        p = net.scores(texts)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).mean())

    g = net.gradients(np.concatenate(chunks), owner, sizes, y, weight)
    for name in ("embed", "conv", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        flat, d = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        i = int(np.abs(d).argmax())
        old, eps = flat[i], 1e-2
        flat[i] = old + eps
        up = loss()
        flat[i] = old - eps
        down = loss()
        flat[i] = old
        assert abs((up - down) / (2 * eps) - d[i]) < 0.1 * abs(d[i]) + 2e-3, name


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in byte_cnn.quality(*frames(spark, rows, labels)).collect()}
    assert len(got) == len(rows)
    out = [(got[i]["predicted"], y) for i, y, _ in labels if got[i]["held_out"]]
    assert len(out) > 60 and np.mean([p == y for p, y in out]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_odd_rows(spark):
    rows, labels = corpus(200)
    odd = [(None, "abc", "x", 1), (9001, None, "x", 1), (9002, "", "x", 1), (9003, "abc def " * 100_000, "x", 1), (0, rows[0][1], "y", 2)]
    labels = labels + [(None, 1, 1), (9001, None, None), (9002, 7, 1), (3, 0, 0), (3, 1, 0)]
    d, lab = frames(spark, rows + odd, labels)
    got = byte_cnn.quality(d, lab).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[9001]["score"] == by[9002]["score"] and by[None]["held_out"] is True  # crc32 of nothing is 0
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1


def test_no_labels_or_one_class(spark):
    rows, labels = corpus(40)
    d, lab = frames(spark, rows, labels)
    for some, share in ((lab.limit(0), 0.5), (lab.where("quality = 1"), None)):
        scores = {r["score"] for r in byte_cnn.quality(d, some).collect()}
        assert len(scores) == 1 and (share is None or scores == {share})
    assert byte_cnn.quality(d.limit(0), lab).count() == 0


def test_sample_bounds_are_kept(spark):
    rows, labels = corpus(500)
    got = byte_cnn.training_rows(*frames(spark, rows, labels), sample_rows=100).collect()
    assert 40 < len(got) < 160
    assert len(byte_cnn.spread(b"x" * 100_000)) == byte_cnn.SAMPLE_CHUNKS
