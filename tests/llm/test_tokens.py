"""Byte-level BPE and packing against the tokenizer libraries and brute force."""

import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import byte_bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
MODEL = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    alphabet = list("abst 'rvelmd  \n\t 　é中1²½!?-_\x1c\x85​\U0001F600") + ["'s", "'re", "'ll", " '", "the "]
    out = ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(300)]
    return [*out, None, "", " ", "\n\n", "'", "x" * 900 + " " * 700 + "!" * 800, "Hello world's end, it'll do. " * 50,
            "<|endoftext|> is text", "same", "same"]


def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_ids_equal_tiktoken_and_decode_to_the_text(spark, encoding, texts):
    got = {r["doc_id"]: r for r in byte_bpe.encode_documents(frame(spark, texts), RANKS, keep_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = np.array(encoding.encode_ordinary(t or ""), "<u4")
        assert got[i]["ids"] == want.tobytes() and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(want.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_decode_documents_round_trip(spark, texts):
    ids = byte_bpe.encode_documents(frame(spark, texts), RANKS, keep_ids=True)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode_documents(ids, RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


def test_memory_of_a_worker_is_bounded_by_small_chunks(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghij", k=1000)).replace(" ", "", 500).encode() for _ in range(1000)]
    with open(MODEL, "rb") as f:
        bpe = byte_bpe.ByteBPE(f.read(), special=True)
    want = [np.concatenate(p).tolist() for _, p in sorted(bpe.encode_many(texts[:20]))]
    tracemalloc.start()
    try:
        bpe._reset()
        n = sum(1 for _ in bpe.encode_many(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(texts) and peak < 80_000_000
    # a piece with more matches than the store has places for
    monkeypatch.setattr(byte_bpe, "CACHE_BITS", 4)
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 4)
    bpe._reset()
    assert [np.concatenate(p).tolist() for _, p in sorted(bpe.encode_many(texts[:20]))] == want


def test_a_text_longer_than_a_chunk_and_a_small_store(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 200)
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 20)
    with open(RANKS, "rb") as f:
        bpe = byte_bpe.ByteBPE(f.read())
    text = "It's one of the  many lines, isn't it?\n\n" * 40 + "y" * 900
    ids = np.concatenate(list(bpe.encode(text.encode())))
    assert ids.tolist() == encoding.encode_ordinary(text)


def test_long_match_by_heap_equals_matrix(encoding):
    with open(RANKS, "rb") as f:
        bpe = byte_bpe.ByteBPE(f.read())
    word = "abcabcabdtheing" * 60
    assert bpe.merge_long(bpe.byte_id[np.frombuffer(word.encode(), np.uint8)].tolist()) == encoding.encode_ordinary(word)


def test_empty_table(spark):
    none = frame(spark, [])
    assert byte_bpe.encode_documents(none, RANKS).count() == 0
    assert packing.pack_documents(none, MODEL).count() == 0


def test_pieces_hold_every_id_once(spark, texts):
    lib = Tokenizer.from_file(MODEL)
    many = [*texts, "word " * 5000, "number 12 " * 3100]
    rows = packing.pack_documents(frame(spark, many), MODEL, keep_ids=True).collect()
    docs: dict = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(many):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(docs[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in parts) == np.array(want, "<u4").tobytes()
        at = 0
        for p in parts:
            assert p["start"] == at and p["doc_tokens"] == len(want) and 0 < p["length"] <= 2048
            assert p["ids_crc32"] == zlib.crc32(np.array(want[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048


def test_sequences_are_padded_but_for_powers_of_two(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "word " * 2100)], "doc_id long, text string")
    packed = packing.pack_documents(docs, MODEL, keep_ids=True)
    for r in packing.sequences(packed).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 2048)


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(1)
    for capacity in (7, 64, 100):
        lengths = rng.integers(1, capacity + 1, 200)
        window, offset = packing.best_fit_decreasing(lengths, capacity)
        room: dict[int, int] = {}
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room.values() if r >= lengths[i]]
            left = capacity - offset[i]
            assert left == (min(fits) if fits else capacity)
            assert room.get(window[i], capacity) == left
            room[window[i]] = left - lengths[i]
        assert len(room) <= -(-lengths.sum() // capacity) * 1.3 + 1


def test_sharded_packing_wastes_little(spark):
    rng = random.Random(2)
    cut = spark.createDataFrame([(i, 0, n, 0, n) for i, n in enumerate(rng.choices(range(1, 2048), k=3000))],
                                packing.PIECE)
    packed = packing.pack(cut, shard_pieces=500)
    used, total = packed.selectExpr("count(distinct sequence_id)", "sum(length)").first()
    assert total / (used * 2048) > 0.95
    assert packed.count() == 3000
