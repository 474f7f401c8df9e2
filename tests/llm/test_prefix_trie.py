"""The trie of conversation prefixes against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from quarry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, Text string, `a.b` int, node int"


def brute(rows):
    def digest(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t, role or "", text or ""))
    own = {c: [(r, x) for t, r, x in sorted(v, key=lambda v: (v[0] is not None, v[0] or 0, digest(v[1], v[2])))]
           for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        down = [below[c] for c in children[p]]
        last = len(p[-1][1].encode()) if p else 0
        below[p] = (sum(d[0] for d in down) or 1, sum(d[1] for d in down) + (len(members[p]) - 1) * last)
        ends = sorted(c for c in members[p] if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]),
                    *below[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=repr)


def test_random_conversations(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab")) for c in range(-20, 150)
            for t in range(rng.choice([0, 1, 2, 3, 5, 8, 12]))]
    assert trie(spark, rows) == brute(rows)


def test_long_chains_and_hot_groups(spark):
    """One third start alike, one third are copies, and each of some leaves one
    long conversation at another place."""
    rows = [(5 * c, t, "u", "hot" if t < 9 else f"{c}") for c in range(40) for t in range(12)]
    rows += [(5 * c, t, "u", f"copy{t}") for c in range(40, 80) for t in range(10)]
    rows += [(5 * c, t, "u", f"chain{t}" if t < c - 70 else f"{c}") for c in range(80, 110) for t in range(c - 68)]
    assert trie(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (None, 1, "u", "gone"),
            (2, 5, "u", "é" * 100_000), (3, 5, "u", "é" * 100_000), (10, 1, "1:", "a"), (15, 1, "1", ":a"), (7, 0, "u", "x")]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, []) == []


def test_blocks_of_ids(spark, monkeypatch):
    rows = [(5 * c, t, "u", f"copy{t}") for c in range(3000) for t in range(9)]
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 7)
    assert trie(spark, rows) == brute(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 40) for a in range(b)]
    got = spark.createDataFrame(pairs, "a long, b long").selectExpr("a", "b", f"{prefix_trie.fattest('a', 'b')} as f").collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)
