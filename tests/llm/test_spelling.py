"""Spelling variants against all pairs, and single steps of the search."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import spelling

SCHEMA = "doc_id long, text string, Text int, word int, `n.m` int"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(rows):
    n = counted(rows)
    near = defaultdict(list)
    for a in n:
        for b in n:
            if one_apart(a, b):
                near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variants(spark, rows, limit=spelling.CELL_WORDS):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return sorted(map(tuple, spelling.spelling_variants(df, limit).collect()), key=repr)


def random_rows(seed, words=900, docs=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcé", k=rng.randint(4, 8))) for _ in range(words)]
    return [(i, ", ".join(rng.choices(vocab, [1 / (k + 1) for k in range(words)], k=300))) for i in range(docs)]


@pytest.mark.parametrize("limit", [spelling.CELL_WORDS, 40])
def test_random_words(spark, limit):
    rows = random_rows(2)
    want = brute(rows)
    assert len(want) > 300 and sum(w[1] is not None for w in want) > 100
    assert variants(spark, rows, limit) == want


def test_anagrams_fill_more_than_a_cell(spark):
    rng = random.Random(3)
    words = {"".join(rng.sample("abcdef", 6)) for _ in range(300)} | {"abcde", "abcdeg", "bbcdef", "abcdeff"}
    rows = [(i, " ".join(sorted(words))) for i in range(4)]
    assert variants(spark, rows, 20) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "Straße straße STRASSE"), (1, None), (2, ""), (3, "Straße straßen"), (3, "Straße straßen"), (4, "straßen strasse"),
            (5, "x" * 70 + " " + "x" * 70 + " " + "x" * 70), (6, "ÉCOLE école École ÉCOLE ÉCOLE"), (7, "wordÿword word×word " * 3),
            (8, "hello1hello2hello_hellö " * 40_000), (9, "aaaaaābbbbb 中aaaaa " * 3)]
    assert variants(spark, rows) == brute(rows)
    assert variants(spark, []) == []


def test_counts_of_a_chunk():
    rng = random.Random(5)
    ids = [str(i) for i in range(400)]
    texts = [" ".join("".join(rng.choices("abcdéÀZ×", k=rng.randint(1, 12))) for _ in range(200)) for _ in ids]
    texts[7] = "k" * 300 + "." + "k" * 300
    want = Counter()
    for i, t in zip(ids, texts):
        want.update({w: k for w, k in _all_words(i, t).items()})
    got = spelling.count_words(ids, [t.encode() for t in texts])
    assert {w.decode(): k for w, k in got.items() if len(w.decode()) >= 5} == {w: k for w, k in want.items() if len(w) >= 5}


def _all_words(i, text):
    n = Counter()
    for run in re.findall("[A-Za-zÀ-ÿ]+", text):
        run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
        h = zlib.crc32(f"{i}:{run}".encode())
        n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return n


def test_tree_finds_all_near_words():
    rng = random.Random(6)
    for size, length, letters in ((500, 6, "abc"), (800, 5, "abcdefgh"), (50, 12, "ab")):
        members = sorted({"".join(rng.choices(letters, k=length)) for _ in range(size)})
        tree = spelling.Tree([w.encode() for w in members], [1] * len(members))
        for more in (0, 1):
            queries = sorted({"".join(rng.choices(letters, k=length - more)) for _ in range(200)} | (set(members) if not more else set()))
            rows, counts = spelling.letters_of([q.encode() for q in queries])
            found = [(int(q), int(m)) for a, b in tree.near(rows, counts, more) for q, m in zip(a, b)]
            assert len(found) == len(set(found))
            assert set(found) == {(i, j) for i, q in enumerate(queries) for j, m in enumerate(members) if one_apart(q, m)}


def test_replaced_letters():
    a = np.array([list(b"abcdefghij")] * 3, np.uint8)
    b = a.copy()
    b[1, 9] = 0xFF
    b[2, [0, 8]] = 1
    assert spelling.replaced(spelling.lanes_of(a), spelling.lanes_of(b)).tolist() == [False, True, False]
