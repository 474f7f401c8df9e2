"""Exact, line, shingle and vector deduplication against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import common, components, embedding_dedup, exact_dedup, line_dedup, ngram_join, words


def joined(nodes, pairs):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    edges += [(None, 5), (7, 7), (1, 2), (1, 2)]
    got = {r["node"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    top = joined({n for e in real for n in e}, real)
    least = {t: min(n for n in top if top[n] == t) for t in set(top.values())}
    assert got == {n: least[t] for n, t in top.items()}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_duplicates(spark):
    rows = [(5, "a b"), (3, " ab "), (4, "a\tb\n\x0b"), (9, "ab"), (1, None), (2, ""), (8, " \n"), (7, "a\u00a0b"),
            (6, "x" * 5000), (10, "x" * 2500 + " " + "x" * 2500), (11, "é"), (11, "é"), (None, "q"), (12, "q")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, digest int").repartition(9)
    got = exact_dedup.exact_duplicates(df).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    assert len(got) == len(rows)
    for r in got:
        norm = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        if r["doc_id"] is not None:
            assert r["doc_id"] in [g[2] for g in groups[norm]]
        best = min(groups[norm], key=lambda g: (g[0], g[1], g[2] or 0))
        assert (r["keep_id"], r["group_size"]) == (best[2], len(groups[norm]))
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1000, 3, 0.5])
def test_hot_groups_are_looked_up_in_place(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", hot)
    rows = [(i, "the same " * (1 + i % 2)) for i in range(40)] + [(50 + i, f"t {i % 5}") for i in range(10)] + [(70, None), (71, " ")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, Text int, `d.e` int").repartition(5)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()}
    want = {i: (i % 2, 20, i < 2) for i in range(40)}
    want |= {50 + i: (50 + i % 5, 2, i < 5) for i in range(10)} | {70: (71, 2, False), 71: (71, 2, True)}
    assert got == want


def test_merge_rounds_give_the_groups_of_one_pass(spark):
    df = spark.range(3000).selectExpr("id doc_id", "concat('t', id % 70) text").repartition(20)
    slim = exact_dedup.digests(df)
    one, many = (exact_dedup.merge_runs(slim, n).select("digest", "size").toPandas().sort_values("size")["size"].sum()
                 for n in (1, 20))
    assert one == many == 3000 and exact_dedup.merge_runs(slim, 20).count() == 70


def line_rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(6, 12))) for _ in range(25)]

    def edit(line):
        w, k = line.split(), rng.random()
        i = rng.randrange(len(w))
        if k < .3:
            w[i] = rng.choice(vocab)
        elif k < .5:
            w.insert(i, rng.choice(vocab))
        elif k < .7:
            del w[i]
        return (" " if k > .9 else "") + " ".join(w).upper() if k > .8 else " ".join(w)

    rows = []
    for d in range(50):
        lines = [edit(rng.choice(base)) for _ in range(rng.randint(0, 6))] + rng.choice([[], [""], ["ab c", ""]])
        rows.append((d * 7 % 50, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (None, "a b c d\n" + base[0]), (102, "long " * 3000 + "\n" + base[1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rows = line_rows(seed)
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, id string, line int")
    got = line_dedup.dedup_lines(df, count_col="n_dropped").collect()
    lines = [((line_dedup.LAST if i is None else i, k), t.encode().lower().split())
             for i, text in rows if text is not None for k, t in enumerate(text.split("\n"))]
    drop = {p for p, w in lines if len(w) >= 3 and any(
        q < p and (w == v or min(len(w), len(v)) >= 8 and line_dedup.within_one(w, v)) for q, v in lines)}
    want = {}
    for i, text in rows:
        kept = None if text is None else "\n".join(
            t for k, t in enumerate(text.split("\n")) if (line_dedup.LAST if i is None else i, k) not in drop)
        want[i] = (kept, sum(p[0] == (line_dedup.LAST if i is None else i) for p in drop))
    assert drop and {r["doc_id"]: (r["text"], r["n_dropped"]) for r in got} == want
    assert all(r["id"] == "x" and r["line"] == 7 for r in got)


def test_words_of_scripts_without_spaces():
    rng = random.Random(7)
    texts = ["".join(rng.choices("aB \t\n\u00e9\u4e2d\u3002\u0e01\u0e49\ud55c\U00020001\U0001f600\u3000\u2014", k=rng.randint(0, 30)))
             for _ in range(300)] + ["\u4e2d", "a\u4e2d", "plain A", ""]
    raw = [t.encode() for t in texts]
    for group in (raw, raw[-2:]):
        w = words.Words(group, units=True)
        data = b"\n".join(group).lower()
        got = [data[a:b] for a, b in zip(w.start, w.end)]
        assert got == [u for t in group for u in words.units_of(t.decode())]
        assert [w.text[i + 1] - w.text[i] for i in range(len(group))] == [len(words.units_of(t.decode())) for t in group]
    assert words.units_of("A\u4e2d\u6587 b\u00e9") == ["a".encode(), "\u4e2d".encode(), "\u6587".encode(), "b\u00e9".encode()]


def test_lines_of_every_script_and_long_lines_of_few_words(spark):
    zh, th = "\u8fd9\u662f\u4e00\u4e2a\u5728\u6bcf\u4e2a\u6587\u6863\u91cc\u90fd\u91cd\u590d\u7684\u6bb5\u843d\u3002", "\u0e02\u0e49\u0e2d\u0e04\u0e27\u0e32\u0e21\u0e19\u0e35\u0e49\u0e0b\u0e49\u0e33\u0e01\u0e31\u0e19"
    url, two = "https://example.org/terms", "Advertisement continues"
    near_zh, far_zh = zh.replace("\u91cc", "\u4e2d"), zh.replace("\u8fd9\u662f", "\u90a3\u4e0d")
    rows = [(1, "\n".join([zh, th, url, two, "ok"])), (2, "\n".join([near_zh, th[:-1], url + "s", two.upper(), "ok"])),
            (3, "\n".join([far_zh, zh + "\u4e86", th, url, "ok"]))]
    got = {r["doc_id"]: (r["text"], r["n"]) for r in line_dedup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string"), count_col="n").collect()}
    assert got == {1: (rows[0][1], 0), 2: (url + "s\nok", 3), 3: (far_zh + "\nok", 3)}


def test_lines_of_an_empty_table_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d\nx y z"), (1, "a b c d\nx y z"), (2, "x y z")], "doc_id long, text string")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, "a b c d\nx y z"), (1, "a b c d\nx y z"), (2, "")]


def test_edit_distance_of_one():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j] + (x != y), d[j + 1] + 1, e[-1] + 1))
            d = e
        return d[-1]

    rng = random.Random(1)
    for _ in range(2000):
        a, b = (rng.choices("ab", k=rng.randint(0, 5)) for _ in range(2))
        assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset([tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []))


def near_copies(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=60)

    def mutate(w, k):
        w = list(w)
        for _ in range(k):
            i, c = rng.randrange(len(w)), rng.random()
            if c < .4:
                w[i] = rng.choice(vocab)
            elif c < .7:
                w.insert(i, rng.choice(vocab))
            elif len(w) > 1:
                del w[i]
        return w

    rows = []
    for b in [rng.choices(vocab, k=rng.choice([3, 6, 30, 80, 200])) for _ in range(20)]:
        x = b
        for _ in range(rng.choice([1, 2, 5, 20])):
            x = mutate(b if rng.random() < .5 else x, max(1, int(len(b) * rng.choice([.005, .01, .02, .03]))))
            rows.append((len(rows) * 13 % 997, " ".join(x + (passage if rng.random() < .5 else []))))
    rows += [(2000 + i, " ".join(rng.choices(vocab, k=rng.randint(20, 150)) + passage)) for i in range(40)]
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (None, "a b c d e f"), (None, "A b c d e f"),
                   (5003, "a b"), (5004, "a  B"), (7, "x y z"), (7, "x y z"), (7, "p q r")]


@pytest.mark.parametrize("seed,block,sample,hot", [(1, 3, 1, 2), (2, 256, 16, 9)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed, block, sample, hot):
    for name, value in (("BLOCK", block), ("SAMPLE", sample), ("HOT_LEVEL", hot), ("PAIR_CELLS", 10 * block)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(seed)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = joined(range(len(rows)), links)
    want = collections.Counter()
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in top if top[j] == top[i] and rows[j][0] is not None]
        want[doc_id, len(sets[i]), min(ids) if ids else None] += 1
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows],
                               "doc_id long, text string, point string, Row int, `a.b` int, TEXT int")
    got = ngram_join.jaccard_components(df).collect()
    assert collections.Counter(map(tuple, got)) == want
    if seed == 1:
        kept = ngram_join.drop_near_duplicates(df)
        assert kept.columns == df.columns
        empty = sum(not s for s in sets)
        assert kept.count() == empty + len({top[i] for i in range(len(rows)) if sets[i]})


def test_rarity_counts_the_shingles_of_all_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ORDER_BITS", 8)
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randint(0, 60))) + f" t{i}" for i in range(150)] + [None, ""]
    want = collections.Counter()
    for _, _, h, ends in ngram_join.sets_of([(t or "").encode() for t in texts]):
        want.update((h >> np.uint64(56)).tolist())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = ngram_join.rarity(df)
    assert got.tolist() == [want[b].bit_length() if want[b] >= ngram_join.OFTEN else 0 for b in range(256)]
    assert got.max() > 1


def short_copies(seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(10**6)}"
    common = [word() for _ in range(12)]
    rows = [common + [word() for _ in range(rng.choice([1] if i % 100 == 0 else [4, 5, 6, 7, 8]))] for i in range(700)]
    rows += [r[:-1] + [word()] for r in rows[:600:20]]
    return [(i, " ".join(r)) for i, r in enumerate(rng.sample(rows, len(rows)))]


@pytest.mark.parametrize("seed,block", [(1, 256), (3, 20)])
def test_short_copies_around_one_sentence_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "ORDER_BITS", 10 if seed == 1 else 22)
    rows = short_copies(seed)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = joined(range(len(rows)), links)
    least = {t: min(i for i in top if top[i] == t) for t in set(top.values())}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(least) < len(rows) - 20 and got == {i: least[t] for i, t in top.items()}


@pytest.mark.parametrize("block", [4, 1000])
def test_window_pairs_are_all_that_sizes_allow(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block)
    rows = [(k, p, rng.choice([5, 8, 9, 10, 12, 40, 50, 51, 64]), p % 3) for k in range(3) for p in rng.sample(range(300), 90)]
    size = {}
    rows = [(k, p, size.setdefault(p, n), part) for k, p, n, part in rows]
    got = [tuple(r) for r in ngram_join.window_pairs(spark.createDataFrame(
        [(*r, bytes(ngram_join.CELLS)) for r in rows], "key long, point long, n int, part long, cells binary")).collect()]
    want = {(p, q) for k, p, n, part in rows for l, q, m, other in rows
            if k == l and p < q and part != other and 100 * min(n, m) >= 80 * max(n, m)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block", [7, 1000])
def test_near_copies_meet_in_one_of_their_regions(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block)
    copies = {p: (rng.choice([40, 45, 50, 60]), sorted(rng.sample(range(-20, 20), 30))) for p in range(40)}
    far = {p: (50, [k]) for p, k in ((90, 19), (91, 19), (92, 5))}  # share one region with each other and with some
    rows = [(k, p, n, p, bytes(ngram_join.CELLS)) for p, (n, keys) in (copies | far).items() for k in keys]
    got = [tuple(r) for r in ngram_join.window_meetings(spark.createDataFrame(
        rows, "key long, point long, n int, part long, cells binary")).collect()]
    some = copies | far
    want = {(p, q) for p in some for q in some if p < q and set(some[p][1]) & set(some[q][1])
            and 100 * min(some[p][0], some[q][0]) >= 80 * max(some[p][0], some[q][0])}
    assert set(got) == want
    near = [x for x in got if x[1] < 90]
    assert len(near) < 1.05 * len(set(near))  # about 22 times as many if every common region made a row


def test_among_keeps_every_wanted_point(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MARK_BITS", 16)
    rows = [(i * 2654435761 - 2**40, bytes([i % 256])) for i in range(3000)]
    some = spark.createDataFrame([(p,) for p, _ in rows[::50]], "point long")
    got = {tuple(r) for r in ngram_join.among(spark.createDataFrame(rows, "point long, cells binary"), some).collect()}
    assert {(p, c) for p, c in rows[::50]} <= got <= set(rows) and len(got) < 200


def test_bitmap_holds_every_number(spark):
    rows = [0, 1, -1, 32767, 32768, 65535, 65536, 2**63 - 1, -2**63, 123456789]
    bits = common.bitmap(spark.createDataFrame([(r,) for r in rows], "row long"), 16)
    at = {r & 0xFFFF for r in rows}
    assert set(np.flatnonzero(common.has_bit(bits, np.arange(1 << 16))).tolist()) == at
    assert common.has_bit(bits, np.array(rows)).all()


def test_jaccard_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.drop_near_duplicates(none).count() == 0


def test_threshold_is_met_exactly(spark):
    base = [f"a{i}" for i in range(13)]  # 9 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["z"])), (3, " ".join(base[:12]))]
    # 1 and 2 share 8 of 10 (0.8), 1 and 3 share 8 of 9
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24))
    x[1000:1200] = x[:200] + 0.2 * rng.standard_normal((200, 24))
    x[1200:1400] = x[5] + 0.12 * rng.standard_normal((200, 24))
    x[1400:1450] = x[7] * 3
    x[1450:] = x[8]
    rows = [(int(i * 7 % 1500), [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23),
           (2004, [None] + [1.0] * 23), (2005, [float("inf")] + [1.0] * 23), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, cell_rows=20).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    n = np.array([got[i]["n_links"] for i, _ in rows])
    assert (n <= links.sum(1)).all() and n.sum() >= 0.9 * links.sum()
    top = joined(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(links)) if i < j])
    least = {t: min(rows[j][0] for j in top if top[j] == t) for t in set(top.values())}
    assert np.mean([got[rows[i][0]]["component_id"] == least[top[i]] for i in top]) > 0.97
    for i in range(2000, 2006):
        assert tuple(got[i]) == (i, 0, i, True)
    assert got[2007]["component_id"] == 2006 and got[2006]["n_links"] == 1 and not got[2007]["kept"]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_traversal_is_in_order():
    rng = np.random.default_rng(5)
    a, b = rng.random(9), rng.random(7)
    sums = (a[:, None] + b).ravel()
    assert np.allclose(sums[embedding_dedup.traverse(a, b, 30)], np.sort(sums)[:30])
