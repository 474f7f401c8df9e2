"""Spelling variants of a vocabulary, by k-d trees over letter-count vectors.

Words. Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased are
counted over whole texts; every run whose crc32 with its document's id is
divisible by ``TYPO`` loses one letter first (planted misspellings). A word is
what has ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences.

Near words. One inserted, deleted or replaced letter moves the vector of a
word's letter counts by L1 distance one or two: a replacement takes one of one
letter and adds one of another, an insertion only adds one. So for every pair of
lengths (l, l) and (l, l + 1) the words of length l search the k-d tree of the
other length: its root cell is the length, and a cell of over ``CELL_WORDS``
words is split in Spark, by the letter and the count that halve it best, until
none is larger. A search goes down both sides of a split only while it still has
its one letter to add or to take, which is its distance to the cell's box. Inside
of a cell the tree goes on in numpy down to a few words, and these are compared
letter by letter. Cells of anagrams, which no letter can split, are dealt out by
hash and searched part by part.

No pair of words is written: a cell gives every word its number of near words
there and the most frequent of them, and both are merged per word. ``root``
follows the forms by pointer doubling; counts at least double at each step, so a
chain has at most 63 words.

Cases: a null text has no words, a null id counts as the empty text before the
colon; repeated rows are counted as often as they stand; runs of any length are
whole words; ties go to the smallest word in code-point order. Other columns,
whatever their names, aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_text, pick, text_chunks, written

MIN_LETTERS = 5
MIN_COUNT = 3
TYPO = 97
LEAST_RATIO = 2
CELL_WORDS = 20_000
LEAF_WORDS = 8
CHUNK_BYTES = 1 << 22
BLOCK_QUERIES = 4096
LONG_RUN = 64
PAIR_BYTES = 1 << 20

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_SPREAD = np.random.default_rng(90).integers(1, 2**63, LONG_RUN, dtype=np.uint64) | np.uint64(1)
#: letters by Latin-1 byte: a-z, then U+00C0 to U+00FF
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(26)
_LETTER[192:256] = 26 + np.arange(64)
LETTERS = 90
NONE, SPENT = -1, -2


# -- words -------------------------------------------------------------------------

def _shortened(run: str, h: int) -> str:
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(ids: list[str], texts: list[bytes]) -> Counter:
    """Words (UTF-8) of at least ``MIN_LETTERS`` letters of some texts, counted."""
    found: Counter = Counter()
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    if not len(data):
        return found
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    lead = data == 0xC3  # U+00C0 to U+00FF are C3 and one byte more
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    start, size = edge[::2], edge[1::2] - edge[::2]
    pairs = np.concatenate([[0], np.cumsum(lead)])
    letters = size - (pairs[start + size] - pairs[start])
    keep = letters >= MIN_LETTERS
    start, size, letters = start[keep], size[keep], letters[keep]
    owner = np.searchsorted(first, start, side="right") - 1
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    for n in np.unique(size[size <= LONG_RUN]):
        of = np.flatnonzero(size == n)
        rows = data[start[of][:, None] + np.arange(n)]
        crc = ~seeds[owner[of]]
        key = np.zeros(len(of), np.uint64)
        for j in range(n):
            crc = _CRC[(crc ^ rows[:, j]) & 255] ^ (crc >> np.uint32(8))
            key += (rows[:, j].astype(np.uint64) + np.uint64(1)) * _SPREAD[j]
        crc = ~crc
        typo = crc % TYPO == 0
        for row, h in zip(rows[typo], crc[typo].tolist()):
            found[_shortened(row.tobytes().decode(), h).encode()] += 1
        rows, key = rows[~typo], key[~typo]
        _, at, back, k = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if (rows[at][back] == rows).all():  # equal keys stood for equal words
            for row, c in zip(rows[at], k.tolist()):
                found[row.tobytes()] += c
        else:
            found.update(row.tobytes() for row in rows)
    raw = data.tobytes()
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        run = raw[start[i]:start[i] + size[i]]
        h = zlib.crc32(run, int(seeds[owner[i]]))
        found[_shortened(run.decode(), h).encode() if h % TYPO == 0 else run] += 1
    return found


def _count(batches):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        for at, run in text_chunks(texts, CHUNK_BYTES):
            found = count_words(ids[at:at + len(run)], run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``."""
    rows = pick(docs, "doc_id", "text").select(as_text(F.col("doc_id")).alias("i"), as_text(F.col("text")).alias("t"))
    return (rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LETTERS)))


# -- the upper part of the trees, in Spark -------------------------------------------

def letter_count(word: str, letter: str) -> str:
    return f"(length({word}) - length(replace({word}, {letter}, '')))"


def splits(members: DataFrame, limit: int) -> DataFrame:
    """``cell, letter, v, parts`` of every cell of over ``limit`` members: the side
    with at most v of the letter is the lower one; a cell whose words all have the
    same letters has no letter and is dealt out to ``parts``."""
    large = members.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit)
    rows = members.join(large, "cell", "left_semi")
    counts = (rows.select("cell", "word", F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
              .where("letter <> ''").groupBy("cell", "letter", F.expr(letter_count("word", "letter")).alias("v"))
              .agg(F.count(F.lit(1)).alias("k")))
    of = Window.partitionBy("cell", "letter")
    lower = (counts.join(large, "cell")
             .withColumn("none", F.col("size") - F.sum("k").over(of))
             .withColumn("upto", F.col("none") + F.sum("k").over(of.orderBy("v"))))
    # a bound below the least count puts the words without the letter on the lower side
    options = (lower.select("cell", "size", "letter", "v", F.col("upto").alias("low"))
               .unionByName(lower.where("none > 0").select("cell", "size", "letter", F.lit(0).alias("v"), F.col("none").alias("low")))
               .where("low < size"))
    best = options.groupBy("cell").agg(F.min(F.struct(F.expr("abs(2 * low - size)").alias("off"), "letter", "v")).alias("s"))
    return large.join(best, "cell", "left").select(
        "cell", F.col("s.letter").alias("letter"), F.col("s.v").alias("v"),
        F.ceil(F.col("size") / limit).cast("int").alias("parts"))


def _member_side() -> str:
    return (f"case when parts is null then cell when letter is null then concat(cell, '#', pmod(xxhash64(word), parts)) "
            f"when {letter_count('word', 'letter')} <= v then concat(cell, '0') else concat(cell, '1') end")


def grown(vocab: DataFrame, limit: int = CELL_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """``word, n, cell`` of all words, and the splits round by round. A round
    halves the largest cells; the tables of splits have a row per cell split."""
    members = vocab.select("word", "n", F.concat(F.length("word").cast("string"), F.lit(":")).alias("cell"))
    rounds = []
    while True:
        cut = written(splits(members.where("not contains(cell, '#')"), limit), "spelling-splits")
        if cut.isEmpty():
            return members, rounds
        rounds.append(cut)
        members = written(members.join(cut, "cell", "left").selectExpr("word", "n", f"{_member_side()} as cell"),
                          "spelling-cells")


def searches(vocab: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``word, n, cell, more`` of every cell that a word's search may enter;
    ``more`` is the length searched less the word's own."""
    more = F.explode(F.array(F.lit(0), F.lit(1))).alias("more")
    now = (vocab.select("word", "n", more)
           .selectExpr("word", "n", "more", "concat(length(word) + more, ':') as cell", "cast(null as string) as plus",
                       # a longer word takes no letter away
                       "if(more = 0, cast(null as string), '') as minus"))
    count = f"({letter_count('word', 'letter')} + if(plus <=> letter, 1, 0) - if(minus <=> letter, 1, 0))"
    step = lambda side, plus, minus: f"named_struct('cell', concat(cell, '{side}'), 'plus', {plus}, 'minus', {minus})"
    go = (f"case when parts is null then array(named_struct('cell', cell, 'plus', plus, 'minus', minus)) "
          f"when letter is null then transform(sequence(0, parts - 1), p -> named_struct('cell', concat(cell, '#', p), 'plus', plus, 'minus', minus)) "
          f"when {count} <= v and {count} = v and plus is null and not minus <=> letter then "
          f"array({step(0, 'plus', 'minus')}, {step(1, 'letter', 'minus')}) "
          f"when {count} <= v then array({step(0, 'plus', 'minus')}) "
          f"when {count} = v + 1 and minus is null and not plus <=> letter then "
          f"array({step(1, 'plus', 'minus')}, {step(0, 'plus', 'letter')}) "
          f"else array({step(1, 'plus', 'minus')}) end")
    for cut in rounds:
        now = (now.join(cut, "cell", "left").selectExpr("word", "n", "more", f"explode({go}) as to")
               .selectExpr("word", "n", "more", "to.cell as cell", "to.plus as plus", "to.minus as minus"))
    return now.select("word", "n", "cell", "more")


# -- the lower part, inside of a cell --------------------------------------------------

def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length (Latin-1) as rows of bytes and as letter counts."""
    rows = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
    counts = np.zeros((len(words), LETTERS), np.int32)
    np.add.at(counts, (np.arange(len(words))[:, None], _LETTER[rows]), 1)
    return rows, counts


class Tree:
    """A k-d tree over the letter counts of one cell's words."""

    def __init__(self, words: list[bytes], n: list[int]):
        rows, counts = letters_of(words)
        self.rows, self.lanes = rows, lanes_of(rows)
        self.n = np.array(n, np.int64)
        self.words = words
        self.order = np.arange(len(words))
        nodes: list[list[int]] = []  # letter (-1: leaf), bound, lower child or first, upper child or end
        todo = [(0, len(words), -1)]
        while todo:
            a, b, up = todo.pop()
            if up >= 0:
                nodes[up >> 1][2 + (up & 1)] = len(nodes)
            of = self.order[a:b]
            cut = self._cut(counts[of]) if b - a > LEAF_WORDS else None
            if cut is None:
                nodes.append([-1, 0, a, b])
                continue
            s, v = cut
            low = counts[of, s] <= v
            self.order[a:b] = np.concatenate([of[low], of[~low]])
            at, m = len(nodes), a + int(low.sum())
            nodes.append([s, v, 0, 0])
            todo += [(m, b, 2 * at + 1), (a, m, 2 * at)]
        self.letter, self.bound, self.low, self.high = np.array(nodes, np.int64).reshape(-1, 4).T

    @staticmethod
    def _cut(counts: np.ndarray) -> tuple[int, int] | None:
        """The letter and bound that halve the rows best; None if all are equal."""
        size, top = len(counts), int(counts.max())
        best = None
        for v in range(min(top, 3)):
            low = (counts <= v).sum(0)
            off = np.where(low < size, np.abs(2 * low - size), size + 1)
            s = int(off.argmin())
            if off[s] <= size and (best is None or off[s] < best[0]) and low[s]:
                best = (int(off[s]), s, v)
        if best is None:  # only large counts differ
            spread = counts.max(0) - counts.min(0)
            s = int(spread.argmax())
            if not spread[s]:
                return None
            v = int(np.median(counts[:, s]))
            return s, min(v, int(counts[:, s].max()) - 1)
        return best[1:]

    def leaves(self, counts: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of every leaf that a query's search enters."""
        q = np.arange(len(counts))
        node = np.zeros(len(q), np.int64)
        plus = np.full(len(q), NONE, np.int64)
        minus = np.full(len(q), SPENT if more else NONE, np.int64)
        out_q, out_leaf = [], []
        while len(q):
            s = self.letter[node]
            end = s < 0
            out_q.append(q[end])
            out_leaf.append(node[end])
            q, node, plus, minus, s = (x[~end] for x in (q, node, plus, minus, s))
            x = counts[q, s] + (plus == s) - (minus == s)
            v = self.bound[node]
            low = x <= v
            up = low & (x == v) & (plus == NONE) & (minus != s)
            down = (x == v + 1) & (minus == NONE) & (plus != s)
            side = np.where(low, self.low[node], self.high[node])
            q, node, plus, minus = (
                np.concatenate([q, q[up], q[down]]),
                np.concatenate([side, self.high[node[up]], self.low[node[down]]]),
                np.concatenate([plus, s[up], plus[down]]),
                np.concatenate([minus, minus[up], s[down]]))
        return np.concatenate(out_q or [q]), np.concatenate(out_leaf or [node])

    def near(self, rows: np.ndarray, counts: np.ndarray, more: int):
        """(query, member) of all near words, in blocks."""
        q, leaf = self.leaves(counts, more)
        lanes = lanes_of(rows)
        limit = max(LEAF_WORDS, PAIR_BYTES // max(1, rows.shape[1]))
        # a leaf of anagrams may hold many words: it is searched piece by piece
        pieces = -(-(self.high[leaf] - self.low[leaf]) // limit)
        q, leaf = np.repeat(q, pieces), np.repeat(leaf, pieces)
        first = self.low[leaf] + limit * (np.arange(len(leaf)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(limit, self.high[leaf] - first)
        ends = np.cumsum(size)
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + limit, side="right")))
            n = size[a:b]
            of = np.repeat(q[a:b], n)
            at = np.arange(len(of)) + np.repeat(first[a:b] - (ends[a:b] - n - (ends[a] - size[a])), n)
            member = self.order[at]
            ok = longer(rows[of], self.rows[member]) if more else replaced(lanes[of], self.lanes[member])
            yield of[ok], member[ok]
            a = b


def lanes_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers, padded with zeros."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, :rows.shape[1]] = rows
    return padded.view(np.uint64)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows (as lanes) differ in exactly one byte."""
    x = a ^ b
    seven = np.uint64(0x7F7F7F7F7F7F7F7F)
    # the high bit of every byte that isn't zero
    return np.bitwise_count((((x & seven) + seven) | x) & ~seven).sum(1) == 1


def longer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b`` are those of ``a`` with one letter put in."""
    n = a.shape[1]
    head = np.logical_and.accumulate(a == b[:, :n], 1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= n


class Best:
    """Number of near words and the best of them, per word of a list."""

    def __init__(self, size: int):
        self.count = np.zeros(size, np.int64)
        self.best: dict[int, tuple[int, bytes]] = {}

    def add(self, of: np.ndarray, n: np.ndarray, words: list[bytes], which: np.ndarray) -> None:
        self.count += np.bincount(of, minlength=len(self.count))
        if not len(of):
            return
        order = np.lexsort((-n, of))
        o, m = of[order], n[order]
        head = np.flatnonzero(np.diff(o, prepend=-1))
        top = m == np.repeat(m[head], np.diff(np.append(head, len(o))))
        for i, k, w in zip(o[top].tolist(), m[top].tolist(), which[order][top].tolist()):
            new = (-k, words[w])
            if i not in self.best or new < self.best[i]:
                self.best[i] = new

    def rows(self, words: list[bytes]):
        for i in np.flatnonzero(self.count).tolist():
            k, w = self.best[i]
            yield words[i], int(self.count[i]), -k, w


def _near_in_cells(batches):
    """Partitions hold whole cells, sorted: members first, then searches."""
    cell, words, n, tree, own = None, [], [], None, None
    queries: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}

    def flush(more):
        nonlocal tree, own
        qs, qn = queries[more]
        if not qs:
            return []
        queries[more] = ([], [])
        if not words:
            return []
        if tree is None:
            tree, own = Tree(words, n), Best(len(words))
        rows, counts = letters_of(qs)
        qn = np.array(qn, np.int64)
        found = Best(len(qs))
        for of, member in tree.near(rows, counts, more):
            found.add(of, tree.n[member], words, member)
            if more:
                own.add(member, qn[of], qs, of)
        return list(found.rows(qs))

    def close():
        out = flush(0) + flush(1)
        return out + list(own.rows(words)) if own else out

    def table(out):
        col = lambda i: pa.array([r[i].decode("latin-1") for r in out], pa.string())
        return pa.RecordBatch.from_arrays(
            [col(0), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), col(3)],
            names=["word", "k", "best_n", "best"])

    for batch in batches:
        out = []
        for c, kind, w, k in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if c != cell:
                out += close()
                cell, words, n, tree, own = c, [], [], None, None
            w = w.encode("latin-1")
            if kind < 0:
                words.append(w)
                n.append(k)
            else:
                queries[kind][0].append(w)
                queries[kind][1].append(k)
                if len(queries[kind][0]) >= BLOCK_QUERIES:
                    out += flush(kind)
        yield table(out)
    yield table(close())


def near_words(vocab: DataFrame, limit: int = CELL_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word that has a near word."""
    members, rounds = grown(vocab, limit)
    rows = (members.selectExpr("cell", "-1 as kind", "word", "n")
            .unionByName(searches(vocab, rounds).selectExpr("cell", "more as kind", "word", "n")))
    parts = (rows.repartition("cell").sortWithinPartitions("cell", "kind")
             .mapInArrow(_near_in_cells, "word string, k long, best_n long, best string"))
    return (parts.groupBy("word").agg(F.sum("k").alias("n_near"),
                                      F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")))


def spelling_variants(docs: DataFrame, limit: int = CELL_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    vocab = written(vocabulary(docs), "spelling-words")
    near = near_words(vocab, limit)
    good = F.col("best_n") >= LEAST_RATIO * F.col("n")
    words = written(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"),
        F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    ways = words.select("word", F.col("form").alias("to"), F.coalesce("form", "word").alias("root"))
    while True:
        ways = written(ways, "spelling-roots")
        if ways.where("to is not null").isEmpty():
            break
        then = (ways.where("root <> word")
                .select(F.col("word").alias("to"), F.col("to").alias("next"), F.col("root").alias("last")))
        ways = ways.join(then, "to", "left").select("word", F.col("next").alias("to"), F.coalesce("last", "root").alias("root"))
    return words.join(ways.select("word", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")
