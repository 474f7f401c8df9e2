"""Byte-level BPE, encoding and decoding, on padded numpy matrices.

Method. A batch of texts is split into matches of the tokenizer's pattern by
vector operations on its code points. Distinct matches are sorted into buckets
by byte length and padded into one matrix per bucket. In every round each row
finds the rank of every adjacent pair through a hash table in two arrays,
merges its leftmost pair of the smallest rank, and is compacted by one place;
rows without a mergeable pair leave the matrix. Ids of a text are the ids of
its matches, gathered by index.

Matches of over ``LONG_MATCH`` bytes don't go into matrices, where a round per
merge is quadratic in their length: they are merged one at a time with a heap
of pairs over a linked list, with the same ids.

Distinct matches are told apart by a 64-bit multilinear hash of their bytes.
A worker keeps the ids of the matches that it has met, up to ``CACHE_ENTRIES``
of them, and starts afresh beyond that (a piece of text with more has a larger
store): this bounds memory, not the result.

Cases: a null or empty text has no ids (``n_tokens`` 0, digests of no bytes).
A text of any length is worked through in pieces of about ``CHUNK_BYTES``, cut
only where white space follows other characters, which is always a border of
two matches. Special tokens are ordinary text in ``encode_documents``. Repeated
rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
CACHE_ENTRIES = 600_000
CACHE_BITS = 20
CELLS = 500_000
LONG_MATCH = 384
BUCKETS = (4, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 256, LONG_MATCH)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
NONE = np.int32(2**31 - 1)


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            lo, hi = (ord(text[m.start()]), ord(text[m.end() - 1]) + 1)
            table[lo:hi] = kind
    return table


def split_points(codes: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True where a match of the pattern starts. ``codes``: code points of all
    texts; ``starts``: index of each text's first one (texts may not be empty)."""
    n = len(codes)
    kind = classes[codes]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    prev = np.empty(n, np.uint8)
    prev[0] = 255
    prev[1:] = kind[:-1]
    prev[starts] = 255
    after_blank = np.zeros(n, bool)
    after_blank[1:] = codes[:-1] == 32
    after_blank &= ~first[:n]
    at = kind != prev
    # a single blank belongs to the match that follows it
    at &= ~((kind != SPACE) & after_blank)
    # the last white space of a run stands alone if other text follows
    space = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~first[1:]
    at |= last
    # contractions split a run of letters
    quotes = np.flatnonzero((codes == 39) & at)
    if len(quotes):
        room = np.concatenate([codes, np.zeros(3, codes.dtype)])
        edge = np.concatenate([first, np.ones(3, bool)])
        a, b = room[quotes + 1], room[quotes + 2]
        in1 = ~edge[quotes + 1]
        in2 = in1 & ~edge[quotes + 2]
        one = in1 & np.isin(a, [ord(c) for c in "stmd"])
        two = in2 & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        at[quotes[one | two] + 1] = False
        ends = np.concatenate([quotes[one] + 2, quotes[two] + 3])
        ends = ends[ends < n]
        at[ends] = True
    return at


class ByteBPE:
    """A vocabulary (ranks of a ``.tiktoken`` file, or the model of a
    ``tokenizer.json``) with vectorised encoding and decoding."""

    def __init__(self, content: bytes, special: bool = False):
        self.special: dict[str, int] = {}
        if content.lstrip()[:1] == b"{":
            tokens, merges = self._from_json(content, special)
        else:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            merges = ((t[:i], t[i:], rank) for t, rank in tokens.items() for i in range(1, len(t))
                      if t[:i] in tokens and t[i:] in tokens)
        self.tokens = tokens
        self.byte_id = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        rank_id: dict[int, int] = {}
        for left, right, rank in merges:
            pairs[(tokens[left] << 20) | tokens[right]] = rank
            rank_id[rank] = tokens[left + right]
        self.pairs = pairs
        self.rank_id = np.zeros(max(rank_id, default=0) + 1, np.int32)
        self.rank_id[list(rank_id)] = list(rank_id.values())
        self._build_hash()
        size = max([*tokens.values(), *self.special.values()]) + 1
        words = [b""] * size
        for t, i in tokens.items():
            words[i] = t
        for t, i in self.special.items():
            words[i] = t.encode()
        self.word_len = np.array([len(w) for w in words], np.int64)
        self.word_at = np.concatenate([[0], np.cumsum(self.word_len)[:-1]])
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)
        self.classes = _classes()
        rng = np.random.default_rng(20240229)
        self.mix_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.mix_place = rng.integers(1, 2**63, LONG_MATCH + 1, dtype=np.uint64) | np.uint64(1)
        self._reset()

    @staticmethod
    def _byte_alphabet() -> dict[str, int]:
        """The printable stand-in of each byte in a byte-level tokenizer.json."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def _from_json(self, content: bytes, special: bool):
        doc = json.loads(content)
        back = self._byte_alphabet()
        to_bytes = lambda s: bytes(back[c] for c in s)
        added = {x["content"]: x["id"] for x in doc.get("added_tokens", [])}
        if special:
            self.special = added
        tokens = {to_bytes(s): i for s, i in doc["model"]["vocab"].items() if s not in added}
        merges = []
        for rank, m in enumerate(doc["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            merges.append((to_bytes(left), to_bytes(right), rank))
        return tokens, merges

    def _build_hash(self) -> None:
        """Open-addressing table: slot -> pair key and rank."""
        bits = max(10, int(np.ceil(np.log2(len(self.pairs) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, NONE, np.int32)
        keys = np.array(list(self.pairs), np.int64)
        ranks = np.array(list(self.pairs.values()), np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.slot_key[slots] == -1
            chosen, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slot_key[chosen] = keys[put]
            self.slot_rank[chosen] = ranks[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, ranks, slots = keys[rest], ranks[rest], (slots[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE if they don't merge (or are padding)."""
        keys = ((left.astype(np.int64) << 20) | right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = keys[todo]
        slots = self._slot(keys)
        while len(todo):
            seen = self.slot_key[slots]
            hit = seen == keys
            out[todo[hit]] = self.slot_rank[slots[hit]]
            go = ~hit & (seen != -1)
            todo, keys, slots = todo[go], keys[go], (slots[go] + 1) & self.mask
        return out.reshape(left.shape)

    def merge_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row (padded with -1 at the end) to the end; returns the
        padded ids and each row's count."""
        n = len(ids)
        out = np.full(ids.shape, -1, np.int32)
        rows, work = np.arange(n), ids
        while len(rows):
            if work.shape[1] < 2:
                out[rows, :work.shape[1]] = work
                break
            ranks = self.pair_ranks(work[:, :-1], work[:, 1:])
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done], :work.shape[1]] = work[done]
                live = ~done
                rows, work, at, best = rows[live], work[live], at[live], best[live]
                if not len(rows):
                    break
            places = np.arange(work.shape[1] - 1)
            moved = np.take_along_axis(work, places + (places > at[:, None]), axis=1)
            moved[np.arange(len(rows)), at] = self.rank_id[best]
            work = moved
        return out, (out >= 0).sum(axis=1)

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for one long match, with a heap over a linked list."""
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = lambda i: self.pairs.get((ids[i] << 20) | ids[nxt[i]]) if nxt[i] < n else None
        heap = [(r, i, ids[i], ids[nxt[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = int(self.rank_id[r]), False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for k in (i, prv[i]):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[nxt[k]]))
        return [x for x, ok in zip(ids, alive) if ok]

    def _reset(self, least: int = 0) -> None:
        """An empty store, with room for ``least`` matches at least."""
        self.known = 0
        self.bits = max(CACHE_BITS, (2 * least).bit_length())
        self.seen_key = np.zeros(1 << self.bits, np.uint64)
        self.seen_slot = np.zeros(1 << self.bits, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each match in the worker's store, -1 if it isn't there."""
        out = np.full(len(hashes), -1, np.int32)
        todo, keys = np.arange(len(hashes)), hashes
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            seen = self.seen_key[slots]
            hit = seen == keys
            out[todo[hit]] = self.seen_slot[slots[hit]]
            go = ~hit & (seen != 0)
            todo, keys, slots = todo[go], keys[go], (slots[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _store(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.seen_key[slots] == 0)
            chosen, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.seen_key[chosen], self.seen_slot[chosen] = hashes[put], numbers[put]
            rest = np.ones(len(hashes), bool)
            rest[put] = False
            hashes, numbers, slots = hashes[rest], numbers[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        k, m = self.known, len(hashes)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + m > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.count[k:k + m] = counts
        self.at[k:k + m] = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.used += len(ids)
        self.known += m
        self._store(hashes, np.arange(k, k + m, dtype=np.int32))

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> None:
        """Encode distinct matches that the worker hasn't met."""
        low = 0
        for high in BUCKETS:
            pick = np.flatnonzero((size > low) & (size <= high))
            low = high
            for part in np.array_split(pick, max(1, len(pick) * high // CELLS)):
                if not len(part):
                    continue
                cols = np.arange(high)
                ok = cols < size[part][:, None]
                where = np.minimum(start[part][:, None] + cols, len(data) - 1)
                ids, counts = self.merge_matrix(np.where(ok, self.byte_id[data[where]], np.int32(-1)))
                self._keep(hashes[part], ids[ids >= 0], counts)

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the count of each text."""
        counts = np.zeros(len(texts), np.int64)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return np.zeros(0, np.int32), counts
        raw = b"".join(texts[i] for i in full)
        sizes = np.array([len(texts[i]) for i in full])
        data = np.frombuffer(raw, np.uint8)
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        char_at = np.flatnonzero((data & 0xC0) != 0x80)
        text_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        firsts = np.searchsorted(char_at, text_at)
        start = char_at[np.flatnonzero(split_points(codes, firsts, self.classes))]
        size = np.diff(np.append(start, len(data)))
        place = np.arange(len(data)) - np.repeat(start, size)
        value = self.mix_byte[data] * self.mix_place[np.minimum(place, LONG_MATCH)]
        sums = np.add.reduceat(value, start) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in np.flatnonzero(size > LONG_MATCH):  # rare: the bytes themselves tell them apart
            word = raw[start[i]:start[i] + size[i]]
            sums[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        sums += sums == 0  # 0 marks a free place
        slot = self._find(sums)
        if (slot < 0).any():
            uniq, where = np.unique(sums[slot < 0], return_index=True)
            where = np.flatnonzero(slot < 0)[where]
            if self.known + len(uniq) > CACHE_ENTRIES:
                uniq, where = np.unique(sums, return_index=True)
                self._reset(len(uniq))
            self._learn(data, start[where], size[where], uniq)
            for i, h in zip(where[size[where] > LONG_MATCH], uniq[size[where] > LONG_MATCH]):
                ids = self.merge_long(self.byte_id[data[start[i]:start[i] + size[i]]].tolist())
                self._keep(np.array([h]), np.array(ids, np.int32), np.array([len(ids)]))
            slot = self._find(sums)
        lens = self.count[slot]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.at[slot] - (ends - lens), lens) + np.arange(ends[-1])]
        totals = np.concatenate([[0], ends])[np.searchsorted(start, np.append(text_at, len(data)))]
        counts[full] = np.diff(totals)
        return ids, counts

    def encode(self, text: bytes):
        """Yield the ids of one text in pieces of bounded size."""
        try:
            text.decode("utf-8")
        except UnicodeDecodeError:
            text = text.decode("utf-8", "replace").encode()
        if self.special:
            hits = [(m.start(), m.end()) for m in
                    regex.finditer(b"|".join(regex.escape(s.encode()) for s in self.special), text)]
            at = 0
            for a, b in hits:
                yield from self._plain(text[at:a])
                yield np.array([self.special[text[a:b].decode()]], np.int32)
                at = b
            text = text[at:] if hits else text
        yield from self._plain(text)

    def _plain(self, text: bytes):
        at = 0
        while len(text) - at > CHUNK_BYTES:
            m = _BORDER.search(text, at + CHUNK_BYTES)
            if not m:
                break
            yield self.encode_batch([text[at:m.start() + 1]])[0]
            at = m.start() + 1
        yield self.encode_batch([text[at:]])[0]

    def encode_many(self, texts: list[bytes]):
        """Yield (index, list of id arrays) for every text, batching short ones."""
        run, size = [], 0
        for i, t in enumerate(texts):
            if len(t) > CHUNK_BYTES or (self.special and any(s.encode() in t for s in self.special)):
                yield i, list(self.encode(t))
                continue
            run.append(i)
            size += len(t)
            if size > CHUNK_BYTES:
                yield from self._run(texts, run)
                run, size = [], 0
        yield from self._run(texts, run)

    def _run(self, texts, run):
        try:
            ids, counts = self.encode_batch([texts[i] for i in run])
        except UnicodeDecodeError:
            for i in run:
                yield i, list(self.encode(texts[i]))
            return
        for i, part in zip(run, np.split(ids, np.cumsum(counts)[:-1])):
            yield i, [part]

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.word_len[ids]
        ends = np.cumsum(size)
        return self.word_bytes[np.repeat(self.word_at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()


#: white space after another ASCII character: always a border of two matches
_BORDER = regex.compile(rb"[!-~](?=[ \n])")
_LOADED: dict[tuple[str, bool], ByteBPE] = {}


def loaded(content: bytes, special: bool = False) -> ByteBPE:
    """The vocabulary, built once in each Python worker."""
    key = (hashlib.md5(content).hexdigest(), special)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(content, special)
    return _LOADED[key]


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast variable (a file of fixed size)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row, and the
    ids themselves (``ids``, little-endian unsigned 32-bit) with ``keep_ids``."""
    vocab = vocabulary(df, path)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())] + ([("ids", pa.binary())] if keep_ids else [])
    schema = pa.schema(fields)

    def work(batches):
        bpe = loaded(vocab.value)
        for batch in batches:
            keys = batch.column(0)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows: list = [None] * len(texts)
            for i, parts in bpe.encode_many(texts):
                told, back, n = hashlib.sha256(), hashlib.sha256(), 0
                for part in parts:
                    n += len(part)
                    told.update(part.astype("<u4").tobytes())
                    back.update(bpe.decode(part))
                rows[i] = (n, told.hexdigest(), back.hexdigest(),
                           b"".join(p.astype("<u4").tobytes() for p in parts) if keep_ids else None)
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64())] + [pa.array(c, f[1]) for c, f in zip(cols, fields[1:])], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(work, ddl)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, bytes`` from little-endian unsigned 32-bit ids (null: empty)."""
    vocab = vocabulary(df, path)

    def work(batches):
        bpe = loaded(vocab.value)
        for batch in batches:
            out = [bpe.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.col(ids_col).alias("ids")).mapInArrow(work, "doc_id long, bytes binary")
