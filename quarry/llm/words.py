"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Words are maximal runs of bytes other than white space (blank, tab to carriage
return) of the UTF-8 text with A-Z lower-cased. Runs of bytes and runs of words
are hashed by polynomials modulo 2**64 over random tables, so that the hash of
any run follows from two prefix sums; results are mixed by a bijection.

On demand (``units``) every code point of a script that puts no spaces between
words is a word of its own.
"""

from __future__ import annotations

import re

import numpy as np

CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(618033)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUE = _BYTE[_LOWER]
#: fixed values: Unicode blocks of scripts without spaces between words (Thai,
#: Lao, Tibetan, Myanmar; Khmer; Tai; Balinese; kana and Han with their
#: punctuation; Yi; Javanese; Myanmar and Tai Viet; Han; full and half width)
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x312F),
            (0x31A0, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
            (0xFF00, 0xFFEF), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
_UNIT = re.compile(f"[{_CLASS}]|[^{_CLASS} \t-\r]+")
#: fixed odd multipliers
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """Hashes of runs of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = _powers(_BASE_INV, n + 2)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n), dtype=np.uint64, out=self.sums[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the runs [a, b)."""
        return mix(self.raw(a, b) + (b - a).astype(np.uint64) * np.uint64(_BASE))

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of the runs [a, b) with their element i left out."""
        rest = (self.sums[b] - self.sums[i + 1]) * self.inverse[a + 1]
        return mix(self.raw(a, i) + rest + (b - a - 1).astype(np.uint64) * np.uint64(_BASE))


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every code point of an unspaced script in UTF-8."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + np.where(data[at] >= 0xF0, 4, 3) <= len(data)]
    b = [data[np.minimum(at + i, len(data) - 1)].astype(np.int64) & 0x3F for i in range(4)]
    four = data[at] >= 0xF0
    code = np.where(four, (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3], (b[0] & 15) << 12 | b[1] << 6 | b[2])
    edges = np.array(UNSPACED).ravel() + np.tile([0, 1], len(UNSPACED))
    ok = np.searchsorted(edges, code, side="right") % 2 == 1
    return at[ok], at[ok] + np.where(four[ok], 4, 3)


def units_of(text: str) -> list[bytes]:
    """The words of one text, as ``Words(units=True)`` has them."""
    raw = text.encode("utf-8", "replace").lower()
    if not raw or max(raw) < 0xE0:
        return raw.split()
    return [w.encode() for w in _UNIT.findall(raw.decode())]


class Words:
    """The words of a list of UTF-8 texts: ``hash`` of each, ``text`` with the
    first word of each text (n + 1 entries), and on demand their line."""

    def __init__(self, texts: list[bytes], units: bool = False):
        raw = b"\n".join(texts)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
        blank = _BLANK[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = blank[1:] != blank[:-1]
        if len(data):
            edge[0], edge[-1] = ~blank[0], ~blank[-1]
        else:
            edge[:] = False
        marks = np.flatnonzero(edge)
        self.start, self.end = marks[::2], marks[1::2]
        if units and len(data) and data.max() >= 0xE0:
            a, b = unspaced(data)
            cut = np.append(blank, True)[b]  # the word ends there anyway
            last = self.end
            self.start = np.unique(np.concatenate([self.start, a, b[~cut]]))
            self.end = np.minimum(last[np.searchsorted(last, self.start, side="right")],
                                  np.append(self.start[1:], len(data)))
        self.hash = Runs(_VALUE[data]).hashes(self.start, self.end)
        self.text = np.searchsorted(self.start, self.text_at)
        self._data = data

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every line with words: its text, its number there (from 0), its
        first word and the word after its last."""
        breaks = np.flatnonzero(self._data == 10)
        line = np.searchsorted(breaks, self.start)
        first = np.flatnonzero(np.diff(line, prepend=-1))
        last = np.append(first[1:], len(line))
        owner = np.searchsorted(self.text_at, self.start[first], side="right") - 1
        before = np.searchsorted(breaks, self.text_at[owner])
        return owner, line[first] - before, first, last


def batches_of(texts: list[bytes], limit: int = CHUNK_BYTES, units: bool = False):
    """(index of the first text, Words) of runs of about ``limit`` bytes."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield start, Words(run, units)
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, Words(run, units)
