"""Byte-level helpers over Arrow string columns, vectorized with numpy.

Texts are handled as UTF-8 bytes straight from the Arrow buffers: splitting at
ASCII delimiters never cuts a character, and lower-casing A-Z is a table look-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The arrays over a slice take about twenty times its size, in every Python worker of an executor.
SLICE_BYTES = 1 << 19
_HASH_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Delimiters of words made of a-z, digits and non-ASCII characters, after lower-casing.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``size`` bytes; a longer row comes alone."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, rows)
        at = min(to, rows)


def word_spans(data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray):
    """Byte starts and ends of all words, and each row's first word; no word crosses rows."""
    inside = ~delimiter[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    up, down = np.full(n, _MULTIPLIER), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over random symbols, then mixed."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(min(_HASH_BYTES, len(data)) + 1)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _HASH_BYTES, "right")))
        low = starts[at]
        need = int(ends[to - 1] - low) + 1
        if need > len(up):
            up, down = _powers(need)
        sums = np.zeros(need, np.uint64)
        np.cumsum(_SYMBOLS[data[low:ends[to - 1]]] * up[:need - 1], dtype=np.uint64, out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mixed(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray = WHITE):
    """Hashes of all lower-cased words and each row's first word index."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, delimiter)
    return span_hashes(data, starts, ends), first


def byte_rows(column: pa.Array) -> Iterator[bytes]:
    """Each text as bytes; a null is empty."""
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield raw[a:b]


class Remembered:
    """What ``make`` gives for short chunks, kept for two generations: bounded memory, frequent chunks stay."""

    def __init__(self, make, most: int = 200_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def of(self, chunks: list) -> list:
        need, extra = [], {}
        for c in set(chunks):
            if c not in self.young:
                if c in self.old:
                    self.young[c] = self.old[c]
                else:
                    need.append(c)
        for c, made in zip(need, self.make(need) if need else ()):
            (self.young if len(c) <= self.longest else extra)[c] = made
        found = [extra[c] if c in extra else self.young[c] for c in chunks] if extra else [*map(self.young.__getitem__, chunks)]
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        return found


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
