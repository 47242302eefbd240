"""Interpolated modified Kneser-Ney model of any order counted in Spark (operator 10).

Counting: each task hashes words, makes (context, word) grams with starts
before and an end after every text, and sends sorted distinct grams with counts
to shards, the commonest words as numbers. A gram goes by the word just
before its last one, so its context, the gram without its first word and all
shorter ones lie in the same shard: one exchange carries the text. A frequent
word has as many shards as its share asks for and deals its grams over them by
the word before it, or by the whole gram if that is frequent too. Only what these
hold in parts meets again: grams without their first word, level by level, and
sums of contexts of two frequent words. A shard merges its blocks into sorted
gram hashes and counts and its contexts' sums (total and how many grams occur
once, twice, more), files of the shared folder. Sums by previous word and by word
(distinct previous words, count in the text) meet in shards of words.

Scoring maps documents only: workers memory-map the arrays and look up sorted
hashes. A hash is kept whole: its first bits by an index, the others in place;
small counts take a byte, others a row of a second table. A gram of three words
or more after an infrequent word is kept as the places of its context and of the
gram without its first word in the shard's tables. Nothing of the model passes
through the driver but a handful of sums and the commonest words of a sample
(at most 262,141), which settle how grams are dealt and coded, not what is counted. Files are written under a temporary name and renamed, so a repeated or
lost task leaves the same files. Workers map the arrays from
``spark.checkpoint.dir``, which must be a mounted folder.

P(w | u) = (c(uw) - D(c)) / c(u) + g(u) P(w | u without its first word), down to
P(w) from distinct previous words, interpolated with one share among the known
words and one for all unknown ones. Below the highest order c counts the
different words before; an order has three discounts, from its counts of counts.
A context never seen leaves the lower order alone. As many starts stand before a
text as a context has words. A null text is empty: one end token. Rows that
repeat count each.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm.text import mixed, row_slices, text_bytes, word_hashes
from crosspanel.session import stage_root

BUFFERED, SHARD_PAIRS, SLICE = 1_600_000, 1_250_000, 6 << 20
#: Words that have a number, with start and end, the number of all others, and bytes of text they are drawn from.
COMMON, RARE, SAMPLE = (1 << 18) - 3, (1 << 18) - 1, 40 << 20

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_FOLD, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def pairs(data: np.ndarray, offsets: np.ndarray):
    """(previous, word) hashes of all texts with begin and end, and each row's first pair."""
    hashes, first = word_hashes(data, offsets)
    rows = np.arange(len(offsets) - 1)
    word = np.empty(len(hashes) + len(rows), np.uint64)
    word[np.arange(len(hashes)) + np.repeat(rows, np.diff(first))] = hashes
    word[first[1:] + rows] = END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    starts = first[:-1] + rows
    before[starts] = BEGIN
    return before, word, starts


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * _FOLD + word)


def words_before(before: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """The ``order`` - 1 words before each word, nearest first; starts stand before a text."""
    found = [before]
    for _ in range(order - 2):
        further = np.empty_like(before)
        further[1:] = found[-1][:-1]
        further[starts] = BEGIN
        found.append(further)
    return found


def contexts(words: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the nearest one, two and so on of the words before."""
    found = []
    for n in range(len(words)):
        made = words[n]
        for x in words[:n][::-1]:
            made = pair_hashes(made, x)
        found.append(made)
    return found


def all_frequent(words: list[np.ndarray], frequent: np.ndarray) -> list[np.ndarray]:
    """Whether the nearest one, two and so on are all frequent words."""
    return [*np.logical_and.accumulate([_among(x, frequent) for x in words])]


def _among(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    if not len(chosen):
        return np.zeros(len(x), bool)
    at = np.searchsorted(chosen, x)
    return chosen[np.minimum(at, len(chosen) - 1)] == x


def gram_shards(words: list[np.ndarray], hashes: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """By the nearest word; a frequent one's by the word before it too, or by the gram if that is frequent as well."""
    key = mixed(words[0] ^ _SPREAD)
    far = np.flatnonzero(_among(words[0], frequent))
    if len(far):
        near = words[0][far]
        parts = np.searchsorted(frequent, near, "right") - np.searchsorted(frequent, near)
        by = hashes[far]
        if len(words) > 1:
            by = np.where(_among(words[1][far], frequent), by, mixed(words[1][far] * _FOLD))
        key[far] = mixed(key[far] + by % parts.astype(np.uint64))
    return (key % np.uint64(shards)).astype(np.int64)


def word_shards(word: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(word * _SPREAD) % np.uint64(shards)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _save(path: str, *columns: np.ndarray) -> None:
    """Columns one behind the other in one file, which appears whole or not at all."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        for c in columns:
            c.tofile(file)
    os.replace(own, path)


MANY = 255
#: Sums of contexts by one byte: no gram more than twice, or one such gram; 255 says that the row is in the other table.
_SMALL = np.array([(o + 2 * t, o, t, 0) for t in range(4) for o in range(32)]
                  + [(o + 2 * t + n, o, t, 1) for n in range(3, 11) for t in range(2) for o in range(7)], np.int64)


def _small(sums: list[np.ndarray]) -> np.ndarray:
    """The byte of each (total, once, twice, more)."""
    total, once, twice, more = sums
    n = total - once - 2 * twice
    out = np.full(len(total), MANY, np.int64)
    out = np.where((more == 0) & (once < 32) & (twice < 4), twice * 32 + once, out)
    fits = (more == 1) & (once < 7) & (twice < 2) & (n < 11)
    return np.where(fits, 128 + (n - 3) * 14 + twice * 7 + once, out).astype(np.uint8)


def _keep(path: str, hashes: np.ndarray, *columns: np.ndarray) -> None:
    """Sorted hashes, whole: an index by their first 0, 8 or 16 bits and the other bits; then columns of one width."""
    bits = 16 if len(hashes) >= 1 << 18 else 8 if len(hashes) >= 1 << 10 else 0
    first, rest = _split(hashes, bits)
    index = np.searchsorted(first, np.arange((1 << bits) + 1)).astype(np.uint32)
    low = [(rest >> np.uint64(16)).astype(np.uint16)] + ([] if bits == 16 else [rest.astype(np.uint16)])
    head = np.array([len(hashes), bits, len(index), len(low), len(columns), columns[0].itemsize], np.int64)
    _save(path, head, index, (rest >> np.uint64(32)).astype(np.uint32), *low, *columns)


def _split(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    first = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    return first, hashes << np.uint64(bits)


_PLACE = 28


def _keep_pairs(path: str, context: np.ndarray, shorter: np.ndarray, count: np.ndarray) -> None:
    """Grams sorted by the places of context and shorter gram: an index by 16 contexts, four bits of the first and the second."""
    if int(shorter.max(initial=0)) >> _PLACE:
        raise ValueError("a shard has too many grams: train with fewer pairs a shard")
    index = np.searchsorted(context >> 4, np.arange((int(context.max(initial=0)) >> 4) + 2)).astype(np.uint32)
    head = np.array([len(count), 0, len(index), 0, 1, 1], np.int64)
    _save(path, head, index, ((context & 15) << _PLACE | shorter).astype(np.uint32), np.minimum(count, MANY).astype(np.uint8))


def _kept(path: str):
    """What finds keys in a table of ``_keep``: places, -1 for none, and the columns; none for a shard that got nothing."""
    if not os.path.exists(path):
        return None
    whole = np.memmap(path, np.uint8, "r")
    (n, bits, length, lows, width, size), at = whole[:48].view(np.int64).tolist(), 48

    def take(count, kind):
        nonlocal at
        to = at + count * np.dtype(kind).itemsize
        out, at = np.asarray(whole[at:to]).view(kind), to
        return out
    index, high = take(length, np.uint32), take(n, np.uint32)
    low = [take(n, np.uint16) for _ in range(lows)]
    return n, bits, index, high, low, [take(n, np.uint8 if size == 1 else np.int64) for _ in range(width)]


def _places(table, keys: np.ndarray) -> np.ndarray:
    first, rest = _split(keys, table[1])
    lows = [(rest >> np.uint64(16)).astype(np.uint16), rest.astype(np.uint16)]
    return _searched(table, first, (rest >> np.uint64(32)).astype(np.uint32), lows)


def _searched(table, first: np.ndarray, want: np.ndarray, lows=()) -> np.ndarray:
    n, _, index, high, low, _ = table
    if not n:
        return np.full(len(first), -1)
    a, end = index[first].astype(np.int64), index[first + 1].astype(np.int64)
    b = end
    for _ in range(int((end - a).max(initial=0)).bit_length()):
        middle = (a + b) >> 1
        less = (high[np.minimum(middle, n - 1)] < want) & (middle < b)
        a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
    out, left = np.full(len(first), -1), np.flatnonzero(a < end)
    while len(left):  # hashes that agree in their first bits are gone through
        at = a[left]
        same = high[at] == want[left]
        match = same.copy()
        for x, y in zip(low, lows):
            match &= x[at] == y[left]
        out[left[match]] = at[match]
        left = left[same & ~match]
        a[left] += 1
        left = left[a[left] < end[left]]
    return out


def _blob(x: np.ndarray, kind) -> bytes:
    return x.astype(kind, copy=False).tobytes()


_BLOCK = "shard long, stats binary, " + ", ".join(f"c{k} binary" for k in range(8))


def _rows(rows: list[tuple], stats: np.ndarray | None = None) -> pa.Table:
    """Rows (shard, columns as bytes); the first carries the stats."""
    rows = [(x[0], stats.tobytes() if stats is not None and not i else b"", *x[1:], *[b""] * (9 - len(x)))
            for i, x in enumerate(rows)]
    columns = [*zip(*rows)] if rows else [()] * 10
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 9))],
                    names=["shard", "stats", *(f"c{k}" for k in range(8))])


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed, after their width and count."""
    most = int(x.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    size = np.dtype(kind).itemsize
    raw = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, size).T).tobytes()
    return size.to_bytes(1, "little") + len(x).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unpacked(cell: bytes) -> np.ndarray:
    size, n = cell[0], int.from_bytes(cell[1:9], "little")
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.Codec("zstd").decompress(cell[9:], n * size, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(size, n)
    return sum((planes[k].astype(np.int64) << 8 * k for k in range(1, size)), planes[0].astype(np.int64))


def _numbered(known: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Each word's number among the common ones, or RARE."""
    if not len(common):
        return np.full(len(known), RARE)
    order = np.argsort(common)
    at = order[np.minimum(np.searchsorted(common, known, sorter=order), len(common) - 1)]
    return np.where(common[at] == known, at, RARE)


def _keys(code: list[np.ndarray], n: int) -> np.ndarray:
    """One number for each row of codes below ``n``, in the rows' order."""
    key, room = code[0].astype(np.int64), n
    for x in code[1:]:
        if room * n >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            room = len(values)
        key, room = key * n + x, room * n
    return key


def _coded(known: np.ndarray, number: np.ndarray, code: list[np.ndarray], bits: np.ndarray,
           counts: tuple[np.ndarray, ...], shard: np.ndarray) -> list[tuple]:
    """Rows of blocks by shard of sorted grams: rare words' hashes, bits and lengths of the runs of
    nearest words, numbers of their words, the words' and the others' numbers, counts."""
    order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
    code, counts, shard, bits = [x[order] for x in code], [x[order] for x in counts], shard[order], bits[order]
    begins, rows = _runs(shard), []
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(shard)]):
        first = _runs(code[0][a:b])
        own = [code[0][a:b][first], *(x[a:b] for x in code[1:])]
        numbers = [number[x] for x in own]
        rare = np.concatenate([known[x[y == RARE]] for x, y in zip(own, numbers)])
        rows.append((int(shard[a]), _blob(rare, np.uint64), _packed(bits[a:b]), _packed(np.diff(first, append=b - a)),
                     _packed(numbers[0]), _packed(np.concatenate(numbers[1:])), *(_packed(x[a:b]) for x in counts)))
    return rows


def _blocks(words: list[np.ndarray], spread: list[np.ndarray], hashes: np.ndarray, word: np.ndarray,
            counts: tuple[np.ndarray, ...], shards: int, frequent: np.ndarray = np.zeros(0, np.uint64),
            common: np.ndarray = np.zeros(0, np.uint64)) -> list[tuple]:
    """Different grams by shard, as ``_coded``."""
    known, code = np.unique(np.concatenate([*words, word]), return_inverse=True)
    code, shard = code.reshape(len(words) + 1, -1), gram_shards(words, hashes, frequent, shards)
    bits = sum(x.astype(np.uint8) << k for k, x in enumerate(spread))
    order = np.lexsort(code[::-1])
    return _coded(known, _numbered(known, common), [x[order] for x in code], bits[order], [x[order] for x in counts], shard[order])


def _grams(table: pa.Table, n: int):
    """Words before, word, spread bits and counts of all blocks; the table's metadata has the common words."""
    common = np.frombuffer((table.schema.metadata or {}).get(b"common", b""), np.uint64)
    common = np.concatenate([common, np.zeros(RARE + 1 - len(common), np.uint64)])
    words, bits, counts = [], [], []
    for row in zip(*(table.column(f"c{k}").to_pylist() for k in range(7))):
        numbers = [_unpacked(row[3]), *_unpacked(row[4]).reshape(n, -1)]
        rare, at, own = np.frombuffer(row[0], np.uint64), 0, []
        for x in numbers:
            found, unknown = common[x], np.flatnonzero(x == RARE)
            found[unknown] = rare[at:at + len(unknown)]
            at += len(unknown)
            own.append(found)
        words.append([np.repeat(own[0], _unpacked(row[2])), *own[1:]])
        bits.append(_unpacked(row[1]).astype(np.uint8))
        counts.append([_unpacked(x) for x in row[5:] if x])
    words = [np.concatenate(x) for x in zip(*words)]
    return words[:-1], words[-1], np.concatenate(bits), [np.concatenate(x) for x in zip(*counts)]


def _count(frequent: np.ndarray, common: np.ndarray, shards: int, order: int):
    def flush(buffer):
        word, starts, at = [], [], 0
        for w, s in buffer:
            word.append(w)
            starts.append(s + at)
            at += len(w)
        buffer.clear()
        known, code = np.unique(np.concatenate([*word, np.array([BEGIN])]), return_inverse=True)
        word.clear()
        number = _numbered(known, common)
        by = np.argsort(number, kind="stable")
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        known, number, code = known[by], number[by], place[code]
        last, starts = code[:-1], np.concatenate(starts)
        before = [last]
        for _ in range(order - 1):
            further = np.empty_like(last)
            further[1:] = before[-1][:-1]
            further[starts] = code[-1]
            before.append(further)
        code = [*before[1:], last]
        n = len(known)
        key = _keys(code, n)
        if order <= 3 and n < 1 << 21:
            key = np.sort(key)
            at = _runs(key)
            count, key, code = np.diff(at, append=len(key)), key[at], []
            for _ in range(order):
                code.insert(0, key % n)
                key = key // n
        else:
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            code = [x[at] for x in code]
        words = [known[x] for x in code[:-1]]
        spread = all_frequent(words[:2], frequent)
        hashes = pair_hashes(contexts(words)[-1], known[code[-1]])
        return _rows(_coded(known, number, code, sum(x.astype(np.uint8) << k for k, x in enumerate(spread)), (count,),
                            gram_shards(words, hashes, frequent, shards)))

    def run(batches):
        buffer, held = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_slices(offsets, SLICE):
                part = offsets[a:b + 1]
                _, word, starts = pairs(data[part[0]:part[-1]], part - part[0])
                buffer.append((word, starts))
                held += len(word)
                if held >= BUFFERED:
                    yield from flush(buffer).to_batches()
                    buffer, held = [], 0
        if buffer:
            yield from flush(buffer).to_batches()
    return run


def _column(table: pa.Table, k: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(f"c{k}").to_pylist()), kind)


def _stats(table: pa.Table, size: int) -> np.ndarray:
    return sum((np.frombuffer(x, np.int64) for x in table.column("stats").to_pylist() if x), np.zeros(size, np.int64))


def _sums(key: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Different keys, total of the counts, how many are one, two, more."""
    order = np.argsort(key, kind="stable")
    at, c = _runs(key[order]), count[order]
    return [key[order][at], *(np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c > 2))]


def _keep_sums(folder: str, kind: str, shard: int, known: np.ndarray, sums: list[np.ndarray]) -> None:
    """Sums of contexts: a byte each, and whole rows where that isn't enough."""
    small = _small(sums)
    many = small == MANY
    _keep(f"{folder}/{kind}-{shard}", known, small)
    name = kind.rstrip("0123456789")
    _keep(f"{folder}/{name}many{kind[len(name):]}-{shard}", known[many], *(x[many].astype(np.int64) for x in sums))


def _keyed(keys: np.ndarray, common: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words as bytes, those with a number first, and their order."""
    number = _numbered(keys, common)
    order = np.argsort(number, kind="stable")
    known = number[order][:np.count_nonzero(number != RARE)]
    cell = _packed(np.diff(known, prepend=0))
    return len(cell).to_bytes(8, "little") + cell + _blob(keys[order[len(known):]], np.uint64), order


def _added(table: pa.Table, at: int, width: int, common: np.ndarray) -> list[np.ndarray]:
    """Different words of the blocks in the columns from ``at`` on and their sums."""
    keys = [np.zeros(0, np.uint64)]
    for cell in table.column(f"c{at}").to_pylist():
        if cell:
            to = 8 + int.from_bytes(cell[:8], "little")
            keys += [common[np.cumsum(_unpacked(cell[8:to]))], np.frombuffer(cell[to:], np.uint64)]
    keys = np.concatenate(keys)
    parts = [np.concatenate([np.zeros(0, np.int64), *(_unpacked(x) for x in table.column(f"c{k}").to_pylist() if x)])
             for k in range(at + 1, at + width)]
    order = np.argsort(keys)
    begins = _runs(keys[order])
    return [keys[order][begins], *(np.add.reduceat(x[order], begins) if len(begins) else x for x in parts)]


def _sent(sides: list[list[np.ndarray]], words: int, first: int, common: np.ndarray) -> list[tuple]:
    """Rows of sums (by previous word, by word) to the shards of words."""
    of = [word_shards(x[0], words) for x in sides]
    out = []
    for k in range(words):
        cells, some = [], False
        for side, own in zip(sides, of):
            here = np.flatnonzero(own == k)
            cell, order = _keyed(side[0][here], common)
            cells += [cell, *(_packed(x[here][order]) for x in side[1:])]
            some |= len(here) > 0
        if some:
            out.append((first + k, *cells))
    return out


def _merged(keys: np.ndarray, *sums: np.ndarray):
    """Where the first of each key stands, in the keys' order, its sums, and each row's place among them."""
    order = np.argsort(keys)
    begins = _runs(keys[order])
    place = np.empty_like(order)
    place[order] = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(order)))
    return order[begins], [np.add.reduceat(x[order], begins) if len(begins) else x for x in sums], place


def _merge_grams(folder: str, level: int, top: int, shards: int, words: int, sent, coded):
    """Shards of grams from 0 on, then those of sums of contexts in parts, then those of words."""
    # The last step's rows are those of the shards of words alone.
    first = shards + words if level > 2 else 0

    def run(table: pa.Table) -> pa.Table:
        shard, stats = table.column("shard")[0].as_py(), _stats(table, 4 * (top - 1))
        frequent, common, rows = sent.value, coded.value, []

        def keep(kind, hashes, count, n):
            many = count >= MANY
            if kind:
                _keep(f"{folder}/{kind}{n}-{shard}", hashes, np.minimum(count, MANY).astype(np.uint8))
            return _keep(f"{folder}/{kind or 'pairs'}many{n}-{shard}", hashes[many], count[many].astype(np.int64))

        def counted(n, count):
            stats[4 * (n - 2):4 * (n - 1)] += [int((count == k).sum()) for k in (1, 2, 3, 4)]

        def to_words(before, word, count, raw):
            at, sums, _ = _merged(word, np.ones(len(word), np.int64), raw)
            rows.extend(_sent([_sums(before[0], count), [word[at], *sums]], words, first, common))

        def shorter(n, before, word, raw):
            """The grams without their first word: how many, and how often they stand in the text."""
            hashes = pair_hashes(contexts(before)[n - 3], word)
            at, sums, place = _merged(hashes, np.ones(len(word), np.int64), raw)
            return hashes[at], [x[at] for x in before[:-1]], word[at], sums, place

        def near(n, hashes, before, word, count, raw):
            """Tables of grams after infrequent words, of n words and fewer; the grams' places in theirs."""
            counted(n, count)
            if n == 2:
                keep("grams", hashes, count, n)
                to_words(before, word, count, raw)
                return np.arange(len(hashes))
            context = contexts(before)[-1]
            known, *sums = _sums(context, count)
            _keep_sums(folder, f"contexts{n}", shard, known, sums)
            fewer, their, last, (kinds, text), place = shorter(n, before, word, raw)
            place = near(n - 1, fewer, their, last, kinds, text)[place]
            context = np.searchsorted(known, context)
            order = np.argsort(context << 32 | place)
            _keep_pairs(f"{folder}/pairs{n}-{shard}", context[order], place[order], count[order])
            keep("", hashes, count, n)
            out = np.empty_like(order)
            out[order] = np.arange(len(order))
            return out

        def far(n, hashes, before, word, bits, count, raw):
            """Tables of grams after frequent words; shorter grams, and sums of contexts of two, go on."""
            counted(n, count)
            keep("far", hashes, count, n)
            if n == 2:
                return to_words(before, word, count, raw)
            context = contexts(before)[-1]
            known, *sums = _sums(context, count)
            spread = _among(known, np.unique(context[bits > 1]))
            _keep_sums(folder, f"farcontexts{n}", shard, known[~spread], [x[~spread] for x in sums])
            known, sums = known[spread], [x[spread] for x in sums]
            of = word_shards(known, words)
            rows.extend((shards + k, _keyed(known[of == k], common[:0])[0], *(_packed(x[of == k]) for x in sums))
                        for k in np.unique(of).tolist())
            fewer, their, last, (kinds, text), _ = shorter(n, before, word, raw)
            rows.extend(_blocks(their, all_frequent(their[:2], frequent), fewer, last, (kinds, text), shards, frequent, common))

        if shard >= shards + words:
            rows = _sent([_added(table, 0, 5, common), _added(table, 5, 3, common)], words, first, common)
        elif shard >= shards:
            known, *sums = _added(table, 0, 5, common)
            _keep_sums(folder, f"spread{level + 1}", shard - shards, known, sums)
        else:
            before, word, bits, counts = _grams(table.replace_schema_metadata({"common": common.tobytes()}), level - 1)
            hashes = pair_hashes(contexts(before)[-1], word)
            at, (count, raw), _ = _merged(hashes, counts[0], counts[-1])
            hashes, word, bits, before = hashes[at], word[at], bits[at], [x[at] for x in before]
            for chosen in (bits == 0, bits > 0):
                if chosen.any():
                    own = hashes[chosen], [x[chosen] for x in before], word[chosen]
                    if bits[chosen][0]:
                        far(level, *own, bits[chosen], count[chosen], raw[chosen])
                    else:
                        near(level, *own, count[chosen], raw[chosen])
        return _rows(rows or [(first, *[b""] * 8)], stats)
    return run


_STATS = ["k1", "k2", "k3", "k4", "words", "tokens", "kinds"]


def _names(top: int) -> list[str]:
    return [f"n{k}_{n}" for k in range(2, top + 1) for n in (1, 2, 3, 4)] + _STATS


def _merge_words(folder: str, top: int, coded):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        left, right = _added(table, 0, 5, coded.value), _added(table, 5, 3, coded.value)
        known = np.union1d(left[0], right[0])
        sums = [np.zeros(len(known), np.int64) for _ in range(6)]
        for side, own in ((left, sums[:4]), (right, sums[4:])):
            for x, y in zip(own, side[1:]):
                x[np.searchsorted(known, side[0])] = y
        many = np.maximum.reduce(sums) >= MANY
        _keep(f"{folder}/words-{shard}", known, *(np.minimum(x, MANY).astype(np.uint8) for x in sums))
        _keep(f"{folder}/wordsmany-{shard}", known[many], *(x[many] for x in sums))
        kinds, count = sums[4], sums[5]
        stats = _stats(table, 4 * (top - 1)).tolist()
        stats += [int((kinds == n).sum()) for n in (1, 2, 3, 4)]
        stats += [int((count > 0).sum()), int(count.sum()), int(kinds.sum())]
        return pa.table([pa.array([x], pa.int64()) for x in stats], names=_names(top))
    return run


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all workers can open as files."""
    root = urlparse(stage_root(spark))
    if root.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's arrays, so {root.geturl()} must be a mounted folder")
    folder = f"{root.path}/crosspanel/llm-model-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest of the words that a sample of texts has more than once, with counts."""
    part = min(1.0, SAMPLE / max(size, 1))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)

    def tally(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            word, count = np.unique(word_hashes(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "n"])

    counts = some.mapInArrow(tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    return found["word"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.int64)


def _frequent(words: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """Words of more than half a shard, sorted, each as often as the half shards it fills."""
    need = np.minimum(np.ceil(2 * shards * counts / max(counts.sum(), 1)).astype(np.int64), 2 * shards)
    return np.sort(np.repeat(words[need > 1], need[need > 1]))


def train(texts: DataFrame, shard_pairs: int = SHARD_PAIRS, order: int = 2) -> dict:
    """Count the rows of ``texts(text)`` into arrays of the shared folder; returns where they are and their sums."""
    if not 2 <= order <= 9:
        raise ValueError(f"order {order} is not between 2 and 9")
    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(24, int(size / 7 // shard_pairs))
    words = max(12, shards // 4)
    folder, context = shared_folder(texts.sparkSession), texts.sparkSession.sparkContext
    known, counts = _common(texts, size)
    # The start stands before every text, in no text.
    starts = min(2 * shards, 2 + int(2 * shards * rows * 7 / max(size, 1)))
    sent = context.broadcast(np.sort(np.concatenate([_frequent(known, counts, shards), np.repeat(BEGIN, starts)])))
    coded = context.broadcast(np.concatenate([np.array([BEGIN, END]), known]))
    sums = texts.mapInArrow(lambda batches: _count(sent.value, coded.value, shards, order)(batches), _BLOCK)
    for level in range(order, 1, -1):
        sums = sums.groupBy("shard").applyInArrow(_merge_grams(folder, level, order, shards, words, sent, coded), _BLOCK)
    names = _names(order)
    stats = sums.groupBy("shard").applyInArrow(_merge_words(folder, order, coded), ", ".join(f"{c} long" for c in names))
    total = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first().asDict()
    return {"folder": folder, "shards": shards, "word_shards": words, "frequent": sent, "order": order, **total}


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more from how many items have counts 1 to 4."""
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y, n = n1 / (n1 + 2 * n2), (n1, n2, n3, n4)
    found = [(k + 1) - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2 for k in range(3)]
    return np.array([0.0, *(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))])


def _looked_up(keys: np.ndarray, shard: np.ndarray, opened, kind: str, width: int, pair=None):
    """Columns of the tables at the keys, or at the places of a pair, zero where none is, and the places found, else -1.

    The tables of the kind's name before its digits and "many" have the rows that bytes don't hold.
    """
    out, place = [np.zeros(len(keys), np.int64) for _ in range(width)], np.full(len(keys), -1)
    order = np.lexsort((keys, shard))
    name = kind.rstrip("0123456789")
    others = f"{name}many{kind[len(name):]}"
    begins = _runs(shard[order])
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
        here, k = order[a:b], int(shard[order[a]])
        table = opened(kind, k)
        if table is None:
            continue
        if pair:
            context, shorter = (x[here] for x in pair)
            at = _searched(table, context >> 4, ((context & 15) << _PLACE | shorter).astype(np.uint32))
        else:
            at = _places(table, keys[here])
        here, at = here[at >= 0], at[at >= 0]
        place[here] = at
        columns = [x[at] for x in table[-1]]
        many = np.flatnonzero(np.maximum.reduce(columns) == MANY)
        columns = [*_SMALL[np.minimum(columns[0], len(_SMALL) - 1)].T] if width > len(columns) else columns
        for o, c in zip(out, columns):
            o[here] = c
        if len(many):
            table = opened(others, k)
            at = _places(table, keys[here[many]])
            for o, c in zip(out, table[-1]):
                o[here[many]] = c[at]
    return out, place


def _score(model: dict, text: int):
    def run(batches):
        frequent, maps = model["frequent"].value, {}

        def opened(kind, k):
            if (kind, k) not in maps:
                maps[kind, k] = _kept(f"{model['folder']}/{kind}-{k}")
            return maps[kind, k]

        top, shards, word_shards_ = model["order"], model["shards"], model["word_shards"]
        d = {x: discounts(*(model[f"n{x}_{i}"] for i in (1, 2, 3, 4))) for x in range(2, top + 1)}
        k = discounts(*(model[f"k{i}"] for i in (1, 2, 3, 4)))
        n, v, kinds = model["tokens"], model["words"], model["kinds"]
        several = v - model["k1"] - model["k2"]
        spare = (k[1] * model["k1"] + k[2] * model["k2"] + k[3] * several) / kinds if kinds else 1.0
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for a, b in row_slices(offsets, SLICE):
                part = offsets[a:b + 1]
                before, word, starts = pairs(data[part[0]:part[-1]], part - part[0])
                known, at = np.unique(np.concatenate([before, word]), return_inverse=True)
                (total, once, twice, more, types, count), _ = _looked_up(known, word_shards(known, word_shards_), opened, "words", 6)
                alone = spare / (v + 1) + np.maximum(types - k[np.minimum(types, 3).astype(np.int64)], 0) / max(kinds, 1)
                u, w = at[:len(before)], at[len(before):]
                lags = words_before(before, starts, top)
                context, spread = contexts(lags), all_frequent(lags[:2], frequent)
                p, place = alone[w], np.full(len(word), -1)
                close, far = np.flatnonzero(~spread[0]), np.flatnonzero(spread[0])
                for level in range(2, top + 1):
                    c_, dk, hashes = context[level - 2], d[level], pair_hashes(context[level - 2], word)
                    of = gram_shards(lags[:level - 1], hashes, frequent, shards)
                    c, sums = np.zeros(len(word), np.int64), [np.zeros(len(word), np.int64) for _ in range(4)]
                    (c[far],), _ = _looked_up(hashes[far], of[far], opened, f"far{level}", 1)
                    if level == 2:
                        sums = [x[u] for x in (total, once, twice, more)]
                        (c[close],), place[close] = _looked_up(hashes[close], of[close], opened, "grams2", 1)
                    else:
                        before_ = np.full(len(word), -1)
                        for kind, rows, dealt in (
                                (f"contexts{level}", close, of), (f"farcontexts{level}", far[~spread[1][far]], of),
                                (f"spread{level}", np.flatnonzero(spread[1]), word_shards(c_, word_shards_))):
                            found, at = _looked_up(c_[rows], dealt[rows], opened, kind, 4)
                            for s, f in zip(sums, found):
                                s[rows] = f
                            before_[rows] = at
                        rows = close[(before_[close] >= 0) & (place[close] >= 0)]
                        pair, place = (before_[rows], place[rows]), np.full(len(word), -1)
                        (c[rows],), place[rows] = _looked_up(hashes[rows], of[rows], opened, f"pairs{level}", 1, pair)
                    all_, whole = sums[0], np.maximum(sums[0], 1)
                    rest = (dk[1] * sums[1] + dk[2] * sums[2] + dk[3] * sums[3]) / whole
                    p = np.where(all_ > 0, np.maximum(c - dk[np.minimum(c, 3).astype(np.int64)], 0) / whole + rest * p, p)
                base = np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
                add = lambda x: pa.array(np.add.reduceat(x, starts))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(np.diff(starts, append=len(word))),
                     add((count[w] > 0).astype(np.int64)), add(base), add(np.log10(p))],
                    [*batch.schema.names, "n_tokens", "n_known", "base_score", "score"])
    return run


def log_probabilities(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) of each row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _score(model, 1), f"doc_id {kind}, text string, n_tokens long, n_known long, base_score double, score double")
    return found.drop("text").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def fold(of: int = 10) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null doc_id, which is never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % of
