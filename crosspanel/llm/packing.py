"""Best-fit packing by length patterns and non-negative least squares (operator 1).

Texts become token pieces of at most ``capacity``. Only the histogram of piece
lengths (at most ``capacity`` numbers) reaches the driver. There, patterns of a
few lengths that fill a sequence are enumerated, a non-negative least-squares
fit finds how often to repeat each, the counts are rounded down to what the
histogram holds, and the residual histogram is packed best-fit, longest first,
by whole runs of equal sequences. The result is a list of runs: each covers a
range of ranks of one length and says which sequence and offset a rank gets.
A run uses up a length or comes from a fitted pattern, and a sequence holds at
most about ``sqrt(2 * capacity)`` different lengths, so the list is bounded by
the capacity alone, whatever the number of documents.

Ranks within a length are a piece's rank inside the task that made it (stored
with it) plus the pieces of that length in earlier tasks, so no group of equal
lengths is ever gathered.

A null text is empty and becomes the end token alone; repeated rows are packed
each; no rows give no pieces.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crosspanel.llm.graph import staged
from crosspanel.llm.text import LOWER, WHITE, row_slices, span_hashes, text_bytes, word_spans

CAPACITY, END = 2048, 0
_BATCH_CHUNKS, _LINE, _GATHERED = 20_000, 128, 1 << 18

#: Byte kinds within words, as the tokenizer's first split sees them: letters, digits (each alone), other signs.
_LETTER, _DIGIT, _SIGN, _OTHER = range(1, 5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[0x21:0x7F] = _SIGN
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[0x20] = 0
#: Second bytes of Latin-1 letters, whose first byte is 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


class Arena:
    """Ids of words by the hash of their bytes, one behind the other: found once, gathered often.

    Beyond ``most`` words only those of the last slice stay, and words of more
    than ``longest`` bytes never do. A 64-bit hash tells the words of one slice
    and the kept ones apart.
    """

    def __init__(self, make, most: int = 400_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest
        self.ids = np.zeros(0, "<u4")
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands among the kept ones, and whether it does."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def _add(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        ids, size = self.make(chunks)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        hashes, at, size = (np.concatenate(x) for x in ((self.hashes, hashes), (self.at, at), (self.size, size)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.size = hashes[order], at[order], size[order]

    def _keep(self, chosen: np.ndarray) -> None:
        """Only the chosen words, their ids moved together."""
        self.hashes, at, self.size = self.hashes[chosen], self.at[chosen], self.size[chosen]
        self.ids = self.ids[_spread(at, self.size)]
        self.at = np.cumsum(self.size) - self.size

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and how many each word has."""
        hashes, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        fresh = ~self._places(hashes)[1]
        long = hashes[fresh][(ends - starts)[one[fresh]] > self.longest]
        if fresh.any():
            raw = data.tobytes()
            self._add(hashes[fresh], [raw[i:j] for i, j in zip(starts[one[fresh]].tolist(), ends[one[fresh]].tolist())])
        places = self._places(hashes)[0]
        at, size = self.at[places][which], self.size[places][which]
        ids = [self.ids[_spread(at[k:k + _GATHERED], size[k:k + _GATHERED])] for k in range(0, len(at), _GATHERED)]
        chosen = ~np.isin(self.hashes, long) if len(long) else np.ones(len(self.hashes), bool)
        if len(self.hashes) > self.most:
            used = np.zeros(len(self.hashes), bool)
            used[places] = True
            chosen &= used
        if not chosen.all():
            self._keep(chosen)
        return np.concatenate(ids) if ids else self.ids[:0], size


class Encoder:
    """Little-endian unsigned 32-bit ids of texts.

    The tokenizer drops white space and never joins what white space parts, so a
    text's ids are those of its words in a row. Words of letters, digits and
    signs alone are in turn the ids of their parts in a row.
    """

    def __init__(self, tokenizer: Tokenizer, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        self.tokenizer, self.end = tokenizer, end
        self.closes = np.zeros(tokenizer.get_vocab_size(), bool)
        self.closes[[k for piece, k in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.lowers = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
        self.words, self.parts = Arena(self._of_words), Arena(self._of_parts)

    def _alone(self, chunks: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for k in range(0, len(chunks), _BATCH_CHUNKS)
                for e in self.tokenizer.encode_batch_fast(
                    [c.decode() for c in chunks[k:k + _BATCH_CHUNKS]], add_special_tokens=False)]

    def _of_parts(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Parts many at a time, told apart again by the pieces that end one; lines where that fails part by part."""
        lines = [chunks[k:k + _LINE] for k in range(0, len(chunks), _LINE)]
        made, sizes = [], []
        texts = [b" ".join(x).decode() for x in lines]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(line):
                apart = self._alone(line)
                ids, ends = np.concatenate(apart), np.cumsum([*map(len, apart)])
            made.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(made), np.concatenate(sizes)

    def _of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        blob = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        stop = np.cumsum([len(w) + 1 for w in words]) - 1
        start = np.concatenate([[0], stop[:-1] + 1])
        kind = _KINDS[blob]
        lead = np.flatnonzero((blob[:-1] == 0xC3) & _LATIN[blob[1:]])
        kind[lead] = kind[lead + 1] = _LETTER
        # An apostrophe may begin a part of its own, and "<|" a special token: such words go whole.
        odd = (kind == _OTHER) | (blob == 0x27)
        odd[:-1] |= (blob[:-1] == 0x3C) & (blob[1:] == 0x7C)
        whole = np.logical_or.reduceat(odd, start)
        begins = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == _DIGIT)
        begins[lead + 1] = False
        a = np.flatnonzero(begins & (kind > 0))
        b = np.flatnonzero((kind[:-1] > 0) & begins[1:]) + 1
        of = np.searchsorted(start, a, "right") - 1
        a, b, of = (x[~whole[of]] for x in (a, b, of))
        plain, n = self.parts.find(blob, a, b)
        rest = np.flatnonzero(whole)
        apart = self._alone([words[k] for k in rest.tolist()])
        size = np.bincount(of, n, len(words)).astype(np.int64)
        size[rest] = [*map(len, apart)]
        at, out = np.cumsum(size) - size, np.empty(int(size.sum()), "<u4")
        out[_spread(at[~whole], size[~whole])] = plain
        if apart:
            out[_spread(at[rest], size[rest])] = np.concatenate(apart)
        return out, size

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with an end, and how many each text has."""
        # Special tokens are matched before letters are lowered.
        if self.lowers and not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():
            data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, WHITE)
        ids, size = self.words.find(data, starts, ends)
        sums = np.concatenate([[0], np.cumsum(size)])
        n = np.diff(sums[first]) + 1
        out = np.empty(len(ids) + len(n), "<u4")
        body = np.ones(len(out), bool)
        body[np.cumsum(n) - 1] = False
        out[body], out[~body] = ids, self.end
        return out, n


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of every run."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(at - before, size)


def _cut(tokenizer: Tokenizer, capacity: int, end: int):
    def run(batches):
        encoder, part = Encoder(tokenizer, end), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_slices(offsets):
                own = offsets[a:b + 1]
                ids, n = encoder.of(data[own[0]:own[-1]], own - own[0])
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, n[row] - piece * capacity)
                ends = 4 * np.cumsum(length)
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[i:j]) for i, j in zip((ends - 4 * length).tolist(), ends.tolist())]
                # Ranks go on from the task's earlier pieces of the same length.
                order = np.argsort(length, kind="stable")
                several, first, count = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) + np.repeat(ranks[several] - first, count)
                ranks[several] += count
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(a + row)), pa.array(piece.astype(np.int32)),
                    pa.array(piece * capacity), pa.array(length), pa.array(sums, pa.int64()),
                    pa.array(np.full(len(row), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank) of every piece of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(Tokenizer.from_file(tokenizer))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _cut(sent.value, capacity, end)(batches),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def patterns(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that fill a sequence exactly, else as far as two lengths can.

    Each length has at most about 25 in which it is the longest, and all are kept.
    """
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    # The longest length that fits into each room.
    fit = np.maximum.accumulate(np.where(there, np.arange(capacity + 1), 0))
    found: dict[tuple[int, ...], int] = {}
    for a in lengths[::-1].tolist():
        room = capacity - a
        if fit[room]:
            found[tuple(sorted((a, int(fit[room])), reverse=True))] = room - int(fit[room])
        seconds = lengths[lengths <= min(a, room)][::-1]
        for b in seconds[:: max(1, len(seconds) // 12)].tolist():
            c = int(fit[room - b])
            if c:
                left = room - b - c
                pattern = (a, b, c) + ((int(fit[left]),) if left and fit[left] else ())
                found[tuple(sorted(pattern, reverse=True))] = capacity - sum(pattern)
    return sorted(found, key=lambda p: (found[p], p))


def nonnegative(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, target: np.ndarray, width: int,
                steps: int = 400) -> np.ndarray:
    """min |A x - target| with x >= 0 for a sparse A, by accelerated projected gradients."""
    times = lambda x: np.bincount(rows, vals * x[cols], len(target))
    back = lambda r: np.bincount(cols, vals * r[rows], width)
    # The diagonal of A'A 1 bounds A'A where A has no negative entry.
    bound = np.maximum(back(times(np.ones(width))), 1e-12)
    x = y = np.zeros(width)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - target) / bound)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences as ((length, times), ...) with how often each is made; together they use up the histogram.

    Exact patterns may use up the short pieces that long ones need, so smaller
    shares of the fitted counts are tried too, and the plan with the fewest
    sequences is taken; the first that leaves no room to spare ends the search.
    A share so small that nothing of a fit is left of it isn't tried.
    """
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    fit = fitted(histogram, capacity)
    best, fewest, kept = [], None, False
    for share in (1.0, 0.9, 0.7, 0.5, 0.3, 0.1):
        made, n_fitted = _planned(histogram, capacity, fit, share)
        if kept and not n_fitted:
            break
        kept = kept or n_fitted > 0
        n = sum(times for _, times in made)
        if fewest is None or n < fewest:
            best, fewest = made, n
        if n <= least:
            break
    return best


def fitted(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, float]]:
    """Patterns that fill a sequence and how often the fit repeats each, most often first."""
    left = np.zeros(capacity + 1)
    for n, count in histogram.items():
        if n < capacity:
            left[n] = count
    candidates = [p for p in patterns(np.flatnonzero(left), capacity) if sum(p) == capacity]
    if not candidates:
        return []
    entries = [(n, k, m) for k, p in enumerate(candidates) for n, m in Counter(p).items()]
    rows, cols, vals = (np.array(c) for c in zip(*entries))
    weights = nonnegative(rows, cols, vals.astype(float), left, len(candidates))
    return [(Counter(candidates[k]), float(weights[k])) for k in np.argsort(-weights, kind="stable").tolist()]


def _planned(histogram: dict[int, int], capacity: int, fit: list[tuple[Counter, float]], share: float):
    """The sequences with a share of the fitted counts, and how many of them are fitted ones."""
    left = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    made: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        for n, m in pattern.items():
            left[n] -= m * times
        made.append((tuple(sorted(pattern.items(), reverse=True)), times))

    if left[capacity]:
        take({capacity: 1}, int(left[capacity]))
    n_fitted = 0
    for pattern, weight in fit:
        times = min(int(share * weight), *(int(left[n]) // m for n, m in pattern.items()))
        if times > 0:
            take(pattern, times)
            n_fitted += times
    # Residuals, longest first: fill up with the longest that fits, and repeat while counts last.
    heap = [-int(n) for n in np.flatnonzero(left)]
    heapq.heapify(heap)
    while heap:
        top = -heap[0]
        if not left[top]:
            heapq.heappop(heap)
            continue
        pattern, room = Counter({top: 1}), capacity - top
        while room:
            free = left[:room + 1].copy()
            for n, m in pattern.items():
                if n <= room:
                    free[n] -= m
            fits = np.flatnonzero(free > 0)
            if not len(fits):
                break
            n = int(fits[-1])
            m = int(min(room // n, free[n]))
            pattern[n] += m
            room -= n * m
        take(pattern, min(int(left[n]) // m for n, m in pattern.items()))
    return made, n_fitted


def runs(made: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in each, first offset), by length and rank."""
    rank, sequence, out = Counter(), 0, []
    for pattern, times in made:
        offset = 0
        for n, m in pattern:
            out.append((n, rank[n], sequence, m, offset))
            rank[n] += m * times
            offset += n * m
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _place(table: np.ndarray):
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (n << 44) + rank, "right") - 1
            _, first, sequence, times, offset = table[at].T
            since = rank - first
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in range(5)), pa.array(sequence + since // times),
                pa.array(offset + since % times * n)],
                [*batch.schema.names[:5], "sequence_id", "offset"])
    return run


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces, n, _ = staged(token_pieces(docs, tokenizer, capacity, end), "pieces")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    by_part, *_ = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = by_part.select("part", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    table = docs.sparkSession.sparkContext.broadcast(runs(plan(histogram, capacity)))
    return ranked.mapInArrow(lambda batches: _place(table.value)(batches), schema)
