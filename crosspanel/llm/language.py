"""Language identification by prediction by partial matching (operator 5).

Each language has a context tree of case-folded bytes: contexts of up to
``ORDER`` bytes with the counts of the bytes that followed. A byte costs its
share among those counts; an unseen byte pays for an escape (as likely as the
number of different bytes seen there) and is looked for after the next shorter
context, without the bytes the longer one would have coded; below all contexts
lie equal shares of the remaining bytes. The trees are frozen, so a text's code
length is exact and depends on its grams only: every different gram of a slice
is costed once for every language. The shortest code names the language; the
score is its posterior under equal priors, equal lengths going to the first
name. Counts cover all training rows and no gram is left out.

A language's tree is cut by the byte before the coded one: such a part holds
whole contexts and at most 2^24 grams. Parts are files of the shared folder
(``spark.checkpoint.dir``, which must be a mounted folder) that workers map;
only the 256 counts below all contexts pass the driver for each language.

A null text or one without a letter is ``und`` with score 0; without training
rows every text is.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.kneser_ney import shared_folder
from crosspanel.llm.text import LOWER, row_slices, text_bytes

ORDER, SLICE, OPEN = 3, 2 << 20, 16_384
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it as one number; before a text come line ends."""
    n, rows = len(data), len(offsets) - 1
    held = np.full(n + ORDER * rows, 10, np.uint32)
    at = np.arange(n) + ORDER * (np.repeat(np.arange(rows), np.diff(offsets)) + 1)
    held[at] = LOWER[data]
    out = held[at]
    for k in range(1, ORDER + 1):
        out |= held[at - k] << np.uint32(8 * k)
    return out


def _tally(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        langs = batch.column(1).dictionary_encode()
        codes = langs.indices.to_numpy()
        found: dict[int, list] = {}
        for a, b in row_slices(offsets, SLICE):
            part = offsets[a:b + 1]
            made = grams(data[part[0]:part[-1]], part - part[0])
            of = np.repeat(codes[a:b], np.diff(part))
            for k in np.unique(codes[a:b]).tolist():
                found.setdefault(k, []).append(np.unique(made[of == k], return_counts=True))
        for k, parts in found.items():
            keys, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs.dictionary[k].as_py()] * len(keys)), pa.array(keys.astype(np.int64)),
                 pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def tree(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each context length: grams and counts; contexts with totals, kinds and the count their bytes have one level down."""
    levels = []
    for k in range(ORDER + 1):
        short, at = np.unique(keys & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(at, counts, len(short))
        contexts, of = np.unique(short >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
        below = np.zeros(len(contexts))
        if k:
            lower, less = levels[-1][:2]
            below = np.bincount(of, less[np.searchsorted(lower, short & np.uint32((1 << 8 * k) - 1))], len(contexts))
        levels.append((short, n, contexts, total, kinds.astype(float), below))
    return levels


_KINDS = (np.uint32, np.float64, np.uint32, np.float64, np.float64, np.float64)


def _blocks(batches):
    """Grams and counts by language and the byte before the coded one."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        keys, n = batch.column(1).to_numpy().astype(np.uint32), batch.column(2).to_numpy()
        part = langs.indices.to_numpy().astype(np.int64) << 8 | (keys >> np.uint32(8)) & np.uint32(255)
        order = np.argsort(part, kind="stable")
        begins = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
        at = [order[a:b] for a, b in zip(begins, [*begins[1:], len(order)])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([langs.dictionary[int(part[x[0]]) >> 8].as_py() for x in at], pa.string()),
             pa.array([int(part[x[0]]) & 255 for x in at], pa.int32()),
             pa.array([keys[x].tobytes() for x in at], pa.binary()),
             pa.array([n[x].astype(np.int64).tobytes() for x in at], pa.binary())], ["lang", "before", "grams", "counts"])


def _path(folder: str, lang: str, before: int) -> str:
    return f"{folder}/{hashlib.sha256(lang.encode()).hexdigest()}-{before}"


def _write(folder: str):
    """A part's levels above the lowest as a file; its counts of coded bytes are returned."""
    def run(table: pa.Table) -> pa.Table:
        lang, before = table.column("lang")[0].as_py(), table.column("before")[0].as_py()
        keys = np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
        lowest, *levels = tree(keys, counts)
        sizes = np.array([[len(x[0]), len(x[2])] for x in levels], np.int64)
        path = _path(folder, lang, before)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as file:
            sizes.tofile(file)
            for level in levels:
                for x, kind in zip(level, _KINDS):
                    x.astype(kind).tofile(file)
                    file.write(bytes(-file.tell() % 8))
        os.replace(own, path)
        return pa.table({"lang": [lang] * len(lowest[0]), "byte": pa.array(lowest[0].astype(np.int32)),
                         "n": pa.array(lowest[1].astype(np.int64))})
    return run


def _lowest(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The level below all contexts from the counts of the 256 bytes."""
    short = np.flatnonzero(counts).astype(np.uint32)
    return (short, counts[short].astype(float), np.zeros(1, np.uint32), np.array([float(counts.sum())]),
            np.array([float(len(short))]), np.zeros(1))


def _mapped(path: str, lowest: tuple[np.ndarray, ...]) -> list[tuple[np.ndarray, ...]]:
    """All levels of a part; contexts that no text of the language had have no file."""
    if not os.path.exists(path):
        return [lowest]
    whole = np.asarray(np.memmap(path, np.uint8, "r"))
    at, levels = 16 * ORDER, [lowest]
    for grams_, contexts_ in whole[:at].view(np.int64).reshape(-1, 2).tolist():
        level = []
        for size, kind in zip((grams_, grams_, *[contexts_] * 4), _KINDS):
            width = size * np.dtype(kind).itemsize
            level.append(whole[at:at + width].view(kind))
            at += width + -width % 8
        if len(levels) == 1:  # a single context, whose bytes are counted in all parts below
            known, less = lowest[:2]
            level[5] = np.array([less[np.searchsorted(known, level[0] & np.uint32(255))].sum()])
        levels.append(tuple(level))
    return levels


def code_bits(levels: list[tuple[np.ndarray, ...]], made: np.ndarray) -> np.ndarray:
    """The code length in bits of the last byte of each gram."""
    bits, open_ = np.zeros(len(made)), np.ones(len(made), bool)
    gone, gone_kinds = np.zeros(len(made)), np.zeros(len(made))
    for k in range(len(levels) - 1, -1, -1):
        short, n, contexts, total, kinds, below = levels[k]
        g = made & np.uint32((1 << 8 * (k + 1)) - 1)
        c = np.minimum(np.searchsorted(contexts, g >> np.uint32(8)), len(contexts) - 1)
        i = np.minimum(np.searchsorted(short, g), len(short) - 1)
        known = open_ & (contexts[c] == g >> np.uint32(8))
        seen = known & (short[i] == g)
        left, escape = total[c] - gone, kinds[c] - gone_kinds
        bits[seen] += np.log2((left[seen] + escape[seen]) / n[i[seen]])
        missed = known & ~seen
        paid = missed & (escape > 0)
        bits[paid] += np.log2((left[paid] + escape[paid]) / escape[paid])
        gone, gone_kinds = np.where(missed, below[c], gone), np.where(missed, kinds[c], gone_kinds)
        open_ &= ~seen
    bits[open_] += np.log2(256 - gone_kinds[open_])
    return bits


def train(docs: DataFrame) -> dict[str, tuple[str, np.ndarray]]:
    """Frozen trees by language from ``docs(text, lang)``: folder and counts of the 256 bytes.

    Rows without text or language teach nothing.
    """
    rows = docs.where("text is not null and lang is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(_tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    folder = shared_folder(docs.sparkSession)
    parts = counts.mapInArrow(_blocks, "lang string, before int, grams binary, counts binary")
    lowest = parts.groupBy("lang", "before").applyInArrow(_write(folder), "lang string, byte int, n long")
    found: dict[str, tuple[str, np.ndarray]] = {}
    for r in lowest.groupBy("lang", "byte").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r.lang, (folder, np.zeros(256, np.int64)))[1][r.byte] = r.n
    return found


def _identify(trees: dict[str, tuple[str, np.ndarray]], text: int):
    letter = regex.compile(r"\p{L}")
    lowest = {name: _lowest(counts) for name, (_, counts) in trees.items()}
    maps: dict[tuple[str, int], list] = {}

    def levels(name: str, before: int) -> list:
        if (name, before) not in maps:
            if len(maps) >= OPEN:
                maps.clear()
            maps[name, before] = _mapped(_path(trees[name][0], name, before), lowest[name])
        return maps[name, before]

    def costs(name: str, made: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
        bits = np.empty(len(made))
        for before, at in parts:
            bits[at] = code_bits(levels(name, before), made[at])
        return bits

    def run(batches):
        names = sorted(trees)
        for batch in batches:
            column = batch.column(text)
            data, offsets = text_bytes(column)
            bits = np.zeros((batch.num_rows, len(names)))
            for a, b in row_slices(offsets, SLICE):
                part = offsets[a:b + 1] - offsets[a]
                made = grams(data[offsets[a]:offsets[b]], part)
                some, at = np.unique(made, return_inverse=True)
                full = np.flatnonzero(np.diff(part)) if len(made) else np.zeros(0, int)
                before = (some >> np.uint32(8)) & np.uint32(255)
                order = np.argsort(before, kind="stable")
                begins = np.flatnonzero(np.diff(before[order].astype(int), prepend=-1)).tolist()
                parts = [(int(before[order[x]]), order[x:y]) for x, y in zip(begins, [*begins[1:], len(order)])]
                for k, name in enumerate(names):
                    if len(full):
                        bits[a + full, k] = np.add.reduceat(costs(name, some, parts)[at], part[full])
            spoken = np.array([bool(letter.search(x.as_py() or "")) for x in column], bool) & bool(names)
            if names:
                weight = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
                score = np.where(spoken, weight.max(1) / weight.sum(1), 0.0)
                best = [names[k] if s else UNKNOWN for k, s in zip(bits.argmin(1).tolist(), spoken.tolist())]
            else:
                score, best = np.zeros(batch.num_rows), [UNKNOWN] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(score)],
                [*batch.schema.names, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, trees: dict[str, tuple[str, np.ndarray]]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _identify(sent.value, 1)(batches),
        f"doc_id {kind}, text string, lang_pred string, score double").drop("text")


def fold(of: int = 4) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null doc_id, which teaches nothing."""
    return F.crc32(F.col("doc_id").cast("string")) % of
