"""Benchmark decontamination by Wu-Manber search over words (operator 2).

Every run of ``window`` words of a benchmark item is a pattern; an item with
fewer words is one pattern. Patterns of one length form a table: a block of the
last two words gives the shift, the number of words that no occurrence can end
in; where the shift is zero the block selects the patterns that end with it,
their first block narrows those, and a direct comparison confirms.

The benchmark is read in blocks of bounded text (``BLOCK_BYTES``), each searched
in turn in the same pass over the documents, so neither the driver nor a worker
ever holds more than one block's tables. Null texts have no words; items without
words and items with a null item_id have no patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import LOWER, NOT_WORD, byte_rows, free_name

WINDOW, SHARE = 13, 20
BLOCK_BYTES = 16 << 20

_SPLIT = bytes(np.where(NOT_WORD[LOWER], 32, LOWER).astype(np.uint8))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: letters a-z, digits, non-ASCII characters."""
    return text.translate(_SPLIT).split()


def pattern_tables(items: list[tuple[object, bytes]], window: int = WINDOW):
    """The items that own each pattern, and for each pattern length its shift and bucket tables."""
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            owners.setdefault(tuple(words[k:k + size]), set()).add(str(item))
    tables: dict[int, tuple[dict, dict]] = {}
    for at, pattern in enumerate(owners):
        m = len(pattern)
        block = min(2, m)
        shift, buckets = tables.setdefault(m, ({}, {}))
        for end in range(block, m + 1):
            key = pattern[end - block:end]
            shift[key] = min(shift.get(key, m), m - end)
        buckets.setdefault(pattern[m - block:], {}).setdefault(pattern[:block], {})[pattern] = at
    return list(owners.values()), tables


def search(tables: dict[int, tuple[dict, dict]], words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word ranges (from, to) inside occurrences, and the patterns that occur."""
    spans, found = [], set()
    for m, (shift, buckets) in tables.items():
        block = min(2, m)
        skip, n, end = m - block + 1, len(words), m
        while end <= n:
            key = tuple(words[end - block:end])
            step = shift.get(key, skip)
            if step:
                end += step
                continue
            begin = end - m
            same = buckets[key].get(tuple(words[begin:begin + block]))
            if same and (at := same.get(tuple(words[begin:end]))) is not None:
                spans.append((begin, end))
                found.add(at)
            end += 1
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "struct<n_words: long, spans: array<array<long>>, items: array<string>>"


def _scan(tables: Broadcast, name: str):
    def run(batches):
        owners, lengths = tables.value
        for batch in batches:
            before = batch.column(batch.num_columns - 1).to_pylist()
            text = batch.column(batch.schema.get_field_index(name))
            out = []
            for raw, old in zip(byte_rows(text), before):
                words = words_of(raw)
                spans, found = search(lengths, words)
                items = set().union(*(owners[k] for k in found))
                if old:
                    spans, items = merged(spans + [tuple(s) for s in old["spans"]]), items.union(old["items"])
                out.append({"n_words": len(words), "spans": [list(s) for s in spans], "items": sorted(items)})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out, _FOUND)], batch.schema.names)
    return run


def with_occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                     text: str = "text", into: str = "occurrences", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct of its word count, the merged word ranges inside occurrences and the items found."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(
        "item_id", F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    out = docs.withColumn(into, F.lit(None).cast(_FOUND_DDL))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields]
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        tables = pattern_tables([(r.item_id, bytes(r.text)) for r in part.toLocalIterator()], window)
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(tables), text), ", ".join(fields))
    return out


def hit_words(found: str) -> Column:
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def is_contaminated(found: str, share: int = SHARE) -> Column:
    """At least one word in ``share`` is hit."""
    hit = hit_words(found)
    return (hit > 0) & (share * hit >= F.col(f"{found}.n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, contaminated) of each row of ``docs``."""
    found = with_occurrences(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id", "occurrences.n_words", hit_words("occurrences").alias("n_hit"), "occurrences.spans",
        "occurrences.items", is_contaminated("occurrences", share).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``docs`` without contaminated documents, columns unchanged, whatever their names."""
    into = free_name(docs, "occurrences")
    found = with_occurrences(docs, benchmark, window, into=into)
    return found.where(~is_contaminated(into, share)).select(*(f"`{c}`" for c in docs.columns))
