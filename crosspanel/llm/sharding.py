"""Shards of equal size by histogram sort: probe, count exactly, refine, exchange once.

Documents stand in the order of (digest of the text, digest of the id, place
at staging), so equal texts lie side by side and any order of the sources is
mixed. Candidate boundaries cut that order into intervals; every round counts
exact rows and bytes per interval across all partitions and cuts again only
the intervals that still matter: those that hold a splitter farther than
``tolerance`` from its target, and those with too many rows for one task. The
driver sees counts of intervals only, at most 4,096 of the first round and 64
of each one cut again. Then the rows are dealt once, by interval; an interval's
first slot is known from the counts, so rows are numbered without another pass.

Every step is made of DataFrame functions. An interval is cut by the digest of
the text first, by the id's where all texts in it are equal, by the place where
ids are equal too; so a text, or a repeated row, that makes up a third of the
table spreads over many tasks. Narrow rows are staged once, whole rows only on
request.

Defined results: a null text has no bytes, its checksum is 0; a null id is one
more id; equal rows all get a place of their own; an empty table gives no rows.
Columns beyond ``doc_id`` and ``text`` are ignored or, with ``whole``, returned
nested, so no name can clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.graph import staged

OVERHEAD = 8
DIGITS = 15                     # hexadecimal digits of a digest that order documents
ROOT = 4096                     # intervals of the first round
CHILDREN = 64                   # intervals that one is cut into
KEYS = ("k0", "k1", "k2")


def _digest(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _rows(docs: DataFrame, law: str, whole: bool) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"),
        (size if law == "bytes" else F.lit(1).cast("long")).alias("weight"),
        _digest(text).alias("k0"), _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k1"),
        F.monotonically_increasing_id().alias("k2"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []))


def _small(df: DataFrame, rows: list[tuple], schema: str, label: str) -> DataFrame:
    """A table of bounded size made from the driver's counts, staged and meant for broadcast."""
    columns = [part.split() for part in schema.split(", ")]
    text = json.dumps([dict(zip((name for name, _ in columns), row)) for row in rows])
    inner = ", ".join(f"{name}: {kind}" for name, kind in columns)
    table = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{inner}>>")))
    return F.broadcast(staged(table, label)[0])


def _counted(df: DataFrame) -> list[dict]:
    """Rows, weight and span of keys of every interval, in no particular order."""
    spans = [f(k).alias(f"{n}{k}") for k in KEYS for n, f in (("lo", F.min), ("hi", F.max))]
    return [r.asDict() for r in
            df.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight"), *spans).collect()]


def _cut(leaf: dict) -> tuple[int, int, int] | None:
    """(key, lowest, width) to cut ``leaf`` by: its first key that differs within it."""
    for level, key in enumerate(KEYS):
        low, high = leaf[f"lo{key}"], leaf[f"hi{key}"]
        if low < high:
            return level, low, (high - low) // CHILDREN + 1
    return None


def _to_refine(leaves: list[dict], shards: int, tolerance: int, heavy: int) -> list[int]:
    """Places of the leaves to cut again. Targets are multiples of total / shards, compared times shards."""
    total = sum(leaf["weight"] for leaf in leaves)
    out, before = [], 0
    for place, leaf in enumerate(leaves):
        after = before + leaf["weight"]
        first, last = before * shards // total + 1, min(shards - 1, (after * shards - 1) // total)
        # The leaf's inner targets; the first and the last of them are the farthest from one of its ends.
        near = tolerance * shards
        open_ = any(min(k * total - before * shards, after * shards - k * total) > near for k in range(first, last + 1))
        if (leaf["rows"] > heavy or open_) and leaf["rows"] > 1 and _cut(leaf):
            out.append(place)
        before = after
    return out


def _descend(rows: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    """Every row's interval after all ``cuts``."""
    for cut in cuts:
        child = F.expr("base + (CASE level WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END - low) div width")
        rows = rows.join(cut, "node", "left").withColumn("node", F.coalesce(child, "node")).drop(
            "level", "low", "width", "base")
    return rows


def sharded(docs: DataFrame, shards: int = 24, law: str = "bytes", tolerance: int = 0, whole: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard[, row]) of every document.

    Under the law ``bytes`` the sizes of all shards are within ``tolerance`` and
    half a document of each other's targets at both ends; ``rows`` deals equal
    counts instead, at most one apart. Tolerance 0 refines every splitter down
    to the nearest document. Slots number a shard's documents from 0.
    """
    if law not in ("bytes", "rows") or shards < 1:
        raise ValueError(f"no such law or number of shards: {law}, {shards}")
    rows, total, _ = staged(_rows(docs, law, whole), "shard-rows")
    span = 16 ** DIGITS // ROOT
    rows = rows.withColumn("node", F.expr(f"k0 div {span}L"))
    heavy = max(256, 4 * -(-total // ROOT))
    leaves = sorted(_counted(rows), key=lambda leaf: leaf["node"])
    cuts, fresh = [], ROOT
    while places := _to_refine(leaves, shards, tolerance, heavy) if total else []:
        table = []
        for place in places:
            table.append((leaves[place]["node"], *_cut(leaves[place]), fresh))
            fresh += CHILDREN
        cut = _small(rows, table, "node long, level int, low long, width long, base long", "shard-cut")
        inside = _descend(rows, cuts).join(cut.select("node"), "node", "left_semi")
        found: dict[int, list[dict]] = {}
        for leaf in sorted(_counted(_descend(inside, [cut])), key=lambda leaf: leaf["node"]):
            found.setdefault((leaf["node"] - ROOT) // CHILDREN, []).append(leaf)
        for place, row in zip(reversed(places), reversed(table)):
            leaves[place : place + 1] = found[(row[-1] - ROOT) // CHILDREN]
        cuts.append(cut)

    weight, before, slots, ends = sum(leaf["weight"] for leaf in leaves), 0, [0] * shards, []
    for leaf in leaves:
        # Splitter k lies before a leaf that it meets in its first half.
        shard = min(shards - 1, (2 * before + leaf["weight"]) * shards // (2 * weight))
        ends.append((leaf["node"], shard, slots[shard]))
        slots[shard] += leaf["rows"]
        before += leaf["weight"]
    places = _small(rows, ends, "node long, shard int, first long", "shard-places")
    within = F.row_number().over(Window.partitionBy("node").orderBy(*KEYS))
    return _descend(rows, cuts).join(places, "node").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
        (F.col("first") + within - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if whole else []))


def write_shards(docs: DataFrame, path: str, shards: int = 24, law: str = "bytes", tolerance: int = 0) -> None:
    """Whole documents as Parquet below ``path/shard=K``, each with its slot; the input row is nested in ``row``."""
    sharded(docs, shards, law, tolerance, whole=True).select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
