"""MinHash near-duplicates by a multi-index Hamming join (operator 6).

A text's set holds its distinct ``width``-word shingles. Each set gets a
signature of ``chunks * symbols`` 16-bit MinHash symbols. By pigeonhole, two
signatures that differ in fewer than ``2 * chunks`` places have a chunk with at
most one wrong symbol; leaving out each symbol of each chunk in turn enumerates
those errors, so all such pairs share a key. A pair at similarity 0.8 misses
every chunk with probability ``0.263 ** 12``, about 1e-7. All shared keys are
followed, whatever the rest of the signature says, and confirmed on full sets.

Groups never turn into all their pairs: equal sets are one class; a bucket first
links its members to its smallest one, its hub; only members that are still in
another component than their hub are then compared with the hub's other members,
in blocks whose tasks return links, never candidate pairs.

Null or wordless texts have empty sets and link with nothing. Rows that share a
doc_id are one document. A null doc_id links with nothing and is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.graph import connected_components, staged
from crosspanel.llm.sieve import sieve, sieved
from crosspanel.llm.text import free_name, mixed, row_slices, text_bytes, word_hashes

WIDTH, SIMILARITY, CHUNKS, SYMBOLS = 5, 80, 12, 5

_ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """The sorted distinct shingle hashes of each row; a short row is one shingle, an empty one none."""
    hashes, first = word_hashes(data, offsets)
    grams = hashes.copy()
    for k in range(1, width):
        grams = grams[:-1] * _FOLD + hashes[k:] if len(grams) > 1 else grams[:0]
    grams = mixed(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a:b - width + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = np.uint64((int(whole) * int(_FOLD) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            yield mixed(np.array([whole]))
        else:
            yield grams[:0]


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """MinHash signatures of non-empty sets: (sets, places) of 16-bit symbols."""
    out = np.empty((len(sets), places), np.uint16)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 1 << 16):
            n, to = n + len(sets[to]), to + 1
        values = np.concatenate(sets[at:to])
        begins = np.cumsum([0, *map(len, sets[at:to - 1])])
        for k in range(places):
            least = np.minimum.reduceat(values * _ODD[k], begins)
            out[at:to, k] = mixed(least) >> np.uint64(48)
        at = to
    return out


def _describe(width: int, places: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_slices(offsets):
                part = offsets[a:b + 1]
                sets = list(shingle_sets(data[part[0]:part[-1]], part - part[0], width))
                sizes = [len(x) for x in sets]
                made = iter(signatures([x for x in sets if len(x)], places))
                signs = [next(made).tobytes() if n else None for n in sizes]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "content", "signature"])
    return run


def described(docs: DataFrame, width: int = WIDTH, chunks: int = CHUNKS, symbols: int = SYMBOLS) -> DataFrame:
    """(doc_id, n_shingles, content, signature) of each row; content names the set."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _describe(width, chunks * symbols), "doc_id long, n_shingles long, content binary, signature binary")


def _keys(chunks: int, symbols: int):
    """One key for each chunk and each place left out of it."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            signs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).astype(np.uint64)
            signs = signs.reshape(n, chunks, symbols)
            keys = np.zeros((n, chunks, symbols), np.uint64)
            for gone in range(symbols):
                for k in range(symbols):
                    if k != gone:
                        keys[:, :, gone] = keys[:, :, gone] * _FOLD + signs[:, :, k] + np.uint64(1)
            keys = mixed(keys + np.arange(1, chunks * symbols + 1, dtype=np.uint64).reshape(chunks, symbols) * _ODD[0])
            each = chunks * symbols
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.reshape(-1).view(np.int64)),
                pa.array(np.repeat(batch.column(0).to_numpy(), each)),
                pa.array(np.repeat(batch.column(1).to_numpy(), each))], ["key", "doc_id", "n"])
    return run


def _fits(a: Column, b: Column, similarity: int) -> Column:
    """Sets whose sizes alone allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def _sets(width: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_slices(offsets):
                part = offsets[a:b + 1]
                sets = shingle_sets(data[part[0]:part[-1]], part - part[0], width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "shingles"])
    return run


def _confirm(similarity: int):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
                good.append(common > 0 and 100 * common >= similarity * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
    return run


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents named in ``ids(doc_id)``."""
    texts = sieved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                   "doc_id", sieve(ids), named=True).join(ids, "doc_id", "left_semi")
    return staged(texts.mapInArrow(_sets(width), "doc_id long, shingles binary"), "sets")[0]


def linked(sets: DataFrame, pairs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full ``sets(doc_id, shingles)`` are similar enough."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_confirm(similarity), "a long, b long")


def _compare_blocks(similarity: int):
    """Links from the left sets of a block pair to its right ones in other components, one for each component."""
    def run(table: pa.Table) -> pa.Table:
        ids, parts, lefts = (table.column(c).to_pylist() for c in ("doc_id", "part", "left"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        left = [k for k, x in enumerate(lefts) if x]
        sizes = np.array([len(sets[k]) for k in left], np.int64)
        of = np.repeat(np.arange(len(left)), sizes)
        values = np.concatenate([sets[k] for k in left]) if left else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, of = values[order], of[order]
        own = np.array([parts[k] for k in left], np.int64)
        found = {}
        for k in (k for k, x in enumerate(lefts) if not x and left):
            low, high = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(of[at], minlength=len(left))
            good = (100 * common >= similarity * (sizes + len(sets[k]) - common)) & (common > 0) & (own != parts[k])
            for j in np.flatnonzero(good).tolist():
                found[left[j], parts[k]] = k
        pairs = [(ids[j], ids[k]) for (j, _), k in found.items()]
        return pa.table([pa.array([x[c] for x in pairs], pa.int64()) for c in (0, 1)], names=["a", "b"])
    return run


def _beyond_hubs(sets: DataFrame, members: DataFrame, parts: DataFrame, similarity: int,
                 block: int = 1 << 16, deal: int = 512) -> DataFrame:
    """Links between members of a hub's buckets that lie in different components.

    Those apart from the hub meet all the others in blocks of bounded size;
    only links leave a task, so members that share much and link little cost
    comparisons but no rows.
    """
    of = parts.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "part")
    wide = members.where("size > 2 and doc_id <> hub").select("hub", "doc_id", "n").distinct() \
        .join(of, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    wide, *_ = staged(wide, "wide")
    # A hub may have a great many members: sums by hub and part first, few rows by hub alone.
    by_part = wide.groupBy("hub", "part").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("rows"))
    hubs = by_part.groupBy("hub").agg(
        F.sum("own").alias("all"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("members"))
    hubs = hubs.join(of.select(F.col("doc_id").alias("hub"), F.col("part").alias("hub_part")), "hub", "left") \
        .withColumn("hub_part", F.coalesce("hub_part", "hub"))
    near = by_part.select("hub", F.col("part").alias("hub_part"), "own")
    sums = hubs.join(near, ["hub", "hub_part"], "left").withColumn("few", F.col("all") - F.coalesce("own", F.lit(0)))
    sums, *_ = staged(sums.where("few > 0 and parts > 1").select(
        "hub", "hub_part", "members", F.ceil(F.col("few") / block).cast("int").alias("rows"),
        F.ceil(F.col("all") / block / 4).cast("int").alias("cols")), "hubs")
    # Members meet their hub's sums in as many deals as its size asks for; its row is copied to each.
    most = sums.agg(F.max("members")).first()[0] or 1
    deals = int(min(-(-most // deal), int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    met = wide.withColumn("deal", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(deals).cast("long"))).join(
        sums.withColumn("deal", F.explode(F.lit([*range(deals)]).cast("array<long>"))), ["hub", "deal"]) \
        .withColumn("apart", F.col("part") != F.col("hub_part"))
    row, col = (F.pmod(F.xxhash64("doc_id"), c).cast("int") for c in ("rows", "cols"))
    left = met.where("apart").select("hub", "doc_id", "part", row.alias("row"), F.explode(
        F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(True).alias("left"))
    right = met.select("hub", "doc_id", "part", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"),
                       col.alias("col"), F.lit(False).alias("left"))
    sides, *_ = staged(left.unionByName(right), "sides")
    return sides.join(sets, "doc_id").groupBy("hub", "row", "col").applyInArrow(
        _compare_blocks(similarity), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY,
                    chunks: int = CHUNKS, symbols: int = SYMBOLS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest doc_id reachable over links of at least
    ``similarity`` percent; ``kept`` marks that document.
    """
    rows, *_ = staged(described(docs, width, chunks, symbols), "signatures")
    known = rows.where("doc_id is not null and n_shingles > 0")
    # Only content and doc_id cross the first exchange; a class's signature is its representative's.
    first = known.groupBy("content").agg(
        F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r"))
    classes, *_ = staged(first.select("content", "r.*"), "classes")
    same = known.select("doc_id", "content").join(
        classes.select("content", F.col("doc_id").alias("b")), "content") \
        .where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")

    keys = classes.select("doc_id", F.col("n_shingles").alias("n"), "signature").mapInArrow(
        _keys(chunks, symbols), "key long, doc_id long, n long")
    buckets = keys.groupBy("key").agg(
        F.min(F.struct("doc_id", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members, *_ = staged(keys.join(buckets, "key").select(
        "key", "doc_id", "n", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"), "size"), "members")
    near, *_ = staged(members.where(
        (F.col("doc_id") != F.col("hub")) & _fits(F.col("n"), F.col("hub_n"), similarity))
        .select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "near")
    # The texts of documents that share a key with another cross one exchange, once.
    sets = sets_of(docs, members.select("doc_id").distinct(), width)
    edges, *_ = staged(linked(sets, near, similarity).unionByName(same), "links")
    parts = connected_components(edges)

    more, n, _ = staged(_beyond_hubs(sets, members, parts, similarity), "more")
    if n:
        flat = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        parts = connected_components(flat.unionByName(more))
    return rows.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, columns unchanged, whatever their names."""
    found = near_duplicates(docs, width, similarity)
    ids, *_ = staged(found.select("doc_id", "kept"), "decisions")
    name = free_name(docs, "chosen")
    here = F.col("doc_id").cast("long")
    gone, *_ = staged(ids.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    # Most rows are surely kept and stay where they are; the others meet the exact list.
    bits = sieve(gone)
    kept = sieved(docs, "doc_id", bits, named=False).unionByName(
        sieved(docs, "doc_id", bits, named=True).join(gone, here == F.col(name), "left_anti"))
    again, n, _ = staged(ids.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1"), "again")
    if not n:
        return kept
    # Rows that repeat a doc_id: one of them stays.
    again = again.select(F.col("doc_id").alias(name))
    return kept.join(again, here == F.col(name), "left_anti").unionByName(
        kept.join(again, here == F.col(name), "left_semi").dropDuplicates(["doc_id"]))
