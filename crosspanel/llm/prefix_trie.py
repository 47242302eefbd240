"""A trie of conversation prefixes, counted in flat arrays behind minimal perfect hashes.

Every conversation is rebuilt on the beginning of its hundred's first one, and
each prefix of it gets a digest chained over its turns. Equal digests are one
node: counts, smallest member and ends are partial aggregates, so a first turn
or a whole conversation that a third of all share costs no more than others.

Subtree sums need parents and children together. Nodes with at least ``wide``
members form the trie's top, the rest falls apart into subtrees of fewer
members, which are dealt over shards whole. In a shard, every distinct digest
gets a slot by a minimal perfect hash (levels of bits, each key at the first
level where it stands alone), the slot's stored digest is compared, counts are
scattered into flat arrays, and sums go up through the array of parent slots,
deepest first. Subtrees then hand their totals to the top, which is one more,
small shard: at most 1,024 nodes of each depth while there are fewer than a
hundred million conversations. A node with one member has a single line below
it, whose sums are known; only the first node of such a line enters a shard.

Lists of members that end at a node are joined in blocks of 64 neighbouring
ids, those 64 at a time, and stream into the digest in order.

One conversation's turns stream through one task, sorted on disk; of a
hundred's first conversation five turns are remembered.

Defined results: a null role or text is empty; rows with a null conv_id belong
to no conversation; turns with equal numbers are ordered by the digest of role
and text, repeated rows are turns of their own; the remainder of a negative id
is negative. No conversations give no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.graph import staged

BLOCK = 100                     # conversations that share a beginning
HEADS = 6                       # the shared beginning has fewer turns than this
WIDE_SHARE, WIDE_MOST = 1024, 100_000
SHARD_ROWS = 100_000
BROADCAST_ROWS = 200_000
FLUSH = 1 << 16

PREFIXES = "n0 long, n1 long, p0 long, p1 long, depth long, conv_id long, chars long, ends long"
SUMS = ("n0 long, n1 long, p0 long, p1 long, depth long, conv_id long, n_convs long, parent_conv_id long, "
        "n_children long, n_leaves long, saved_tokens long, outside boolean")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


# --- prefixes -----------------------------------------------------------------

def _prefix_rows(batches):
    """Rows of PREFIXES of the conversations of a sorted partition, streaming."""
    base = conv = None
    head, position, skip, last = [], 0, 0, None
    root = (0, 0, None, None, 0)

    def step(before, digest, chars):
        node = hashlib.md5(np.array(before[:2], np.int64).tobytes() + digest).digest()
        return (*np.frombuffer(node, np.int64).tolist(), before[0], before[1], before[4] + 1), chars

    for batch in batches:
        for now_base, now, h, digest, chars in zip(*(c.to_pylist() for c in batch.columns)):
            if now != conv:
                if conv is not None:
                    yield (*last[0], conv, last[1], 1)
                if now_base != base:
                    base, head = now_base, []
                conv, position, last = now, 0, (root, 0)
                skip = 0 if now == base else h
                for d, n in head[:skip]:
                    yield (*last[0], conv, last[1], 0)
                    last = step(last[0], d, n)
            position += 1
            if now == base and position < HEADS:
                head.append((digest, chars))
            if position > skip:
                yield (*last[0], conv, last[1], 0)
                last = step(last[0], digest, chars)
    if conv is not None:
        yield (*last[0], conv, last[1], 1)


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included.

    A node and its parent are 128-bit digests in two numbers; ``chars`` counts
    the code points of the prefix's last text; ``ends`` marks the whole.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.expr("conv_id - conv_id % 100").cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.char_length(text).cast("long").alias("chars"))
    schema = _schema(PREFIXES)

    def run(batches):
        block = []
        for row in _prefix_rows(batches):
            block.append(row)
            if len(block) == FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block)], schema=schema)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block)], schema=schema)

    # A hundred's first conversation leads its partition's run of that hundred.
    return (rows.repartition("base")
            .sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
            .select("base", "conv_id", "h", "digest", "chars").mapInArrow(run, PREFIXES))


# --- arrays of a shard --------------------------------------------------------

def _places(k0: np.ndarray, k1: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = (k0 ^ (k1 * np.uint64(2 * level + 1))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def perfect_hash(k0: np.ndarray, k1: np.ndarray) -> tuple[list, np.ndarray]:
    """(levels, slot of every key): distinct keys get the slots 0 to n - 1."""
    slots, left, first, levels = np.full(len(k0), -1), np.arange(len(k0)), 0, []
    while len(left):
        size = 2 * len(left)
        at = _places(k0[left], k1[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = first + np.cumsum(alone) - 1
        placed = alone[at]
        slots[left[placed]] = rank[at[placed]]
        levels.append((alone, rank))
        first += int(alone.sum())
        left = left[~placed]
        if len(levels) > 200:
            raise ValueError("prefix digests are not distinct")
    return levels, slots


def lookup(levels: list, q0: np.ndarray, q1: np.ndarray) -> np.ndarray:
    """The slot a key has if it is one of the hash's own; -1 or any slot if not."""
    slots, left = np.full(len(q0), -1), np.arange(len(q0))
    for level, (alone, rank) in enumerate(levels):
        at = _places(q0[left], q1[left], level, len(alone))
        hit = alone[at]
        slots[left[hit]] = rank[at[hit]]
        left = left[~hit]
    return slots


def accumulate(t: pa.Table) -> pa.Table:
    """Sums over subtrees of the nodes in ``t``, on top of what lies below them elsewhere (add_*)."""
    col = lambda name: t.column(name).to_numpy()
    n0, n1 = col("n0").view(np.uint64), col("n1").view(np.uint64)
    levels, slot = perfect_hash(n0, n1)
    size = len(slot)
    if size and (np.bincount(slot, minlength=size) != 1).any():
        raise ValueError("two prefixes share a slot")

    def scattered(values):
        out = np.zeros(size, np.int64)
        out[slot] = values
        return out

    inside = t.column("p0").is_valid().to_numpy()
    p0, p1 = (t.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("p0", "p1"))
    row_at = scattered(np.arange(size))
    up = lookup(levels, p0, p1)
    known = np.flatnonzero(inside & (up >= 0))
    same = (n0[row_at[up[known]]] == p0[known]) & (n1[row_at[up[known]]] == p1[known])
    parent = np.full(size, -1)
    parent[slot[known[same]]] = up[known[same]]

    depth, members, conv = scattered(col("depth")), scattered(col("n_convs")), scattered(col("conv_id"))
    children, leaves = scattered(col("add_children")), scattered(col("add_leaves"))
    saved = scattered(col("add_saved")) + (members - 1) * scattered(col("chars"))
    has = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[has], 1)
    leaves += children == 0
    deepest_first = has[np.argsort(-depth[has], kind="stable")]
    ends = np.flatnonzero(np.diff(depth[deepest_first])) + 1
    for nodes in np.split(deepest_first, ends):
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])

    mine = parent[slot]
    up_conv = pa.array(conv[mine], pa.int64(), mask=mine < 0)
    keys = [t.column(c).combine_chunks() for c in ("n0", "n1", "p0", "p1", "depth", "conv_id", "n_convs")]
    rest = [pa.array(x[slot]) for x in (children, leaves, saved)]
    return pa.Table.from_arrays([*keys, up_conv, *rest, pa.array(inside & (mine < 0))], schema=_schema(SUMS))


def _summed(nodes: DataFrame) -> DataFrame:
    """``accumulate`` over every partition as it stands."""
    def run(batches):
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from accumulate(pa.Table.from_batches(held)).to_batches()
    return nodes.select("n0", "n1", "p0", "p1", "depth", "conv_id", "n_convs", "chars", "add_children", "add_leaves",
                        "add_saved").mapInArrow(run, SUMS)


# --- the trie -----------------------------------------------------------------

def _end_digests(rows: DataFrame) -> DataFrame:
    """(n0, n1, ends_sha256) over the sorted ids that end at each node."""
    blocks = rows.where("ends = 1").groupBy("n0", "n1", F.expr("shiftright(conv_id, 6)").alias("b")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("t"))
    runs = blocks.groupBy("n0", "n1", F.expr("shiftright(b, 6)").alias("r")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "t"))), lambda s: s.t), ",").alias("t"))
    ddl = "n0 long, n1 long, ends_sha256 string"
    schema = _schema(ddl)

    def digests(batches):
        node = digest = None
        for batch in batches:
            for n0, n1, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (n0, n1) != node:
                    if node:
                        yield *node, digest.hexdigest()
                    node, digest = (n0, n1), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if node:
            yield *node, digest.hexdigest()

    def run(batches):
        block = []
        for row in digests(batches):
            block.append(row)
            if len(block) == FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
    return runs.repartition("n0", "n1").sortWithinPartitions("n0", "n1", "r").select("n0", "n1", "t").mapInArrow(run, ddl)


def prefix_trie(conversations: DataFrame, wide: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``wide`` members put a node into the top; unset, the 1,024th part of all
    conversations, from 2 to 100,000.
    """
    spark = conversations.sparkSession
    rows, *_ = staged(prefixes(conversations), "prefixes")
    same = [F.min(c) == F.max(c) for c in ("depth", "chars")]
    nodes, *_ = staged(rows.groupBy("n0", "n1").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("p0").alias("p0"), F.max("p1").alias("p1"),
        F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.sum("ends").alias("ends"),
        F.coalesce((F.min("p0") == F.max("p0")) & (F.min("p1") == F.max("p1")), F.lit(True)).alias("_one"),
        (same[0] & same[1]).alias("_alike"))
        .withColumn("n_convs", F.when(F.col("_one") & F.col("_alike"), F.col("n_convs")).otherwise(
            F.raise_error(F.lit("two prefixes share a digest")).cast("long"))).drop("_one", "_alike"), "trie-nodes")
    total = nodes.where("depth = 0").agg(F.sum("n_convs")).first()[0] or 0
    wide = wide or min(max(total // WIDE_SHARE, 2), WIDE_MOST)
    top, n_top, _ = staged(nodes.where(f"n_convs >= {wide} OR depth = 0"), "trie-top")
    small = F.broadcast if n_top <= BROADCAST_ROWS else (lambda df: df)
    keys = small(top.select("n0", "n1"))

    # The subtree below the top that each conversation runs into, and where it is alone.
    cuts = rows.join(keys, ["n0", "n1"], "left_anti").groupBy("conv_id").agg(
        F.min_by("n0", "depth").alias("c0"), F.min_by("n1", "depth").alias("c1"))
    below = nodes.join(keys, ["n0", "n1"], "left_anti")
    alone = below.where("n_convs = 1").groupBy("conv_id").agg(F.min("depth").alias("alone"))
    below, n_below, _ = staged(below.join(cuts.join(alone, "conv_id", "left"), "conv_id"), "trie-below")
    line = F.when(F.col("n_convs") == 1, 1 - F.col("ends")).otherwise(0).cast("long")
    entering = below.where("n_convs > 1 OR depth = alone").select(
        "*", line.alias("add_children"), line.alias("add_leaves"), F.lit(0).cast("long").alias("add_saved"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_below // shard_rows))
    lower, *_ = staged(_summed(entering.repartition(shards, "c0", "c1")), "trie-lower")

    handed = lower.where("outside").groupBy(F.col("p0").alias("n0"), F.col("p1").alias("n1")).agg(
        F.count(F.lit(1)).alias("add_children"), F.sum("n_leaves").alias("add_leaves"), F.sum("saved_tokens").alias("add_saved"))
    upper = _summed(top.join(handed, ["n0", "n1"], "left").fillna(0, ["add_children", "add_leaves", "add_saved"]).coalesce(1))

    owners = small(top.select(F.col("n0").alias("p0"), F.col("n1").alias("p1"), F.col("conv_id").alias("owner")))
    out = ["n0", "n1", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    found = (lower.join(owners, ["p0", "p1"], "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "owner")).select(*out)
             .unionByName(upper.select(*out))
             .unionByName(below.where("n_convs = 1 AND depth > alone").select(
                 "n0", "n1", "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs",
                 (1 - F.col("ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                 F.lit(0).cast("long").alias("saved_tokens"))))
    return found.join(_end_digests(rows), ["n0", "n1"], "left").select(
        *out[2:], F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
