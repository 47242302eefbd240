"""Cosine near-duplicates of vectors by int8 tile products (operator 8).

Equal vectors are one class. Classes are dealt into groups of near ones: by the
nearest of a few pivot vectors, large cells further by hash. Every two groups
whose caps (mean direction and widest angle) come close enough meet in one task;
there int8 tiles are multiplied. A quantised vector's own error norm e bounds
the error of a product by ``e_x |y'| + e_y`` with |y'| the quantised norm, so a
pair is linked for sure, apart for sure, or computed anew in double precision.
Caps that are too far apart hold no link, so leaving them out loses none.

The work is that of all pairs where vectors point everywhere alike, as a
threshold join without index must be; each task holds two groups of at most
about ``GROUP`` vectors. A task returns link counts and a spanning forest,
never its pairs, so a huge group of near copies costs no more rows than others.

Vectors that are null, zero or hold null or non-finite components, and vectors
of another length than each other, link with nothing. Rows that repeat a vec_id
are one vector each in the counts and one node in the components; a row with a
null vec_id has n_links 0, no component, and is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.graph import connected_components, staged

THRESHOLD, GROUP, TILE, PIVOTS = 0.9, 8192, 1024, 64
_SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors divided by their norms, which are measured after scaling so that none over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, the scale, and the error's norm of unit vectors."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    q = np.rint(x / scale).astype(np.int8)
    return q, scale[:, 0], np.sqrt(((x - q * scale) ** 2).sum(1)) + _SLACK


def links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float):
    """Index pairs (i, j) with cosine at least the threshold, tile by tile; once each (i < j) if x and y are the same."""
    (qx, sx, ex), (qy, sy, ey) = quantised(x), quantised(y)
    # Products of int8 values stay exact integers in float32 up to 1040 dimensions.
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    qx, qy = qx.astype(kind), qy.astype(kind)
    for a in range(0, len(x), TILE):
        for b in range(a if same else 0, len(y), TILE):
            i, j = slice(a, a + TILE), slice(b, b + TILE)
            near = (qx[i] @ qy[j].T).astype(np.float64) * sx[i, None] * sy[None, j]
            error = ex[i, None] * (1 + ey[None, j]) + ey[None, j] + _SLACK
            sure = near - error >= threshold
            rows, cols = np.nonzero((near + error >= threshold) & ~sure)
            for k in range(0, len(rows), 1 << 15):
                r, c = rows[k:k + (1 << 15)], cols[k:k + (1 << 15)]
                sure[r, c] = np.einsum("ij,ij->i", x[i][r], y[j][c]) >= threshold
            if same and a == b:
                sure = np.triu(sure, 1)
            rows, cols = np.nonzero(sure)
            if len(rows):
                yield rows + a, cols + b


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; its rows have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cells(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = (unit(_vectors(batch.column(2))) @ pivots.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])
    return run


_GROUPED = "size int, cell int, block long, ids binary, copies binary, vectors binary, middle array<double>, angle double"


def _gather(table: pa.Table) -> pa.Table:
    """One row for a group: its vectors as blobs, its mean direction and widest angle from it."""
    x = unit(_vectors(table.column("embedding").combine_chunks()))
    middle = x.mean(0)
    middle /= np.linalg.norm(middle) or 1.0
    angle = float(np.arccos(np.clip(x @ middle, -1, 1)).max()) + 1e-7 if np.any(middle) else float(np.pi)
    blobs = [np.ascontiguousarray(v).tobytes() for v in (
        table.column("vec_id").to_numpy().astype(np.int64), table.column("copies").to_numpy().astype(np.int64), x)]
    first = [table.column(c)[0].as_py() for c in ("size", "cell", "block")]
    return pa.table([pa.array([v]) for v in (*first, *blobs)]
                    + [pa.array([middle.tolist()], pa.list_(pa.float64())), pa.array([angle])],
                    schema=pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()),
                                      *((c, pa.binary()) for c in ("ids", "copies", "vectors")),
                                      ("middle", pa.list_(pa.float64())), ("angle", pa.float64())]))


def _meet(groups: list[tuple[int, np.ndarray, float]], threshold: float):
    """Each group once for every group it must meet, itself included."""
    order = {size: k for k, size in enumerate(sorted({len(m) for _, m, _ in groups}))}
    by_size = {size: ([g for g, m, _ in groups if len(m) == size], np.stack([m for _, m, _ in groups if len(m) == size]),
                      np.array([a for _, m, a in groups if len(m) == size])) for size in order}

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                own, angle = row.column(0)[0].as_py(), row.column(5)[0].as_py()
                middle = np.array(row.column(4)[0].as_py())
                ids, middles, angles = by_size[len(middle)]
                apart = np.arccos(np.clip(middles @ middle, -1, 1)) - angles - angle
                other = np.array(ids)[(apart <= np.arccos(threshold) + 1e-7) | (np.array(ids) == own)]
                n = len(other)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other))]
                    + [row.column(c).take(pa.array([0] * n)) for c in (0, 1, 2, 3)],
                    ["low", "high", "group", "ids", "copies", "vectors"])
    return run


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("group", "ids", "copies", "vectors"))))
        ids = [np.frombuffer(p[1], np.int64) for p in parts]
        copies = [np.frombuffer(p[2], np.int64) for p in parts]
        x = [np.frombuffer(p[3], np.float64).reshape(len(i), -1) for p, i in zip(parts, ids)]
        same = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        n = len(ids[0])
        every, weight = (ids[0], copies[0]) if same else (np.concatenate(ids), np.concatenate(copies))
        found, root = np.zeros(len(every), np.int64), np.arange(len(every))
        if same or len(parts) == 2:
            for i, j in links(x[0], x[0] if same else x[1], same, threshold):
                j = j if same else j + n
                np.add.at(found, i, weight[j])
                np.add.at(found, j, weight[i])
                while True:  # smallest index of each component of all links so far
                    low = np.minimum(root[i], root[j])
                    before = root.copy()
                    np.minimum.at(root, root[i], low)
                    np.minimum.at(root, root[j], low)
                    np.minimum.at(root, i, low)
                    np.minimum.at(root, j, low)
                    root = root[root]
                    if (root == before).all():
                        break
        while (root[root] != root).any():
            root = root[root]
        keep = found > 0
        return pa.table([pa.array(every[keep]), pa.array(found[keep]), pa.array(every[root[keep]])],
                        names=["vec_id", "n_links", "root"])
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("content", F.when(sound, F.sha2(F.to_json("embedding"), 256)))
    rows, *_ = staged(rows, "vectors")
    classes, n, _ = staged(rows.where("content is not null").groupBy("content").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .select("vec_id", "copies", "embedding", "content", F.size("embedding").alias("size")), "vector-classes")
    edges = rows.where("content is not null").select("vec_id", "content").join(
        classes.select(F.col("vec_id").alias("b"), "content"), "content").select(F.col("vec_id").alias("a"), "b")
    if n:
        sizes = [r["size"] for r in classes.select("size").distinct().collect()]
        cells = None
        for size in sizes:
            some = classes.where(F.col("size") == size)
            lead = some.orderBy(F.xxhash64("content")).limit(pivots).toArrow()
            sent = unit(_vectors(lead["embedding"].combine_chunks()))
            dealt = some.select("vec_id", "copies", "embedding", "size").mapInArrow(
                _cells(sent), "vec_id long, copies long, embedding array<double>, size int, cell int")
            cells = dealt if cells is None else cells.unionByName(dealt)
        cells, *_ = staged(cells, "cells")
        wide = cells.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / group).alias("blocks"))
        groups, *_ = staged(cells.join(F.broadcast(wide), ["size", "cell"]).withColumn(
            "block", F.pmod(F.xxhash64("vec_id"), "blocks")).groupBy("size", "cell", "block").applyInArrow(_gather, _GROUPED).select(
            F.xxhash64("size", "cell", "block").alias("group"), "ids", "copies", "vectors", "middle", "angle"), "groups")
        caps = [(r.group, np.array(r.middle), r.angle) for r in groups.select("group", "middle", "angle").toLocalIterator()]
        found, *_ = staged(groups.mapInArrow(
            _meet(caps, threshold), "low long, high long, group long, ids binary, copies binary, vectors binary")
            .groupBy("low", "high").applyInArrow(_compare(threshold), "vec_id long, n_links long, root long"), "found")
        counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("linked"))
        edges = edges.unionByName(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    else:
        counts = classes.select("vec_id", F.lit(0).cast("long").alias("linked"))
    of_class = classes.join(counts, "vec_id", "left").select(
        "content", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    parts = connected_components(edges).withColumnRenamed("node", "vec_id")
    return rows.join(of_class, "content", "left").join(parts, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
