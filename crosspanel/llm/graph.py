"""Connected components as alternating star steps over staged edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from crosspanel.session import stage_root


def staged(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """``df`` written to the shared folder and read back, its rows and a checksum of them."""
    spark, seen = df.sparkSession, Observation()
    path = f"{stage_root(spark)}/crosspanel/llm-{label}-{uuid.uuid4().hex}"
    check = F.sum(F.xxhash64(*df.columns).bitwiseAND(0xFFFFFFFF))
    df.observe(seen, F.count(F.lit(1)).alias("n"), check.alias("check")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"], seen.get["check"] or 0


def _toward_smallest(pairs: DataFrame, below: bool) -> DataFrame:
    """Each node sends its neighbours (all above it, or all below) to the smallest it knows."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = pairs.join(least, "a")
    if below:
        moved = joined.select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``: the smallest node it reaches.

    Large-star and small-star steps alternate until nothing moves, so any graph
    settles in logarithmically many rounds. A hub's minimum is a partial
    aggregate; its edges meet it in a join that can be split. Null ends, loops
    and repeated edges count for nothing; no edges give no rows.
    """
    links, n, check = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges")
    while n:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, *_ = staged(_toward_smallest(both, below=False), "large")
        links, n, now = staged(_toward_smallest(large, below=True), "small")
        if now == check:
            break
        check = now
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
