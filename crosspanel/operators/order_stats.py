"""Exact ranks and quantiles inside groups of any size.

The largest group's row count picks the way. Groups within ``ROWS_PER_TASK``
are ordered by a plain window, one shuffle for any number of columns.

Beyond that, equal values are counted first and every different value falls
into a bucket given by a fixed, order-preserving function of the value alone
(logarithmic, about 0.8 % wide; zero has its own). A bucket with more different
values than a task may order is cut 4096 times finer, and those again: the
finest is so narrow that it holds about two million doubles at most. Counts per
(group, bucket) are a small table whose running sum says how many rows lie
below each bucket, so only the values inside one bucket are ever ordered
against each other. A cross-section holding most of the data therefore spreads
over many tasks however close its values lie, and since buckets depend on no
sample a recomputed task gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.groups import ROWS_PER_TASK, fits
from crosspanel.session import bounded_like, stage

RESOLUTION = 128            # buckets per factor of e
_MAX_DOUBLE = 1.7976931348623157e308


FINER = 4096                # how much finer a bucket is cut that holds too many values
BUCKETS = ["_bucket", "_bucket1", "_bucket2"]


def value_bucket(x: Column, resolution: int = RESOLUTION) -> Column:
    """Monotone bucket number of a double."""
    size = F.floor(F.log(F.least(F.abs(x), F.lit(_MAX_DOUBLE))) * float(resolution))
    size = size + 1000 * resolution      # positive for every non-zero double
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def _running(counts: DataFrame, keys: list[str], order: list[str], n: str) -> Column:
    """Sum of ``n`` over the rows that sort strictly before this one."""
    before = (Window.partitionBy(*keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum(n).over(before), F.lit(0))


def spread_values(df: DataFrame, keys: list[str], value: str, most: int = ROWS_PER_TASK) -> DataFrame:
    """(keys, distinct value, ``_equal``) with bucket columns; staged, as it is read several times."""
    ties = (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_equal"))
            .withColumn("_bucket", value_bucket(F.col(value))))
    for level in (1, 2):
        above = keys + BUCKETS[:level]
        full = (ties.groupBy(*above).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > most).select(*above, F.lit(True).alias("_full")))
        fine = value_bucket(F.col(value), RESOLUTION * FINER ** level)
        ties = ties.join(full, above, "left").withColumn(
            BUCKETS[level], F.when(F.col("_full"), fine).otherwise(F.lit(0).cast("long"))).drop("_full")
    return stage(ties, "values")


def bucket_counts(ties: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, buckets): rows in the bucket, rows below it, rows in the group."""
    counts = ties.groupBy(*keys, *BUCKETS).agg(F.sum("_equal").alias("_n"))
    whole = F.sum("_n").over(Window.partitionBy(*keys))
    return counts.select(*keys, *BUCKETS, "_n",
                         _running(counts, keys, BUCKETS, "_n").alias("_under"),
                         whole.alias("_total"))


def tie_table(df: DataFrame, keys: list[str], value: str, most: int = ROWS_PER_TASK) -> DataFrame:
    """One row per (keys, distinct value): ``_below``, ``_equal``, ``_total``."""
    ties = spread_values(df, keys, value, most)
    inside = _running(ties, keys + BUCKETS, [value], "_equal")
    return (ties.withColumn("_inside", inside)
            .join(bucket_counts(ties, keys), keys + BUCKETS)
            .select(*keys, value, "_equal", "_total",
                    (F.col("_under") + F.col("_inside")).alias("_below")))


def _average_rank(pct: bool) -> Column:
    rank = F.col("_below") + (F.col("_equal") + F.lit(1)) / F.lit(2.0)
    return (rank / F.col("_total") if pct else rank).cast("double")


def _window_rank(keys: list[str], column: str, pct: bool) -> Column:
    """Average of a row's rank and the count at or below it: ties share their mean."""
    order = Window.partitionBy(*keys).orderBy(F.col(column).asc_nulls_last())
    upto = F.count(column).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = (F.rank().over(order) + upto) / F.lit(2.0)
    if pct:
        rank = rank / F.count(column).over(Window.partitionBy(*keys))
    present = F.col(column).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    return F.when(present, rank.cast("double"))


def average_ranks(df: DataFrame, keys: list[str], columns: list[str],
                  suffix: str = "_rank", pct: bool = True, rows_per_task: int = ROWS_PER_TASK,
                  small: bool | None = None) -> DataFrame:
    """Ranks with ties averaged, per group, as ``{column}{suffix}``.

    With ``pct`` the rank is divided by the group's non-null count, giving
    (0, 1]; nulls, and rows with a null key, stay null. More than two columns
    of large groups are ranked in long form under a row number given once, so
    that the wide table is shuffled once. Unless ``small`` tells whether groups
    fit a task, ``df`` is counted first; large groups read it several times.
    Stage it when it is costly.
    """
    if fits(df, keys, rows_per_task) if small is None else small:
        ranked = df.withColumns({c + suffix: _window_rank(keys, c, pct) for c in columns})
        return bounded_like(ranked, df)
    return _bucketed_ranks(df, keys, columns, suffix, pct, max(1, rows_per_task))


def _bucketed_ranks(df: DataFrame, keys: list[str], columns: list[str],
                    suffix: str, pct: bool, most: int) -> DataFrame:
    if len(columns) <= 2:
        for c in columns:
            ties = tie_table(df.select(*keys, c), keys, c, most)
            df = (df.join(ties, keys + [c], "left")
                  .withColumn(c + suffix, _average_rank(pct))
                  .drop("_below", "_equal", "_total"))
        return df
    df = stage(df.withColumn("_line", F.monotonically_increasing_id()), "numbered")
    long = (df.select("_line", *keys, *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["_line", *keys], columns, "_name", "_value")
            .where(F.col("_value").isNotNull()))
    group = keys + ["_name"]
    ranked = long.join(tie_table(long, group, "_value", most), group + ["_value"])
    wide = ranked.groupBy("_line").agg(*[
        F.max(F.when(F.col("_name") == c, _average_rank(pct))).alias(c + suffix)
        for c in columns])
    return df.join(wide, "_line", "left").drop("_line")


def group_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float],
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Exact linearly interpolated quantiles, nulls ignored.

    Returns (keys, ``name``, ``n``, ``quantiles`` array in the order of
    ``probs``). Small groups use the built-in exact percentile; for large ones
    only the rows of the buckets that hold a wanted position are shuffled.
    """
    if not fits(df, keys, rows_per_task):
        return _bucketed_quantiles(df, keys, columns, probs, max(1, rows_per_task))
    at = F.array(*[F.lit(float(p)) for p in probs])
    rows = df.groupBy(*keys).agg(*[
        F.struct(F.lit(c).alias("name"), F.count(c).alias("n"),
                 F.percentile(F.col(c).cast("double"), at).alias("quantiles")).alias(f"_{i}")
        for i, c in enumerate(columns)])
    return (rows.select(*keys, F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))
            .where(F.col("n") > 0))


def _bucketed_quantiles(df: DataFrame, keys: list[str], columns: list[str],
                        probs: list[float], most: int) -> DataFrame:
    long = (df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(keys, columns, "name", "_value"))
    long = long.where(F.col("_value").isNotNull())
    group = keys + ["name"]

    points = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    wanted = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(p), F.ceil(p)) for p in points])))
    holds = F.filter(wanted, lambda k: (k >= F.col("_under"))
                     & (k < F.col("_under") + F.col("_n")))
    spread = spread_values(long, group, "_value", most)
    picked = (bucket_counts(spread, group)
              .withColumn("_holds", holds).where(F.size("_holds") > 0)
              .select(*group, *BUCKETS, "_under", "_total", "_holds"))
    ties = spread.join(picked, group + BUCKETS)
    start = F.col("_under") + _running(ties, group + BUCKETS, ["_value"], "_equal")
    at = (ties.withColumn("_start", start)
          .withColumn("_at", F.explode(F.filter("_holds", lambda k: (k >= F.col("_start"))
                                       & (k < F.col("_start") + F.col("_equal")))))
          .groupBy(*group).agg(
              F.first("_total").alias("_total"),
              F.map_from_entries(F.collect_set(F.struct("_at", "_value"))).alias("_values")))

    def interpolate(p: Column) -> Column:
        low = F.element_at("_values", F.floor(p))
        high = F.element_at("_values", F.ceil(p))
        return low + (high - low) * (p - F.floor(p))

    return at.select(*group, F.col("_total").alias("n"),
                     F.array(*[interpolate(p) for p in points]).alias("quantiles"))
