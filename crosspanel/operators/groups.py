"""Group statistics attached to rows, in the way the largest group allows.

A group that fits one task takes a window: one shuffle serves every statistic
of the group, and the input is read once. A group beyond that must not gather
in one task, so it is aggregated first (combining map-side) and the small
result joins back; the planner broadcasts it when its measured size allows and
otherwise shuffles, splitting hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.session import row_bound

ROWS_PER_TASK = 1_000_000   # largest group that one task may order


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Upper bound on the rows of one group.

    A staged table no larger than a task answers without a job. Otherwise the
    groups are counted; counts combine map-side and one number comes back.
    """
    known = row_bound(df)
    if known is not None and known <= ROWS_PER_TASK:
        return known
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def fits(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> bool:
    """Whether every group of ``keys`` may be ordered inside one task."""
    return largest_group(df, keys) <= rows_per_task


def with_group_stats(df: DataFrame, keys: list[str], small: bool, **aggs: Column) -> DataFrame:
    """``df`` plus named aggregates of each row's group.

    ``small`` is the answer of ``fits`` for these keys or coarser ones. The
    large way reads ``df`` twice: stage it when it is costly.
    """
    if small:
        group = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(group) for name, agg in aggs.items()})
    stats = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return df.join(stats, keys, "left")
