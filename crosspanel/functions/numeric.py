"""Null-safe numeric expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null, as every measure must be at a source."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def paired(x: Column, y: Column) -> tuple[Column, Column]:
    """Both values where both are present, else two nulls."""
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x.cast("double")), F.when(both, y.cast("double"))


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over complete pairs, null at zero variance."""
    px, py = paired(x, y)
    return ratio(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """``one`` plus the columns of the one-row ``other``, as scalar subqueries."""
    return one.select("*", *[other.select(c).scalar().alias(c) for c in other.columns])
