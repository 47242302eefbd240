"""Expanding walk-forward folds as small tables keyed by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_index(df: DataFrame, date: str = "week_ending_friday") -> DataFrame:
    """(date, d): distinct dates numbered from zero. As small as the calendar."""
    return (df.select(date).distinct()
            .withColumn("d", F.row_number().over(Window.orderBy(date)) - 1))


def _unroll(spans: DataFrame, keys: list[str], name: str, n_folds: int, min_train: Column,
            purge: int, embargo: int) -> DataFrame:
    """Folds over ``n`` leading dates; keeps ``keys`` and numbers kept folds from 1."""
    size = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("_min")) / n_folds))
    rows = (spans.withColumn("_min", min_train)
            .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
            .withColumn("_size", size)
            .withColumn("_train", F.col("_min") + F.col("_k") * F.col("_size"))
            .withColumn("test_lo", F.col("_train") + embargo)
            .withColumn("test_hi", F.least(F.col("test_lo") + F.col("_size"), F.col("n")))
            .where((F.col("test_lo") < F.col("n")) & (F.col("_train") > purge)
                   & (F.col("test_hi") > F.col("test_lo"))))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_k"))
    return rows.select(*keys, number.alias(name), (F.col("_train") - purge).cast("long").alias("train_n"),
                       F.col("test_lo").cast("long").alias("test_lo"),
                       F.col("test_hi").cast("long").alias("test_hi"))


def walk_forward(dates: DataFrame, n_folds: int = 8, min_train: int = 104, purge: int = 1,
                 embargo: int = 1) -> DataFrame:
    """(fold, train_n, test_lo, test_hi): train on d < train_n, test on [lo, hi)."""
    span = dates.agg(F.count(F.lit(1)).alias("n"))
    return _unroll(span, [], "fold", n_folds, F.lit(min_train), purge, embargo)


def inner_folds(outer: DataFrame, n_inner: int = 3, purge: int = 1, embargo: int = 1,
                floor: int = 52, fraction: float = 0.5) -> DataFrame:
    """Folds inside each outer fold's own training dates."""
    spans = outer.select("fold", F.col("train_n").alias("n"))
    start = F.greatest(F.lit(floor), F.floor(F.col("n") * fraction))
    return _unroll(spans, ["fold"], "inner", n_inner, start, purge, embargo)


def fold_dates(folds: DataFrame, dates: DataFrame, role: str) -> DataFrame:
    """One row per fold and date of its ``train`` or ``test`` part.

    Folds and dates are calendar-sized, and facts then meet their folds in an
    equality join on date instead of a range join.
    """
    keys = [c for c in folds.columns if c in ("fold", "inner")]
    days = (F.sequence(F.lit(0).cast("long"), F.col("train_n") - 1) if role == "train"
            else F.sequence("test_lo", F.col("test_hi") - 1))
    return folds.select(*keys, F.explode(days).alias("d")).join(dates, "d").drop("d")
