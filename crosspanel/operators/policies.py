"""Missing-data policies and their reports.

Each policy returns the table and a lazy report of (source, metric, value)
rows; reports stack with ``imputation_report``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _report(df: DataFrame, source: str, metrics: dict[str, Column]) -> DataFrame:
    one = df.agg(*[m.cast("long").alias(k) for k, m in metrics.items()])
    return (one.unpivot([], list(metrics), "metric", "value")
            .select(F.lit(source).alias("source"), "metric", "value"))


def _mask_early(df: DataFrame, starts: DataFrame, value: str, date: str,
                only_zero: bool) -> DataFrame:
    early = F.col(date) < F.col("first_date")
    if only_zero:
        early = early & (F.col(value) == 0)
    return (df.join(starts.select("ticker", "first_date"), "ticker", "left")
            .withColumn("_before", F.col(value))
            .withColumn(value, F.when(~F.coalesce(early, F.lit(False)), F.col(value)))
            .drop("first_date"))


def price_policy(returns: DataFrame, starts: DataFrame, value: str = "daily_return",
                 date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Null before an entity's first valid date; other gaps stay as they are."""
    masked = _mask_early(returns, starts, value, date, only_zero=False)
    report = _report(masked, "prices", {
        "n_nan_before": F.count_if(F.col("_before").isNull()),
        "n_nan_after": F.count_if(F.col(value).isNull()),
        "n_structural_nan_added": F.count_if(F.col("_before").isNotNull() & F.col(value).isNull())})
    return masked.drop("_before"), report


def interest_policy(interest: DataFrame, starts: DataFrame,
                    value: str = "search_interest_rescaled", date: str = "date",
                    recode_structural_zeros: bool = True) -> tuple[DataFrame, DataFrame]:
    """Zeros before the first valid date become null; other zeros are signal."""
    if recode_structural_zeros:
        masked = _mask_early(interest, starts, value, date, only_zero=True)
    else:
        masked = interest.withColumn("_before", F.col(value))
    report = _report(masked, "trends", {
        "n_zero_before": F.count_if(F.col("_before") == 0),
        "n_zero_after": F.count_if(F.col(value) == 0),
        "n_structural_replaced": F.count_if(F.col("_before").isNotNull() & F.col(value).isNull())})
    return masked.drop("_before"), report


def news_policy(news: DataFrame, method: str = "zero", tone: str = "tone",
                volume: str = "volume") -> tuple[DataFrame, DataFrame]:
    """No news is neutral tone and zero volume (``zero``), or stays null (``nan``)."""
    if method not in ("zero", "nan"):
        raise ValueError(f"method must be 'zero' or 'nan', got {method!r}")
    out = news.fillna({tone: 0.0, volume: 0}) if method == "zero" else news
    kept = 0 if method == "zero" else 1
    report = _report(news, "gdelt", {
        "n_tone_nan_before": F.count_if(F.col(tone).isNull()),
        "n_volume_nan_before": F.count_if(F.col(volume).isNull()),
        "n_tone_nan_after": F.count_if(F.col(tone).isNull()) * kept,
        "n_volume_nan_after": F.count_if(F.col(volume).isNull()) * kept})
    return out, report


def imputation_report(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
