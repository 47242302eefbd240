"""Per-date winsorizing, ranking and group neutralization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators.groups import ROWS_PER_TASK, fits, with_group_stats
from crosspanel.operators.order_stats import average_ranks, group_quantiles
from crosspanel.session import bounded_like, stage

PANEL_MEASURES = ["weekly_return", "trends_interest", "gdelt_tone", "gdelt_volume"]


def winsorize(df: DataFrame, columns: list[str], date: str = "week_ending_friday",
              lower: float = 0.01, upper: float = 0.99,
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Clip each column to its date's quantiles, as ``{column}_wins``."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    marks = F.array(F.lit(float(lower)), F.lit(float(upper)))
    if fits(df, [date], rows_per_task):
        out = with_group_stats(df, [date], True, **{
            "_q_" + c: F.percentile(F.col(c).cast("double"), marks) for c in columns})
    else:
        bounds = group_quantiles(df, [date], columns, [lower, upper], rows_per_task)
        bounds = bounds.groupBy(date).agg(*[
            F.max(F.when(F.col("name") == c, F.col("quantiles"))).alias("_q_" + c)
            for c in columns])
        out = df.join(bounds, date, "left")
    for c in columns:
        q = F.col("_q_" + c)
        clipped = F.least(F.greatest(F.col(c).cast("double"), q[0]), q[1])
        out = out.withColumn(c + "_wins", F.when(F.col(c).isNotNull(), clipped))
    return bounded_like(out.drop(*["_q_" + c for c in columns]), df)


def rank_standardize(df: DataFrame, columns: list[str], date: str = "week_ending_friday",
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per-date percentile rank with ties averaged, as ``{column}_rank``."""
    columns = [c for c in columns if c in df.columns]
    return average_ranks(df, [date], columns, rows_per_task=rows_per_task)


def neutralize(df: DataFrame, columns: list[str], group: str = "sector",
               date: str = "week_ending_friday", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Subtract the (date, group) mean, as ``{column}_sector_neutral``."""
    columns = [c for c in columns if c in df.columns]
    if not columns or group not in df.columns:
        return df
    out = with_group_stats(df, [date, group], fits(df, [date, group], rows_per_task),
                           **{"_m_" + c: F.avg(c) for c in columns})
    for c in columns:
        centred = F.when(F.col(group).isNotNull(), F.col(c) - F.col("_m_" + c))
        out = out.withColumn(c + "_sector_neutral", centred)
    return bounded_like(out.drop(*["_m_" + c for c in columns]), df)


def standardize(df: DataFrame, columns: list[str] | None = None, group: str = "sector",
                date: str = "week_ending_friday", lower: float = 0.01, upper: float = 0.99,
                neutral: bool = True,
                rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Winsorize, rank, neutralize; returns the wider panel and a report row."""
    spark = df.sparkSession
    measures = [c for c in (columns or PANEL_MEASURES) if c in df.columns]
    if not measures:
        report = spark.range(1).select(
            F.lit("winsorize_standardize").alias("step"),
            F.lit("no value columns found in panel").alias("error"))
        return df, report
    neutral = neutral and group in df.columns
    wins = [c + "_wins" for c in measures]
    ranks = [c + "_rank" for c in wins]
    small = fits(df, [date], rows_per_task)
    out = winsorize(df, measures, date, lower, upper, rows_per_task)
    # Windows chain without re-reading; the large way re-reads, so it stages.
    out = rank_standardize(out if small else stage(out, "winsorized"), wins, date,
                           rows_per_task=rows_per_task)
    if neutral:
        out = neutralize(out if small else stage(out, "ranked"), ranks, group, date, rows_per_task)
    added = [c for c in out.columns if c not in df.columns]
    report = df.agg(F.count_distinct(date).alias("n_dates"),
                    F.count_distinct("ticker").alias("n_tickers")).select(
        F.lit("winsorize_standardize").alias("step"),
        F.lit(float(lower)).alias("lower"), F.lit(float(upper)).alias("upper"),
        F.array(*[F.lit(c) for c in measures]).alias("columns_processed"),
        F.lit(neutral).alias("sector_neutralized"), "n_dates", "n_tickers",
        F.array(*[F.lit(c) for c in sorted(added)]).alias("output_columns"))
    return out, report
