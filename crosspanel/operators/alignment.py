"""Daily and weekly sources aligned to the Friday calendar, and panel assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.calendar import bucket_friday, week_ending_friday
from crosspanel.functions.numeric import ratio
from crosspanel.operators.groups import fits, with_group_stats
from crosspanel.session import stage


def by_entity(date: str) -> Window:
    """Date order inside one entity: bounded by the calendar, not by the data."""
    return Window.partitionBy("ticker").orderBy(date)


def within_horizon(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Closed date interval."""
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def first_entities(members: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """The first ``n`` entities in universe order."""
    return members.orderBy(order).limit(n)


def daily_log_returns(prices: DataFrame) -> DataFrame:
    """``daily_return`` = ln(adj_close / previous adj_close), null on the first row."""
    previous = F.lag("adj_close").over(by_entity("date"))
    change = ratio(F.col("adj_close"), previous)
    return prices.withColumn("daily_return", F.when(change > 0, F.log(change)))


def weekly_returns(returns: DataFrame, min_days: int = 3, min_fraction: float = 0.6) -> DataFrame:
    """Sum of daily log returns per entity and week, thin weeks dropped.

    A week stays when the entity has at least ``min_days`` returns and at least
    ``min_fraction`` of the best-covered entity's count in that week.
    """
    weekly = stage(
        returns.where(F.col("daily_return").isNotNull())
        .groupBy("ticker", week_ending_friday(F.col("date")).alias("week_ending_friday"))
        .agg(F.count(F.lit(1)).alias("n_days"), F.sum("daily_return").alias("weekly_return")),
        "weekly-returns")
    needed = F.greatest(F.lit(min_days), F.ceil(F.lit(float(min_fraction)) * F.col("_most")))
    small = fits(weekly, ["week_ending_friday"])
    return (with_group_stats(weekly, ["week_ending_friday"], small, _most=F.max("n_days"))
            .where(F.col("n_days") >= needed)
            .select("ticker", "week_ending_friday", "n_days", "weekly_return"))


def weekly_interest(interest: DataFrame, bucket_lag: int = 5) -> DataFrame:
    """Sunday-labelled buckets moved to their Friday."""
    return interest.select(
        "ticker", bucket_friday(F.col("date"), bucket_lag).alias("week_ending_friday"),
        F.col("search_interest").alias("trends_interest"))


def weekly_news(news: DataFrame) -> DataFrame:
    """Mean tone and total volume per entity and week."""
    return (news.groupBy("ticker", week_ending_friday(F.col("date")).alias("week_ending_friday"))
            .agg(F.avg("tone").alias("gdelt_tone"),
                 F.coalesce(F.sum("volume"), F.lit(0)).cast("double").alias("gdelt_volume")))


def assemble_panel(returns: DataFrame, members: DataFrame, interest: DataFrame,
                   news: DataFrame | None = None) -> DataFrame:
    """Weekly returns, left-joined with group, search interest and news."""
    key = ["ticker", "week_ending_friday"]
    panel = (returns.select(*key, "weekly_return")
             .join(members.select("ticker", "sector"), "ticker", "left")
             .join(interest.select(*key, "trends_interest"), key, "left"))
    if news is not None:
        panel = panel.join(news.select(*key, "gdelt_tone", "gdelt_volume"), key, "left")
    else:
        panel = panel.withColumns({"gdelt_tone": F.lit(None).cast("double"),
                                   "gdelt_volume": F.lit(None).cast("double")})
    return panel.select("week_ending_friday", "ticker", "sector", "weekly_return",
                        "trends_interest", "gdelt_tone", "gdelt_volume")


def short_history(returns: DataFrame, min_history_days: int = 252) -> DataFrame:
    """Entities with few daily returns: reported, never dropped."""
    return (returns.groupBy("ticker").agg(F.count("daily_return").alias("history_days"))
            .where(F.col("history_days").between(1, min_history_days - 1)))


def chunk_plan(start: str, end: str, months: int) -> Column:
    """Array of (chunk_no, chunk_start, chunk_end): inclusive ranges, the last clipped.

    Each chunk starts where the one before it ended, so a month-end start that
    shrinks to a shorter month stays shrunk.
    """
    if months < 1:
        raise ValueError("months must be at least 1")
    if start > end:
        raise ValueError("start must be on or before end")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    upper = (F.months_between(last, first) / months).cast("int") + 1
    starts = F.aggregate(
        F.sequence(F.lit(1), upper), F.array(first),
        lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), months))))
    return F.transform(
        F.filter(starts, lambda d: d <= last),
        lambda d, i: F.struct((i + 1).cast("long").alias("chunk_no"), d.alias("chunk_start"),
                              F.least(F.date_sub(F.add_months(d, months), 1), last).alias("chunk_end")))


def calendar_chunks(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    return spark.range(1).select(F.inline(chunk_plan(start, end, months)))


def chunk_coverage(facts: DataFrame, start: str, end: str, months: int,
                   date: str = "date") -> DataFrame:
    """Rows per entity and chunk, zero where a chunk is still to be filled.

    The plan is a constant array, so a day finds its chunk inside its own row.
    An entity's counts, at most one a chunk, meet the plan in its one row, so
    the facts are read once.
    """
    plan = chunk_plan(start, end, months)
    day = F.col(date)
    mine = F.filter(plan, lambda c: day.between(c["chunk_start"], c["chunk_end"]))
    counted = (facts.groupBy("ticker", date).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("chunk_no", F.try_element_at(mine, F.lit(1))["chunk_no"])
               .groupBy("ticker", "chunk_no").agg(F.sum("_n").alias("n_rows")))
    # A null entity equals none, so it has rows in no chunk.
    filled = F.col("chunk_no").isNotNull() & F.col("ticker").isNotNull()
    found = counted.groupBy("ticker").agg(F.map_from_entries(
        F.collect_list(F.when(filled, F.struct("chunk_no", "n_rows")))).alias("_found"))
    return found.select("ticker", "_found", F.inline(plan)).select(
        "ticker", "chunk_no", "chunk_start", "chunk_end",
        F.coalesce(F.try_element_at("_found", F.col("chunk_no")), F.lit(0)).alias("n_rows"))
