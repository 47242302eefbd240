"""Data-quality checks. Each returns a table; nothing is dropped or repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.numeric import beside, ratio
from crosspanel.operators.alignment import by_entity
from crosspanel.operators.order_stats import group_quantiles


def input_coverage(members: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Per source: entities expected, present, missing, and an issue line."""
    expected = members.select("ticker").distinct().withColumn("_want", F.lit(1))
    rows = []
    for name, df in sources.items():
        have = df.select("ticker").distinct().withColumn("_has", F.lit(1))
        rows.append(expected.join(have, "ticker", "full_outer").agg(
            F.count("_want").alias("n_tickers"), F.count("_has").alias("n_present"),
            F.count_if(F.col("_has").isNull()).alias("n_missing"),
        ).select(F.lit(name).alias("source"), "*"))
    out = reduce(DataFrame.unionByName, rows)
    issue = F.format_string("%d tickers missing %s", F.col("n_missing"), F.col("source"))
    return out.withColumn("issue", F.when(F.col("n_missing") > 0, issue))


def price_checks(prices: DataFrame, short_history: DataFrame | None = None) -> DataFrame:
    """Missing and stale prices per entity, with the flags they raise.

    ``short_history(ticker)`` names entities known to start late.
    """
    close, before = F.col("close"), F.lag("close").over(by_entity("date"))
    stats = (prices.withColumn("_same", close - before == 0)
             .groupBy("ticker").agg(
                 F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("adj_close").isNull()).alias("n_null_adj_close"),
                 F.count_if(F.col("volume") == 0).alias("n_zero_volume"),
                 F.count_if("_same").alias("n_repeated_close"),
                 F.min("date").alias("first_date"), F.max("date").alias("last_date")))
    if short_history is None:
        stats = stats.withColumn("_short", F.lit(None).cast("boolean"))
    else:
        stats = stats.join(short_history.select("ticker", F.lit(True).alias("_short")).distinct(), "ticker", "left")
    flags = F.array_compact(F.array(
        F.when(F.col("n_null_adj_close") > 0, F.format_string("%d NaN in Adj Close", "n_null_adj_close")),
        F.when(F.col("_short"), F.format_string("short history: %d rows", "n_rows")),
        F.when(F.col("n_zero_volume") > 0, F.format_string("%d zero-volume days", "n_zero_volume")),
        F.when(F.col("n_repeated_close") > 5,
               F.format_string("%d repeated-Close days", "n_repeated_close"))))
    return stats.withColumn("flags", flags).drop("_short")


def split_checks(prices: DataFrame, splits: DataFrame) -> DataFrame:
    """Raw and adjusted simple returns on known split dates.

    Only entities with a known split are ordered; the adjusted return must stay
    under 2 %, and a raw jump over 10 % is flagged.
    """
    def simple(c: str) -> Column:
        return ratio(F.col(c), F.lag(c).over(by_entity("date"))) - 1
    moves = (prices.join(splits.select("ticker"), "ticker", "left_semi")
             .select("ticker", F.col("date").alias("split_date"), F.lit(True).alias("_found"),
                     simple("close").alias("close_return"), simple("adj_close").alias("adj_close_return")))
    out = splits.join(moves, ["ticker", "split_date"], "left")
    return out.select(
        "ticker", "split_date", "ratio", "close_return", "adj_close_return",
        (F.abs("adj_close_return") < 0.02).alias("passed"),
        (F.abs("close_return") > 0.10).alias("flagged"),
        F.when(F.col("_found").isNull(), "split date outside horizon or missing").alias("note"))


def entity_flags(checks: DataFrame, splits: DataFrame) -> DataFrame:
    """All flags per entity: price checks plus split jumps."""
    jumps = splits.where("flagged").select("ticker", F.format_string(
        "split on %s", F.col("split_date").cast("string")).alias("_jump"))
    return checks.join(jumps, "ticker", "left").select("ticker", F.concat(
        "flags", F.array_compact(F.array("_jump"))).alias("flags"))


def flag_counts(flags: DataFrame) -> DataFrame:
    flagged = F.size("flags") > 0
    return flags.agg(F.count(F.lit(1)).alias("n_tickers"), F.count_if(flagged).alias("n_flagged"),
                     F.count_if(~flagged).alias("n_clean"))


def validate_news(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Statistics and errors per news file.

    ``rows`` holds text columns date, tone, volume with (ticker, block,
    position): file order is checked inside each block, then across block ends,
    so a file of any size needs no single ordered pass.
    """
    day, tone = F.col("date").try_cast("date"), F.col("tone").try_cast("double")
    volume = F.col("volume").try_cast("double")
    typed = rows.select("ticker", "block", "position", day.alias("day"),
                        F.when(~F.isnan(tone), tone).alias("tone_"),
                        F.when(~F.isnan(volume), volume).alias("volume_"))
    inside = Window.partitionBy("ticker", "block").orderBy("position")
    blocks = (typed.withColumn("_down", F.col("day") < F.lag("day").over(inside))
              .groupBy("ticker", "block").agg(
                  F.max(F.coalesce("_down", F.lit(False))).alias("down"),
                  F.min_by("day", "position").alias("head"), F.max_by("day", "position").alias("tail")))
    across = Window.partitionBy("ticker").orderBy("block")
    order = (blocks.withColumn("_down", F.col("down") | F.coalesce(
        F.col("head") < F.lag("tail").over(across), F.lit(False)))
        .groupBy("ticker").agg(F.max("_down").alias("descends")))

    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    per_day = typed.groupBy("ticker", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("tone_").isNull()).alias("bad_tone"),
        F.count_if(F.col("volume_").isNull()).alias("bad_volume"),
        F.count_if(F.col("volume_") < 0).alias("negative"),
        F.count_if(F.abs(F.col("volume_") % 1) >= 1e-9).alias("fractional"),
        F.min("tone_").alias("tone_min"), F.max("tone_").alias("tone_max"),
        F.min("volume_").alias("volume_min"), F.max("volume_").alias("volume_max"))
    stats = per_day.groupBy("ticker").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("day").isNull(), F.col("n"))), F.lit(0)).alias("n_bad_dates"),
        F.sum("bad_tone").alias("n_bad_tone"), F.sum("bad_volume").alias("n_bad_volume"),
        (F.sum("n") - F.count(F.lit(1))).alias("n_duplicate_dates"),
        F.sum("negative").alias("n_negative"), F.sum("fractional").alias("n_fractional"),
        F.coalesce(F.sum(F.when((F.col("day") < lo) | (F.col("day") > hi), F.col("n"))), F.lit(0)).alias("n_outside"),
        F.min("day").alias("first_date"), F.max("day").alias("last_date"),
        F.min("tone_min").alias("tone_min"), F.max("tone_max").alias("tone_max"),
        F.min("volume_min").alias("volume_min"), F.max("volume_max").alias("volume_max"))
    out = stats.join(order, "ticker").withColumn(
        "unsorted", F.col("descends") | (F.col("n_bad_dates") > 0)).drop("descends")

    def counted(n: str, text: str) -> Column:
        return F.when(F.col(n) > 0, F.format_string(f"%d {text}", n))
    return out.withColumn("errors", F.array_compact(F.array(
        counted("n_bad_dates", "invalid date(s)"),
        counted("n_bad_tone", "invalid/missing tone value(s)"),
        counted("n_bad_volume", "invalid/missing volume value(s)"),
        counted("n_duplicate_dates", "duplicate date(s)"),
        F.when(F.col("unsorted"), "dates are not sorted ascending"),
        F.when(F.col("n_negative") > 0, "negative volume value(s)"),
        F.when(F.col("n_fractional") > 0, "non-integer article count(s)"),
        F.when(F.coalesce(F.col("first_date") > lo, F.lit(True)), f"coverage starts after {start}"),
        F.when(F.coalesce(F.col("last_date") < hi, F.lit(True)), f"coverage ends before {end}"),
        F.when(F.col("n_outside") > 0, "date(s) outside requested window"))))


def missing_columns(lacking: DataFrame) -> DataFrame:
    """(ticker, errors) of files that lack columns, from ``lacking(ticker, missing)``."""
    return lacking.groupBy("ticker").agg(F.max("missing").alias("missing")).select("ticker", F.array(F.concat(
        F.lit("missing column(s): "), F.array_join("missing", ", "))).alias("errors"))


def validate_news_directory(rows: DataFrame, members: DataFrame, start: str, end: str,
                            lacking: DataFrame | None = None) -> DataFrame:
    """(ticker, errors) of every expected entity that fails, missing files included.

    ``lacking(ticker, missing)`` names files whose rows could not be read for want of columns.
    """
    if start > end:
        raise ValueError("start must be on or before end")
    checked = validate_news(rows, start, end).select("ticker", "errors")
    if lacking is not None:
        checked = checked.unionByName(missing_columns(lacking))
    expected = members.select("ticker").distinct()
    return (expected.join(checked, "ticker", "left")
            .withColumn("errors", F.coalesce("errors", F.array(F.lit("file is missing"))))
            .where(F.size("errors") > 0))


def series_information(interest: DataFrame, value: str = "search_interest") -> DataFrame:
    """Rows, distinct values, share of zeros and constancy per entity."""
    return interest.groupBy("ticker", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(value).alias("distinct"),
        F.round(100 * F.avg(F.coalesce(F.col(value) == 0, F.lit(False)).cast("double")), 1).alias("zero_pct"),
    ).withColumn("constant", F.col("distinct") == 1)


def series_totals(information: DataFrame) -> DataFrame:
    """Entities per source, constant series, and the median distinct count."""
    counts = information.agg(
        F.count(F.lit(1)).alias("n_tickers"),
        F.count_if(F.col("source") == "single").alias("n_from_single"),
        F.count_if(F.col("source") == "disambig").alias("n_from_disambig"),
        F.count_if(F.col("source") == "anchored").alias("n_from_anchored"),
        F.count_if("constant").alias("n_constant"))
    median = group_quantiles(information, [], ["distinct"], [0.5]).select(
        F.col("quantiles")[0].alias("median_distinct"))
    return beside(counts, median)


def feature_coverage(features: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of non-null rows per column, long."""
    one = features.agg(*[(100 * F.avg(F.col(c).isNotNull().cast("double"))).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "coverage_pct")
