"""News payloads: timeline JSON to daily tone and volume, article feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.numeric import finite

TIMELINE = ("struct<timeline: array<struct<series: string, "
            "data: array<struct<date: string, value: string>>>>>")
MODES = ("tone", "volume")


# Fixed value: the compact timestamp shape, rewritten to ISO before the cast.
COMPACT = r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(Z?)$"


def parse_day(text: Column) -> Column:
    """UTC day of a timestamp in compact or ISO shape; null if it is neither.

    A cast that yields null is far cheaper per bad row than a format parser
    that throws, and the two shapes are mixed freely.
    """
    iso = F.regexp_replace(text, COMPACT, "$1-$2-$3T$4:$5:$6$7")
    return F.to_date(iso.try_cast("timestamp"))


def check_timelines(payloads: DataFrame) -> DataFrame:
    """Adds ``points`` and ``error`` to (ticker, mode, chunk_no, payload).

    The points, typed (date, value) pairs, are those of the first series that
    has a data list. One bad point rejects the payload, as does a negative
    volume. Each payload is checked inside its own row, without a shuffle.
    """
    def typed(p: Column) -> Column:
        return F.struct(parse_day(p["date"]).alias("date"),
                        finite(p["value"].try_cast("double")).alias("value"))

    series = F.filter("_t", lambda s: s["data"].isNotNull())
    data = F.when(F.size("_t") == 0, F.array().cast("array<struct<date:string,value:string>>")).otherwise(
        F.try_element_at(series, F.lit(1))["data"])
    parsed = (payloads.withColumn("_t", F.from_json("payload", TIMELINE)["timeline"])
              .withColumn("points", F.transform(data, typed)))
    bad = F.exists("points", lambda p: p["date"].isNull() | p["value"].isNull())
    negative = (F.col("mode") == "volume") & F.exists("points", lambda p: p["value"] < 0)
    error = (F.when(~F.col("mode").isin(*MODES), "unknown series")
             .when(F.col("_t").isNull(), "no timeline list")
             .when(F.col("points").isNull(), "no series with a data list")
             .when(bad, "invalid date or value").when(negative, "negative article count"))
    return parsed.withColumn("error", error).drop("_t", "payload")


def timeline_errors(checked: DataFrame) -> DataFrame:
    return checked.where("error is not null").drop("points")


def daily_points(checked: DataFrame) -> DataFrame:
    """(ticker, mode, chunk_no, date, value): tone averaged, volume summed per day."""
    # A filter on the error, or an inner explode, would be pushed below the
    # parsing and repeat it; the outer explode keeps it to one pass.
    usable = F.when(F.col("error").isNull(), F.col("points"))
    rows = (checked.select("ticker", "mode", "chunk_no", F.explode_outer(usable).alias("p"))
            .where("p is not null").select("ticker", "mode", "chunk_no", "p.date", "p.value"))
    return rows.groupBy("ticker", "mode", "chunk_no", "date").agg(
        F.when(F.col("mode") == "tone", F.avg("value")).otherwise(F.sum("value")).alias("value"))


def assemble_daily(points: DataFrame) -> DataFrame:
    """(ticker, date, tone, volume): the last chunk wins, series outer-aligned.

    One aggregate does both: no join, and copies of a day combine map-side.
    """
    def last(mode: str) -> Column:
        mine = F.col("mode") == mode
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("chunk_no"))).alias(mode)
    return points.groupBy("ticker", "date").agg(last("tone"), last("volume"))


def uncovered(members: DataFrame, daily: DataFrame) -> DataFrame:
    """Entities for which nothing came back."""
    return members.select("ticker").join(daily.select("ticker"), "ticker", "left_anti")


def check_feeds(payloads: DataFrame) -> DataFrame:
    """Article count per landed feed, or the message that came instead of one."""
    # The raw text of each field tells an absent feed from an empty one.
    get = lambda k: F.get_json_object("payload", f"$['{k}']")
    articles = F.size(F.from_json(get("feed"), "array<string>"))
    return payloads.select(
        "ticker", F.when(get("feed").isNotNull(), articles).cast("long").alias("articles"),
        F.when(get("feed").isNull(), F.coalesce(
            get("Note"), get("Information"), get("Error Message"), F.col("payload"))).alias("message"),
        get("feed").isNull().alias("failed"))
