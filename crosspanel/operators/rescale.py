"""Search-interest source choice and anchor rescaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.numeric import ratio
from crosspanel.operators.alignment import by_entity
from crosspanel.operators.groups import with_group_stats

# Which sources a mode admits, in falling priority.
SOURCE_MODES = {
    "best": ["disambig", "single", "anchored"],
    "single": ["single"],
    "anchored": ["anchored"],
    "disambig": ["disambig", "single"],
}


def choose_source(series: DataFrame, mode: str = "best") -> DataFrame:
    """Keep, per entity, the whole series of its best available source."""
    if mode not in SOURCE_MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {', '.join(SOURCE_MODES)}")
    order = SOURCE_MODES[mode]
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    usable = series.withColumn("_priority", rank).where(F.col("_priority") > 0)
    # One entity's weekly series is bounded by the calendar.
    return (with_group_stats(usable, ["ticker"], True, _best=F.min("_priority"))
            .where(F.col("_priority") == F.col("_best")).drop("_priority", "_best"))


def match_batches(entities: DataFrame, anchors: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Batch of each entity: its recorded one, else the anchor nearest in time.

    ``entities`` has (ticker, batch, at), ``anchors`` (batch, at), both with
    timestamps. Time is cut into buckets as wide as the tolerance. Of the
    neighbouring buckets only the last, or first, anchor can be nearest; inside
    its own bucket an entity time takes the closest anchor on either side from
    one ordered pass. Only distinct instants are ordered, so a bucket holds at
    most as many rows as it has microseconds, however many files share them.
    The match must be strictly nearer than the tolerance; equal distances take
    the smaller batch.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    width = int(tolerance * 1_000_000)
    bucket = F.floor(F.col("us") / width).cast("long")
    marks = (anchors.select("batch", micros.alias("us")).groupBy("us")
             .agg(F.min("batch").alias("batch")).withColumn("bucket", bucket))
    edges = marks.groupBy("bucket").agg(
        F.min(F.struct("us", "batch")).alias("head"), F.max(F.struct("us", "batch")).alias("tail"))
    unknown = entities.where(F.col("batch").isNull() & F.col("at").isNotNull())
    instants = unknown.select(micros.alias("us")).distinct().withColumn("bucket", bucket)

    both = (marks.select("bucket", "us", F.struct("us", "batch").alias("mark"))
            .unionByName(instants.select("bucket", "us", F.lit(None).cast(
                "struct<us:bigint,batch:int>").alias("mark"))))
    # Frames that only grow: one that shrinks would be summed anew for every row.
    upward = Window.partitionBy("bucket").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    downward = Window.partitionBy("bucket").orderBy(F.desc("us")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    near = both.select(
        "bucket", "us", "mark",
        F.last("mark", ignorenulls=True).over(upward).alias("left"),
        F.last("mark", ignorenulls=True).over(downward).alias("right"),
    ).where("mark is null").drop("mark")
    near = (near.join(edges.select((F.col("bucket") + 1).alias("bucket"), "tail"), "bucket", "left")
            .join(edges.select((F.col("bucket") - 1).alias("bucket"), "head"), "bucket", "left"))
    choices = F.filter(F.array("left", "right", "tail", "head"), lambda m: m.isNotNull())
    ranked = F.array_min(F.transform(choices, lambda m: F.struct(
        F.abs(m["us"] - F.col("us")).alias("gap"), m["batch"].alias("batch"))))
    matched = near.select("us", ranked.alias("best")).where(F.col("best.gap") < width)
    return (entities.withColumn("us", micros)
            .join(matched.select("us", F.col("best.batch").alias("_found")), "us", "left")
            .select("ticker", F.coalesce("batch", "_found").alias("batch")))


def anchor_for_entities(interest: DataFrame, entities: DataFrame, anchors: DataFrame,
                        use_average: bool = True) -> DataFrame:
    """Anchor value on each entity's own dates: its batch's, else the mean of all.

    Returns (ticker, date, anchor, anchor_source); entities without a usable
    anchor series are absent.
    """
    known = anchors.select("batch").distinct().withColumn("_has", F.lit(True))
    days = interest.select("ticker", "date").join(entities.join(known, "batch", "left"), "ticker")
    own = (days.where("_has")
           .join(anchors.select("batch", "date", F.col("search_interest").alias("anchor")), ["batch", "date"])
           .select("ticker", "date", "anchor",
                   F.concat(F.lit("batch_"), F.col("batch").cast("string")).alias("anchor_source")))
    if not use_average:
        return own
    mean = anchors.groupBy("date").agg(F.avg("search_interest").alias("anchor"))
    average = (days.where("_has is null").join(mean, "date")
               .select("ticker", "date", "anchor", F.lit("average").alias("anchor_source")))
    return own.unionByName(average)


def rescale(interest: DataFrame, anchor: DataFrame, zero_handling: str = "ffill") -> DataFrame:
    """``search_interest / anchor`` on the dates both series have.

    Zero anchors: ``ffill`` takes the previous non-zero anchor (the next one at
    the start), ``clip`` lifts anchors to at least 1 in series that contain a
    zero, ``drop`` removes those dates.
    """
    if zero_handling not in ("ffill", "clip", "drop"):
        raise ValueError(f"unknown zero_handling {zero_handling!r}; expected ffill, clip or drop")
    joined = interest.join(anchor, ["ticker", "date"]).withColumn("zero_anchor", F.col("anchor") == 0)
    usable: Column = F.col("anchor")
    if zero_handling == "ffill":
        seen = F.when(~F.col("zero_anchor"), F.col("anchor"))
        back = by_entity("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        usable = F.coalesce(F.last(seen, ignorenulls=True).over(back),
                            F.last(seen, ignorenulls=True).over(ahead))
    elif zero_handling == "clip":
        any_zero = F.max("zero_anchor").over(Window.partitionBy("ticker"))
        usable = F.when(any_zero, F.greatest(F.col("anchor"), F.lit(1.0))).otherwise(F.col("anchor"))
    out = joined.withColumn("anchor_used", usable)
    if zero_handling == "drop":
        out = out.withColumn("n_zero_weeks", F.sum(F.col("zero_anchor").cast("long")).over(
            Window.partitionBy("ticker"))).where(~F.col("zero_anchor"))
    else:
        out = out.withColumn("n_zero_weeks", F.sum(F.col("zero_anchor").cast("long")).over(
            Window.partitionBy("ticker")))
    return out.withColumn("search_interest_rescaled",
                          ratio(F.col("search_interest"), F.col("anchor_used")))


def rescale_stats(rescaled: DataFrame) -> DataFrame:
    return rescaled.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.max("n_zero_weeks").alias("n_zero_weeks"),
        F.round(F.avg("search_interest"), 4).alias("mean_raw"),
        F.round(F.avg("search_interest_rescaled"), 4).alias("mean_rescaled"),
        F.first("anchor_source").alias("anchor_source"))


def rescale_summary(interest: DataFrame, rescaled: DataFrame) -> DataFrame:
    """Per date: count, mean and sample deviation before and after rescaling."""
    chosen = interest.join(rescaled.select("ticker").distinct(), "ticker", "left_semi")
    raw = chosen.groupBy("date").agg(
        F.count("search_interest").alias("n_tickers"), F.avg("search_interest").alias("mean_raw"),
        F.stddev_samp("search_interest").alias("std_raw"))
    after = rescaled.groupBy("date").agg(
        F.avg("search_interest_rescaled").alias("mean_rescaled"),
        F.stddev_samp("search_interest_rescaled").alias("std_rescaled"))
    return raw.join(after, "date", "full_outer")
