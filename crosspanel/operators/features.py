"""Trailing features that never see their own week, and the forward target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.numeric import ratio
from crosspanel.operators.groups import fits, with_group_stats
from crosspanel.operators.order_stats import average_ranks
from crosspanel.session import stage

# Feature -> (origin, risk bucket), in model order.
FEATURE_TAGS = {
    "asvi": ("external", "alt-data"),
    "trends_z_26": ("external", "alt-data"),
    "trends_chg_4": ("external", "alt-data"),
    "trends_vol_13": ("external", "statistical"),
    "mom_52_4": ("internal", "fundamental"),
    "mom_12_1": ("internal", "fundamental"),
    "rvol_13": ("internal", "statistical"),
    "ivol_26": ("internal", "statistical"),
    "rev_1": ("internal", "fundamental"),
}
FEATURES = list(FEATURE_TAGS)
RANKS = [f + "_rank" for f in FEATURES]
TARGET = "fwd_return"
MIN_HISTORY_WEEKS = 52


def _by_entity() -> Window:
    return Window.partitionBy("ticker").orderBy("week_ending_friday")


def trailing(fn, x: Column, first: int, last: int, min_obs: int) -> Column:
    """``fn`` over rows ``first``..``last`` relative to this one, null if too few.

    Frames count an entity's own rows; a missing week shortens the span and is
    never filled.
    """
    frame = _by_entity().rowsBetween(first, last)
    return F.when(F.count(x).over(frame) >= min_obs, fn(x).over(frame))


def min_periods(window: int, fraction: float = 0.6) -> int:
    return max(2, int(window * fraction))


def lagged(fn, x: Column, window: int, min_obs: int | None = None) -> Column:
    """``fn`` over the ``window`` rows before this one."""
    return trailing(fn, x, -window, -1, min_obs or min_periods(window))


def _median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def feature_columns() -> dict[str, Column]:
    """Every by-entity feature; all share one partitioning and one sort."""
    svi, r, resid = F.col("log_svi"), F.col("weekly_return"), F.col("_resid")
    change = F.col("_dlog")
    return {
        TARGET: F.lead("weekly_return", 1).over(_by_entity()),
        "asvi": svi - lagged(_median, svi, 8, 4),
        "trends_z_26": ratio(svi - lagged(F.avg, svi, 26), lagged(F.stddev_samp, svi, 26)),
        "trends_chg_4": svi - F.lag(svi, 4).over(_by_entity()),
        "trends_vol_13": lagged(F.stddev_samp, change, 13),
        "rev_1": F.lag(r, 1).over(_by_entity()),
        "mom_12_1": lagged(F.sum, r, 11, 8),
        "mom_52_4": trailing(F.sum, r, -51, -4, 30),
        "rvol_13": lagged(F.stddev_samp, r, 13),
        "ivol_26": lagged(F.stddev_samp, resid, 26),
        "_row": F.row_number().over(_by_entity()) - 1,
    }


def with_market(panel: DataFrame) -> DataFrame:
    """Equal-weight market return per date and each row's residual (beta of one)."""
    out = with_group_stats(panel, ["week_ending_friday"], fits(panel, ["week_ending_friday"]),
                           market_return=F.avg("weekly_return"))
    return out.withColumn("_resid", F.col("weekly_return") - F.col("market_return"))


def build_features(panel: DataFrame, min_history: int = MIN_HISTORY_WEEKS) -> DataFrame:
    """Panel plus target and nine features, short histories filtered afterwards.

    The market mean is per date and everything else per entity: two shuffles.
    """
    base = with_market(panel).withColumn("log_svi", F.log1p(F.col("trends_interest").cast("double")))
    base = base.withColumn("_dlog", F.col("log_svi") - F.lag("log_svi").over(_by_entity()))
    return (base.withColumns(feature_columns()).where(F.col("_row") >= min_history)
            .drop("log_svi", "_resid", "_dlog", "_row", "market_return"))


def rank_features(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per-date percentile rank of each feature, as ``{feature}_rank``."""
    return average_ranks(features, ["week_ending_friday"], columns or FEATURES)


def feature_table(panel: DataFrame) -> DataFrame:
    """Features and their ranks, staged between the two steps."""
    return rank_features(stage(build_features(panel), "features"))


def feature_tags(spark: SparkSession) -> DataFrame:
    rows = [(i, f, o, b) for i, (f, (o, b)) in enumerate(FEATURE_TAGS.items())]
    return spark.createDataFrame(rows, "ordinal int, feature string, origin string, bucket string")
