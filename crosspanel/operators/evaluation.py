"""Rank-correlation evaluation, per-group tests and false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.calendar import week_ending_friday
from crosspanel.functions.numeric import beside, ratio, safe_corr
from crosspanel.functions.tails import student_p
from crosspanel.operators.alignment import by_entity
from crosspanel.operators.groups import fits, with_group_stats
from crosspanel.operators.order_stats import average_ranks, tie_table
from crosspanel.session import bounded_like

DATE = "week_ending_friday"


def rank_ic(preds: DataFrame, pred: str, keys: list[str] | None = None,
            target: str = "fwd_return", min_names: int = 5,
            target_rank: str | None = None, small: bool | None = None) -> DataFrame:
    """(keys, date, n, ic): Spearman correlation per date over complete pairs.

    Dates with fewer than ``min_names`` pairs or without variance are absent.
    Ranks average (n + 1) / 2, so plain sums of half-integers give the
    covariance, and a correlation of zero comes out as exactly zero. A caller
    that knows the target's rank within each group, or that groups fit a task,
    passes it on.
    """
    group = (keys or []) + [DATE]
    y_rank = [F.col(target_rank).alias("_y_rank")] if target_rank else []
    pairs = (preds.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
             .select(*group, F.col(pred).cast("double").alias("_p"), F.col(target).alias("_y"), *y_rank))
    small = fits(bounded_like(pairs, preds), group) if small is None else small
    ranked = average_ranks(pairs, group, ["_p"] if y_rank else ["_p", "_y"], pct=False, small=small)
    p, y = F.col("_p_rank"), F.col("_y_rank")
    sums = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p * y).alias("_py"), F.sum(p * p).alias("_pp"),
        F.sum(y * y).alias("_yy"))
    centre = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / F.lit(4.0)
    ic = ratio(F.col("_py") - centre, F.sqrt((F.col("_pp") - centre) * (F.col("_yy") - centre)))
    return (sums.where(F.col("n") >= min_names).select(*group, "n", ic.alias("ic"))
            .where(F.col("ic").isNotNull()))


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: the distribution of the per-date rank correlations."""
    mean, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.agg(
        n.alias("weeks_evaluated"), mean.alias("mean_rank_ic"), F.percentile("ic", 0.5).alias("median_rank_ic"),
        sd.alias("std_rank_ic"), ratio(mean, sd).alias("ic_ir"),
        (ratio(mean, sd) * F.sqrt(n)).alias("ic_t_stat"),
        (100 * F.avg((F.col("ic") > 0).cast("double"))).alias("pct_weeks_positive_ic"))


def hit_rate(preds: DataFrame, pred: str, target: str = "fwd_return") -> DataFrame:
    """Share of rows whose demeaned prediction has the sign of the demeaned target."""
    rows = preds.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(
        DATE, F.col(pred).alias("_p"), F.col(target).alias("_y"))
    rows = bounded_like(rows, preds)
    tilt = with_group_stats(rows, [DATE], fits(rows, [DATE]), _mp=F.avg("_p"), _my=F.avg("_y"))
    same = F.signum(F.col("_p") - F.col("_mp")) == F.signum(F.col("_y") - F.col("_my"))
    return tilt.agg((100 * F.avg(same.cast("double"))).alias("hit_rate_pct"),
                    F.count(F.lit(1)).alias("n_predictions"))


def summarise(preds: DataFrame, pred: str, label: str) -> DataFrame:
    """The model card: rank-correlation summary and hit rate, one row."""
    return (beside(ic_summary(rank_ic(preds, pred)), hit_rate(preds, pred))
            .select(F.lit(label).alias("model"), "*"))


def sector_ic(preds: DataFrame, pred: str, min_names: int = 5, min_dates: int = 20) -> DataFrame:
    """Per group: mean rank correlation inside the group and its t statistic."""
    ic = rank_ic(preds, pred, keys=["sector"], min_names=min_names)
    mean, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    stats = ic.groupBy("sector").agg(
        n.alias("n_weeks"), mean.alias("mean_ic"), sd.alias("std_ic"),
        ratio(mean, sd / F.sqrt(n)).alias("t_stat"),
        (100 * F.avg((F.col("ic") > 0).cast("double"))).alias("pct_positive"),
    ).where(F.col("n_weeks") >= min_dates)
    names = (preds.where(F.col(pred).isNotNull() & F.col("fwd_return").isNotNull())
             .groupBy("sector").agg(F.count_distinct("ticker").alias("n_names")))
    return stats.join(names, "sector").withColumn("naive_t_gt_2", F.abs("t_stat") > 2)


def sector_ic_tested(preds: DataFrame, pred: str, q: float = 0.10, **kw) -> DataFrame:
    """``sector_ic`` with p-values and the groups that survive at level ``q``."""
    tested = sector_ic(preds, pred, **kw).withColumn(
        "p_value", student_p(F.col("t_stat"), F.col("n_weeks") - 1))
    return benjamini_hochberg(tested, "p_value", q).withColumnRenamed("rejected", "survives_bh")


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", q: float = 0.10) -> DataFrame:
    """Adds ``rejected``: the step-up rule at level ``q``.

    Reject everything up to the largest p with p <= q * (share of tests at or
    below p). Counting at or below through the bucketed ranks needs no global
    sort; equal p-values stand or fall together.
    """
    ties = tie_table(tests.select(F.col(p).cast("double").alias("_p")), [], "_p")
    m = tests.agg(F.count(F.lit(1)).alias("m")).scalar()
    passing = ties.where(F.col("_p") <= (F.col("_below") + F.col("_equal")) / m * q)
    limit = passing.agg(F.max("_p").alias("limit")).scalar()
    return tests.withColumn("rejected", F.coalesce(F.col(p) <= limit, F.lit(False)))


def weekly_dollar_volume(prices: DataFrame) -> DataFrame:
    """Sum of close x volume per entity and Friday week."""
    return (prices.groupBy("ticker", week_ending_friday(F.col("date")).alias(DATE))
            .agg(F.coalesce(F.sum(F.col("close") * F.col("volume")), F.lit(0.0)).alias("dollar_volume")))


def coupling(panel: DataFrame, dollar_volume: DataFrame, min_rows: int = 60,
             min_pairs: int = 50) -> DataFrame:
    """Per entity: correlation of log changes in search interest and dollar volume.

    Changes run over the rows left after both measures are positive.
    """
    both = (panel.select("ticker", DATE, "trends_interest").join(dollar_volume, ["ticker", DATE])
            .where((F.col("trends_interest") > 0) & (F.col("dollar_volume") > 0)))

    def change(c: str) -> Column:
        return F.log(c) - F.lag(F.log(c)).over(by_entity(DATE))
    moves = both.select("ticker", change("trends_interest").alias("_s"), change("dollar_volume").alias("_v"))
    return (moves.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("_s").isNotNull() & F.col("_v").isNotNull()).alias("n_obs"),
        safe_corr(F.col("_s"), F.col("_v")).alias("corr_svi_volume"))
        .where((F.col("_rows") >= min_rows) & (F.col("n_obs") >= min_pairs)).drop("_rows"))


def coupling_p(scores: DataFrame) -> DataFrame:
    """Two-sided p of a correlation through its t statistic; 0 where it is 1 or -1."""
    r, dof = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("corr_svi_volume"))), F.col("n_obs") - 2
    t = r * F.sqrt(dof / F.nullif(1 - r * r, F.lit(0.0)))
    exact = (F.abs(r) == 1) & (dof > 0)
    return scores.withColumn("p_value", F.when(exact, 0.0).otherwise(student_p(t, dof)))


def label_coupling(scores: DataFrame, members: DataFrame, concerns: DataFrame) -> DataFrame:
    """Adds keyword, group and the ambiguity noted before looking at the data."""
    return (scores.join(members.select("ticker", "keyword", "sector"), "ticker", "left")
            .join(concerns.select("ticker", "concern"), "ticker", "left")
            .withColumn("flagged_a_priori", F.col("concern").isNotNull()))


def welch(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """One row: unequal-variance t comparing flagged rows with the rest."""
    x, y = F.when(flag, F.col(value)), F.when(~flag, F.col(value))
    one = df.agg(F.count(x).alias("n_flagged"), F.count(y).alias("n_rest"),
                 F.avg(x).alias("mean_flagged"), F.avg(y).alias("mean_rest"),
                 F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"))
    a = ratio(F.col("_vx"), F.col("n_flagged").cast("double"))
    b = ratio(F.col("_vy"), F.col("n_rest").cast("double"))
    t = ratio(F.col("mean_flagged") - F.col("mean_rest"), F.sqrt(a + b))
    dof = ratio((a + b) * (a + b), ratio(a * a, F.col("n_flagged") - F.lit(1.0))
                + ratio(b * b, F.col("n_rest") - F.lit(1.0)))
    return one.select("n_flagged", "n_rest", "mean_flagged", "mean_rest",
                      t.alias("t_stat"), dof.alias("dof"))


def welch_p(result: DataFrame) -> DataFrame:
    return result.withColumn("p_value", student_p(F.col("t_stat"), F.col("dof")))


def weakest(scores: DataFrame, n: int = 12, value: str = "corr_svi_volume") -> DataFrame:
    return scores.orderBy(F.col(value).asc(), "ticker").limit(n)


def strongest(scores: DataFrame, n: int = 8, value: str = "corr_svi_volume") -> DataFrame:
    return scores.orderBy(F.col(value).desc(), "ticker").limit(n)


def mean_by_group(scores: DataFrame, value: str = "corr_svi_volume") -> DataFrame:
    return scores.groupBy("sector").agg(F.avg(value).alias("mean_" + value))
