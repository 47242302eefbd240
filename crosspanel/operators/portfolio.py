"""Neutral long/short books: weights, trades, costs and performance.

Tables are long, keyed by (book, date, entity); any number of books runs in one
job. A cross-section too large for a task is never gathered: the linear steps
need only sums per (book, date, group), which combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.numeric import finite, ratio
from crosspanel.operators.groups import ROWS_PER_TASK, fits, with_group_stats
from crosspanel.operators.order_stats import average_ranks, group_quantiles
from crosspanel.session import bounded_like, stage

DATE = "week_ending_friday"
WEEKS_PER_YEAR = 52
MIN_NAMES = 10


def average_dollar_volume(prices: DataFrame) -> DataFrame:
    """Mean daily close x volume per entity over the whole history."""
    traded = finite(F.col("close") * F.col("volume"))
    return (prices.groupBy("ticker").agg(F.avg(traded).alias("adv"))
            .where(F.col("adv").isNotNull()))


def annual_volatility(rows: DataFrame) -> DataFrame:
    """Sample deviation of weekly returns over prediction rows, annualized."""
    return rows.groupBy("ticker").agg(
        (F.stddev_samp("weekly_return") * F.sqrt(F.lit(float(WEEKS_PER_YEAR)))).alias("vol"))


def ranked_names(df: DataFrame, pred: str, small: bool) -> DataFrame:
    """Rows with a prediction on dates with enough names, plus the percentile rank."""
    rows = bounded_like(df.where(F.col(pred).isNotNull()), df)
    group = ["book", DATE]
    ranked = average_ranks(rows, group, [pred], suffix="_r", small=small)
    return (with_group_stats(ranked, group, small, n_names=F.count(F.lit(1)))
            .where(F.col("n_names") >= MIN_NAMES).withColumnRenamed(pred + "_r", "r"))


def _legs(scheme: str, n_groups: int) -> tuple[Column, Column]:
    """Each weight is a/A - b/B for row terms a, b and date sums A, B.

    ``rank``: the centred rank, normalized to a gross of two. ``decile``: ones
    for the long and the short end, each divided by its own count.
    """
    r = F.col("r")
    if scheme == "rank":
        centred = r - (F.col("n_names") + 1) / (2.0 * F.col("n_names"))
        return centred, F.lit(0.0)
    if scheme == "decile":
        return ((r > 1 - 1 / n_groups).cast("double"), (r < 1 / n_groups).cast("double"))
    raise ValueError(f"unknown scheme: {scheme}")


def raw_weights(ranked: DataFrame, scheme: str, n_groups: int, small: bool) -> DataFrame:
    """Weights before neutralization, as column ``w``."""
    a, b = _legs(scheme, n_groups)
    legs = ranked.withColumn("_a", a).withColumn("_b", b)
    size_a = F.sum(F.abs("_a"))
    out = with_group_stats(legs, ["book", DATE], small, _sa=size_a, _sb=F.sum("_b"))
    scale = 2.0 if scheme == "rank" else 1.0
    w = (F.coalesce(ratio(scale * F.col("_a"), F.col("_sa")), F.lit(0.0))
         - F.coalesce(ratio(F.col("_b"), F.col("_sb")), F.lit(0.0)))
    return out.withColumn("w", w).drop("_a", "_b", "_sa", "_sb")


def neutralise(weights: DataFrame, sector_neutral: bool, beta_neutral: bool, small: bool) -> DataFrame:
    """Remove the group mean, then the beta exposure, then the date mean."""
    if not small:
        return _neutralise_by_sums(weights, sector_neutral, beta_neutral)
    day = ["book", DATE]
    out = weights
    if sector_neutral:
        out = with_group_stats(out, day + ["sector"], True, _m=F.avg("w"))
        out = out.withColumn("w", F.when(F.col("sector").isNotNull(), F.col("w") - F.col("_m"))).drop("_m")
    if beta_neutral:
        beta = F.coalesce("beta", F.lit(1.0))
        out = with_group_stats(out, day, True, _bw=F.sum(beta * F.col("w")), _bb=F.sum(beta * beta),
                               _known=F.count("beta"))
        tilt = F.when(F.col("_known") > 0, F.coalesce(ratio(F.col("_bw"), F.col("_bb")), F.lit(0.0)))
        out = out.withColumn("w", F.col("w") - beta * F.coalesce(tilt, F.lit(0.0)))
        out = out.drop("_bw", "_bb", "_known")
    return demean(out, True)


def _neutralise_by_sums(weights: DataFrame, sector_neutral: bool, beta_neutral: bool) -> DataFrame:
    """The same three steps for cross-sections of any size.

    All are linear, so one aggregate per (book, date, group) determines them;
    its small roll-up per date gives the beta multiple and the final mean.
    """
    beta = F.coalesce("beta", F.lit(1.0)) if beta_neutral else F.lit(1.0)
    known = F.count("beta") if beta_neutral else F.sum(F.lit(0))
    group = ["book", DATE] + (["sector"] if sector_neutral else [])
    w = F.col("w")
    # Rows without a sector get no weight, but their betas count.
    weighed = F.when(F.col("sector").isNotNull(), w) if sector_neutral else w
    of_weighed = F.when(weighed.isNotNull(), beta)
    sums = weights.groupBy(*group).agg(
        F.count(weighed).alias("_n"), F.coalesce(F.sum(weighed), F.lit(0.0)).alias("_sw"),
        F.coalesce(F.sum(of_weighed), F.lit(0.0)).alias("_sb"), F.sum(beta * beta).alias("_sbb"),
        F.coalesce(F.sum(of_weighed * weighed), F.lit(0.0)).alias("_swb"), known.alias("_known"))
    sums = sums.withColumn("_m", F.coalesce(ratio(F.col("_sw"), F.col("_n").cast("double")), F.lit(0.0)) if sector_neutral else F.lit(0.0))
    per_date = sums.groupBy("book", DATE).agg(
        F.sum("_n").alias("_n"), F.sum(F.col("_sw") - F.col("_m") * F.col("_n")).alias("_sw"),
        F.sum("_sb").alias("_sb"), F.sum("_sbb").alias("_sbb"),
        F.sum(F.col("_swb") - F.col("_m") * F.col("_sb")).alias("_swb"), F.sum("_known").alias("_known"))
    multiple = F.when(F.col("_known") > 0, ratio(F.col("_swb"), F.col("_sbb")))
    per_date = per_date.withColumn("_k", F.coalesce(multiple, F.lit(0.0))).select(
        "book", DATE, "_k", ratio(F.col("_sw") - F.col("_k") * F.col("_sb"), F.col("_n").cast("double")).alias("_c"))
    terms = sums.select(*group, "_m").join(per_date, ["book", DATE])
    return (weights.join(terms, group, "left")
            .withColumn("w", w - F.col("_m") - beta * F.col("_k") - F.col("_c"))
            .drop("_m", "_k", "_c"))


def rescale_gross(weights: DataFrame, gross: float, small: bool) -> DataFrame:
    """Scale each date to the wanted gross exposure; all-zero dates stay."""
    out = with_group_stats(weights, ["book", DATE], small, _s=F.sum(F.abs("w")))
    return out.withColumn("w", F.when(F.col("_s") > 0, F.col("w") / F.nullif("_s", F.lit(0.0)) * gross)
                          .otherwise(F.col("w"))).drop("_s")


def demean(weights: DataFrame, small: bool) -> DataFrame:
    out = with_group_stats(weights, ["book", DATE], small, _m=F.avg("w"))
    return out.withColumn("w", F.col("w") - F.col("_m")).drop("_m")


def apply_limits(weights: DataFrame, max_weight: float, gross: float, small: bool) -> DataFrame:
    """Clip names, demean again, rescale.

    The rescale comes last and can lift a name above the cap again; this is the
    documented behaviour, not a binding limit.
    """
    w = F.col("w")
    clipped = weights.withColumn("w", F.when(w.isNotNull(), F.greatest(
        F.lit(-max_weight), F.least(F.lit(max_weight), w))))
    return rescale_gross(demean(clipped, small), gross, small)


def build_weights(df: DataFrame, pred: str, scheme: str = "rank", n_groups: int = 5,
                  sector_neutral: bool = True, beta_neutral: bool = False,
                  max_weight: float = 0.05, gross: float = 2.0,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(book, date, ticker, fwd_return, weight). ``df`` may lack ``book``.

    Cross-sections that fit a task take one shuffle and a chain of windows.
    Larger ones aggregate and join per step, staged twice on the way so that
    no step re-reads more than one staged table.
    """
    bound = df
    if "book" not in df.columns:
        df = df.withColumn("book", F.lit(pred))
    keep = [c for c in ("sector", "beta") if c in df.columns]
    rows = bounded_like(df.select("book", DATE, "ticker", "fwd_return", pred, *keep), bound)
    sector_neutral = sector_neutral and "sector" in keep
    beta_neutral = beta_neutral and "beta" in keep
    small = fits(rows, ["book", DATE], rows_per_task)
    ranked = ranked_names(rows, pred, small)
    if not small:
        ranked = stage(ranked, "ranked-names")
    w = neutralise(raw_weights(ranked, scheme, n_groups, small), sector_neutral, beta_neutral, small)
    if not small:
        w = stage(w, "neutral")
    out = (apply_limits(w, max_weight, gross, small)
           .select("book", DATE, "ticker", "fwd_return", F.col("w").alias("weight")))
    return bounded_like(out, bound)


def trades(weights: DataFrame) -> DataFrame:
    """(book, date, ticker, dw): weight changes between consecutive dates of a book.

    An entity absent on a date has weight zero there, so leaving the book is a
    trade on the next date. The dense (date x entity) grid is never built: a
    row's own change comes from its neighbour, and a gap after it adds one exit.
    """
    calendar = (weights.select("book", DATE).distinct()
                .withColumn("_d", F.row_number().over(Window.partitionBy("book").orderBy(DATE))))
    rows = weights.select("book", DATE, "ticker", F.coalesce("weight", F.lit(0.0)).alias("_w")).join(
        calendar, ["book", DATE])
    line = Window.partitionBy("book", "ticker").orderBy("_d")
    joined = F.lag("_d").over(line) == F.col("_d") - 1
    gone = F.coalesce(F.lead("_d").over(line) != F.col("_d") + 1, F.lit(True))
    marked = rows.select(
        "book", "ticker", "_d", "_w",
        F.when(F.coalesce(joined, F.lit(False)), F.lag("_w").over(line)).otherwise(0.0).alias("_prev"),
        gone.alias("_gone"))
    moves = marked.select("book", "ticker", F.inline(F.array_compact(F.array(
        F.struct(F.col("_d").alias("_d"), (F.col("_w") - F.col("_prev")).alias("dw")),
        F.when(F.col("_gone"), F.struct((F.col("_d") + 1).alias("_d"), (-F.col("_w")).alias("dw")))))))
    # Exits after the last date have no date to trade on and drop out here.
    return moves.join(calendar, ["book", "_d"]).select("book", DATE, "ticker", "dw")


def costs(moves: DataFrame, adv: DataFrame, vol: DataFrame, aum: float = 10e6,
          linear_bps: float = 5.0, impact_c: float = 0.5) -> DataFrame:
    """(book, date, turnover, cost): linear cost plus square-root impact.

    An entity without volume or volatility takes the median over all entities.
    The two entity tables are read for the join and for the median: staged.
    """
    adv, vol = stage(adv, "adv"), stage(vol, "vol")

    def median(df: DataFrame, c: str) -> Column:
        return group_quantiles(df, [], [c], [0.5]).select(F.col("quantiles")[0].alias("m")).scalar()
    size = F.abs("dw")
    volume = F.coalesce("adv", median(adv, "adv"))
    sigma = F.coalesce("vol", median(vol, "vol"))
    priced = moves.join(adv, "ticker", "left").join(vol, "ticker", "left")
    share = F.greatest(ratio(size * aum, volume), F.lit(0.0))
    cost = size * (linear_bps / 1e4) + size * impact_c * sigma * F.sqrt(share)
    return (priced.select("book", DATE, size.alias("_t"), cost.alias("_c")).groupBy("book", DATE)
            .agg((F.sum("_t") / 2.0).alias("turnover"), F.coalesce(F.sum("_c"), F.lit(0.0)).alias("cost")))


def returns(weights: DataFrame, cost: DataFrame) -> DataFrame:
    """(book, date, gross_return, net_return, turnover, cost)."""
    gross = weights.groupBy("book", DATE).agg(
        F.coalesce(F.sum(F.col("weight") * F.col("fwd_return")), F.lit(0.0)).alias("gross_return"))
    return gross.join(cost, ["book", DATE], "left").select(
        "book", DATE, "gross_return",
        (F.col("gross_return") - F.coalesce("cost", F.lit(0.0))).alias("net_return"), "turnover", "cost")


def equity_curve(book_returns: DataFrame) -> DataFrame:
    """Compounded equity and drawdown; a book has one row per date."""
    upto = Window.partitionBy("book").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    eq = book_returns
    for side in ("gross", "net"):
        eq = eq.withColumn(f"{side}_equity", F.product(1 + F.col(f"{side}_return")).over(upto))
    for side in ("gross", "net"):
        peak = F.max(f"{side}_equity").over(upto)
        eq = eq.withColumn(f"{side}_drawdown", ratio(F.col(f"{side}_equity"), peak) - 1)
    return eq


def performance(book_returns: DataFrame) -> DataFrame:
    """One row per book: return, risk, drawdown, turnover and cost."""
    year = float(WEEKS_PER_YEAR)
    aggs: list[Column] = [F.count(F.lit(1)).alias("weeks")]
    for side in ("gross", "net"):
        x = F.col(f"{side}_return")
        ann, vol = F.avg(x) * year, F.stddev_samp(x) * F.sqrt(F.lit(year))
        low = F.stddev_samp(F.when(x < 0, x)) * F.sqrt(F.lit(year))
        worst = F.min(f"{side}_drawdown")
        aggs += [
            (100 * ann).alias(f"{side}_ann_return_pct"), (100 * vol).alias(f"{side}_ann_vol_pct"),
            ratio(ann, vol).alias(f"{side}_sharpe"), (100 * worst).alias(f"{side}_max_drawdown_pct"),
            ratio(ann, low).alias(f"{side}_sortino"),
            F.when(worst < 0, ann / F.nullif(F.abs(worst), F.lit(0.0))).alias(f"{side}_calmar")]
    aggs += [(100 * F.avg("turnover")).alias("mean_weekly_turnover_pct"),
             (F.avg("turnover") * year).alias("annual_turnover_x"),
             (1e4 * F.avg("cost")).alias("mean_weekly_cost_bps")]
    out = equity_curve(book_returns).groupBy("book").agg(*aggs)
    return out.withColumn("cost_drag_ann_pct",
                          F.col("gross_ann_return_pct") - F.col("net_ann_return_pct"))
