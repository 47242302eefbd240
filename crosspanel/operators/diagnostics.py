"""Residual tests and the deflated Sharpe ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.numeric import ratio, safe_corr
from crosspanel.functions.tails import chi2_p, noise_benchmark, normal_cdf
from crosspanel.session import stage

DATE = "week_ending_friday"
LJUNG_BOX_LAGS = (1, 4, 8)


def residual_series(preds: DataFrame, pred: str) -> DataFrame:
    """(book, date, e): mean residual per date. One row per date and book."""
    if "book" not in preds.columns:
        preds = preds.withColumn("book", F.lit(pred))
    return (preds.where(F.col(pred).isNotNull() & F.col("fwd_return").isNotNull())
            .groupBy("book", DATE).agg(F.avg(F.col("fwd_return") - F.col(pred)).alias("e")))


def _by_book() -> Window:
    return Window.partitionBy("book").orderBy(DATE)


def durbin_watson(series: DataFrame) -> DataFrame:
    step = F.col("e") - F.lag("e").over(_by_book())
    return (series.withColumn("_s", step).groupBy("book")
            .agg(ratio(F.sum(F.col("_s") * F.col("_s")), F.sum(F.col("e") * F.col("e"))).alias("durbin_watson")))


def ljung_box(series: DataFrame, lags: tuple[int, ...] = LJUNG_BOX_LAGS) -> DataFrame:
    """(book, lag, stat): autocorrelation of the overall-demeaned series."""
    top = max(lags)
    centred = series.withColumn("_u", F.col("e") - F.avg("e").over(Window.partitionBy("book")))
    for k in range(1, top + 1):
        centred = centred.withColumn(f"_u{k}", F.lag("_u", k).over(_by_book()))
    u = F.col("_u")
    sums = centred.groupBy("book").agg(
        F.count(u).alias("n"), F.sum(u * u).alias("_v"),
        *[F.sum(u * F.col(f"_u{k}")).alias(f"_c{k}") for k in range(1, top + 1)])

    def stat(lag: int) -> Column:
        terms = [F.coalesce(ratio(F.pow(ratio(F.col(f"_c{k}"), F.col("_v")), 2),
                                  (F.col("n") - k).cast("double")), F.lit(0.0)) for k in range(1, lag + 1)]
        return F.col("n") * (F.col("n") + 2) * sum(terms[1:], terms[0])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), stat(k).alias("stat")) for k in lags])
    return sums.select("book", F.inline(rows))


def ljung_box_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", chi2_p(F.col("stat"), F.col("lag")))


def moments(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean, sample deviation, population skew and plain kurtosis."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurtosis"))


def jarque_bera(series: DataFrame, value: str = "e", keys: list[str] | None = None) -> DataFrame:
    """Normality statistic; its two-degree tail is an exponential."""
    m = moments(series, value, keys or ["book"])
    stat = F.col("n") / 6.0 * (F.pow("skew", F.lit(2.0)) + F.pow(F.col("kurtosis") - 3, F.lit(2.0)) / 4)
    return (m.withColumn("stat", stat).withColumn("p_value", F.exp(-F.col("stat") / 2))
            .select(*(keys or ["book"]), "stat", "p_value", "skew", "kurtosis"))


def breusch_pagan(preds: DataFrame, pred: str) -> DataFrame:
    """Row-level heteroskedasticity: n times the R-squared of e^2 on the prediction."""
    if "book" not in preds.columns:
        preds = preds.withColumn("book", F.lit(pred))
    rows = preds.where(F.col(pred).isNotNull() & F.col("fwd_return").isNotNull())
    e = F.col("fwd_return") - F.col(pred)
    return rows.groupBy("book").agg(
        (F.count(F.lit(1)) * F.pow(safe_corr(e * e, F.col(pred)), F.lit(2.0))).alias("stat"))


def breusch_pagan_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", chi2_p(F.col("stat"), F.lit(1)))


def lag1_autocorrelation(series: DataFrame) -> DataFrame:
    """Pearson correlation of the series with its own previous value."""
    return (series.withColumn("_b", F.lag("e").over(_by_book())).groupBy("book")
            .agg(safe_corr(F.col("e"), F.col("_b")).alias("acf_lag1")))


def reading(dw: Column, lb1_p: Column) -> Column:
    """Serial structure in words."""
    return (F.when((dw < 1.7) & (lb1_p < 0.05), "positive")
            .when((dw > 2.3) & (lb1_p < 0.05), "negative").otherwise("none"))


def residual_report(preds: DataFrame, pred: str) -> DataFrame:
    """All residual tests of each book on one row."""
    series = stage(residual_series(preds, pred), "residuals")
    lb = ljung_box_p(ljung_box(series)).groupBy("book").agg(*[
        F.max(F.when(F.col("lag") == k, F.col(c))).alias(f"ljung_box_{k}_{c}")
        for k in LJUNG_BOX_LAGS for c in ("stat", "p_value")])
    jb = jarque_bera(series).withColumnsRenamed({"stat": "jarque_bera", "p_value": "jarque_bera_p"})
    bp = breusch_pagan_p(stage(breusch_pagan(preds, pred), "breusch-pagan")).withColumnsRenamed(
        {"stat": "breusch_pagan", "p_value": "breusch_pagan_p"})
    out = durbin_watson(series)
    for part in (lag1_autocorrelation(series), lb, jb, bp):
        out = out.join(part, "book")
    return out.withColumn("reading", reading(F.col("durbin_watson"), F.col("ljung_box_1_p_value")))


def sharpe_moments(book_returns: DataFrame, value: str = "gross_return", min_periods: int = 10) -> DataFrame:
    """(book, n, sharpe, skew, kurtosis, variance): inputs of the deflated ratio."""
    m = moments(book_returns, value, ["book"])
    sr = F.when(F.col("sd") > 0, F.col("mean") / F.nullif("sd", F.lit(0.0))).otherwise(0.0)
    m = m.withColumn("sharpe", sr).withColumn(
        "_shape", 1 - F.col("skew") * F.col("sharpe")
        + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe"))
    return m.select("book", "n", "sharpe", (F.col("sharpe") * F.sqrt(F.lit(52.0))).alias("sharpe_annualised"),
                    "skew", "kurtosis", F.greatest("_shape", F.lit(1e-12)).alias("shape"),
                    (F.col("_shape") / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))).alias("sr_variance"),
                    F.when(F.col("n") < min_periods, "too few observations").alias("error"))


def deflated_z(stats: DataFrame, benchmark: Column) -> DataFrame:
    z = (F.col("sharpe") - F.col("benchmark")) * F.sqrt(F.col("n") - 1) / F.sqrt("shape")
    return stats.withColumn("benchmark", benchmark).withColumn("z", F.when(F.col("error").isNull(), z))


def deflated_sharpe(book_returns: DataFrame, n_trials: int = 342, benchmark: float | None = None,
                    value: str = "gross_return") -> DataFrame:
    """Probability that the Sharpe ratio beats the best of ``n_trials`` noise trials."""
    stats = sharpe_moments(book_returns, value)
    bench = (noise_benchmark(n_trials, F.greatest("sr_variance", F.lit(1e-12)))
             if benchmark is None else F.lit(float(benchmark)))
    out = deflated_z(stats, bench).withColumn("probability", normal_cdf(F.col("z")))
    return out.withColumn("passes_at_95pct", F.col("probability") > 0.95).drop("shape")
