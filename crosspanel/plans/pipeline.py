"""The whole workflow over files: prices, search interest and news to diagnostics.

Every step is a function from tables to tables; ``run`` chains them and writes
each result below one folder. Tables are staged where several later steps read
them: returns, panel, features, predictions, weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.operators import alignment as A
from crosspanel.operators import boosting as B
from crosspanel.operators import breadth as BR
from crosspanel.operators import cross_section as X
from crosspanel.operators import diagnostics as D
from crosspanel.operators import evaluation as E
from crosspanel.operators import features as FE
from crosspanel.operators import linear as L
from crosspanel.operators import policies as P
from crosspanel.operators import portfolio as PF
from crosspanel.operators import quality as Q
from crosspanel.operators import rescale as R
from crosspanel.operators import variants as V
from crosspanel.session import bounded_like, stage
from crosspanel.sources import files, ledger, news, universe

# The study horizon, both days included.
HORIZON = ("2021-08-01", "2026-07-27")


@dataclass
class Inputs:
    """Where the files are, and the small tables that describe the entities."""
    prices: str
    interest: dict[str, str]                      # source name -> folder
    timelines: DataFrame | None = None            # (ticker, mode, chunk_no, payload)
    news: DataFrame | None = None                 # (ticker, date, tone, volume)
    news_files: str | None = None                 # folder of daily news files, validated before use
    anchors: str | None = None                    # anchor files; the source "anchored" is rescaled by them
    batches: DataFrame | None = None              # (ticker, batch) as recorded when the series were pulled
    betas: DataFrame | None = None                # (ticker, beta) for beta-neutral books
    landing: str | None = None                    # folder where price files land by week and are read only when changed
    members: DataFrame | None = None              # (ticker, keyword, sector)
    starts: DataFrame | None = None
    splits: DataFrame | None = None
    concerns: DataFrame | None = None


@dataclass
class Settings:
    horizon: tuple[str, str] = HORIZON
    interest_mode: str = "best"
    bucket_lag: int = 5
    min_days: int = 3
    min_fraction: float = 0.6
    folds: int = 8
    nested_folds: int = 6
    inner_folds: int = 3
    min_train: int = 104
    purge: int = 1
    embargo: int = 1
    trees: int = 300
    boosting: bool = True
    walk_forward: bool = True                     # fit the plain walk-forward models beside the nested ones
    zero_handling: str = "ffill"
    average_anchor: bool = True
    batch_tolerance: float = 5.0
    scheme: str = "rank"
    sector_neutral: bool = True
    beta_neutral: bool = False
    max_weight: float = 0.05
    gross: float = 2.0
    aum: float = 10e6
    linear_bps: float = 5.0
    impact_c: float = 0.5
    n_trials: int = 342
    variants: tuple[str, ...] = field(default=V.VARIANTS)


def with_defaults(spark: SparkSession, inputs: Inputs) -> Inputs:
    inputs.members = inputs.members or universe.flatten_universe(universe.universe_table(spark))
    inputs.starts = inputs.starts or universe.starts_table(spark)
    inputs.splits = inputs.splits or universe.splits_table(spark)
    inputs.concerns = inputs.concerns or universe.mapping_table(spark, universe.AMBIGUOUS_KEYWORDS, "concern")
    return inputs


def rescale_anchored(spark: SparkSession, series: DataFrame, inputs: Inputs, s: Settings, keep) -> DataFrame:
    """The anchored source in units of its batch's anchor; batches are the recorded ones or the nearest in time."""
    anchors = stage(files.read_anchors(spark, inputs.anchors), "anchors")
    pulled = series.groupBy("ticker").agg(F.max("modified").alias("at"))
    entities = (pulled.join(inputs.batches, "ticker", "left") if inputs.batches is not None
                else pulled.withColumn("batch", F.lit(None).cast("int")))
    marks = anchors.groupBy("batch").agg(F.max("modified").alias("at"))
    batches = keep("anchor_batches", R.match_batches(entities, marks, s.batch_tolerance))
    anchor = R.anchor_for_entities(series, batches, anchors, s.average_anchor)
    rescaled = stage(R.rescale(series, anchor, s.zero_handling), "rescaled")
    keep("rescale_stats", R.rescale_stats(rescaled))
    keep("rescale_summary", R.rescale_summary(series, rescaled))
    return rescaled.select("ticker", "date", F.col("search_interest_rescaled").alias("search_interest"))


def load_interest(spark: SparkSession, inputs: Inputs, s: Settings, keep) -> DataFrame:
    """The chosen series per entity out of the given sources."""
    parts = []
    for name, path in inputs.interest.items():
        series = files.read_interest(spark, path)
        if name == "anchored" and inputs.anchors:
            series = rescale_anchored(spark, stage(series, "anchored"), inputs, s, keep)
        parts.append(series.select("ticker", "date", "search_interest", F.lit(name).alias("source")))
    return R.choose_source(reduce(DataFrame.unionByName, parts), s.interest_mode)


NEWS_FIELDS = ["date", "tone", "volume"]


def load_news_files(spark: SparkSession, inputs: Inputs, s: Settings, keep) -> DataFrame:
    """Daily news from files, those that fail validation left out and named in ``news_validation``."""
    rows = stage(files.scan_entity_csv(spark, inputs.news_files, NEWS_FIELDS), "news-rows")
    lacking = files.files_lacking(spark, inputs.news_files, NEWS_FIELDS)
    failed = keep("news_validation", Q.validate_news_directory(rows, inputs.members, *s.horizon, lacking=lacking))
    return rows.join(failed, "ticker", "left_anti").select(
        "ticker", F.col("date").try_cast("date").alias("date"), F.col("tone").try_cast("double").alias("tone"),
        F.col("volume").try_cast("double").alias("volume"))


def build_panel(returns: DataFrame, interest: DataFrame, daily_news: DataFrame | None,
                inputs: Inputs, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(standardized weekly panel, imputation report)."""
    masked, price_report = P.price_policy(A.within_horizon(returns, *s.horizon), inputs.starts)
    weekly = A.weekly_returns(masked, s.min_days, s.min_fraction)
    buckets = A.within_horizon(A.weekly_interest(interest, s.bucket_lag), *s.horizon, date="week_ending_friday")
    recoded, interest_report = P.interest_policy(buckets, inputs.starts, "trends_interest", "week_ending_friday")
    reports, tone = [price_report, interest_report], None
    if daily_news is not None:
        tone, news_report = P.news_policy(A.weekly_news(daily_news), "zero", "gdelt_tone", "gdelt_volume")
        reports.append(news_report)
    panel = stage(A.assemble_panel(weekly, inputs.members, recoded, tone), "panel")
    measures = X.PANEL_MEASURES if daily_news is not None else X.PANEL_MEASURES[:2]
    standardized, _ = X.standardize(panel, measures)
    return standardized, P.imputation_report(*reports)


def manifest(panel: DataFrame, s: Settings, coverage: DataFrame, imputation: DataFrame) -> DataFrame:
    """One row: parameters, counts, date range, and the coverage and policy reports as arrays."""
    rows = lambda df: df.agg(F.collect_list(F.struct(*df.columns)).alias("r")).scalar()
    counts = panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"),
        F.count_distinct("week_ending_friday").alias("n_weeks"), F.min("week_ending_friday").alias("first_week"),
        F.max("week_ending_friday").alias("last_week"))
    return counts.select(
        F.lit("build_panel").alias("step"), F.lit(s.horizon[0]).alias("horizon_start"),
        F.lit(s.horizon[1]).alias("horizon_end"), F.lit(s.min_days).alias("min_days"),
        F.lit(s.min_fraction).alias("min_fraction"), "*",
        rows(coverage).alias("coverage"), rows(imputation).alias("imputation"))


def walk_forward(features: DataFrame, s: Settings, keep) -> None:
    """The plain walk-forward models: predictions, summaries, mean coefficients, gain importance."""
    enet, coefs = L.walk_forward_enet(features, s.folds, s.min_train, s.purge, s.embargo)
    out, names = enet, ["pred_enet"]
    keep("walk_forward_coefficients", L.coefficient_table(coefs))
    if s.boosting:
        trees, nodes = B.walk_forward_gbt(features, s.folds, s.min_train, s.purge, s.embargo, s.trees)
        out = out.join(trees.select("week_ending_friday", "ticker", "pred_gbt"), ["week_ending_friday", "ticker"], "left")
        names.append("pred_gbt")
        keep("gain_importance", B.importance_table(nodes))
    preds = keep("walk_forward_predictions", out)
    keep("walk_forward_summary", reduce(DataFrame.unionByName, [E.summarise(preds, m, m) for m in names]))


def predict(features: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, list[str]]:
    """(predictions of every model, Elastic Net coefficients, prediction columns)."""
    enet, coefs = L.nested_enet(features, s.nested_folds, s.inner_folds, s.min_train, s.purge, s.embargo)
    out, names = enet.drop("config"), ["pred_enet"]
    if s.boosting:
        trees, _ = B.nested_gbt(features, s.nested_folds, s.inner_folds, s.min_train, s.purge, s.embargo, s.trees)
        out = out.join(trees.select("week_ending_friday", "ticker", "pred_gbt"), ["week_ending_friday", "ticker"], "left")
        names.append("pred_gbt")
    return out, coefs, names


def run(spark: SparkSession, inputs: Inputs, out: str, settings: Settings | None = None) -> dict[str, str]:
    """Run everything; returns the folder of each written table."""
    s, inputs = settings or Settings(), with_defaults(spark, inputs)
    written: dict[str, str] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        written[name] = f"{out}/{name}"
        files.write_table(df, written[name])
        return spark.read.schema(df.schema).parquet(written[name])

    if inputs.landing:
        ledger.land_prices(spark, inputs.prices, f"{inputs.landing}/prices", f"{inputs.landing}/ledger")
        landed = files.read_table(spark, f"{inputs.landing}/prices", ["ticker", "date", "close", "adj_close", "volume"])
    prices = keep("prices", landed if inputs.landing else files.read_prices(spark, inputs.prices))
    checks = keep("price_checks", Q.price_checks(prices, inputs.starts))
    splits = keep("split_checks", Q.split_checks(prices, inputs.splits))
    keep("flag_counts", Q.flag_counts(Q.entity_flags(checks, splits)))
    returns = keep("daily_returns", A.daily_log_returns(prices).select("ticker", "date", "adj_close", "daily_return"))
    keep("short_history", A.short_history(returns))

    interest = keep("interest", load_interest(spark, inputs, s, keep))
    keep("series_information", Q.series_information(interest))
    daily_news = inputs.news
    if inputs.timelines is not None:
        checked = news.check_timelines(inputs.timelines)
        keep("news_errors", news.timeline_errors(checked))
        daily_news = keep("news_daily", news.assemble_daily(news.daily_points(checked)))
    elif inputs.news_files:
        daily_news = keep("news_daily", load_news_files(spark, inputs, s, keep))
    sources = {"prices": prices, "trends": interest}
    if daily_news is not None:
        sources["news"] = daily_news
    coverage = keep("input_coverage", Q.input_coverage(inputs.members, sources))

    standardized, imputation = build_panel(returns, interest, daily_news, inputs, s)
    panel = keep("panel", standardized)
    imputation = keep("imputation", imputation)
    written["panel_manifest"] = f"{out}/panel_manifest"
    files.write_manifest(manifest(panel, s, coverage, imputation), written["panel_manifest"])

    base = stage(panel.select("week_ending_friday", "ticker", "sector", "weekly_return", "trends_interest"), "base")
    ranked = stage(FE.feature_table(base), "ranked")
    features = bounded_like(keep("features", ranked), ranked)
    keep("feature_coverage", Q.feature_coverage(features, FE.FEATURES + [FE.TARGET]))

    if s.walk_forward:
        walk_forward(features, s, keep)
    predictions, coefs, models = predict(features, s)
    predictions = keep("predictions", predictions)
    keep("coefficients", L.coefficient_table(coefs))
    keep("nested_summary", L.nested_summary(coefs, s.inner_folds))
    preds = stage(predictions.join(panel.select("week_ending_friday", "ticker", "sector", "weekly_return"),
                                   ["week_ending_friday", "ticker"], "left"), "predictions")
    keep("model_summary", reduce(DataFrame.unionByName, [E.summarise(preds, m, m) for m in models]))

    if inputs.betas is not None:
        preds = stage(preds.join(inputs.betas, "ticker", "left"), "predictions-betas")
    weights = keep("weights", V.sweep(
        preds, models, s.variants, gross=s.gross, scheme=s.scheme, sector_neutral=s.sector_neutral,
        beta_neutral=s.beta_neutral, max_weight=s.max_weight))
    cost = PF.costs(PF.trades(weights), PF.average_dollar_volume(prices), PF.annual_volatility(preds),
                    s.aum, s.linear_bps, s.impact_c)
    book_returns = keep("book_returns", PF.returns(weights, cost))
    keep("equity", PF.equity_curve(book_returns))
    keep("performance", PF.performance(book_returns))

    keep("residuals", reduce(DataFrame.unionByName, [D.residual_report(preds, m) for m in models]))
    keep("deflated_sharpe", D.deflated_sharpe(book_returns, s.n_trials))
    breadth = keep("breadth", BR.effective_breadth(base))
    keep("fundamental_law", reduce(DataFrame.unionByName, [
        BR.fundamental_law(breadth, E.ic_summary(E.rank_ic(preds, m))).withColumn("model", F.lit(m)) for m in models]))

    keep("sector_ic", E.sector_ic_tested(preds, models[-1]))
    scores = E.coupling_p(E.coupling(base, E.weekly_dollar_volume(prices)))
    labelled = keep("keyword_coupling", E.label_coupling(scores, inputs.members, inputs.concerns))
    keep("coupling_by_sector", E.mean_by_group(labelled))
    tests = {"flagged": F.col("flagged_a_priori"), "consumer": F.col("sector").startswith("Consumer")}
    keep("coupling_tests", reduce(DataFrame.unionByName, [
        E.welch_p(E.welch(labelled, "corr_svi_volume", flag)).withColumn("comparison", F.lit(name))
        for name, flag in tests.items()]))
    return written
