"""Winsorizing, ranks and neutralization; both ways of each give the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import cross_section as X
from crosspanel.operators import groups
from crosspanel.operators.order_stats import BUCKETS, average_ranks, group_quantiles, spread_values, value_bucket
from helpers import KEY, merged, same, to_spark, weekly_panel

DATE = "week_ending_friday"


@pytest.fixture(scope="module")
def panel(spark):
    pdf = weekly_panel(50, 5)
    return pdf, to_spark(spark, pdf).cache()


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 0])
def test_chain_equals_pandas(panel, rows_per_task):
    pdf, df = panel
    out, report = X.standardize(df, ["weekly_return", "trends_interest"], rows_per_task=rows_per_task)
    want = pdf.copy()
    for c in ("weekly_return", "trends_interest"):
        by = want.groupby(DATE)
        want[c + "_w"] = by[c].transform(lambda x: x.clip(x.quantile(.01), x.quantile(.99)))
        want[c + "_r"] = want.groupby(DATE)[c + "_w"].rank(pct=True)
        want[c + "_n"] = want[c + "_r"] - want.groupby([DATE, "sector"])[c + "_r"].transform("mean")
    m = merged(out.drop("weekly_return", "trends_interest", "sector"), want)
    for c in ("weekly_return", "trends_interest"):
        same(m[c + "_w"], m[c + "_wins"])
        same(m[c + "_r"], m[c + "_wins_rank"])
        same(m[c + "_n"], m[c + "_wins_rank_sector_neutral"])
    assert len(m) == len(pdf)
    row = report.first()
    assert row.n_dates == 5 and row.n_tickers == 50 and row.sector_neutralized
    assert row.output_columns == sorted(c for c in out.columns if c not in df.columns)


def test_input_is_left_alone(panel):
    _, df = panel
    before = df.columns
    X.winsorize(df, ["weekly_return"])
    assert df.columns == before


def test_outlier_is_clamped(spark):
    pdf = weekly_panel(50, 3, gaps=0)
    pdf.loc[0, "weekly_return"] = 100.0
    out = X.winsorize(to_spark(spark, pdf), ["weekly_return"])
    day = pdf[pdf[DATE] == pdf[DATE].iloc[0]].weekly_return.dropna()
    assert abs(out.agg(F.max("weekly_return_wins")).first()[0] - day.quantile(.99)) < 1e-9 < 100 - day.quantile(.99)


def test_rank_limits(spark):
    pdf = weekly_panel(30, 2, gaps=0)
    pdf["x"] = np.arange(len(pdf), dtype=float)
    out = X.rank_standardize(to_spark(spark, pdf), ["x"]).groupBy(DATE).agg(
        F.min("x_rank").alias("lo"), F.max("x_rank").alias("hi")).collect()
    assert all(abs(r.lo - 1 / 30) < 1e-12 and r.hi == 1.0 for r in out)


def test_neutral_groups_average_to_zero(panel):
    _, df = panel
    out = X.neutralize(df, ["weekly_return"]).groupBy(DATE, "sector").agg(
        F.abs(F.avg("weekly_return_sector_neutral")).alias("m"))
    assert out.agg(F.max("m")).first()[0] < 1e-9


def test_missing_columns_and_flag(panel, spark):
    _, df = panel
    out, report = X.standardize(df, ["weekly_return", "absent"], neutral=False)
    assert "weekly_return_wins_rank" in out.columns
    assert not [c for c in out.columns if c.endswith("_sector_neutral") or c.startswith("absent")]
    other = spark.createDataFrame([("2021-01-08", "T", 1.0)], "week_ending_friday string, ticker string, other double")
    same_df, error = X.standardize(other)
    assert same_df.columns == other.columns and error.first().error == "no value columns found in panel"


def test_ranks_with_one_hot_value_and_extremes(spark):
    """A third of the rows share one value; both ways agree with pandas."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros(400), np.full(300, 0.1), rng.normal(size=480), [1e308, -1e308, 5e-324, np.nan] * 5])
    pdf = pd.DataFrame({DATE: "d", "ticker": [f"T{i}" for i in range(len(x))], "x": x})
    pdf["want"] = pdf.x.rank(pct=True)
    df = to_spark(spark, pdf)
    for limit in (10 ** 6, 0):
        m = merged(average_ranks(df, [DATE], ["x"], rows_per_task=limit).select(*KEY, "x_rank"), pdf)
        same(m["want"], m["x_rank"])


def test_many_columns_of_large_groups(spark):
    pdf = weekly_panel(20, 4, seed=5)
    df = to_spark(spark, pdf.assign(z=pdf.weekly_return * 2 - 1))
    cols = ["weekly_return", "trends_interest", "z"]
    twice = df.unionByName(df.where("ticker = 'T01'").withColumn("weekly_return", F.col("weekly_return") + 1))
    order = [*KEY, "weekly_return"]
    a = average_ranks(twice, [DATE], cols).orderBy(*order).toPandas()
    b = average_ranks(twice, [DATE], cols, rows_per_task=0).orderBy(*order).toPandas()
    for c in cols:
        same(a[c + "_rank"], b[c + "_rank"])


def test_values_that_lie_close(spark):
    """A bucket with too many different values is cut finer, twice where need be."""
    df = spark.range(0, 40_000, 1, 8).select(F.lit("d").alias(DATE), (100 + F.col("id") * 1e-5).alias("x"))
    close = df.unionByName(spark.range(0, 3000, 1, 4).select(F.lit("d").alias(DATE), (1 + F.col("id") * 1e-10).alias("x")))
    ties = spread_values(close, [DATE], "x", 500)
    assert ties.groupBy(*BUCKETS).count().agg(F.max("count")).first()[0] <= 500
    got = average_ranks(close, [DATE], ["x"], pct=False, rows_per_task=500).orderBy("x").toPandas()
    same(got.x.rank(), got.x_rank)


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_quantiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 997), "x": np.r_[rng.normal(size=700) * 1e6, rng.integers(0, 3, 297)]})
    pdf.loc[::11, "x"] = np.nan
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    df = to_spark(spark, pdf)
    for row in group_quantiles(df, ["g"], ["x"], probs, limit).collect():
        mine = pdf[pdf.g == row.g].x.dropna()
        assert row.n == len(mine)
        same(np.quantile(mine, probs), row.quantiles)
    whole = group_quantiles(df, [], ["x"], probs, limit).first()
    same(np.quantile(pdf.x.dropna(), probs), whole.quantiles)


def test_buckets_keep_the_order(spark):
    xs = sorted([0.0, 1e-300, -1e-300, 1e300, -1e300, 0.999, 1.0, 1.001, -5.0, 3.5, float("inf"), -float("inf")])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").orderBy("x").select(
        value_bucket(F.col("x"))).collect()]
    assert got == sorted(got)


def test_group_stats_both_ways(panel):
    _, df = panel
    parts = [groups.with_group_stats(df, [DATE], small, m=F.avg("weekly_return")).orderBy(*KEY).toPandas()
             for small in (True, False)]
    same(parts[0].m, parts[1].m)
