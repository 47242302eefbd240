"""Features against pandas rolling windows, and the look-ahead check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import features as FE
from helpers import KEY, merged, same, to_spark, weekly_panel


@pytest.fixture(scope="module")
def panel(spark):
    pdf = weekly_panel()
    return pdf, to_spark(spark, pdf).cache()


def by_pandas(pdf):
    df = pdf.sort_values(["ticker", "week_ending_friday"]).reset_index(drop=True)
    df["svi"] = np.log1p(df.trends_interest)
    df["resid"] = df.weekly_return - df.groupby("week_ending_friday").weekly_return.transform("mean")
    df["dlog"] = df.groupby("ticker").svi.diff()
    roll = lambda c, w, m, f, lag=1: df.groupby("ticker")[c].transform(                 # noqa: E731
        lambda s: getattr(s.rolling(w, min_periods=m), f)().shift(lag))
    df["fwd_return"] = df.groupby("ticker").weekly_return.shift(-1)
    df["asvi"] = df.svi - roll("svi", 8, 4, "median")
    df["trends_z_26"] = (df.svi - roll("svi", 26, 15, "mean")) / roll("svi", 26, 15, "std")
    df["trends_chg_4"] = df.svi - df.groupby("ticker").svi.shift(4)
    df["trends_vol_13"] = roll("dlog", 13, 7, "std")
    df["mom_52_4"] = roll("weekly_return", 48, 30, "sum", 4)
    df["mom_12_1"] = roll("weekly_return", 11, 8, "sum")
    df["rvol_13"] = roll("weekly_return", 13, 7, "std")
    df["ivol_26"] = roll("resid", 26, 15, "std")
    df["rev_1"] = df.groupby("ticker").weekly_return.shift(1)
    return df[df.groupby("ticker").cumcount() >= 52][KEY + FE.FEATURES + [FE.TARGET]]


def test_features_equal_pandas(panel):
    pdf, df = panel
    m = merged(FE.build_features(df).select(*KEY, *FE.FEATURES, FE.TARGET), by_pandas(pdf))
    for c in FE.FEATURES + [FE.TARGET]:
        same(m[c + "_want"], m[c], 1e-8)


def test_future_rows_change_no_feature(panel, spark):
    pdf, df = panel
    cut = sorted(pdf.week_ending_friday.unique())[70]
    full = FE.build_features(df).where(F.col("week_ending_friday") <= F.lit(cut)).select(*KEY, *FE.FEATURES)
    part = FE.build_features(df.where(F.col("week_ending_friday") <= F.lit(cut))).select(*KEY, *FE.FEATURES)
    a, b = (x.orderBy(*KEY).toPandas() for x in (full, part))
    assert len(a) == len(b) > 0
    for c in FE.FEATURES:
        same(a[c], b[c], 1e-12)


def test_feature_ranks(panel):
    _, df = panel
    out = FE.feature_table(df)
    limits = out.agg(*[F.min(c).alias("lo_" + c) for c in FE.RANKS], *[F.max(c).alias(c) for c in FE.RANKS]).first()
    assert all(0 < limits["lo_" + c] <= limits[c] == 1.0 for c in FE.RANKS)
    assert FE.feature_tags(df.sparkSession).count() == 9
