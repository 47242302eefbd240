"""Small seeded panels and pandas versions of the semantics under test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

KEY = ["week_ending_friday", "ticker"]


def weekly_panel(n_names=12, n_weeks=90, seed=0, gaps=0.1) -> pd.DataFrame:
    """Names x Fridays with gaps, nulls, ties and one name that leaves and returns."""
    rng = np.random.default_rng(seed)
    weeks = pd.date_range("2021-01-08", periods=n_weeks, freq="W-FRI").date
    rows = [(w, f"T{i:02d}", f"S{i % 3}") for w in weeks for i in range(n_names)]
    pdf = pd.DataFrame(rows, columns=KEY + ["sector"])
    pdf["weekly_return"] = rng.normal(0, 0.03, len(pdf)).round(3)
    pdf["trends_interest"] = rng.integers(0, 40, len(pdf)).astype(float)
    pdf.loc[rng.random(len(pdf)) < gaps, "trends_interest"] = np.nan
    pdf.loc[rng.random(len(pdf)) < gaps / 2, "weekly_return"] = np.nan
    away = (pdf.ticker == "T03") & pdf.week_ending_friday.isin(weeks[20:31])
    keep = (rng.random(len(pdf)) >= gaps) & ~away
    return pdf[keep].reset_index(drop=True)


def to_spark(spark, pdf: pd.DataFrame):
    """NaN becomes null, as at every source."""
    df = spark.createDataFrame(pdf)
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def merged(df, pdf: pd.DataFrame, on=KEY) -> pd.DataFrame:
    got = df.toPandas()
    out = pdf.merge(got, on=on, how="outer", suffixes=("_want", ""), indicator=True)
    assert (out["_merge"] == "both").all(), out["_merge"].value_counts()
    return out


def same(want, got, tol=1e-9):
    want, got = np.asarray(want, float), np.asarray(got, float)
    assert (np.isnan(want) == np.isnan(got)).all()
    np.testing.assert_allclose(got[~np.isnan(got)], want[~np.isnan(want)], rtol=tol, atol=tol)


def average_rank_ic(g: pd.DataFrame, pred: str) -> float:
    a, b = g[pred].rank(), g["fwd_return"].rank()
    if a.std() == 0 or b.std() == 0:
        return np.nan
    return float(np.corrcoef(a, b)[0, 1])
