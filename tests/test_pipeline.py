"""The whole workflow over a small folder of files."""

import json

import numpy as np
import pandas as pd

from crosspanel.plans.pipeline import Inputs, Settings, run
from crosspanel.sources import ledger, universe


def test_workflow(spark, tmp_path):
    rng = np.random.default_rng(0)
    members = [(t, k, s) for s, m in list(universe.SECTORS.items())[:3] for t, k in m]
    days = pd.bdate_range("2021-08-02", periods=5 * 140)
    sundays = pd.date_range("2021-08-01", periods=140, freq="W-SUN")
    for folder in ("prices", "single", "disambig"):
        (tmp_path / folder).mkdir()
    for i, (t, _, _) in enumerate(members):
        close = 100 * np.exp(np.cumsum(rng.normal(0, .01, len(days))))
        pd.DataFrame({"Date": days.date, "Close": close, "Adj Close": close * .9,
                      "Volume": rng.integers(1000, 9000, len(days))}).to_csv(tmp_path / "prices" / f"{t}.csv", index=False)
        for folder in ("single", "disambig")[: 1 + (i % 2)]:
            pd.DataFrame({"date": sundays.date, "search_interest": rng.integers(1, 100, 140)}).to_csv(
                tmp_path / folder / f"{t}.csv", index=False)
    point = lambda v: json.dumps({"timeline": [{"data": [                               # noqa: E731
        {"date": f"{d:%Y%m%d}T000000Z", "value": v} for d in days[::7]]}]})
    timelines = spark.createDataFrame(
        [(t, m, 1, point(2.5)) for t, _, _ in members for m in ("tone", "volume")] + [("AAPL", "tone", 2, "{}")],
        "ticker string, mode string, chunk_no long, payload string")
    out = run(spark, Inputs(
        prices=str(tmp_path / "prices"), timelines=timelines,
        interest={"single": str(tmp_path / "single"), "disambig": str(tmp_path / "disambig")},
        members=spark.createDataFrame(members, "ticker string, keyword string, sector string")),
        str(tmp_path / "out"), Settings(nested_folds=2, inner_folds=1, min_train=60, boosting=False))
    read = {k: spark.read.parquet(v) for k, v in out.items() if k != "panel_manifest"}
    m = spark.read.json(out["panel_manifest"]).first()
    assert m.n_tickers == 24 and m.n_weeks == 140 and m.n_rows == 24 * 140
    assert len(m.coverage) == read["input_coverage"].count() and len(m.imputation) == read["imputation"].count()
    assert read["walk_forward_predictions"].select("fold").distinct().count() == 8
    assert read["walk_forward_summary"].count() == 1 and read["walk_forward_coefficients"].count() == 9
    assert read["news_errors"].count() == 1 and read["input_coverage"].where("n_missing > 0").count() == 0
    assert read["panel"].where(
        "gdelt_volume is not null and gdelt_volume_wins_rank_sector_neutral is null").count() == 0
    assert {r.source: r["count"] for r in read["series_information"].groupBy("source").count().collect()} == {
        "single": 12, "disambig": 12}
    assert read["features"].count() == 24 * (140 - 52) and read["performance"].count() == 4
    assert read["coefficients"].count() == 9 and read["residuals"].count() == 1
    assert read["nested_summary"].first().total_fits == 2 * 19 * 1
    assert read["breadth"].first().n_names == 24 and read["coupling_tests"].count() == 2
    book = read["weights"].where("book = 'pred_enet:weight_blend'").groupBy("week_ending_friday").sum("weight").collect()
    assert book and all(abs(r[1]) < 1e-9 for r in book)


def test_anchored_series_news_files_and_book_options(spark, tmp_path):
    """The anchored source in units of its anchors, validated news files, decile and beta-neutral books, boosted trees."""
    rng = np.random.default_rng(1)
    members = [(t, k, s) for s, m in list(universe.SECTORS.items())[:2] for t, k in m]
    days = pd.bdate_range("2021-08-02", periods=5 * 110)
    sundays = pd.date_range("2021-08-01", periods=110, freq="W-SUN")
    for folder in ("prices", "anchored", "anchors", "news"):
        (tmp_path / folder).mkdir()
    raw = {}
    for i, (t, _, _) in enumerate(members):
        close = 50 * np.exp(np.cumsum(rng.normal(0, .01, len(days))))
        pd.DataFrame({"Date": days.date, "Close": close, "Adj Close": close, "Volume": 1000 + i}).to_csv(
            tmp_path / "prices" / f"{t}.csv", index=False)
        raw[t] = rng.integers(1, 100, 110)
        pd.DataFrame({"date": sundays.date, "search_interest": raw[t]}).to_csv(tmp_path / "anchored" / f"{t}.csv", index=False)
        every = pd.date_range("2021-08-01", "2026-07-27")
        volume = np.where(np.arange(len(every)) == 5, -1 if i == 3 else 7, 7)
        if i != 4:
            pd.DataFrame({"date": every.date, "tone": 1.5, "volume": volume}).to_csv(tmp_path / "news" / f"{t}.csv", index=False)
    for b in (1, 2):
        pd.DataFrame({"date": sundays.date, "search_interest": [20 * b] * 110}).to_csv(
            tmp_path / "anchors" / f"anchor_batch{b}.csv", index=False)
    folder = lambda name: str(tmp_path / name)                                          # noqa: E731
    out = run(spark, Inputs(
        prices=folder("prices"), interest={"anchored": folder("anchored")}, anchors=folder("anchors"), news_files=folder("news"),
        batches=spark.createDataFrame([(t, 1 + i % 2) for i, (t, _, _) in enumerate(members)], "ticker string, batch int"),
        landing=folder("landing"),
        betas=spark.createDataFrame([(t, .5 + i / 10) for i, (t, _, _) in enumerate(members)], "ticker string, beta double"),
        members=spark.createDataFrame(members, "ticker string, keyword string, sector string")),
        str(tmp_path / "out"), Settings(nested_folds=1, inner_folds=1, min_train=52, folds=2, trees=3, interest_mode="anchored",
                                        variants=("baseline",), scheme="decile", beta_neutral=True, sector_neutral=False, gross=1.0))
    read = {k: spark.read.parquet(v) for k, v in out.items() if k != "panel_manifest"}
    got = {(r.ticker, r.date): r.search_interest for r in read["interest"].collect()}
    assert all(abs(got[t, d] - raw[t][j] / (20 * (1 + i % 2))) < 1e-12 for i, (t, _, _) in enumerate(members)
               for j, d in enumerate(sundays.date))
    assert read["prices"].count() == 16 * len(days)
    assert ledger.land_prices(spark, folder("prices"), folder("landing") + "/prices", folder("landing") + "/ledger") == ledger.Landed(0, 0, 0)
    assert read["rescale_stats"].count() == 16 and read["rescale_summary"].count() == 110
    assert {r.ticker: r.errors for r in read["news_validation"].collect()} == {
        members[3][0]: ["negative volume value(s)"], members[4][0]: ["file is missing"]}
    assert read["news_daily"].select("ticker").distinct().count() == 14
    assert read["gain_importance"].count() == 9 and read["walk_forward_summary"].count() == 2
    book = read["weights"].groupBy("book", "week_ending_friday").agg({"weight": "sum"}).collect()
    assert {r.book for r in book} == {"pred_enet:baseline", "pred_gbt:baseline"} and all(abs(r[2]) < 1e-9 for r in book)
