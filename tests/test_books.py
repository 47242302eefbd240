"""Weights, trades, costs, turnover policies and diagnostics against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import breadth as BR
from crosspanel.operators import diagnostics as D
from crosspanel.operators import portfolio as PF
from crosspanel.operators import variants as V
from helpers import KEY, merged, same, to_spark, weekly_panel

DATE = "week_ending_friday"


@pytest.fixture(scope="module")
def preds(spark):
    pdf = weekly_panel(30, 14, seed=11, gaps=.15)
    rng = np.random.default_rng(4)
    pdf["pred"] = rng.integers(0, 40, len(pdf)).astype(float)
    pdf.loc[rng.random(len(pdf)) < .1, "pred"] = np.nan
    pdf["fwd_return"] = rng.normal(0, .03, len(pdf))
    pdf["beta"] = np.where(rng.random(len(pdf)) < .3, np.nan, rng.random(len(pdf)) + .5)
    weeks = sorted(pdf[DATE].unique())
    pdf = pdf[~((pdf[DATE] == weeks[6]) & (pdf.ticker > "T08"))]          # a date with too few names
    return pdf.reset_index(drop=True), to_spark(spark, pdf).cache()


def target(g, scheme, sector_neutral, beta_neutral, cap=.05, gross=2.0, n_groups=5):
    r = g.pred.rank(pct=True)
    if scheme == "rank":
        w = r - r.mean()
        w = w / w.abs().sum() * 2
    else:
        hi, lo = r > 1 - 1 / n_groups, r < 1 / n_groups
        w = hi / max(hi.sum(), 1) - lo / max(lo.sum(), 1)
    if sector_neutral:
        w = w - w.groupby(g.sector).transform("mean")
    if beta_neutral and g.beta.notna().any():
        b = g.beta.fillna(1.0)
        w = w - b * (w * b).sum() / (b * b).sum()
    w = (w - w.mean()).clip(-cap, cap)
    w = w - w.mean()
    return w / w.abs().sum() * gross


def book(pdf, variant="baseline", **kw):
    kw = {"scheme": "rank", "sector_neutral": True, "beta_neutral": False, **kw}
    held, out = None, []
    for _, g in pdf.dropna(subset=["pred"]).groupby(DATE):
        if len(g) < 10:
            continue
        w = target(g, **kw)
        w.index = g.ticker
        if held is not None and variant != "baseline":
            old = held.reindex(w.index).fillna(0.0)
            w = .4 * w + .6 * old if variant == "weight_blend" else old.where((w - old).abs() <= .004, w)
            w = w - w.mean()
            w = w / w.abs().sum() * 2.0
        held = w
        out.append(g[KEY + ["fwd_return"]].assign(weight=w.to_numpy()))
    return pd.concat(out)


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 0])
@pytest.mark.parametrize("kw", [{}, {"scheme": "decile"}, {"sector_neutral": False}, {"beta_neutral": True},
                                {"sector_neutral": False, "beta_neutral": True, "scheme": "decile"}])
def test_weights(preds, kw, rows_per_task):
    pdf, df = preds
    out = PF.build_weights(df, "pred", rows_per_task=rows_per_task, **kw)
    m = merged(out.select(*KEY, "weight"), book(pdf, **kw).drop(columns="fwd_return"))
    same(m.weight_want, m.weight)
    sums = out.groupBy(DATE).agg(F.abs(F.sum("weight")).alias("net"), F.sum(F.abs("weight")).alias("gross")).collect()
    assert all(r.net < 1e-9 and abs(r.gross - 2) < 1e-9 for r in sums) and len(sums) == 13


def plain_policy(targets, policy, blend=.4, band=.004, gross=2.0):
    """Held weights of one book by the recursion itself."""
    held, out = None, []
    for _, g in targets.groupby(DATE, sort=True):
        w = pd.Series(g.weight.to_numpy(), index=g.ticker.to_numpy())
        if held is not None:
            old = held.reindex(w.index).fillna(0.0)
            w = blend * w + (1 - blend) * old if policy == "weight_blend" else old.where((w - old).abs() <= band, w)
            w = w - w.mean()
            w = w / w.abs().sum() * gross if w.abs().sum() > 0 else w
        held = w
        out.append(g.assign(weight=w.to_numpy()))
    return pd.concat(out)


def wandering_targets(spark, n_names, n_dates, seed, absent=.05, move=.3):
    """Books of zero-sum targets that wander, so that a band holds some names and lets others go."""
    rng = np.random.default_rng(seed)
    weeks = pd.date_range("2020-01-03", periods=n_dates, freq="W-FRI").date
    level, rows = rng.normal(size=n_names), []
    for w in weeks:
        level = level + move * rng.normal(size=n_names)
        there = rng.random(n_names) > absent
        x = np.where(there, level, np.nan)
        x = x - np.nanmean(x)
        x = x / np.nansum(np.abs(x)) * 2
        rows += [(w, f"T{i:03}", v) for i, v in enumerate(x) if there[i]]
    pdf = pd.DataFrame(rows, columns=[DATE, "ticker", "weight"]).assign(fwd_return=0.0, book="b")
    return pdf, to_spark(spark, pdf)


@pytest.mark.parametrize("variant", ["weight_blend", "no_trade_band"])
@pytest.mark.parametrize("cells", [V.CELLS_PER_TASK, 0])
def test_policies(preds, variant, cells):
    pdf, df = preds
    base = PF.build_weights(df, "pred").withColumn("policy", F.lit(variant)).repartition(3)
    m = merged(V.apply_policy(base, cells_per_task=cells).select(*KEY, "weight"), book(pdf, variant).drop(columns="fwd_return"))
    same(m.weight_want, m.weight)


@pytest.mark.parametrize("policy, blend, band", [("weight_blend", .4, 0), ("weight_blend", .05, 0), ("weight_blend", 1.0, 0),
                                                 ("no_trade_band", 0, .004), ("no_trade_band", 0, .02), ("no_trade_band", 0, 9.0)])
@pytest.mark.parametrize("span, cells", [(256, 0), (14, 0), (256, V.CELLS_PER_TASK)])
def test_policies_equal_the_recursion(spark, monkeypatch, policy, blend, band, span, cells):
    """In rounds, in rounds over a few dates each, and where a task holds the whole book."""
    monkeypatch.setattr(V, "SPAN", span)
    monkeypatch.setattr(V, "BAND_SPAN", span)
    pdf, df = wandering_targets(spark, 60, 45, seed=11)
    rounds = []
    monkeypatch.setattr(V, "stage", lambda table, label, stage=V.stage: stage(
        table.repartition(3, "ticker") if label == "policy-series" else table, label))
    out = V.apply_policy(df.withColumn("policy", F.lit(policy)), blend, band, rounds=rounds, cells_per_task=cells)
    want = plain_policy(pdf, policy, blend, band)
    m = merged(out.select(*KEY, "weight"), want[KEY + ["weight"]])
    assert (m.weight_want - m.weight).abs().max() < 1e-12 and len(m) == len(pdf)
    assert rounds[0] <= 2 * 45 and (cells == 0 or rounds[0] == 1)
    if policy == "weight_blend" and span == 256:
        assert rounds[0] <= 12
    if band == .004:                       # the rule does both
        before = want.pivot(index=DATE, columns="ticker", values="weight").shift().fillna(0.0)
        target = pdf.pivot(index=DATE, columns="ticker", values="weight")
        moved = ((target - before).abs() > band)[1:]
        assert .1 < moved.mean().mean() < .98


def test_policies_of_flat_targets(spark):
    """Dates whose mixed weights are all alike are left unscaled; names may vanish and return; one date is its target."""
    weeks = pd.date_range("2021-01-01", periods=5, freq="W-FRI").date
    rows = [(w, t, v) for w, vs in zip(weeks, [(.5, -.5), (-.5, .5), (.25, -.25), (0., 0.), (.125, -.125)]) for t, v in zip("AB", vs)]
    rows = [r for r in rows if r[:2] != (weeks[2], "A")]
    pdf = pd.DataFrame(rows, columns=[DATE, "ticker", "weight"]).assign(fwd_return=0.0, book="b")
    for policy in V.POLICIES:
        out = V.apply_policy(to_spark(spark, pdf).withColumn("policy", F.lit(policy)), blend=.5)
        m = merged(out.select(*KEY, "weight"), plain_policy(pdf, policy, .5)[KEY + ["weight"]])
        same(m.weight_want, m.weight)
    one = V.apply_policy(to_spark(spark, pdf[pdf[DATE] == weeks[0]]).withColumn("policy", F.lit("weight_blend"))).collect()
    assert sorted(r.weight for r in one) == [-.5, .5]
    assert V.apply_policy(to_spark(spark, pdf).where("1 = 0").withColumn("policy", F.lit("weight_blend"))).count() == 0


def test_books_on_different_dates(preds):
    """Books whose dates differ hold over the gap, each by its own calendar."""
    _, df = preds
    base = PF.build_weights(df, "pred").withColumn("policy", F.lit("weight_blend"))
    weeks = [r[0] for r in base.select(DATE).distinct().orderBy(DATE).collect()]
    other = base.where(~F.col(DATE).isin(weeks[0], weeks[4], weeks[5])).withColumn("book", F.lit("late"))
    got = V.apply_policy(base.unionByName(other)).toPandas()
    for name, part in (("late", other), (base.first().book, base)):
        want = plain_policy(part.toPandas(), "weight_blend").sort_values(KEY)
        mine = got[got.book == name].sort_values(KEY)
        same(want.weight, mine.weight)


def test_sweep_over_a_grid(preds):
    _, df = preds
    both = df.withColumn("pred2", -F.col("pred"))
    out = V.sweep(both, ["pred", "pred2"], ("weight_blend", "no_trade_band"), blend=[.2, .8], band=[.001, .004]).toPandas()
    assert set(out.book) == {f"{p}:{v}" for p in ("pred", "pred2") for v in (
        "weight_blend:0.2", "weight_blend:0.8", "no_trade_band:0.001", "no_trade_band:0.004")}
    for p in ("pred", "pred2"):
        base = PF.build_weights(both, p).toPandas()
        for name, policy, value in (("weight_blend:0.8", "weight_blend", .8), ("no_trade_band:0.001", "no_trade_band", .001)):
            want = plain_policy(base, policy, value, value).sort_values(KEY)
            same(want.weight, out[out.book == f"{p}:{name}"].sort_values(KEY).weight)


def test_sweep(preds, spark):
    pdf, df = preds
    both = df.withColumn("pred2", -F.col("pred"))
    out = V.sweep(both, ["pred", "pred2"])
    assert {r.book for r in out.select("book").distinct().collect()} == {
        f"{p}:{v}" for p in ("pred", "pred2") for v in V.VARIANTS}
    mine = out.where("book = 'pred:weight_blend'").select(*KEY, "weight")
    m = merged(mine, book(pdf, "weight_blend").drop(columns="fwd_return"))
    same(m.weight_want, m.weight)
    smooth = pdf.sort_values(KEY).copy()
    smooth["pred"] = smooth.groupby("ticker").pred.transform(lambda s: s.rolling(4, min_periods=1).mean()).round(9)
    got = V.build_variant(df.withColumn("pred", F.col("pred")), "pred", "signal_smooth").select(*KEY, "weight")
    assert len(book(smooth)) == got.count()
    for call in (lambda: V.build_variant(df, "pred", "magic"), lambda: V.sweep(df, ["pred"], ("magic",))):
        with pytest.raises(ValueError):
            call()


def test_trades_costs_and_performance(preds, spark):
    pdf, df = preds
    weights = PF.build_weights(df, "pred").cache()
    mine = book(pdf)
    wide = mine.pivot(index=DATE, columns="ticker", values="weight").fillna(0.0)
    dw = wide.diff()
    dw.iloc[0] = wide.iloc[0]
    got = PF.trades(weights).toPandas().pivot(index=DATE, columns="ticker", values="dw").fillna(0.0)
    same(dw[got.columns], got)
    adv = pd.Series({t: 1e6 * (i + 1) for i, t in enumerate(wide.columns[:-2])})
    vol = pd.Series({t: .2 + .01 * i for i, t in enumerate(wide.columns[1:])})
    share = dw.abs() * 10e6 / adv.reindex(wide.columns).fillna(adv.median())
    cost = (dw.abs() * 5e-4 + dw.abs() * .5 * vol.reindex(wide.columns).fillna(vol.median()) * np.sqrt(share)).sum(axis=1)
    c = PF.costs(PF.trades(weights), spark.createDataFrame(list(adv.items()), "ticker string, adv double"),
                 spark.createDataFrame(list(vol.items()), "ticker string, vol double"))
    costs = c.orderBy(DATE).toPandas()
    same(cost, costs.cost)
    same(dw.abs().sum(axis=1) / 2, costs.turnover)
    ret = wide.mul(mine.pivot(index=DATE, columns="ticker", values="fwd_return").fillna(0.0)).sum(axis=1)
    net = ret - cost
    p = PF.performance(PF.returns(weights, c)).first()
    eq = (1 + net).cumprod()
    assert abs(p.net_sharpe - net.mean() * 52 / (net.std() * np.sqrt(52))) < 1e-9
    assert abs(p.net_max_drawdown_pct - 100 * (eq / eq.cummax() - 1).min()) < 1e-9
    assert abs(p.net_sortino - net.mean() * 52 / (net[net < 0].std() * np.sqrt(52))) < 1e-9
    assert p.weeks == len(net) and abs(p.mean_weekly_cost_bps - 1e4 * cost.mean()) < 1e-9
    r = D.deflated_sharpe(PF.returns(weights, c)).first()
    assert 0 <= r.probability <= 1 and r.error is None and r.passes_at_95pct == (r.probability > .95)
    few = PF.returns(weights, c).limit(5)
    assert D.deflated_sharpe(few).first().error == "too few observations"


def test_residual_report(preds):
    pdf, df = preds
    d = pdf.dropna(subset=["pred"])
    e = (d.fwd_return - d.pred).groupby(d[DATE]).mean().sort_index().to_numpy()
    r = D.residual_report(df, "pred").first()
    u, n = e - e.mean(), len(e)
    rho = [(u[k:] * u[:-k]).sum() / (u * u).sum() for k in range(1, 9)]
    assert abs(r.durbin_watson - (np.diff(e) ** 2).sum() / (e ** 2).sum()) < 1e-9
    assert abs(r.ljung_box_4_stat - n * (n + 2) * sum(p * p / (n - k) for k, p in enumerate(rho[:4], 1))) < 1e-9
    assert abs(r.acf_lag1 - np.corrcoef(e[1:], e[:-1])[0, 1]) < 1e-9
    res2 = (d.fwd_return - d.pred) ** 2
    assert abs(r.breusch_pagan - len(d) * np.corrcoef(res2, d.pred)[0, 1] ** 2) < 1e-6
    assert r.reading in ("positive", "negative", "none")


def reference_correlations(pdf):
    wide = pdf.pivot(index=DATE, columns="ticker", values="weekly_return").dropna(axis=1, how="all")
    corr = wide.corr().fillna(0.0)
    there = wide.notna().astype(int)
    return corr, there.T @ there


@pytest.mark.parametrize("gaps", [0.0, .2, .8])
@pytest.mark.parametrize("block, eigen_names", [(64, 4096), (5, 4096), (6, 0), (4, 0)])
def test_breadth(spark, gaps, block, eigen_names):
    """All three ways to the eigenvalues, within one block and over several."""
    pdf = weekly_panel(17, 30 if gaps < .5 else 60, seed=2, gaps=gaps)
    if gaps == 0.0:
        pdf = pdf[pdf.ticker != "T03"].assign(weekly_return=lambda d: np.where(d.ticker == "T05", .01, d.weekly_return))
    corr, shared = reference_correlations(pdf)
    eig = np.linalg.eigvalsh(corr.to_numpy())
    assert (eig.min() < -.05) == (gaps > .5) or gaps == .2
    eig = eig[eig > 0]
    df = to_spark(spark, pdf)
    r = BR.effective_breadth(df, block=block, eigen_names=eigen_names).first()
    n = len(corr)
    assert abs(r.mean_correlation - corr.to_numpy()[~np.eye(n, dtype=bool)].mean()) < 1e-9
    assert abs(r.effective_bets - eig.sum() ** 2 / (eig ** 2).sum()) < 1e-7
    own = np.diag(shared)
    unequal = (shared.to_numpy() != own[:, None]) | (shared.to_numpy() != own[None, :])
    assert r.n_pairs == n * (n - 1) // 2 and r.n_incomplete == unequal.sum() // 2 and (r.n_incomplete == 0) == (gaps == 0.0)
    if eigen_names:
        pairs = BR.pairwise_correlations(df, block=block).collect()
        assert len(pairs) == r.n_pairs and all(p.ticker_a < p.ticker_b for p in pairs)
        assert all(p.n_shared == shared.loc[p.ticker_a, p.ticker_b] for p in pairs)
        assert all(abs(p.correlation - corr.loc[p.ticker_a, p.ticker_b]) < 1e-9 for p in pairs)


def test_breadth_of_little(spark):
    one = BR.effective_breadth(to_spark(spark, weekly_panel(1, 9, seed=3))).first()
    assert one.n_names == 1 and one.n_pairs == 0 and one.mean_correlation is None and abs(one.effective_bets - 1) < 1e-12
    none = BR.effective_breadth(to_spark(spark, weekly_panel(2, 3, seed=3)).where("1 = 0")).first()
    assert none.n_names == 0 and none.effective_bets is None


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_tournament_meets_every_pair(n):
    met = [pair for round_ in BR.tournament(n) for pair in round_ if max(pair) < n]
    assert sorted(met) == [(a, b) for a in range(n) for b in range(a + 1, n)]
