"""Folds, Elastic Net from sufficient statistics, evaluation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import tails
from crosspanel.operators import boosting as B
from crosspanel.operators import evaluation as E
from crosspanel.operators import features as FE
from crosspanel.operators import folds as FO
from crosspanel.operators import linear as L
from helpers import KEY, average_rank_ic, same, to_spark


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    weeks = pd.date_range("2020-01-03", periods=80, freq="W-FRI").date
    pdf = pd.DataFrame([(w, f"T{i:02d}", f"S{i % 3}") for w in weeks for i in range(20)], columns=KEY + ["sector"])
    for c in FE.RANKS:
        pdf[c] = rng.random(len(pdf)).round(2)
    pdf["fwd_return"] = 0.02 * pdf[FE.RANKS[0]] - 0.03 * pdf[FE.RANKS[4]] + rng.normal(0, .02, len(pdf))
    pdf.loc[rng.random(len(pdf)) < .05, FE.RANKS[1]] = np.nan
    pdf.loc[rng.random(len(pdf)) < .05, "fwd_return"] = np.nan
    return pdf, to_spark(spark, pdf).cache()


def plain_folds(n, k, min_train, purge, embargo):
    size = max(1, (n - min_train) // k)
    for i in range(k):
        end = min_train + i * size
        lo, hi = end + embargo, min(end + embargo + size, n)
        if lo < n and end > purge and hi > lo:
            yield end - purge, lo, hi


@pytest.mark.parametrize("n,k,m,p,e", [(80, 5, 30, 1, 1), (80, 8, 104, 1, 1), (80, 3, 0, 0, 0), (80, 70, 2, 2, 3), (80, 4, 78, 1, 1)])
def test_folds(spark, rows, n, k, m, p, e):
    dates = FO.date_index(rows[1])
    got = [tuple(r)[1:] for r in FO.walk_forward(dates, k, m, p, e).orderBy("fold").collect()]
    assert got == list(plain_folds(n, k, m, p, e))
    parts = {role: {(r.fold, r.week_ending_friday) for r in FO.fold_dates(FO.walk_forward(dates, k, m, p, e), dates, role).collect()}
             for role in ("train", "test")}
    assert not parts["train"] & parts["test"]


def solve(X, y, alpha, ratio):
    mean, sd = X.mean(0), X.std(0)
    Z = (X - mean) / np.where(sd == 0, 1, sd)
    w = L.coordinate_descent(Z.T @ Z / len(Z), Z.T @ (y - y.mean()) / len(Z), alpha, ratio)
    return w, lambda T: y.mean() + ((T - mean) / np.where(sd == 0, 1, sd)) @ w


def test_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    Z = rng.normal(size=(300, 6))
    y = Z @ [1, 0, -2, 0, .1, 0] + rng.normal(size=300)
    for alpha, ratio in ((.1, .5), (.5, .9), (1e-6, .1), (10, 1.0)):
        w = L.coordinate_descent(Z.T @ Z / 300, Z.T @ y / 300, alpha, ratio)
        grad = Z.T @ (y - Z @ w) / 300 - alpha * (1 - ratio) * w
        for g, v in zip(grad, w):
            assert abs(g - alpha * ratio * np.sign(v)) < 1e-9 if v else abs(g) <= alpha * ratio + 1e-9


def clean(pdf):
    d = pdf.dropna(subset=["fwd_return"]).sort_values(KEY)
    return d.assign(**{c: d[c].fillna(.5) for c in FE.RANKS})


def test_walk_forward_equals_refits_from_rows(rows):
    pdf, df = rows
    preds, coefs = L.walk_forward_enet(df, 4, 30, 1, 1)
    got = preds.toPandas().set_index(KEY).pred_enet
    d = clean(pdf)
    weeks, seen = sorted(d.week_ending_friday.unique()), 0
    for train_n, lo, hi in plain_folds(80, 4, 30, 1, 1):
        tr, te = d[d.week_ending_friday.isin(weeks[:train_n])], d[d.week_ending_friday.isin(weeks[lo:hi])]
        _, f = solve(tr[FE.RANKS].to_numpy(), tr.fwd_return.to_numpy(), 1e-3, .5)
        same(f(te[FE.RANKS].to_numpy()), got.loc[pd.MultiIndex.from_frame(te[KEY])], 1e-8)
        seen += len(te)
    assert seen == len(got)
    table = L.coefficient_table(coefs)
    assert table.count() == 9 and table.where("feature = 'asvi'").first().category == "external/alt-data"


def test_nested_choice_equals_brute_force(rows):
    pdf, df = rows
    grid = [(0, 1e-7, .1), (1, 5e-3, .5), (2, 2e-2, .9)]
    preds, chosen = L.nested_enet(df, 3, 2, 40, 1, 1, grid)
    picked = {r.fold: r.config for r in chosen.collect()}
    d = clean(pdf)
    weeks = sorted(d.week_ending_friday.unique())

    def score(train, test, alpha, ratio):
        tr, te = d[d.week_ending_friday.isin(train)], d[d.week_ending_friday.isin(test)]
        if len(tr) < 200:
            return np.nan
        _, f = solve(tr[FE.RANKS].to_numpy(), tr.fwd_return.to_numpy(), alpha, ratio)
        te = te.assign(p=f(te[FE.RANKS].to_numpy()))
        return np.nanmean([average_rank_ic(g, "p") for _, g in te.groupby("week_ending_friday")])
    for fold, (train_n, lo, hi) in enumerate(plain_folds(80, 3, 40, 1, 1), 1):
        inner = list(plain_folds(train_n, 2, max(52, train_n // 2), 1, 1))
        means = [np.nanmean([score(weeks[:t], weeks[a:b], al, ra) for t, a, b in inner] or [np.nan]) for _, al, ra in grid]
        want = 0 if np.isnan(means).all() else int(np.nanargmax(means))
        assert picked[fold] == want
    summary = L.nested_summary(chosen, 2, len(grid)).first()
    assert summary.total_fits == len(picked) * (3 + 4) * 2 and summary.nonzero_coefficients <= 9
    assert preds.count() > 0


def test_default_trial_count(spark):
    six = spark.createDataFrame([(i, [0.0] * 9) for i in range(6)], "fold int, coef array<double>")
    row = L.nested_summary(six).first()
    assert row.total_fits == 342 and row.nonzero_coefficients == 0 and row.external_retained == 0


def test_boosting_queries_take_the_defaults(monkeypatch):
    """The registered queries cut neither folds nor trees nor the grid."""
    from crosspanel.plans import catalogue, model_queries
    asked = []
    monkeypatch.setattr(model_queries.T, "ranked_features", lambda *_: "rows")
    for f in ("walk_forward_gbt", "nested_gbt"):
        monkeypatch.setattr(model_queries.B, f, lambda *a, f=f, **k: (asked.append((f, a, k)), None))
    monkeypatch.setattr(model_queries.B, "importance_table", lambda x: x)
    monkeypatch.setattr(model_queries, "rounded", lambda x: x)
    for name in ("m04_gbt_walk_forward", "m08_gbt_importance", "m05_nested_gbt"):
        catalogue.QUERIES[name](None, "")
    assert asked == [(f, ("rows",), {}) for f in ("walk_forward_gbt", "walk_forward_gbt", "nested_gbt")]


def plain_boosting(bins, y, keys, fit, trees):
    """Nodes (feature, cut, gain) and predictions of a booster that tries every split row by row, sums in whole numbers."""
    unit, out, predicted = B.unit_of(np.abs(y).max()), [], np.full(len(y), fit.base)
    for t in range(trees):
        seen, columns = B.drawn_rows(keys, t), B.drawn_columns(bins.shape[1], t)
        grads = np.rint((y - predicted) / unit)
        leaves, level, step, tree = 1, [(np.flatnonzero(seen), np.arange(len(y)))], np.zeros(len(y)), []
        for _ in range(fit.depth):
            options = []
            for place, (mine, _) in enumerate(level):
                score = lambda rows: (grads[rows].sum() * unit) ** 2 / (len(rows) + 1.0)      # noqa: E731
                best = (0.0, 0, 0)
                for c in columns:
                    for cut in range(B.BINS):
                        low, high = mine[bins[mine, c] <= cut], mine[bins[mine, c] > cut]
                        if min(len(low), len(high)) >= fit.min_rows:
                            gain = score(low) + score(high) - score(mine)
                            if gain > best[0] + 1e-18:
                                best = (gain, c, cut)
                options.append((-best[0], place, best))
            level_, level = level, []
            for _, place, (gain, c, cut) in sorted(options):
                if gain > 0 and leaves < fit.leaves:
                    leaves += 1
                    mine, all_ = level_[place]
                    tree.append((t, int(c), cut, gain))
                    for part in (lambda r: r[bins[r, c] <= cut], lambda r: r[bins[r, c] > cut]):
                        inside, every = part(mine), part(all_)
                        step[every] = fit.rate * grads[inside].sum() * unit / (len(inside) + 1.0)
                        level.append((inside, every))
            if leaves == fit.leaves:
                break
        predicted = predicted + step
        out += tree
    return out, predicted


def test_a_tree_is_what_trying_every_split_gives():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 30, (260, 4)).astype(np.uint8)
    y = np.where(bins[:, 1] > 11, .02, -.01) + .001 * bins[:, 3] + rng.normal(0, .01, 260)
    keys = rng.integers(-2**62, 2**62, 260)
    for fit in (B.Fit(0, 1, 7, .1, 20, .003), B.Fit(0, 1, 5, .3, 10, 0.0)):
        made = B.grow(bins, y, keys, fit, 4, B.unit_of(np.abs(y).max()))
        want, predicted = plain_boosting(bins, y, keys, fit, 4)
        got = [(t, f, c, g) for t, tree in enumerate(made) for f, c, g in zip(tree.feature, tree.cut, tree.gain) if f >= 0]
        assert sorted(g[:3] for g in got) == sorted(w[:3] for w in want) and len(got) >= 12
        same(sorted(g[3] for g in got), sorted(w[3] for w in want))
        total = np.full(260, fit.base)
        for tree in made:
            total += np.array(tree.value)[tree.place(bins)]
            assert tree.leaves <= fit.leaves
        same(predicted, total)


def test_drawn_rows_and_columns():
    keys = np.arange(20_000) * 7_919
    shares = [B.drawn_rows(keys, t).mean() for t in range(5)]
    assert all(abs(s - .8) < .02 for s in shares) and len({tuple(B.drawn_columns(9, t)) for t in range(20)}) > 5
    assert all(len(B.drawn_columns(9, t)) == 7 for t in range(20)) and B.drawn_columns(1, 3).tolist() == [0]


def table_of(nodes):
    return sorted(map(tuple, nodes.select("model", "tree", "node", "feature", "cut", "child", "value", "gain").collect()))


def test_boosting(rows):
    """Fits in tasks and in lockstep are the same trees, however rows are dealt."""
    _, df = rows
    preds, nodes = B.walk_forward_gbt(df, 2, 40, trees=12)
    assert preds.where("pred_gbt is null").count() == 0 and preds.select("fold").distinct().count() == 2
    other, others = B.walk_forward_gbt(df.repartition(7), 2, 40, trees=12, rows_per_task=0)
    assert table_of(nodes) == table_of(others)
    key = lambda p: sorted(map(tuple, p.select("week_ending_friday", "ticker", "fold", "pred_gbt").collect()))
    assert key(preds) == key(other)
    table = {r.feature: r.gain_pct for r in B.importance_table(nodes).collect()}
    assert abs(sum(table.values()) - 100) < 1e-9 and max(table, key=table.get) in ("mom_52_4", "asvi") and len(table) == 9
    gains = nodes.where("feature >= 0").toPandas().groupby("feature")["gain"].sum()
    assert all(abs(table[FE.FEATURES[f]] - 100 * g / gains.sum()) < 1e-9 for f, g in gains.items())


def test_nested_boosting_picks_what_single_fits_pick(rows):
    pdf, df = rows
    grid = [(3, .2, 20), (7, .2, 60), (4, .05, 150)]
    preds, chosen = B.nested_gbt(df, 2, 2, 40, trees=4, grid=grid)
    lockstep, again = B.nested_gbt(df, 2, 2, 40, trees=4, grid=grid, rows_per_task=0)
    assert chosen == again and sorted(map(tuple, preds.collect())) == sorted(map(tuple, lockstep.collect()))
    pdf = pdf.dropna(subset=["fwd_return"]).sort_values(["week_ending_friday", "ticker"])
    weeks = sorted(pdf.week_ending_friday.unique())
    keys = {(r.week_ending_friday, r.ticker): r.k for r in df.select(
        "week_ending_friday", "ticker", F.xxhash64("week_ending_friday", "ticker").alias("k")).collect()}
    bins = np.clip(np.ceil(pdf[FE.RANKS].fillna(.5).to_numpy() * B.BINS) - 1, 0, B.BINS - 1).astype(np.uint8)
    y, day = pdf.fwd_return.to_numpy(), pdf.week_ending_friday.map({w: i for i, w in enumerate(weeks)}).to_numpy()
    key = np.array([keys[k] for k in zip(pdf.week_ending_friday, pdf.ticker)])

    def score(n, lo, hi, config):
        tr, te = day < n, (day >= lo) & (day < hi)
        last = max(t for t, _, _ in plain_folds(len(weeks), 2, 40, 1, 1))
        fit = B.Fit(0, n, *config, round(float(y[tr].mean()), 12))
        unit = B.unit_of(np.abs(y[day < max(i[0] for o in plain_folds(len(weeks), 2, 40, 1, 1)
                                            for i in plain_folds(o[0], 2, max(52, o[0] // 2), 1, 1))]).max())
        assert last
        p = np.full(te.sum(), fit.base)
        for tree in B.grow(bins[tr], y[tr], key[tr], fit, 4, unit):
            p += np.array(tree.value)[tree.place(bins[te])]
        return np.nanmean([average_rank_ic(g, "p") for _, g in pdf[te].assign(p=p).groupby("week_ending_friday")])
    for fold, (train_n, _, _) in enumerate(plain_folds(len(weeks), 2, 40, 1, 1), 1):
        inner = [i for i in plain_folds(train_n, 2, max(52, train_n // 2), 1, 1) if (day < i[0]).sum() >= 200]
        means = [np.mean([score(*i, c) for i in inner]) for c in grid] if inner else [0.0]
        assert tuple(dict((f, c) for f, *c in chosen)[fold]) == grid[int(np.argmax(np.round(means, 12)))]


def test_rank_ic_and_hit_rate(rows):
    pdf, df = rows
    want = {w: average_rank_ic(g, FE.RANKS[0]) for w, g in
            pdf.dropna(subset=[FE.RANKS[0], "fwd_return"]).groupby("week_ending_friday")}
    got = {r.week_ending_friday: r.ic for r in E.rank_ic(df, FE.RANKS[0]).collect()}
    assert got.keys() == want.keys()
    same([want[w] for w in want], [got[w] for w in want])
    assert E.rank_ic(df.withColumn("k", F.lit(1.0)), "k").count() == 0
    assert E.rank_ic(df.where("ticker < 'T04'"), FE.RANKS[0]).count() == 0
    card = E.summarise(df, FE.RANKS[0], "x").first()
    ic = pd.Series(want)
    assert abs(card.ic_t_stat - ic.mean() / ic.std() * np.sqrt(len(ic))) < 1e-9 and 0 < card.hit_rate_pct < 100


def test_sector_ic(rows):
    _, df = rows
    out = E.sector_ic_tested(df, FE.RANKS[4]).collect()
    assert len(out) == 3 and all(r.n_weeks >= 20 and r.survives_bh for r in out)
    assert all(abs(r.p_value - tails.student_two_sided(r.t_stat, r.n_weeks - 1)) < 1e-12 for r in out)


@pytest.mark.parametrize("ps", [[.001, .02, .03, .04, .9], [.5, .6], [.05, .05, .05], [.011, .5, .02, .02, .1], [.04, .9]])
def test_step_up_rule(spark, ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    last = max([i for i, j in enumerate(order, 1) if ps[j] <= i / len(ps) * .1] or [0])
    want = {j: i <= last for i, j in enumerate(order, 1)}
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "k int, p_value double")
    assert {r.k: r.rejected for r in E.benjamini_hochberg(df).collect()} == want


def test_tails():
    assert abs(tails.student_two_sided(2.0, 10) - 0.07338803) < 1e-8
    assert abs(tails.student_two_sided(0.0, 5) - 1) < 1e-12
    assert abs(tails.student_two_sided(-12.706204736, 1) - 0.05) < 1e-9
    assert abs(tails.chi2_survival(3.841458821, 1) - 0.05) < 1e-9
    assert abs(tails.chi2_survival(9.487729037, 4) - 0.05) < 1e-9
    assert abs(tails.chi2_survival(15.50731306, 8) - 0.05) < 1e-9
    assert tails.expected_max_sharpe(1, 1.0) == 0.0 and 2.9 < tails.expected_max_sharpe(342, 1.0) < 3.1
    assert math.isclose(tails.expected_max_sharpe(10, 4.0), 2 * tails.expected_max_sharpe(10, 1.0))


def test_welch_and_coupling(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=12), rng.normal(.5, 2, 30)
    df = spark.createDataFrame([(float(v), True) for v in x] + [(float(v), False) for v in y], "v double, f boolean")
    row = E.welch_p(E.welch(df, "v", F.col("f"))).first()
    a, b = x.var(ddof=1) / 12, y.var(ddof=1) / 30
    assert abs(row.t_stat - (x.mean() - y.mean()) / np.sqrt(a + b)) < 1e-12
    assert abs(row.dof - (a + b) ** 2 / (a * a / 11 + b * b / 29)) < 1e-9 and 0 < row.p_value < 1
    weeks = pd.date_range("2020-01-03", periods=70, freq="W-FRI").date
    s, v = rng.integers(1, 50, 70).astype(float), rng.random(70) * 100 + 1
    s[5] = 0.0
    panel = spark.createDataFrame([("A", w, float(z)) for w, z in zip(weeks, s)] + [("B", weeks[0], 1.0)],
                                  "ticker string, week_ending_friday date, trends_interest double")
    dv = spark.createDataFrame([("A", w, float(z)) for w, z in zip(weeks, v)] + [("B", weeks[0], 1.0)],
                               "ticker string, week_ending_friday date, dollar_volume double")
    got = E.coupling(panel, dv).collect()
    keep = s > 0
    want = np.corrcoef(np.diff(np.log(s[keep])), np.diff(np.log(v[keep])))[0, 1]
    assert len(got) == 1 and got[0].n_obs == 68 and abs(got[0].corr_svi_volume - want) < 1e-12


def test_rank_correlations_of_columns():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 6, (40, 5)).astype(float), rng.integers(0, 9, 40).astype(float)
    x[:, 3] = 2.0
    want = [pd.Series(x[:, c]).rank().corr(pd.Series(y).rank()) for c in range(5)]
    got = L.rank_correlations(x, y)
    assert np.isnan(got[3]) and np.isnan(want[3])
    same(np.delete(want, 3), np.delete(got, 3))
    assert np.isnan(L.rank_correlations(x, np.ones(40))).all()


def test_scores_by_date_equal_scores_spread(rows, monkeypatch):
    """Dates scored in a task and rankings spread over tasks pick the same configs and score alike."""
    _, df = rows
    grid = L.ENET_GRID[::4]
    a, one = L.nested_enet(df, 3, 2, 40, grid=grid)
    monkeypatch.setattr(L, "fits", lambda *_, **__: False)
    b, other = L.nested_enet(df, 3, 2, 40, grid=grid)
    assert [tuple(r) for r in one.orderBy("fold").select("fold", "config").collect()] == [
        tuple(r) for r in other.orderBy("fold").select("fold", "config").collect()]
    assert a.count() == b.count()
