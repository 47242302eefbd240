"""Queries over portfolios and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.tails import expected_max_sharpe
from crosspanel.operators import breadth as BR
from crosspanel.operators import diagnostics as D
from crosspanel.operators import evaluation as E
from crosspanel.operators import portfolio as PF
from crosspanel.operators import variants as V
from crosspanel.operators.groups import fits
from crosspanel.plans import tables as T
from crosspanel.plans.registry import CTES, assembled, normal_sql, query, r, rounded, sql, sql_pct
from crosspanel.session import bounded_like, stage

KEY = ["week_ending_friday", "ticker"]


def base_weights(spark, sf) -> DataFrame:
    """Staged rank-weighted, sector-neutral book on the momentum signal."""
    return T.staged(spark, ("weights", sf), lambda: PF.build_weights(T.predictions(spark, sf), "pred_b"))


def base_returns(spark, sf) -> DataFrame:
    def build() -> DataFrame:
        weights = base_weights(spark, sf)
        cost = PF.costs(PF.trades(weights), PF.average_dollar_volume(T.prices_daily(spark, sf)),
                        PF.annual_volatility(T.predictions(spark, sf)))
        return PF.returns(weights, cost)
    return T.staged(spark, ("book-returns", sf), build)


def _ranked(spark, sf) -> tuple[DataFrame, bool]:
    """Ranked names of one book, and whether its dates fit a task."""
    preds = T.predictions(spark, sf)
    named = bounded_like(preds.withColumn("book", F.lit("b")), preds)
    small = fits(named, ["book", "week_ending_friday"])
    return PF.ranked_names(named, "pred_b", small), small


@query("p01_average_dollar_volume", sql(f"select ticker, {r('adv', digits=3)} from adv"))
def p01(spark, sf):
    return rounded(PF.average_dollar_volume(T.prices_daily(spark, sf)), 3)


@query("p02_annual_volatility", sql(f"select ticker, {r('vol')} from vol"))
def p02(spark, sf):
    return rounded(PF.annual_volatility(T.predictions(spark, sf)))


@query("p03_decile_weights", sql(f"""
    select week_ending_friday, ticker, {r('''case when r > 1 - 1 / 5.0::double then 1.0 / nl when r < 1 / 5.0::double then -1.0 / ns else 0 end''', 'w')}
    from (select *, count(*) filter (r > 1 - 1 / 5.0::double) over d as nl, count(*) filter (r < 1 / 5.0::double) over d as ns
          from ranked window d as (partition by week_ending_friday))"""))
def p03(spark, sf):
    ranked, small = _ranked(spark, sf)
    return rounded(PF.raw_weights(ranked, "decile", 5, small).select(*KEY, "w"))


@query("p04_rank_weights", sql(f"select week_ending_friday, ticker, {r('w0', 'w')} from w_rank"))
def p04(spark, sf):
    ranked, small = _ranked(spark, sf)
    return rounded(PF.raw_weights(ranked, "rank", 5, small).select(*KEY, "w"))


BETA_SQL = {
    "with_beta": "select *, case when weekly_return > 0 then 1 + weekly_return end as beta from w_sector",
    "with_tilt": """
    select *, w1 - coalesce(beta, 1) * sum(w1 * coalesce(beta, 1)) over d / sum(pow(coalesce(beta, 1), 2)) over d as wb
    from with_beta window d as (partition by week_ending_friday)""",
}


@query("p05_neutralise", sql(f"""
    select week_ending_friday, ticker, {r('wb - avg(wb) over (partition by week_ending_friday)', 'w')} from with_tilt""", **BETA_SQL))
def p05(spark, sf):
    ranked, small = _ranked(spark, sf)
    raw = PF.raw_weights(ranked, "rank", 5, small)
    beta = raw.withColumn("beta", F.when(F.col("weekly_return") > 0, 1 + F.col("weekly_return")))
    return rounded(PF.neutralise(beta, True, True, small).select(*KEY, "w"))


@query("p06_limits", sql(f"select week_ending_friday, ticker, {r('weight', 'w')} from weights"))
def p06(spark, sf):
    ranked, small = _ranked(spark, sf)
    neutral = PF.neutralise(PF.raw_weights(ranked, "rank", 5, small), True, False, small)
    return rounded(PF.apply_limits(neutral, 0.05, 2.0, small).select(*KEY, "w"))


@query("p07_book_weights", sql(f"select 'pred_b' as book, week_ending_friday, ticker, {r('fwd_return')}, {r('weight')} from weights"))
def p07(spark, sf):
    return rounded(PF.build_weights(T.predictions(spark, sf), "pred_b"))


@query("p08_weight_changes", sql(f"select 'pred_b' as book, week_ending_friday, ticker, {r('dw')} from moves"))
def p08(spark, sf):
    return rounded(PF.trades(base_weights(spark, sf)))


@query("p09_costs", sql(f"select 'pred_b' as book, week_ending_friday, {r('turnover')}, {r('cost')} from book_cost"))
def p09(spark, sf):
    return rounded(PF.costs(PF.trades(base_weights(spark, sf)), PF.average_dollar_volume(T.prices_daily(spark, sf)),
                            PF.annual_volatility(T.predictions(spark, sf))))


@query("p10_book_returns", sql(f"""
    select 'pred_b' as book, week_ending_friday, {r('gross_return')}, {r('net_return')}, {r('turnover')}, {r('cost')}
    from book_returns"""))
def p10(spark, sf):
    return rounded(base_returns(spark, sf))


CURVE_SQL = {"curve": """
    select *, product(1 + gross_return) over e as gross_equity, product(1 + net_return) over e as net_equity
    from book_returns window e as (order by week_ending_friday rows unbounded preceding)""",
    "drawn": """
    select *, gross_equity / max(gross_equity) over e - 1 as gross_drawdown,
           net_equity / max(net_equity) over e - 1 as net_drawdown
    from curve window e as (order by week_ending_friday rows unbounded preceding)"""}


def _side(s: str) -> str:
    ann, vol = f"avg({s}_return) * 52", f"(stddev_samp({s}_return) * sqrt(52.0))"
    low = f"(stddev_samp({s}_return) filter ({s}_return < 0) * sqrt(52.0))"
    return ", ".join([
        r(f"100 * {ann}", f"{s}_ann_return_pct", 5), r(f"100 * {vol}", f"{s}_ann_vol_pct", 5),
        r(f"{ann} / {vol}", f"{s}_sharpe", 5), r(f"100 * min({s}_drawdown)", f"{s}_max_drawdown_pct", 5),
        r(f"{ann} / {low}", f"{s}_sortino", 5), r(f"{ann} / abs(min({s}_drawdown))", f"{s}_calmar", 5)])


def _performance_of(book: str) -> str:
    return f"""
    select '{book}' as book, count(*) as weeks, {_side('gross')}, {_side('net')},
           {r('100 * avg(turnover)', 'mean_weekly_turnover_pct', 5)}, {r('52 * avg(turnover)', 'annual_turnover_x', 5)},
           {r('10000 * avg(cost)', 'mean_weekly_cost_bps', 5)},
           {r('100 * 52 * (avg(gross_return) - avg(net_return))', 'cost_drag_ann_pct', 5)}
    from drawn"""


@query("p11_performance", sql(_performance_of("pred_b"), **CURVE_SQL))
def p11(spark, sf):
    return rounded(PF.performance(base_returns(spark, sf)), 5)


@query("p12_equity_curve", sql(f"""
    select week_ending_friday, {r('gross_drawdown', digits=5)}, {r('net_drawdown', digits=5)}, {r('turnover')},
           {r('ln(gross_equity)', 'log_gross_equity', 5)}, {r('ln(abs(net_equity))', 'log_net_equity', 5)} from drawn""", **CURVE_SQL))
def p12(spark, sf):
    curve = PF.equity_curve(base_returns(spark, sf))
    return rounded(curve.select(
        "week_ending_friday", F.round("gross_drawdown", 5).alias("gross_drawdown"),
        F.round("net_drawdown", 5).alias("net_drawdown"), "turnover",
        F.round(F.log("gross_equity"), 5).alias("log_gross_equity"),
        F.round(F.log(F.abs("net_equity")), 5).alias("log_net_equity")))


@query("p13_smooth_signal", sql(f"""
    select week_ending_friday, ticker, {r('''avg(pred_a) over (partition by ticker order by week_ending_friday
           rows between 3 preceding and current row)''', 'pred_a')} from live"""))
def p13(spark, sf):
    return rounded(V.smooth_signal(T.predictions(spark, sf), "pred_a", 4).select(*KEY, "pred_a"))


def _held_sql(mix: str) -> dict[str, str]:
    """Holdings date by date: mix target and yesterday, demean, rescale."""
    return {
        "targets": "select d, w.week_ending_friday, ticker, fwd_return, weight from weights w "
                   "join book_dates b using (week_ending_friday)",
        "held": f"""
        select d, ticker, weight from targets where d = 1
        union all
        select d, ticker, c / sum(abs(c)) over () * 2.0
        from (select d, ticker, m - avg(m) over () as c
              from (select t.d, t.ticker, {mix} as m
                    from targets t left join held h on h.ticker = t.ticker
                    where t.d = (select max(d) + 1 from held)))"""}


def _held_out(book: str) -> str:
    return f"""
    select '{book}' as book, t.week_ending_friday, ticker, {r('t.fwd_return', 'fwd_return')}, {r('h.weight', 'weight')}
    from targets t join held h using (d, ticker)"""


BLEND_SQL = "0.4::double * t.weight + 0.6::double * coalesce(h.weight, 0)"
BAND_SQL = "case when abs(t.weight - coalesce(h.weight, 0)) > 0.004::double then t.weight else coalesce(h.weight, 0) end"


@query("p14_weight_blend", sql(_held_out("pred_b:weight_blend"), **_held_sql(BLEND_SQL)))
def p14(spark, sf):
    return rounded(V.build_variant(T.predictions(spark, sf), "pred_b", "weight_blend"))


@query("p15_no_trade_band", sql(_held_out("pred_b:no_trade_band"), **_held_sql(BAND_SQL)))
def p15(spark, sf):
    return rounded(V.build_variant(T.predictions(spark, sf), "pred_b", "no_trade_band"))


def swept_books(spark, sf) -> DataFrame:
    return V.sweep(T.predictions(spark, sf), ["pred_a", "pred_b"])


def _swept_sql(pred: str, variant: str) -> str:
    """One book's performance: its predictions, its policy, then the common tables on top of its weights."""
    tables = {k: v.replace("pred_b", pred) for k, v in CTES.items()}
    if variant == "signal_smooth":
        tables["names"] = f"""
            select * replace (s as {pred}), count(*) over (partition by week_ending_friday) as n_names
            from (select *, avg({pred}) over (partition by ticker order by week_ending_friday
                                              rows between 3 preceding and current row) as s from live)
            where s is not null"""
    mix = {"weight_blend": BLEND_SQL, "no_trade_band": BAND_SQL}.get(variant)
    ordered = {}
    for name, cte in tables.items():
        if name == "weights" and mix:
            ordered["base_weights"] = cte
            ordered["base_dates"] = tables["book_dates"].replace("weights", "base_weights")
            held = _held_sql(mix)
            ordered["targets"] = held["targets"].replace("weights", "base_weights").replace("book_dates", "base_dates")
            ordered["held"] = held["held"]
            cte = """select t.week_ending_friday, t.ticker, t.fwd_return, h.weight from targets t join held h using (d, ticker)"""
        ordered[name] = cte
    return assembled(_performance_of(f"{pred}:{variant}"), ordered | CURVE_SQL)


@query("p16_variant_sweep", " union all ".join(
    f"select * from ({_swept_sql(p, v)})" for p in ("pred_a", "pred_b") for v in V.VARIANTS))
def p16(spark, sf):
    books = stage(swept_books(spark, sf), "swept-books")
    cost = PF.costs(PF.trades(books), PF.average_dollar_volume(T.prices_daily(spark, sf)),
                    PF.annual_volatility(T.predictions(spark, sf)))
    return rounded(PF.performance(PF.returns(books, cost)), 5)


@query("p16_signal_smooth_book", sql(f"""
    select 'pred_b:signal_smooth' as book, week_ending_friday, ticker, {r('weight')} from smooth_weights""",
    smoothed="""select week_ending_friday, ticker, sector, fwd_return, avg(pred_b) over (partition by ticker
        order by week_ending_friday rows between 3 preceding and current row) as s from live""",
    smooth_ranked=f"""select *, {sql_pct('s')} as rk from (
        select *, count(*) over (partition by week_ending_friday) as n from smoothed where s is not null) where n >= 10""",
    smooth_clipped="""select *, greatest(-0.05, least(0.05, v - avg(v) over (partition by week_ending_friday))) as c
        from (select *, u - avg(u) over (partition by week_ending_friday, sector) as v
              from (select *, (rk - a) / sum(abs(rk - a)) over (partition by week_ending_friday) * 2 as u
                    from (select *, avg(rk) over (partition by week_ending_friday) as a from smooth_ranked)))""",
    smooth_weights="""select *, (c - m) / sum(abs(c - m)) over (partition by week_ending_friday) * 2 as weight
        from (select *, avg(c) over (partition by week_ending_friday) as m from smooth_clipped)"""))
def p16_smooth(spark, sf):
    out = V.build_variant(T.predictions(spark, sf), "pred_b", "signal_smooth")
    return rounded(out.select("book", *KEY, "weight"))


# --- diagnostics ----------------------------------------------------------------

def residuals(spark, sf) -> DataFrame:
    return D.residual_series(T.predictions(spark, sf), "pred_a")


@query("d01_residual_series", sql(f"select 'pred_a' as book, week_ending_friday, {r('e')} from residuals"))
def d01(spark, sf):
    return rounded(residuals(spark, sf))


@query("d02_durbin_watson", sql(f"""
    select 'pred_a' as book, {r('sum(pow(e - b, 2)) / sum(e * e)', 'durbin_watson')}
    from (select e, lag(e) over (order by week_ending_friday) as b from residuals)"""))
def d02(spark, sf):
    return rounded(D.durbin_watson(residuals(spark, sf)))


LAGS_SQL = {
    "centred_e": "select week_ending_friday, e - avg(e) over () as u from residuals",
    "lag_no": "select unnest(range(1, 9)) as k",
    "numbered_e": "select u, row_number() over (order by week_ending_friday) as i from centred_e",
    "rho": """select k, sum(a.u * b.u) / (select sum(u * u) from centred_e) as rho, (select count(*) from centred_e) as n
              from lag_no join numbered_e a on true join numbered_e b on b.i = a.i - k group by k""",
}


@query("d03_ljung_box", sql(f"""
    select 'pred_a' as book, cast(m.lag as integer) as lag, {r('any_value(n) * (any_value(n) + 2) * sum(rho * rho / (n - k))', 'stat')}
    from (values (1), (4), (8)) m(lag) join rho on k <= m.lag group by m.lag""", **LAGS_SQL))
def d03(spark, sf):
    return rounded(D.ljung_box(residuals(spark, sf)))


CHI_SQL = {
    1: f"2 * (1 - {normal_sql('sqrt(stat)')})", 4: "exp(-stat / 2) * (1 + stat / 2)",
    8: "exp(-stat / 2) * (1 + stat / 2 + pow(stat / 2, 2) / 2 + pow(stat / 2, 3) / 6)"}
LJUNG_SQL = {**LAGS_SQL, "ljung": f"""
    select lag, stat, case lag when 1 then {CHI_SQL[1]} when 4 then {CHI_SQL[4]} else {CHI_SQL[8]} end as p_value
    from (select m.lag, any_value(n) * (any_value(n) + 2) * sum(rho * rho / (n - k)) as stat
          from (values (1), (4), (8)) m(lag) join rho on k <= m.lag group by m.lag)"""}


@query("d03_ljung_box_p", sql(f"""
    select 'pred_a' as book, cast(lag as integer) as lag, {r('stat')}, {r('p_value')} from ljung""", **LJUNG_SQL))
def d03_p(spark, sf):
    return rounded(D.ljung_box_p(D.ljung_box(residuals(spark, sf))))


@query("d04_jarque_bera", sql(f"""
    select 'pred_a' as book, {r('jb', 'stat')}, {r('exp(-jb / 2)', 'p_value')}, {r('skew')}, {r('kurtosis')}
    from (select n / 6.0 * (skew * skew + pow(kurtosis - 3, 2) / 4) as jb, skew, kurtosis
          from (select n, m3 / pow(m2, 1.5) as skew, m4 / (m2 * m2) as kurtosis
                from (select count(*) as n, avg(u * u) as m2, avg(u * u * u) as m3, avg(u * u * u * u) as m4
                      from centred_e)))""", **LAGS_SQL))
def d04(spark, sf):
    return rounded(D.jarque_bera(residuals(spark, sf)))


@query("d05_breusch_pagan", sql(f"""
    select 'pred_a' as book, {r('count(*) * pow(corr(pow(fwd_return - pred_a, 2), pred_a), 2)', 'stat')} from ic_pairs"""))
def d05(spark, sf):
    return rounded(D.breusch_pagan(T.predictions(spark, sf), "pred_a"))


@query("d06_lag1_autocorrelation", sql(f"""
    select 'pred_a' as book, {r('corr(e, b)', 'acf_lag1')}
    from (select e, lag(e) over (order by week_ending_friday) as b from residuals)"""))
def d06(spark, sf):
    return rounded(D.lag1_autocorrelation(residuals(spark, sf)))


READING_SQL = {**LJUNG_SQL, "watson": """
    select sum(pow(e - b, 2)) / sum(e * e) as dw, corr(e, b) as acf
    from (select e, lag(e) over (order by week_ending_friday) as b from residuals)""",
    "said": """
    select case when dw < 1.7 and p_value < 0.05 then 'positive'
                when dw > 2.3 and p_value < 0.05 then 'negative' else 'none' end as reading
    from watson cross join ljung where lag = 1""",
    "shape_e": """
    select n, m3 / pow(m2, 1.5) as skew, m4 / (m2 * m2) as kurtosis
    from (select count(*) as n, avg(u * u) as m2, avg(u * u * u) as m3, avg(u * u * u * u) as m4 from centred_e)""",
    "pagan": "select count(*) * pow(corr(pow(fwd_return - pred_a, 2), pred_a), 2) as stat from ic_pairs"}
_JB = "n / 6.0 * (skew * skew + pow(kurtosis - 3, 2) / 4)"
_LB = ", ".join(f"(select {r(c, 'v')} from ljung where lag = {k}) as ljung_box_{k}_{c}" for k in (1, 4, 8) for c in ("stat", "p_value"))


@query("d07_residual_report", sql(f"""
    select 'pred_a' as book, {r('dw', 'durbin_watson')}, {r('acf', 'acf_lag1')}, {_LB}, {r(_JB, 'jarque_bera')},
           {r(f'exp(-{_JB} / 2)', 'jarque_bera_p')}, {r('skew')}, {r('kurtosis')}, {r('stat', 'breusch_pagan')},
           {r(CHI_SQL[1], 'breusch_pagan_p')}, reading
    from watson cross join shape_e cross join pagan cross join said""", **READING_SQL))
def d07(spark, sf):
    return rounded(D.residual_report(T.predictions(spark, sf), "pred_a"))


@query("d07_reading", sql("select 'pred_a' as book, reading from said", **READING_SQL))
def d07_reading(spark, sf):
    return D.residual_report(T.predictions(spark, sf), "pred_a").select("book", "reading")


SHARPE_SQL = {"ret_centred": "select gross_return as g, gross_return - avg(gross_return) over () as u from book_returns",
              "ret_moments": """
    select n, sr, m3 / pow(m2, 1.5) as skew, m4 / (m2 * m2) as kurtosis
    from (select count(*) as n, avg(g) / stddev_samp(g) as sr, avg(u * u) as m2, avg(u * u * u) as m3,
                 avg(u * u * u * u) as m4 from ret_centred)""",
              "ret_shape": "select *, 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr as shape from ret_moments"}


@query("d09_deflated_sharpe_z", sql(f"""
    select 'pred_b' as book, n, {r('sr', 'sharpe')}, {r('sr * sqrt(52.0)', 'sharpe_annualised')}, {r('skew')},
           {r('kurtosis')}, {r('shape / (n - 1)', 'sr_variance', 9)},
           {r('(sr - 0.1) * sqrt(n - 1) / sqrt(shape)', 'z')} from ret_shape""", **SHARPE_SQL))
def d09_z(spark, sf):
    stats = D.deflated_z(D.sharpe_moments(base_returns(spark, sf)), F.lit(0.1))
    out = stats.select("book", "n", "sharpe", "sharpe_annualised", "skew", "kurtosis", "sr_variance", "z")
    return rounded(out.withColumn("sr_variance", F.round("sr_variance", 9)), 9).select(
        "book", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("sharpe", "sharpe_annualised", "skew", "kurtosis", "z")],
        "sr_variance")


@query("d08_d09_deflated_sharpe", sql(f"""
    select book, n, {r('sharpe')}, {r('sharpe * sqrt(52.0)', 'sharpe_annualised')}, {r('skew')}, {r('kurtosis')},
           {r('v', 'sr_variance')}, cast(null as varchar) as error, {r('b', 'benchmark')}, {r('z')},
           {r(normal_sql('z'), 'probability')}, {normal_sql('z')} > 0.95 as passes_at_95pct
    from (select 'pred_b' as book, n, sr as sharpe, skew, kurtosis, shape / (n - 1) as v,
                 {expected_max_sharpe(342, 1.0)!r} * sqrt(greatest(shape / (n - 1), 1e-12)) as b,
                 (sr - {expected_max_sharpe(342, 1.0)!r} * sqrt(greatest(shape / (n - 1), 1e-12))) * sqrt(n - 1) / sqrt(shape) as z
          from ret_shape)""", **SHARPE_SQL))
def d09(spark, sf):
    return rounded(D.deflated_sharpe(base_returns(spark, sf)))


# Correlations over shared weeks by a self-join; eigenvalues by cyclic rotations of the matrix as one list.
ROTATION_SWEEPS = 8
PAIR_SQL = {
    "corr_seen": "select ticker, week_ending_friday as w, weekly_return as x from panel where weekly_return is not null",
    "corr_names": "select ticker, count(*) as weeks, max(x) > min(x) as varies, row_number() over (order by ticker) as i "
             "from corr_seen group by ticker",
    "shared": """select a.ticker as ticker_a, b.ticker as ticker_b, count(*) as n,
        case when max(a.x) > min(a.x) and max(b.x) > min(b.x) then corr(a.x, b.x) else 0 end as c
        from corr_seen a join corr_seen b on a.w = b.w and a.ticker < b.ticker group by 1, 2""",
    "pairs": """select a.ticker as ticker_a, b.ticker as ticker_b, a.i as i, b.i as j, coalesce(s.n, 0) as n_shared,
        coalesce(s.c, 0) as correlation, coalesce(s.n, 0) < greatest(a.weeks, b.weeks) as incomplete
        from corr_names a join corr_names b on a.ticker < b.ticker
        left join shared s on s.ticker_a = a.ticker and s.ticker_b = b.ticker""",
    "breadth": """select (select count(*) from corr_names) as n_names, count(*) as n_pairs,
        cast(count_if(incomplete) as bigint) as n_incomplete, avg(correlation) as mean_correlation from pairs""",
}
EIGEN_SQL = PAIR_SQL | {
    "corr_turns": "select list(struct_pack(p := a.i, q := b.i) order by a.i, b.i) as t, max(b.i) as n from corr_names a join corr_names b on a.i < b.i",
    "entries": """select i, j, correlation as c from pairs union all select j, i, correlation from pairs
        union all select i, i, case when varies then 1.0 else 0.0 end from corr_names""",
    "rotated": f"""
        select 0 as step, list(c order by i, j) as m from entries
        union all
        select step + 1, list_transform(range(1, n * n + 1), lambda k: case (k - 1) // n + 1
            when p then cs * b[k] - sn * b[(q - 1) * n + (k - 1) % n + 1]
            when q then sn * b[(p - 1) * n + (k - 1) % n + 1] + cs * b[k] else b[k] end)
        from (select step, n, p, q, cs, sn, list_transform(range(1, n * n + 1), lambda k: case (k - 1) % n + 1
                  when p then cs * m[k] - sn * m[(k - 1) // n * n + q]
                  when q then sn * m[(k - 1) // n * n + p] + cs * m[k] else m[k] end) as b
              from (select *, 1 / sqrt(1 + tn * tn) as cs, tn / sqrt(1 + tn * tn) as sn
                    from (select *, case when off = 0 then 0 when tau >= 0 then 1 / (tau + sqrt(1 + tau * tau))
                                 else 1 / (tau - sqrt(1 + tau * tau)) end as tn
                          from (select *, (m[(q - 1) * n + q] - m[(p - 1) * n + p]) / (2 * nullif(off, 0)) as tau
                                from (select *, m[(p - 1) * n + q] as off
                                      from (select step, m, n, t[step % len(t) + 1].p as p, t[step % len(t) + 1].q as q
                                            from rotated, corr_turns where step < {ROTATION_SWEEPS} * len(t)))))))""",
    "eigen": "select m[(k - 1) * n + k] as v from (select m, n, unnest(range(1, n + 1)) as k from rotated, corr_turns "
             f"where step = {ROTATION_SWEEPS} * len(t))",
    "bets": "select pow(sum(v), 2) / sum(v * v) as effective_bets from eigen where v > 0",
}


@query("d10_pairwise_correlation", sql(f"""
    select n_names, n_pairs, n_incomplete, {r('mean_correlation')} from breadth""", **PAIR_SQL))
def d10(spark, sf):
    return rounded(BR.effective_breadth(T.panel(spark, sf)).drop("effective_bets"))


@query("d10_pairs", sql(f"select ticker_a, ticker_b, n_shared, {r('correlation')} from pairs", **PAIR_SQL))
def d10_pairs(spark, sf):
    return rounded(BR.pairwise_correlations(T.panel(spark, sf), block=8))


@query("d11_effective_bets", sql(f"""
    select n_names, n_pairs, n_incomplete, {r('mean_correlation')}, {r('effective_bets')} from breadth cross join bets""",
    **EIGEN_SQL))
def d11(spark, sf):
    return rounded(BR.effective_breadth(T.panel(spark, sf)))


@query("d12_fundamental_law", sql(f"""
    select {r('ic', 'mean_rank_ic')}, {r('effective_bets', 'effective_names')}, {r('effective_bets * 52', 'breadth')},
           {r('ic * sqrt(effective_bets * 52)', 'implied_ir')}, {r('ic * sqrt(n_names * 52.0)', 'naive_ir')}
    from breadth cross join bets cross join (select avg(ic) as ic from ic)""", **EIGEN_SQL))
def d12(spark, sf):
    ic = E.ic_summary(E.rank_ic(T.predictions(spark, sf), "pred_a"))
    return rounded(BR.fundamental_law(BR.effective_breadth(T.panel(spark, sf)), ic))
