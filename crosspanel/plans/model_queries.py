"""Queries over features, folds, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators import boosting as B
from crosspanel.operators import diagnostics as D
from crosspanel.operators import evaluation as E
from crosspanel.operators import features as FE
from crosspanel.operators import folds as FO
from crosspanel.operators import linear as L
from crosspanel.operators import quality as Q
from crosspanel.plans import tables as T
from crosspanel.plans.registry import query, r, rounded, sql, sql_pct, student_sql
from crosspanel.session import stage

KEY = ["week_ending_friday", "ticker"]
FOLDS = dict(n_folds=8, min_train=104, purge=1, embargo=1)


@query("v08_feature_coverage", sql(" union all ".join(
    f"select '{f}' as feature, {r(f'100.0 * count({f}) / count(*)', 'coverage_pct')} from features"
    for f in FE.FEATURES + [FE.TARGET])))
def v08(spark, sf):
    return rounded(Q.feature_coverage(T.features(spark, sf), FE.FEATURES + [FE.TARGET]))


def _feature_query(name: str, *columns: str):
    def run(spark, sf):
        return rounded(FE.build_features(T.panel(spark, sf)).select(*KEY, *columns))
    query(name, sql(f"select week_ending_friday, ticker, {', '.join(r(c) for c in columns)} "
                    "from features_raw where row_no >= 52"))(run)


_feature_query("f01_forward_return", "fwd_return")
_feature_query("f03_asvi", "asvi")
_feature_query("f04_trends_z_26", "trends_z_26")
_feature_query("f05_trends_chg_4", "trends_chg_4")
_feature_query("f06_trends_vol_13", "trends_vol_13")
_feature_query("f07_rev_1", "rev_1")
_feature_query("f08_mom_12_1", "mom_12_1")
_feature_query("f09_mom_52_4", "mom_52_4")
_feature_query("f10_rvol_13", "rvol_13")
_feature_query("f12_ivol_26", "ivol_26")


@query("f02_log_svi", sql(f"select week_ending_friday, ticker, {r('log_svi')} from panel_svi"))
def f02(spark, sf):
    return rounded(T.panel(spark, sf).select(*KEY, F.log1p("trends_interest").alias("log_svi")))


@query("f11_market_residual", sql(f"""
    select week_ending_friday, ticker, {r('weekly_return - resid', 'market_return')}, {r('resid', 'residual')}
    from panel_svi"""))
def f11(spark, sf):
    out = FE.with_market(T.panel(spark, sf))
    return rounded(out.select(*KEY, "market_return", F.col("_resid").alias("residual")))


@query("f13_min_history", sql("""
    select ticker, count(*) as n_rows, min(week_ending_friday) as first_week from features group by 1"""))
def f13(spark, sf):
    return T.features(spark, sf).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("week_ending_friday").alias("first_week"))


@query("f14_feature_ranks", sql("select week_ending_friday, ticker, " + ", ".join(
    r(sql_pct(f), f + "_rank") for f in FE.FEATURES) + " from features"))
def f14(spark, sf):
    return rounded(FE.rank_features(T.features(spark, sf)).select(*KEY, *FE.RANKS))


@query("f15_feature_tags", sql(
    "select feature, origin, bucket, n from (values " + ", ".join(
        f"('{f}', '{o}', '{b}')" for f, (o, b) in FE.FEATURE_TAGS.items())
    + ") t(feature, origin, bucket) join (" + " union all ".join(
        f"select '{f}' as feature, count({f}) as n from features" for f in FE.FEATURES) + ") using (feature)"))
def f15(spark, sf):
    counted = T.features(spark, sf).agg(*[F.count(f).alias(f) for f in FE.FEATURES]).unpivot(
        [], FE.FEATURES, "feature", "n")
    return FE.feature_tags(spark).join(counted, "feature").select("feature", "origin", "bucket", "n")


FOLD_SQL = {
    "dates": "select week_ending_friday, row_number() over (order by week_ending_friday) - 1 as d "
             "from (select distinct week_ending_friday from live)",
    "spans": "select k, n, 104 + k * greatest(1, (n - 104) // 8) as train_end, greatest(1, (n - 104) // 8) as size "
             "from (select count(*) as n from dates), (select unnest(range(8)) as k)",
    "folds": "select cast(row_number() over (order by k) as integer) as fold, train_end - 1 as train_n, "
             "train_end + 1 as test_lo, least(train_end + 1 + size, n) as test_hi from spans "
             "where train_end + 1 < n and train_end > 1 and least(train_end + 1 + size, n) > train_end + 1",
}


@query("m01_walk_forward_folds", sql("""
    select fold, 'train' as role, week_ending_friday from folds, dates where d < train_n
    union all select fold, 'test', week_ending_friday from folds, dates where d >= test_lo and d < test_hi""", **FOLD_SQL))
def m01(spark, sf):
    dates = FO.date_index(T.predictions(spark, sf))
    folds = FO.walk_forward(dates, **FOLDS)
    parts = [FO.fold_dates(folds, dates, role).select("fold", F.lit(role).alias("role"), "week_ending_friday")
             for role in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("m02_model_rows", sql(f"""
    select week_ending_friday, ticker, {r('fwd_return')}, {r('coalesce(asvi_rank, 0.5)', 'asvi_rank')},
           {r('coalesce(mom_12_1_rank, 0.5)', 'mom_12_1_rank')} from rank_rows"""))
def m02(spark, sf):
    return rounded(L.prepare(T.ranked_features(spark, sf), ["asvi_rank", "mom_12_1_rank"]))


@query("m03_date_moments", sql(f"""
    select week_ending_friday, count(*) as n, {r('sum(fwd_return)', 'sy')}, {r('sum(x)', 'sx')},
           {r('sum(x * fwd_return)', 'sxy')}, {r('sum(x * x)', 'sxx')}
    from (select *, coalesce(asvi_rank, 0.5) as x from rank_rows) group by 1"""))
def m03_moments(spark, sf):
    out = L.date_moments(L.prepare(T.ranked_features(spark, sf), ["asvi_rank"]), ["asvi_rank"])
    return rounded(out.select("week_ending_friday", "n", "sy", *[F.col(c)[0].alias(c) for c in ("sx", "sxy", "sxx")]))


@query("m03_enet_one_column", sql(f"""
    select week_ending_friday, ticker, t.fold, {r('fwd_return')},
           {r('my + sign(c) * greatest(abs(c) - 0.0005, 0) / (1 + 0.0005) * (x - mx) / sx', 'pred_enet')}
    from (select fold, week_ending_friday, ticker, fwd_return, coalesce(asvi_rank, 0.5) as x
          from rank_rows join dates using (week_ending_friday) join folds on d >= test_lo and d < test_hi) t
         join fits using (fold)""", **FOLD_SQL, fits="""
    select fold, avg(fwd_return) as my, avg(x) as mx, stddev_pop(x) as sx, covar_pop(x, fwd_return) / stddev_pop(x) as c
    from (select fold, fwd_return, coalesce(asvi_rank, 0.5) as x
          from rank_rows join dates using (week_ending_friday) join folds on d < train_n) group by 1 having count(*) >= 200"""))
def m03_one(spark, sf):
    preds, _ = L.walk_forward_enet(T.ranked_features(spark, sf), columns=["asvi_rank"], **FOLDS)
    return rounded(preds)


@query("m03_enet_walk_forward")
def m03(spark, sf):
    preds, _ = L.walk_forward_enet(T.ranked_features(spark, sf), **FOLDS)
    return rounded(preds)


@query("m04_gbt_walk_forward")
def m04(spark, sf):
    preds, _ = B.walk_forward_gbt(T.ranked_features(spark, sf))
    return preds


@query("m05_nested_gbt")
def m05_gbt(spark, sf):
    preds, _ = B.nested_gbt(T.ranked_features(spark, sf))
    return preds


@query("m05_nested_enet")
def m05(spark, sf):
    preds, _ = L.nested_enet(T.ranked_features(spark, sf))
    return rounded(preds)


INNER_SQL = """
    select fold, cast(row_number() over (partition by fold order by k) as integer) as inner, train_end - 1 as train_n,
           train_end + 1 as test_lo, least(train_end + 1 + size, n) as test_hi
    from (select fold, k, n, first + k * size as train_end, size
          from (select fold, train_n as n, greatest(52, train_n // 2) as first,
                       greatest(1, (train_n - greatest(52, train_n // 2)) // 3) as size from folds),
               (select unnest(range(3)) as k))
    where train_end + 1 < n and train_end > 1 and least(train_end + 1 + size, n) > train_end + 1"""

# With one column the penalized slope has a closed form and every config with
# a slope ranks alike up to its sign.
NESTED_SQL = {
    "inner_spans": INNER_SQL,
    "x_rows": "select d, week_ending_friday, ticker, fwd_return, coalesce(asvi_rank, 0.5) as x "
              "from rank_rows join dates using (week_ending_friday)",
    "x_ranks": """
    select d, rank() over (partition by d order by x) + (count(*) over (partition by d, x) - 1) / 2.0::double as a,
           rank() over (partition by d order by fwd_return)
               + (count(*) over (partition by d, fwd_return) - 1) / 2.0::double as b from x_rows""",
    "x_ic": """
    select d, (sum(a * b) - count(*) * pow(count(*) + 1, 2) / 4.0)
              / nullif(sqrt((sum(a * a) - count(*) * pow(count(*) + 1, 2) / 4.0)
                            * (sum(b * b) - count(*) * pow(count(*) + 1, 2) / 4.0)), 0) as ic
    from x_ranks group by 1 having count(*) >= 5""",
    "grid_points": "select * from (values " + ", ".join(f"({c}, {a}::double, {q}::double)" for c, a, q in L.ENET_GRID)
                   + ") g(config, alpha, ratio)",
    "inner_slopes": """
    select fold, "inner", config, case when abs(c) > alpha * ratio then sign(c) else 0 end as side
    from (select fold, "inner", covar_pop(x, fwd_return) / stddev_pop(x) as c
          from x_rows join inner_spans on d < train_n group by 1, 2 having count(*) >= 200), grid_points""",
    "inner_scores": """
    select fold, config, round(avg(s), 12) as score
    from (select s.fold, s."inner", s.config, avg(side * ic) as s
          from inner_slopes s join inner_spans i on i.fold = s.fold and i."inner" = s."inner"
               join x_ic on d >= test_lo and d < test_hi
          where side <> 0 and ic is not null group by 1, 2, 3) group by 1, 2""",
    "picked": "select fold, config from (select *, row_number() over (partition by fold order by score desc, config) as k "
              "from inner_scores) where k = 1",
    "outer_fits": """
    select fold, avg(fwd_return) as my, avg(x) as mx, stddev_pop(x) as sx,
           covar_pop(x, fwd_return) / stddev_pop(x) as c
    from x_rows join folds on d < train_n group by 1 having count(*) >= 200""",
    "outer_models": """
    select f.fold, my, mx, sx, g.config, sign(c) * greatest(abs(c) - alpha * ratio, 0) / (1 + alpha * (1 - ratio)) as w
    from outer_fits f left join picked p on p.fold = f.fold join grid_points g on g.config = coalesce(p.config, 0)""",
}


@query("m05_nested_one_column", sql(f"""
    select week_ending_friday, ticker, {r('fwd_return')}, {r('my + w * (x - mx) / sx', 'pred_enet')}, fold, config
    from x_rows join folds on d >= test_lo and d < test_hi join outer_models using (fold)""", **FOLD_SQL, **NESTED_SQL))
def m05_one(spark, sf):
    preds, _ = L.nested_enet(T.ranked_features(spark, sf), n_folds=8, columns=["asvi_rank"])
    return rounded(preds)


@query("m05_inner_folds", sql("select * from inner_spans", **FOLD_SQL, inner_spans=INNER_SQL))
def m05_inner(spark, sf):
    return FO.inner_folds(FO.walk_forward(FO.date_index(T.predictions(spark, sf)), **FOLDS))


@query("m06_rank_ic", sql(f"select week_ending_friday, n, {r('ic')} from ic where ic is not null"))
def m06(spark, sf):
    return rounded(E.rank_ic(T.predictions(spark, sf), "pred_a"))


@query("m07_ic_summary", sql(f"""
    select 'asvi' as model, count(ic) as weeks_evaluated, {r('avg(ic)', 'mean_rank_ic')},
           {r('quantile_cont(ic, 0.5)', 'median_rank_ic')}, {r('stddev_samp(ic)', 'std_rank_ic')},
           {r('avg(ic) / stddev_samp(ic)', 'ic_ir')}, {r('avg(ic) / stddev_samp(ic) * sqrt(count(ic))', 'ic_t_stat')},
           {r('100 * avg(case when ic > 0 then 1.0 else 0.0 end)', 'pct_weeks_positive_ic')},
           (select {r('100 * avg(case when sign(p - mp) = sign(y - my) then 1.0 else 0.0 end)', 'h')} from tilts) as hit_rate_pct,
           (select count(*) from ic_pairs) as n_predictions
    from ic""", tilts="""
    select pred_a as p, fwd_return as y, avg(pred_a) over d as mp, avg(fwd_return) over d as my
    from ic_pairs window d as (partition by week_ending_friday)"""))
def m07(spark, sf):
    return rounded(E.summarise(T.predictions(spark, sf), "pred_a", "asvi"))


@query("m08_coefficients")
def m08(spark, sf):
    _, coefs = L.walk_forward_enet(T.ranked_features(spark, sf), **FOLDS)
    return rounded(L.coefficient_table(coefs), 9)


@query("m08_gbt_importance")
def m08_gbt(spark, sf):
    _, nodes = B.walk_forward_gbt(T.ranked_features(spark, sf))
    return rounded(B.importance_table(nodes))


@query("m09_nested_summary")
def m09(spark, sf):
    _, chosen = L.nested_enet(T.ranked_features(spark, sf))
    return L.nested_summary(chosen)


@query("m09_trials", sql("select count(*) * (15 + 4) * 3 as total_fits, count(*) as n_folds from folds "
                         "where train_n > 0", **FOLD_SQL))
def m09_trials(spark, sf):
    folds = FO.walk_forward(FO.date_index(T.predictions(spark, sf)), **FOLDS)
    per_fold = (len(L.ENET_GRID) + L.BOOSTING_GRID_SIZE) * 3
    return folds.agg((F.count(F.lit(1)) * per_fold).alias("total_fits"), F.count(F.lit(1)).alias("n_folds"))


SECTOR_SQL = {"sector_ics": """
    select sector, week_ending_friday,
           (sum(ra * ry) - count(*) * pow(count(*) + 1, 2) / 4.0)
               / nullif(sqrt((sum(ra * ra) - count(*) * pow(count(*) + 1, 2) / 4.0)
                             * (sum(ry * ry) - count(*) * pow(count(*) + 1, 2) / 4.0)), 0) as ic
    from (select sector, week_ending_friday,
                 rank() over (partition by sector, week_ending_friday order by pred_a)
                     + (count(*) over (partition by sector, week_ending_friday, pred_a) - 1) / 2.0::double as ra,
                 rank() over (partition by sector, week_ending_friday order by fwd_return)
                     + (count(*) over (partition by sector, week_ending_friday, fwd_return) - 1) / 2.0::double as ry
          from ic_pairs) group by 1, 2 having count(*) >= 5"""}


@query("m10_sector_ic", sql(f"""
    select sector, count(ic) as n_weeks, {r('avg(ic)', 'mean_ic')}, {r('stddev_samp(ic)', 'std_ic')},
           {r('avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))', 't_stat')},
           {r('100 * avg(case when ic > 0 then 1.0 else 0.0 end)', 'pct_positive')},
           any_value(n_names) as n_names, abs(avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))) > 2 as naive_t_gt_2
    from sector_ics join (select sector, count(distinct ticker) as n_names from ic_pairs group by 1) using (sector)
    where ic is not null group by sector having count(ic) >= 20""", **SECTOR_SQL))
def m10(spark, sf):
    return rounded(E.sector_ic(T.predictions(spark, sf), "pred_a"))


@query("m10_sector_ic_tested", sql(f"""
    select s.* replace ({r('mean_ic')}, {r('std_ic')}, {r('t_stat')}, {r('pct_positive')}), {r('p_value')},
           p_value <= coalesce((select max(p_value) from (
               select p_value, row_number() over (order by p_value) as i, count(*) over () as m from sector_tests)
               where p_value <= i * 0.10 / m), -1) as survives_bh
    from (select * exclude (p_value) from sector_tests) s join (select sector, p_value from sector_tests) using (sector)""",
    **SECTOR_SQL, sector_scores="""
    select sector, count(ic) as n_weeks, avg(ic) as mean_ic, stddev_samp(ic) as std_ic,
           avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) as t_stat,
           100 * avg(case when ic > 0 then 1.0 else 0.0 end) as pct_positive, any_value(n_names) as n_names,
           abs(avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))) > 2 as naive_t_gt_2
    from sector_ics join (select sector, count(distinct ticker) as n_names from ic_pairs group by 1) using (sector)
    where ic is not null group by sector having count(ic) >= 20""",
    sector_tests=f"select *, {student_sql('t_stat', 'n_weeks - 1')} as p_value from sector_scores"))
def m10_tested(spark, sf):
    return rounded(E.sector_ic_tested(T.predictions(spark, sf), "pred_a"))


def normality_by_entity(spark, sf) -> DataFrame:
    jb = D.jarque_bera(T.panel(spark, sf), "weekly_return", ["ticker"])
    return stage(jb.select("ticker", "p_value"), "normality")


@query("m11_benjamini_hochberg", sql(f"""
    select ticker, {r('p', 'p_value')}, p <= coalesce(lim, -1) as rejected
    from tests cross join (select max(p) as lim from (
        select p, row_number() over (order by p) as i, count(*) over () as m from tests) where p <= i * 0.05 / m)""",
    centred="select ticker, weekly_return - avg(weekly_return) over (partition by ticker) as u from panel",
    tests="""
    select ticker, exp(-(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) / 2) as p
    from (select ticker, count(*) as n, avg(u * u) as m2, avg(u * u * u) as m3, avg(u * u * u * u) as m4
          from centred group by 1)"""))
def m11(spark, sf):
    return rounded(E.benjamini_hochberg(normality_by_entity(spark, sf), "p_value", 0.05))


DV_SQL = {
    "dollar": """
    select ticker, cast(date + cast((12 - dayofweek(date)) % 7 as integer) as date) as week_ending_friday,
           sum(close * volume) as dollar_volume from prices group by 1, 2""",
    "both_positive": """
    select p.ticker, week_ending_friday, ln(trends_interest) as s, ln(dollar_volume) as v
    from panel p join dollar using (ticker, week_ending_friday) where trends_interest > 0 and dollar_volume > 0""",
    "log_moves": """
    select ticker, s - lag(s) over e as s, v - lag(v) over e as v from both_positive
    window e as (partition by ticker order by week_ending_friday)""",
    "scores": """
    select ticker, count(v) as n_obs, corr(s, v) as corr_svi_volume from log_moves
    group by 1 having count(*) >= 60 and count(v) >= 50""",
}


@query("m12_weekly_dollar_volume", sql(f"select ticker, week_ending_friday, {r('dollar_volume', digits=2)} from dollar", **DV_SQL))
def m12(spark, sf):
    return rounded(E.weekly_dollar_volume(T.prices_daily(spark, sf)), 2)


def coupling_scores(spark, sf) -> DataFrame:
    return E.coupling(T.panel(spark, sf), E.weekly_dollar_volume(T.prices_daily(spark, sf)))


CONCERNS = {"NATION_2": "also a brand", "NATION_6": "ordinary word"}


@query("m13_coupling", sql(f"""
    select ticker, n_obs, {r('corr_svi_volume')}, keyword, sector,
           case ticker when 'NATION_2' then 'also a brand' when 'NATION_6' then 'ordinary word' end as concern,
           ticker in ('NATION_2', 'NATION_6') as flagged_a_priori
    from scores join members using (ticker)""", **DV_SQL))
def m13(spark, sf):
    concerns = spark.createDataFrame(list(CONCERNS.items()), "ticker string, concern string")
    return rounded(E.label_coupling(coupling_scores(spark, sf), T.members(spark, sf), concerns))


@query("m13_coupling_p", sql(f"""
    select ticker, n_obs, {r('corr_svi_volume')},
           {r(student_sql('corr_svi_volume * sqrt((n_obs - 2) / (1 - corr_svi_volume * corr_svi_volume))', 'n_obs - 2'), 'p_value')}
    from scores""", **DV_SQL))
def m13_p(spark, sf):
    return rounded(E.coupling_p(coupling_scores(spark, sf)))


@query("m14_welch", sql(f"""
    select nx as n_flagged, ny as n_rest, {r('mx', 'mean_flagged')}, {r('my', 'mean_rest')},
           {r('(mx - my) / sqrt(vx / nx + vy / ny)', 't_stat')},
           {r('pow(vx / nx + vy / ny, 2) / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1))', 'dof')}
    from (select count(*) filter (f) as nx, count(*) filter (not f) as ny,
                 avg(corr_svi_volume) filter (f) as mx, avg(corr_svi_volume) filter (not f) as my,
                 var_samp(corr_svi_volume) filter (f) as vx, var_samp(corr_svi_volume) filter (not f) as vy
          from (select corr_svi_volume, starts_with(sector, 'A') as f from scores join members using (ticker)))""", **DV_SQL))
def m14(spark, sf):
    labelled = coupling_scores(spark, sf).join(T.members(spark, sf).select("ticker", "sector"), "ticker")
    return rounded(E.welch(labelled, "corr_svi_volume", F.col("sector").startswith("A")))


@query("m14_welch_p", sql(f"""
    select n_flagged, n_rest, {r('mean_flagged')}, {r('mean_rest')}, {r('t_stat')}, {r('dof')},
           {r(student_sql('t_stat', 'dof'), 'p_value')} from welch""", **DV_SQL, welch="""
    select nx as n_flagged, ny as n_rest, mx as mean_flagged, my as mean_rest, (mx - my) / sqrt(vx / nx + vy / ny) as t_stat,
           pow(vx / nx + vy / ny, 2) / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1)) as dof
    from (select count(*) filter (f) as nx, count(*) filter (not f) as ny,
                 avg(corr_svi_volume) filter (f) as mx, avg(corr_svi_volume) filter (not f) as my,
                 var_samp(corr_svi_volume) filter (f) as vx, var_samp(corr_svi_volume) filter (not f) as vy
          from (select corr_svi_volume, starts_with(sector, 'A') as f from scores join members using (ticker)))"""))
def m14_p(spark, sf):
    labelled = coupling_scores(spark, sf).join(T.members(spark, sf).select("ticker", "sector"), "ticker")
    return rounded(E.welch_p(E.welch(labelled, "corr_svi_volume", F.col("sector").startswith("A"))))


@query("m15_weakest_strongest", sql(f"""
    select 'weakest' as side, ticker, {r('corr_svi_volume')} from (select * from scores order by corr_svi_volume limit 12)
    union all
    select 'strongest', ticker, {r('corr_svi_volume')} from (select * from scores order by corr_svi_volume desc limit 8)""", **DV_SQL))
def m15(spark, sf):
    scores = stage(coupling_scores(spark, sf).select("ticker", "corr_svi_volume"), "scores")
    return rounded(E.weakest(scores).select(F.lit("weakest").alias("side"), "*").unionByName(
        E.strongest(scores).select(F.lit("strongest").alias("side"), "*")))


@query("m15_mean_by_group", sql(f"""
    select sector, {r('avg(corr_svi_volume)', 'mean_corr_svi_volume')} from scores join members using (ticker)
    group by 1""", **DV_SQL))
def m15_mean(spark, sf):
    labelled = coupling_scores(spark, sf).join(T.members(spark, sf).select("ticker", "sector"), "ticker")
    return rounded(E.mean_by_group(labelled))
