"""Registry of queries and of the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common tables of the SQL side, each using only tables and entries above it.
CTES = {
    "prices": """
        select n_name as ticker, cast(l_shipdate as date) as date,
               sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0 / sum(l_quantity) as close,
               sum(cast(round(l_extendedprice * (1 - l_discount) * 10000) as bigint)) / 10000.0
                   / sum(l_quantity) as adj_close,
               sum(l_quantity) as volume
        from lineitem join supplier on s_suppkey = l_suppkey
             join nation on n_nationkey = s_nationkey group by 1, 2""",
    "members": """
        select n_name as ticker, lower(n_name) as keyword, r_name as sector,
               cast(n_nationkey as bigint) as ordinal
        from nation join region on r_regionkey = n_regionkey""",
    "returns": """
        select *, ln(adj_close / lag(adj_close) over (partition by ticker order by date)) as daily_return
        from prices""",
    "week_sums": """
        select ticker, cast(date + cast((12 - dayofweek(date)) % 7 as integer) as date) as week_ending_friday,
               count(*) as n_days, sum(daily_return) as weekly_return
        from returns where daily_return is not null group by 1, 2""",
    "interest": """
        select ticker, date, round(100.0 * n / max(n) over (partition by ticker)) as search_interest
        from (select n_name as ticker,
                     cast(cast(o_orderdate as date) - cast(dayofweek(o_orderdate) as integer) as date) as date,
                     count(*) as n
              from orders join customer on c_custkey = o_custkey
                   join nation on n_nationkey = c_nationkey group by 1, 2)""",
    "anchors": """
        select cast(substr(o_orderpriority, 1, 1) as integer) as batch,
               cast(cast(o_orderdate as date) - cast(dayofweek(o_orderdate) as integer) as date) as date,
               cast(count(*) as double) as search_interest
        from orders group by 1, 2""",
    "news": """
        select cast(user_id as varchar) as ticker, cast(ts as date) as date,
               avg(value) - 50 as tone, count(*) as volume
        from events group by 1, 2""",
    "panel": """
        select w.week_ending_friday, w.ticker, sector, weekly_return, search_interest as trends_interest
        from week_sums w left join members m on m.ticker = w.ticker
             left join interest i on i.ticker = w.ticker and i.date + 5 = w.week_ending_friday""",
    "panel_svi": """
        select *, ln(1 + trends_interest) as log_svi,
               weekly_return - avg(weekly_return) over (partition by week_ending_friday) as resid
        from panel""",
    "panel_dlog": """
        select *, log_svi - lag(log_svi) over (partition by ticker order by week_ending_friday) as dlog
        from panel_svi""",
    "features_raw": """
        select week_ending_friday, ticker, sector, weekly_return, trends_interest,
            lead(weekly_return) over e as fwd_return,
            log_svi - case when count(log_svi) over w8 >= 4
                      then quantile_cont(log_svi, 0.5) over w8 end as asvi,
            (log_svi - case when count(log_svi) over w26 >= 15 then avg(log_svi) over w26 end)
                / nullif(case when count(log_svi) over w26 >= 15
                         then stddev_samp(log_svi) over w26 end, 0) as trends_z_26,
            log_svi - lag(log_svi, 4) over e as trends_chg_4,
            case when count(dlog) over w13 >= 7 then stddev_samp(dlog) over w13 end as trends_vol_13,
            case when count(weekly_return) over w48 >= 30 then sum(weekly_return) over w48 end as mom_52_4,
            case when count(weekly_return) over w11 >= 8 then sum(weekly_return) over w11 end as mom_12_1,
            case when count(weekly_return) over w13 >= 7 then stddev_samp(weekly_return) over w13 end as rvol_13,
            case when count(resid) over w26 >= 15 then stddev_samp(resid) over w26 end as ivol_26,
            lag(weekly_return) over e as rev_1,
            row_number() over e - 1 as row_no
        from panel_dlog
        window e as (partition by ticker order by week_ending_friday),
               w8 as (partition by ticker order by week_ending_friday rows between 8 preceding and 1 preceding),
               w11 as (partition by ticker order by week_ending_friday rows between 11 preceding and 1 preceding),
               w13 as (partition by ticker order by week_ending_friday rows between 13 preceding and 1 preceding),
               w26 as (partition by ticker order by week_ending_friday rows between 26 preceding and 1 preceding),
               w48 as (partition by ticker order by week_ending_friday rows between 51 preceding and 4 preceding)""",
    "features": """
        select week_ending_friday, ticker, sector, weekly_return, trends_interest, fwd_return,
               round(asvi, 9) as asvi, round(trends_z_26, 9) as trends_z_26,
               round(trends_chg_4, 9) as trends_chg_4, round(trends_vol_13, 9) as trends_vol_13,
               round(mom_52_4, 9) as mom_52_4, round(mom_12_1, 9) as mom_12_1,
               round(rvol_13, 9) as rvol_13, round(ivol_26, 9) as ivol_26, round(rev_1, 9) as rev_1
        from features_raw where row_no >= 52""",
    "preds": """
        select week_ending_friday, ticker, sector, weekly_return, fwd_return,
               asvi as pred_a, mom_12_1 as pred_b
        from features""",
    "rank_rows": """
        select * from (select *, {asvi} as asvi_rank, {mom_12_1} as mom_12_1_rank from features)
        where fwd_return is not null""",
    "live": """
        select * from preds where fwd_return is not null""",
    "ic_pairs": """
        select * from live where pred_a is not null""",
    "ic": """
        select week_ending_friday, count(*) as n,
               (sum(ra * ry) - count(*) * pow(count(*) + 1, 2) / 4.0)
                   / nullif(sqrt((sum(ra * ra) - count(*) * pow(count(*) + 1, 2) / 4.0)
                                 * (sum(ry * ry) - count(*) * pow(count(*) + 1, 2) / 4.0)), 0) as ic
        from (select week_ending_friday,
                     rank() over (partition by week_ending_friday order by pred_a)
                         + (count(*) over (partition by week_ending_friday, pred_a) - 1) / 2.0::double as ra,
                     rank() over (partition by week_ending_friday order by fwd_return)
                         + (count(*) over (partition by week_ending_friday, fwd_return) - 1) / 2.0::double as ry
              from ic_pairs)
        group by 1 having count(*) >= 5""",
    "names": """
        select *, count(*) over (partition by week_ending_friday) as n_names from live
        where pred_b is not null""",
    "ranked": """
        select *, {pred_b} as r from names where n_names >= 10""",
    "w_rank": """
        select *, (r - rm) / nullif(sum(abs(r - rm)) over (partition by week_ending_friday), 0) * 2 as w0
        from (select *, avg(r) over (partition by week_ending_friday) as rm from ranked)""",
    "w_sector": """
        select *, w0 - avg(w0) over (partition by week_ending_friday, sector) as w1 from w_rank""",
    "w_neutral": """
        select *, w1 - avg(w1) over (partition by week_ending_friday) as w2 from w_sector""",
    "w_clipped": """
        select *, greatest(-0.05, least(0.05, w2)) as w3 from w_neutral""",
    "w_centred": """
        select *, w3 - avg(w3) over (partition by week_ending_friday) as w4 from w_clipped""",
    "weights": """
        select week_ending_friday, ticker, fwd_return,
               w4 / nullif(sum(abs(w4)) over (partition by week_ending_friday), 0) * 2.0 as weight
        from w_centred""",
    "book_dates": "select week_ending_friday, row_number() over (order by week_ending_friday) as d "
                  "from (select distinct week_ending_friday from weights)",
    "grid": """
        select d, b.week_ending_friday, t.ticker, w.weight,
               lag(w.weight) over (partition by t.ticker order by d) as prev
        from book_dates b cross join (select distinct ticker from weights) t
             left join weights w on w.week_ending_friday = b.week_ending_friday and w.ticker = t.ticker""",
    "moves": """
        select week_ending_friday, ticker, coalesce(weight, 0) - coalesce(prev, 0) as dw from grid
        where weight is not null or prev is not null""",
    "adv": "select ticker, avg(close * volume) as adv from prices group by 1",
    "vol": "select ticker, stddev_samp(weekly_return) * sqrt(52.0) as vol from live group by 1",
    "book_cost": """
        select week_ending_friday, sum(abs(dw)) / 2 as turnover,
               sum(abs(dw) * 5.0 / 10000 + abs(dw) * 0.5 * coalesce(vol, mv)
                   * sqrt(abs(dw) * 10000000.0 / coalesce(adv, ma))) as cost
        from moves left join adv on adv.ticker = moves.ticker left join vol on vol.ticker = moves.ticker
             cross join (select quantile_cont(adv, 0.5) as ma from adv)
             cross join (select quantile_cont(vol, 0.5) as mv from vol) group by 1""",
    "book_returns": """
        select g.week_ending_friday, gross_return, gross_return - coalesce(cost, 0) as net_return,
               turnover, cost
        from (select week_ending_friday, coalesce(sum(weight * fwd_return), 0) as gross_return
              from weights group by 1) g left join book_cost using (week_ending_friday)""",
    "residuals": """
        select week_ending_friday, avg(fwd_return - pred_a) as e from ic_pairs group by 1""",
}


def _pct(column: str, by: str = "week_ending_friday") -> str:
    return (f"case when {column} is not null then "
            f"(rank() over (partition by {by} order by {column} nulls last) "
            f"+ (count(*) over (partition by {by}, {column}) - 1) / 2.0) "
            f"/ count({column}) over (partition by {by}) end")


for _name, _column in (("rank_rows", "asvi"), ("rank_rows", "mom_12_1"), ("ranked", "pred_b")):
    CTES[_name] = CTES[_name].replace("{" + _column + "}", _pct(_column))


def sql_pct(column: str, by: str = "week_ending_friday") -> str:
    """Percentile rank with ties averaged, in SQL."""
    return _pct(column, by)


# Read once per date of a recursion, so computed once.
MATERIALIZED = {"targets": " as materialized"}


def sql(body: str, **extra: str) -> str:
    """``body`` with the common tables it reaches put in front."""
    return assembled(body, {**CTES, **extra})


def assembled(body: str, tables: dict[str, str]) -> str:
    """``body`` behind those of ``tables`` that it reaches, in their order."""
    needed: set[str] = set()

    def reach(text: str) -> None:
        for name, cte in tables.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                reach(cte)
    reach(body)
    if not needed:
        return body
    parts = [f"{n}{MATERIALIZED.get(n, ' as')} ({c})" for n, c in tables.items() if n in needed]
    return "with recursive " + ",\n".join(parts) + "\n" + body


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL: a rounded output column without negative zero."""
    return f"round({expr}, {digits}) + 0.0 as {name or expr}"


def simpson(f: str, low: str, high: str, steps: int = 2000) -> str:
    """SQL: the integral of ``f``, an expression of x, by Simpson's rule."""
    width = f"(({high}) - ({low})) / {float(steps)}"
    point = f.replace("{x}", f"(({low}) + k * {width})")
    weight = f"case when k in (0, {steps}) then 1 when k % 2 = 1 then 4 else 2 end"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {point})) * {width} / 3)"


def student_sql(t: str, df: str) -> str:
    """SQL: two-sided Student p; with t = sqrt(df) tan(x) the density is a power of the cosine."""
    power = f"pow(cos({{x}}), ({df}) - 1)"
    return (simpson(power, f"atan(abs({t}) / sqrt({df}))", "pi() / 2")
            + " / " + simpson(power, "0.0", "pi() / 2"))


def normal_sql(z: str) -> str:
    """SQL: the normal distribution function."""
    return f"(0.5 + {simpson('exp(-{x} * {x} / 2) / sqrt(2 * pi())', '0.0', z)})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, without negative zero."""
    return df.select(*[
        (F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name) for f in df.schema.fields])


def query(name: str, oracle: str | None = None):
    """Register a query, with its SQL where SQL can say it."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add
