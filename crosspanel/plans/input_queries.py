"""Queries over sources, quality checks, alignment and cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.calendar import week_ending_friday
from crosspanel.operators import alignment as A
from crosspanel.operators import cross_section as X
from crosspanel.operators import policies as P
from crosspanel.operators import quality as Q
from crosspanel.operators import rescale as R
from crosspanel.plans import tables as T
from crosspanel.plans.registry import query, r, rounded, sql, sql_pct
from crosspanel.session import stage, stage_root
from crosspanel.sources import files, news, universe

HORIZON = ("1996-01-01", "2000-12-31")
STARTS = [("NATION_3", "1996-06-01"), ("NATION_7", "1997-03-15"), ("NATION_11", "1998-01-01")]
SPLITS = [("NATION_2", "1997-02-03", 10), ("NATION_5", "1998-07-20", 20), ("NATION_8", "1990-01-01", 2)]
STARTS_SQL = "(values " + ", ".join(f"('{t}', date '{d}')" for t, d in STARTS) + ") s(ticker, first_date)"


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{stage_root(spark)}/crosspanel/{label}-{uuid.uuid4().hex}"


def _landed(df: DataFrame, label: str) -> str:
    """Write per-entity CSV files and return their folder."""
    path = _fresh(df.sparkSession, label)
    files.write_csv(df.repartition("ticker"), path, per_entity=True)
    return path


def _landed_prices(spark, sf):
    return _landed(T.prices_daily(spark, sf).select(
        "ticker", F.col("date").alias("Date"), F.col("close").alias("Close"),
        F.col("adj_close").alias("Adj Close"), F.col("volume").alias("Volume")), "prices-csv")


# --- sources ----------------------------------------------------------------

@query("s01_price_scan", sql("select ticker, date, close, adj_close, volume from prices"))
def s01(spark, sf):
    return files.read_prices(spark, _landed_prices(spark, sf))


@query("s02_price_scan_pruned", sql("select ticker, date, close, volume from prices"))
def s02(spark, sf):
    return files.read_prices(spark, _landed_prices(spark, sf), ("Date", "Close", "Volume"))


@query("s03_interest_scan", sql("select ticker, date, search_interest from interest"))
def s03(spark, sf):
    interest = T.interest_weekly(spark, sf)
    stray = interest.select("ticker").distinct().limit(1).select(
        F.lit("manifest").alias("ticker"), F.lit("1999-01-03").cast("date").alias("date"),
        F.lit(1.0).alias("search_interest"))
    path = _landed(interest.unionByName(stray), "interest-csv")
    return files.read_interest(spark, path).drop("modified")


@query("s04_anchor_scan", sql("select batch, date, search_interest from anchors where batch <> 5"))
def s04(spark, sf):
    # Batch 5 lands under a name without a number and must be skipped.
    stem = F.when(F.col("batch") == 5, F.lit("anchor_batchX")).otherwise(
        F.concat(F.lit("anchor_batch"), F.col("batch").cast("string")))
    path = _landed(T.anchors(spark, sf).select(stem.alias("ticker"), "date", "search_interest"), "anchors-csv")
    return files.read_anchors(spark, path).drop("modified")


def timeline_payloads(spark, sf) -> DataFrame:
    """One tone and one volume response per event: two points, mixed date shapes.

    The first series carries no data list. Small values give a negative volume,
    which rejects the response; error events carry no timeline at all.
    """
    e = T.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("ticker"), "ts", "value", "event_type",
        F.explode(F.array(F.lit("tone"), F.lit("volume"))).alias("mode"))
    shift = F.when(F.col("mode") == "tone", F.col("value") - 50).otherwise(F.col("value") - 2)
    later = F.col("ts") + F.expr("interval 12 hours")
    point = lambda t, v: F.struct(t.alias("date"), v.cast("string").alias("value"))
    series = F.array(
        F.struct(F.lit("header").alias("series"),
                 F.lit(None).cast("array<struct<date:string,value:string>>").alias("data")),
        F.struct(F.lit("points").alias("series"), F.array(
            point(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), shift),
            point(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss'Z'"), shift + 1)).alias("data")))
    payload = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("busy").alias("message")))).otherwise(
        F.to_json(F.struct(series.alias("timeline"))))
    chunk = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return e.select("ticker", "mode", chunk.cast("long").alias("chunk_no"), payload.alias("payload"))


POINTS_SQL = """
    select cast(user_id as varchar) as ticker, mode, chunk_no, date,
           case when mode = 'tone' then avg(v) else sum(v) end as value
    from (select user_id, m.mode,
                 case event_type when 'click' then 1 when 'view' then 2 else 3 end as chunk_no,
                 cast(ts + k.k * interval 12 hours as date) as date,
                 case when m.mode = 'tone' then value - 50 else value - 2 end + k.k as v
          from events cross join (values ('tone'), ('volume')) m(mode) cross join (values (0), (1)) k(k)
          where event_type <> 'error' and (m.mode = 'tone' or value - 2 >= 0))
    group by 1, 2, 3, 4"""


@query("s05_timeline_daily", sql(f"select ticker, mode, cast(chunk_no as bigint) as chunk_no, date, {r('value')} from points",
                                 points=POINTS_SQL))
def s05(spark, sf):
    return rounded(news.daily_points(news.check_timelines(timeline_payloads(spark, sf))))


@query("s05_timeline_rejects", """
    select mode, case when event_type = 'error' then 'no timeline list' else 'negative article count' end as error,
           count(*) as n
    from events cross join (values ('tone'), ('volume')) m(mode)
    where event_type = 'error' or (mode = 'volume' and value - 2 < 0) group by 1, 2""")
def s05_rejects(spark, sf):
    errors = news.timeline_errors(news.check_timelines(timeline_payloads(spark, sf)))
    return errors.groupBy("mode", "error").agg(F.count(F.lit(1)).alias("n"))


@query("s06_tone_volume_assembly", sql(f"""
    select ticker, date, {r("max(case when mode = 'tone' then value end)", 'tone')},
           {r("max(case when mode = 'volume' then value end)", 'volume')}
    from (select *, row_number() over (partition by ticker, mode, date order by chunk_no desc) as k from points)
    where k = 1 group by 1, 2""", points=POINTS_SQL))
def s06(spark, sf):
    return rounded(news.assemble_daily(news.daily_points(news.check_timelines(timeline_payloads(spark, sf)))))


@query("s07_article_feeds", """
    select event_type, case when event_type = 'error' then 'limit reached' end as message, count(*) as n_payloads,
           cast(coalesce(sum(case when event_type = 'error' then null when event_type = 'click' then 0 else 2 end), 0) as bigint)
               as articles
    from events group by 1, 2""")
def s07(spark, sf):
    title = lambda t: F.struct(F.lit(t).alias("title"))                                # noqa: E731
    feed = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("limit reached").alias("Note")))).when(
        F.col("event_type") == "click", F.lit('{"feed": []}')).otherwise(
        F.to_json(F.struct(F.array(title("a"), title("b")).alias("feed"))))
    payloads = T.table(spark, sf, "events").select(F.col("event_type").alias("ticker"), feed.alias("payload"))
    return (news.check_feeds(payloads).groupBy(F.col("ticker").alias("event_type"), "message").agg(
        F.count(F.lit(1)).alias("n_payloads"), F.coalesce(F.sum("articles"), F.lit(0)).alias("articles")))


@query("s08_universe_flatten", sql("select ticker, keyword, sector from members"))
def s08(spark, sf):
    nested = T.members(spark, sf).groupBy("sector").agg(
        F.collect_list(F.struct("ticker", "keyword")).alias("members"))
    return universe.flatten_universe(nested)


NEWS_PHRASES = {"NATION_1": '"First Nation"', "NATION_4": '(Fourth OR "Nation Four")'}
INVESTOR_WORDS = {"NATION_1": "first stock", "NATION_9": "ninth stock"}


@query("s09_news_queries", sql(f"""
    select ticker, case ticker when 'NATION_1' then '"First Nation"' when 'NATION_4' then '(Fourth OR "Nation Four")'
                   else '"' || keyword || '"' end || ' {universe.FINANCE_CLAUSE} sourcelang:eng' as query,
           case ticker when 'NATION_1' then 'first stock' when 'NATION_9' then 'ninth stock' else keyword end as keyword
    from members"""))
def s09(spark, sf):
    m = T.members(spark, sf)
    queries = universe.resolve_news_queries(m, universe.mapping_table(spark, NEWS_PHRASES, "phrase"))
    words = universe.resolve_keywords(m, universe.mapping_table(spark, INVESTOR_WORDS, "investor_keyword"))
    return queries.join(words, "ticker")


@query("s10_horizon_filter", sql(f"""
    select ticker, date, close from prices
    where date between date '{HORIZON[0]}' and date '{HORIZON[1]}'"""))
def s10(spark, sf):
    return A.within_horizon(T.prices_daily(spark, sf), *HORIZON).select("ticker", "date", "close")


@query("s11_parquet_round_trip", sql(f"select ticker, week_ending_friday, {r('weekly_return')} from panel"))
def s11(spark, sf):
    path = _fresh(spark, "panel-table")
    files.write_table(T.panel(spark, sf), path)
    return rounded(files.read_table(spark, path, ["ticker", "week_ending_friday", "weekly_return"]))


@query("s12_csv_sinks", sql(f"select ticker, date, {r('daily_return', digits=5)} from returns"))
def s12(spark, sf):
    path = _fresh(spark, "returns-csv")
    files.write_csv(A.daily_log_returns(T.prices_daily(spark, sf)).select("ticker", "date", "daily_return"), path)
    back = spark.read.schema("ticker string, date date, daily_return double").option("header", True).csv(path)
    return rounded(back, 5)


@query("s13_panel_manifest", sql("""
    select 'build_panel' as step, count(*) as n_rows, count(distinct ticker) as n_tickers,
           count(distinct week_ending_friday) as n_weeks, min(week_ending_friday) as first_week,
           max(week_ending_friday) as last_week from panel"""))
def s13(spark, sf):
    manifest = T.panel(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"),
        F.count_distinct("week_ending_friday").alias("n_weeks"),
        F.min("week_ending_friday").alias("first_week"), F.max("week_ending_friday").alias("last_week"),
    ).select(F.lit("build_panel").alias("step"), "*")
    path = _fresh(spark, "manifest")
    files.write_manifest(manifest, path)
    return spark.read.schema(manifest.schema).json(path)


@query("s14_first_entities", sql("select ticker, sector from members order by ordinal limit 7"))
def s14(spark, sf):
    return A.first_entities(T.members(spark, sf), 7).select("ticker", "sector")


@query("s15_chunk_coverage", sql("""
    select p.ticker, p.chunk_no, p.chunk_start, p.chunk_end, count(s.date) as n_rows
    from (select t.ticker, c.* from (select distinct ticker from prices) t cross join plan c) p
         left join prices s on s.ticker = p.ticker and s.date between p.chunk_start and p.chunk_end
    group by all""", plan="""
    select cast(row_number() over (order by a) as bigint) as chunk_no, cast(a as date) as chunk_start,
           cast(least(a + interval 3 months - interval 1 day, date '2000-12-20') as date) as chunk_end
    from (select unnest(generate_series(date '1995-01-15', date '2000-12-20', interval 3 months)) as a)"""))
def s15(spark, sf):
    return A.chunk_coverage(T.prices_daily(spark, sf), "1995-01-15", "2000-12-20", 3)


# --- quality ----------------------------------------------------------------

@query("v01_input_coverage", sql("""
    select source, (select count(*) from members) as n_tickers, count(h.ticker) as n_present,
           (select count(*) from members) - count(m.ticker) as n_missing,
           case when (select count(*) from members) > count(m.ticker)
                then ((select count(*) from members) - count(m.ticker)) || ' tickers missing ' || source end as issue
    from (select 'prices' as source, ticker from prices group by 2
          union all select 'trends', ticker from interest where search_interest = 0 group by 2
          union all select 'late', ticker from prices where date < date '1995-01-09' group by 2) h
         left join members m using (ticker) group by source
    union all
    select source, (select count(*) from members), 0, (select count(*) from members),
           (select count(*) from members) || ' tickers missing ' || source
    from (select 'prices' as source, not exists (from prices) as none
          union all select 'trends', not exists (from interest where search_interest = 0)
          union all select 'late', not exists (from prices where date < date '1995-01-09')) where none"""))
def v01(spark, sf):
    prices = T.prices_daily(spark, sf)
    out = Q.input_coverage(T.members(spark, sf), {
        "prices": prices, "trends": T.interest_weekly(spark, sf).where("search_interest = 0"),
        "late": prices.where(F.col("date") < F.lit("1995-01-09").cast("date"))})
    return out


@query("v02_price_checks", sql("""
    select ticker, count(*) as n_rows, count(*) filter (adj_close is null) as n_null_adj_close,
           count(*) filter (volume = 1) as n_zero_volume, count(*) filter (same) as n_repeated_close,
           min(date) as first_date, max(date) as last_date,
           concat_ws('; ', case when count(*) filter (adj_close is null) > 0
                                then count(*) filter (adj_close is null) || ' NaN in Adj Close' end,
                     case when ticker = 'NATION_3' then 'short history: ' || count(*) || ' rows' end,
                     case when count(*) filter (volume = 1) > 0
                          then count(*) filter (volume = 1) || ' zero-volume days' end,
                     case when count(*) filter (same) > 5
                          then count(*) filter (same) || ' repeated-Close days' end) as flags
    from (select ticker, date, volume, case when volume >= 2 then adj_close end as adj_close,
                 round(close / 1000) = lag(round(close / 1000)) over (partition by ticker order by date) as same
          from prices) group by ticker"""))
def v02(spark, sf):
    # Coarse closes repeat, single-unit days count as zero volume and as missing.
    prices = T.prices_daily(spark, sf).select(
        "ticker", "date", F.round(F.col("close") / 1000).alias("close"),
        F.when(F.col("volume") >= 2, F.col("adj_close")).alias("adj_close"), (F.col("volume") - 1).alias("volume"))
    return Q.price_checks(prices, spark.createDataFrame([("NATION_3",)], "ticker string")).withColumn("flags", F.array_join("flags", "; "))


def news_rows(spark, sf) -> DataFrame:
    """News file lines: some dates out of order or unreadable, some tones missing."""
    bad = (F.col("event_type") == "signup") & (F.col("value") > 100)
    day = F.date_sub(F.to_date("ts"), F.when(F.col("event_type") == "error", 3).otherwise(0))
    return T.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("ticker"), (F.col("event_id") / 4096).cast("long").alias("block"),
        F.col("event_id").alias("position"), F.when(bad, "n/a").otherwise(day.cast("string")).alias("date"),
        F.when(F.col("value") < 400, (F.col("value") - 50).cast("string")).alias("tone"),
        F.when(F.col("event_type") == "view", F.floor("value") - 1).otherwise(F.col("value")).cast("string").alias("volume"))


LINES_SQL = """
    select cast(user_id as varchar) as ticker, event_id,
           case when not (event_type = 'signup' and value > 100)
                then cast(ts as date) - case when event_type = 'error' then 3 else 0 end end as day,
           case when value < 400 then value - 50 end as tone,
           case when event_type = 'view' then floor(value) - 1 else value end as volume
    from events"""
NEWS_STATS_SQL = """
    select ticker, count(*) as rows, count(*) filter (day is null) as n_bad_dates,
           count(*) filter (tone is null) as n_bad_tone, count(*) filter (volume is null) as n_bad_volume,
           count(*) - count(distinct day) - cast(count(*) filter (day is null) > 0 as integer) as n_duplicate_dates,
           count(*) filter (volume < 0) as n_negative, count(*) filter (abs(volume % 1) >= 1e-9) as n_fractional,
           count(*) filter (day < date '2024-01-02' or day > date '2024-01-31') as n_outside,
           min(day) as first_date, max(day) as last_date, min(tone) as tone_min, max(tone) as tone_max,
           min(volume) as volume_min, max(volume) as volume_max,
           bool_or(day is null or coalesce(day < before, false)) as unsorted
    from (select *, lag(day) over (partition by ticker order by event_id) as before from lines) group by ticker"""
NEWS_ERRORS_SQL = """
    concat_ws('; ', case when n_bad_dates > 0 then n_bad_dates || ' invalid date(s)' end,
        case when n_bad_tone > 0 then n_bad_tone || ' invalid/missing tone value(s)' end,
        case when n_bad_volume > 0 then n_bad_volume || ' invalid/missing volume value(s)' end,
        case when n_duplicate_dates > 0 then n_duplicate_dates || ' duplicate date(s)' end,
        case when unsorted then 'dates are not sorted ascending' end,
        case when n_negative > 0 then 'negative volume value(s)' end,
        case when n_fractional > 0 then 'non-integer article count(s)' end,
        case when coalesce(first_date > date '2024-01-02', true) then 'coverage starts after 2024-01-02' end,
        case when coalesce(last_date < date '2024-01-31', true) then 'coverage ends before 2024-01-31' end,
        case when n_outside > 0 then 'date(s) outside requested window' end)"""


@query("v03_news_file_checks", sql(f"""
    select ticker, rows, n_bad_dates, n_bad_tone, n_bad_volume, n_duplicate_dates, n_negative, n_fractional,
           n_outside, first_date, last_date, {r('tone_min')}, {r('tone_max')}, {r('volume_min')}, {r('volume_max')},
           unsorted, {NEWS_ERRORS_SQL} as errors
    from stats""", lines=LINES_SQL, stats=NEWS_STATS_SQL))
def v03(spark, sf):
    out = Q.validate_news(news_rows(spark, sf), "2024-01-02", "2024-01-31")
    return rounded(out.withColumn("errors", F.array_join("errors", "; ")))


@query("v04_news_directory", sql(f"""
    select ticker, coalesce({NEWS_ERRORS_SQL}, 'file is missing') as errors from stats
    union all select n_name, 'file is missing' from nation""", lines=LINES_SQL, stats=NEWS_STATS_SQL))
def v04(spark, sf):
    users = T.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("ticker"))
    expected = users.unionByName(T.members(spark, sf).select("ticker"))
    out = Q.validate_news_directory(news_rows(spark, sf), expected, "2024-01-02", "2024-01-31")
    return out.withColumn("errors", F.array_join("errors", "; "))


SPLIT_MOVES_SQL = """
    select ticker, date, close / lag(close) over e - 1 as close_return,
           adj_close / lag(adj_close) over e - 1 as adj_close_return
    from prices window e as (partition by ticker order by date)"""
SPLITS_SQL = "(values " + ", ".join(f"('{t}', date '{d}', {k})" for t, d, k in SPLITS) + ") s(ticker, split_date, ratio)"


@query("v05_split_checks", sql(f"""
    select s.ticker, split_date, ratio, {r('close_return')}, {r('adj_close_return')},
           abs(adj_close_return) < 0.02 as passed, abs(close_return) > 0.1 as flagged,
           case when m.ticker is null then 'split date outside horizon or missing' end as note
    from {SPLITS_SQL} left join split_moves m on m.ticker = s.ticker and m.date = split_date""",
    split_moves=SPLIT_MOVES_SQL))
def v05(spark, sf):
    return rounded(Q.split_checks(T.prices_daily(spark, sf), universe.splits_table(spark, SPLITS)))


def sourced_interest(spark, sf) -> DataFrame:
    """Three candidate sources: full, urgent orders outside Africa, low-priority orders."""
    single = T.interest_weekly(spark, sf).join(
        T.members(spark, sf).where("sector <> 'ASIA'").select("ticker"), "ticker", "left_semi")
    urgent = T.interest_weekly(spark, sf, orders_filter=F.col("o_orderpriority") == "1-URGENT").join(
        T.members(spark, sf).where("sector in ('AMERICA', 'EUROPE')").select("ticker"), "ticker", "left_semi")
    low = T.interest_weekly(spark, sf, orders_filter=F.col("o_orderpriority") == "5-LOW")
    return (single.withColumn("source", F.lit("single"))
            .unionByName(urgent.withColumn("source", F.lit("disambig")))
            .unionByName(low.withColumn("source", F.lit("anchored"))))


def _interest_sql(where: str) -> str:
    return f"""
        select ticker, date, round(100.0 * n / max(n) over (partition by ticker)) as search_interest
        from (select n_name as ticker,
                     cast(cast(o_orderdate as date) - cast(dayofweek(o_orderdate) as integer) as date) as date,
                     count(*) as n
              from orders join customer on c_custkey = o_custkey
                   join nation on n_nationkey = c_nationkey where {where} group by 1, 2)"""


SOURCED_SQL = {
    "urgent": _interest_sql("o_orderpriority = '1-URGENT'"), "low": _interest_sql("o_orderpriority = '5-LOW'"),
    "sourced": """
        select i.*, 'single' as source, 2 as prio from interest i join members using (ticker) where sector <> 'ASIA'
        union all select u.*, 'disambig', 1 from urgent u join members using (ticker)
                  where sector in ('AMERICA', 'EUROPE')
        union all select *, 'anchored', 3 from low""",
    "chosen": "select ticker, date, search_interest, source from (select *, min(prio) over (partition by ticker) "
              "as best from sourced) where prio = best",
    "information": """
        select ticker, source, count(*) as rows, count(distinct search_interest) as "distinct",
               round(100 * avg(case when search_interest = 0 then 1.0 else 0.0 end), 1) + 0.0 as zero_pct,
               count(distinct search_interest) = 1 as constant from chosen group by 1, 2""",
}


@query("v06_series_information", sql("select * from information", **SOURCED_SQL))
def v06(spark, sf):
    return rounded(Q.series_information(R.choose_source(sourced_interest(spark, sf))))


@query("v06_series_totals", sql("""
    select count(*) as n_tickers, count(*) filter (source = 'single') as n_from_single,
           count(*) filter (source = 'disambig') as n_from_disambig,
           count(*) filter (source = 'anchored') as n_from_anchored, count(*) filter (constant) as n_constant,
           quantile_cont("distinct", 0.5) as median_distinct from information""", **SOURCED_SQL))
def v06_totals(spark, sf):
    information = Q.series_information(R.choose_source(sourced_interest(spark, sf)))
    return Q.series_totals(stage(information, "information"))


@query("v07_flag_counts", sql(f"""
    select count(*) as n_tickers, count(*) filter (bad or jump) as n_flagged,
           count(*) filter (not (bad or jump)) as n_clean
    from (select ticker, count(*) filter (volume = 0) > 0 or count(*) filter (same) > 5 as bad
          from (select *, close = lag(close) over (partition by ticker order by date) as same from prices) group by 1)
         left join (select s.ticker as t, abs(close_return) > 0.1 as j from {SPLITS_SQL}
                    join split_moves m on m.ticker = s.ticker and m.date = split_date) on t = ticker
         cross join lateral (select coalesce(j, false) as jump)""", split_moves=SPLIT_MOVES_SQL))
def v07(spark, sf):
    prices = T.prices_daily(spark, sf)
    flags = Q.entity_flags(Q.price_checks(prices), Q.split_checks(prices, universe.splits_table(spark, SPLITS)))
    return Q.flag_counts(flags)


# --- cleaning and alignment ---------------------------------------------------

@query("c01_daily_log_return", sql(f"select ticker, date, {r('daily_return')} from returns"))
def c01(spark, sf):
    return rounded(A.daily_log_returns(T.prices_daily(spark, sf)).select("ticker", "date", "daily_return"))


@query("c02_week_ending_friday", """
    select cast(l_shipdate as date) as date,
           cast(cast(l_shipdate as date) + cast((12 - dayofweek(l_shipdate)) % 7 as integer) as date) as week_ending_friday,
           count(*) as n from lineitem group by 1, 2""")
def c02(spark, sf):
    day = F.to_date("l_shipdate")
    return (T.table(spark, sf, "lineitem").groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("n"))
            .select("date", week_ending_friday(F.col("date")).alias("week_ending_friday"), "n"))


@query("c03_weekly_return", sql(f"""
    select ticker, week_ending_friday, n_days, {r('weekly_return')}
    from (select *, max(n_days) over (partition by week_ending_friday) as most from week_sums)
    where n_days >= greatest(3, ceil(0.6 * most))"""))
def c03(spark, sf):
    return rounded(A.weekly_returns(A.daily_log_returns(T.prices_daily(spark, sf))))


@query("c04_interest_to_friday", sql("""
    select ticker, cast(date + 5 as date) as week_ending_friday, search_interest as trends_interest from interest"""))
def c04(spark, sf):
    return A.weekly_interest(T.interest_weekly(spark, sf))


@query("c04_interest_safe_lag", sql("""
    select ticker, cast(date + 12 as date) as week_ending_friday, search_interest as trends_interest from interest"""))
def c04_safe(spark, sf):
    return A.weekly_interest(T.interest_weekly(spark, sf), bucket_lag=12)


@query("c05_weekly_news", sql(f"""
    select ticker, cast(date + cast((12 - dayofweek(date)) % 7 as integer) as date) as week_ending_friday,
           {r('avg(tone)', 'gdelt_tone')}, cast(sum(volume) as double) as gdelt_volume from news group by 1, 2"""))
def c05(spark, sf):
    return rounded(A.weekly_news(T.news_daily(spark, sf)))


@query("c06_structural_start_mask", sql(f"""
    select ret.ticker, date, {r('case when date < first_date then null else daily_return end', 'daily_return')}
    from returns ret left join {STARTS_SQL} on s.ticker = ret.ticker"""))
def c06(spark, sf):
    masked, _ = P.price_policy(A.daily_log_returns(T.prices_daily(spark, sf)), universe.starts_table(spark, STARTS))
    return rounded(masked.select("ticker", "date", "daily_return"))


@query("c07_structural_zero_recode", sql(f"""
    select i.ticker, date, case when date < first_date and v = 0 then null else v end as search_interest
    from (select ticker, date, case when search_interest < 25 then 0 else search_interest end as v from interest) i
         left join {STARTS_SQL} on s.ticker = i.ticker"""))
def c07(spark, sf):
    interest = T.interest_weekly(spark, sf).withColumn(
        "search_interest", F.when(F.col("search_interest") < 25, 0.0).otherwise(F.col("search_interest")))
    out, _ = P.interest_policy(interest, universe.starts_table(spark, STARTS), "search_interest")
    return out.select("ticker", "date", "search_interest")


@query("c08_news_missing_zero", sql(f"""
    select ticker, date, {r('coalesce(case when tone > -40 then tone end, 0)', 'tone')},
           coalesce(case when volume > 1 then volume end, 0) as volume from news"""))
def c08(spark, sf):
    return rounded(P.news_policy(gappy_news(spark, sf), "zero")[0])


def gappy_news(spark, sf) -> DataFrame:
    return T.news_daily(spark, sf).select(
        "ticker", "date", F.when(F.col("tone") > -40, F.col("tone")).alias("tone"),
        F.when(F.col("volume") > 1, F.col("volume")).alias("volume"))


@query("c09_imputation_report", sql("""
    select 'prices' as source, 'n_nan_before' as metric, count(*) filter (v is null) as value from masked
    union all select 'prices', 'n_nan_after', count(*) filter (v is null or early) from masked
    union all select 'prices', 'n_structural_nan_added', count(*) filter (v is not null and early) from masked
    union all select 'trends', 'n_zero_before', count(*) filter (v = 0) from zeroed
    union all select 'trends', 'n_zero_after', count(*) filter (v = 0 and not early) from zeroed
    union all select 'trends', 'n_structural_replaced', count(*) filter (v = 0 and early) from zeroed
    union all select 'gdelt', 'n_tone_nan_before', count(*) filter (tone <= -40) from news
    union all select 'gdelt', 'n_volume_nan_before', count(*) filter (volume <= 1) from news
    union all select 'gdelt', 'n_tone_nan_after', 0 union all select 'gdelt', 'n_volume_nan_after', 0""",
    masked=f"""select daily_return as v, coalesce(date < first_date, false) as early
               from returns ret left join {STARTS_SQL} on s.ticker = ret.ticker""",
    zeroed=f"""select search_interest as v, coalesce(date < first_date, false) as early
               from interest i left join {STARTS_SQL} on s.ticker = i.ticker"""))
def c09(spark, sf):
    starts = universe.starts_table(spark, STARTS)
    _, prices = P.price_policy(A.daily_log_returns(T.prices_daily(spark, sf)), starts)
    _, trends = P.interest_policy(T.interest_weekly(spark, sf), starts, "search_interest")
    _, tone = P.news_policy(gappy_news(spark, sf))
    return P.imputation_report(prices, trends, tone)


@query("c10_source_priority", sql("select ticker, date, search_interest, source from chosen", **SOURCED_SQL))
def c10(spark, sf):
    return R.choose_source(sourced_interest(spark, sf))


@query("c11_batch_by_time", """
    with ent as (select event_id, ts from events where event_type <> 'error'),
         anc as (select event_id, ts from events where event_type = 'error'),
         hit as (select ent.event_id, anc.event_id as batch,
                        abs(epoch_us(ent.ts) - epoch_us(anc.ts)) as gap
                 from ent join anc on anc.ts between ent.ts - interval 60 seconds and ent.ts + interval 60 seconds
                 where abs(epoch_us(ent.ts) - epoch_us(anc.ts)) < 60000000)
    select cast(ent.event_id as varchar) as ticker, cast(b.batch as integer) as batch
    from ent left join (select event_id, batch from (select *, row_number() over (
                            partition by event_id order by gap, batch) as k from hit) where k = 1) b
         on b.event_id = ent.event_id""")
def c11(spark, sf):
    e = T.table(spark, sf, "events")
    entities = e.where("event_type <> 'error'").select(
        F.col("event_id").cast("string").alias("ticker"), F.lit(None).cast("int").alias("batch"), F.col("ts").alias("at"))
    marks = e.where("event_type = 'error'").select(F.col("event_id").cast("int").alias("batch"), F.col("ts").alias("at"))
    return R.match_batches(entities, marks, tolerance=60.0)


def batched_entities(spark, sf) -> DataFrame:
    """Each nation belongs to one of six batches; the sixth has no anchor series."""
    return T.members(spark, sf).select("ticker", (F.col("ordinal") % 6 + 1).cast("int").alias("batch"))


RESCALE_SQL = {
    "gappy": "select batch, date, case when search_interest < 5 then 0 else search_interest end as search_interest from anchors",
    "batches": "select ticker, cast(ordinal % 6 + 1 as integer) as batch from members",
    "mean_anchor": "select date, avg(search_interest) as anchor from gappy group by 1",
    "joined": """
        select i.ticker, i.date, i.search_interest, g.search_interest as anchor, 'batch_' || b.batch as anchor_source
        from interest i join batches b using (ticker) join gappy g on g.batch = b.batch and g.date = i.date
        union all
        select i.ticker, i.date, i.search_interest, m.anchor, 'average'
        from interest i join batches b using (ticker) join mean_anchor m on m.date = i.date
        where b.batch not in (select batch from gappy)""",
    "rescaled": """
        select *, search_interest / case when anchor <> 0 then anchor else coalesce(
                      last_value(nullif(anchor, 0) ignore nulls) over (partition by ticker order by date
                          rows between unbounded preceding and current row),
                      first_value(nullif(anchor, 0) ignore nulls) over (partition by ticker order by date
                          rows between current row and unbounded following)) end as rescaled_value,
               count(*) filter (anchor = 0) over (partition by ticker) as n_zero_weeks
        from joined""",
}


def gappy_anchors(spark, sf) -> DataFrame:
    """Thin weeks read as zero, as search indices report them."""
    return T.anchors(spark, sf).withColumn(
        "search_interest", F.when(F.col("search_interest") < 5, 0.0).otherwise(F.col("search_interest")))


@query("c12_anchor_choice", sql(f"select ticker, date, {r('anchor')}, anchor_source from joined", **RESCALE_SQL))
def c12(spark, sf):
    return rounded(R.anchor_for_entities(
        T.interest_weekly(spark, sf), batched_entities(spark, sf), gappy_anchors(spark, sf)))


def _rescaled(spark, sf, handling: str) -> DataFrame:
    interest = T.interest_weekly(spark, sf)
    anchor = R.anchor_for_entities(interest, batched_entities(spark, sf), gappy_anchors(spark, sf))
    return R.rescale(interest, anchor, handling)


@query("c13_rescale_ffill", sql(f"""
    select ticker, date, {r('rescaled_value', 'search_interest_rescaled')}, n_zero_weeks from rescaled""", **RESCALE_SQL))
def c13(spark, sf):
    return rounded(_rescaled(spark, sf, "ffill").select("ticker", "date", "search_interest_rescaled", "n_zero_weeks"))


@query("c13_rescale_clip", sql(f"""
    select ticker, date, {r('''search_interest / case when count(*) filter (anchor = 0) over (partition by ticker) > 0
        then greatest(anchor, 1.0) else anchor end''', 'search_interest_rescaled')} from joined""", **RESCALE_SQL))
def c13_clip(spark, sf):
    return rounded(_rescaled(spark, sf, "clip").select("ticker", "date", "search_interest_rescaled"))


@query("c13_rescale_drop_stats", sql(f"""
    select ticker, count(*) as rows, max(z) as n_zero_weeks, {r('avg(search_interest)', 'mean_raw', 4)},
           {r('avg(search_interest / nullif(anchor, 0))', 'mean_rescaled', 4)}, any_value(anchor_source) as anchor_source
    from (select *, count(*) filter (anchor = 0) over (partition by ticker) as z from joined)
    where anchor <> 0 group by 1""", **RESCALE_SQL))
def c13_drop(spark, sf):
    return rounded(R.rescale_stats(_rescaled(spark, sf, "drop")))


@query("c14_rescale_summary", sql(f"""
    select i.date, count(i.search_interest) as n_tickers, {r('avg(i.search_interest)', 'mean_raw')},
           {r('stddev_samp(i.search_interest)', 'std_raw')}, {r('avg(rescaled_value)', 'mean_rescaled')},
           {r('stddev_samp(rescaled_value)', 'std_rescaled')}
    from interest i left join rescaled s on s.ticker = i.ticker and s.date = i.date group by 1""", **RESCALE_SQL))
def c14(spark, sf):
    return rounded(R.rescale_summary(T.interest_weekly(spark, sf), _rescaled(spark, sf, "ffill")))


WINS_SQL = {"bounds": """
    select week_ending_friday, quantile_cont(weekly_return, 0.01) as r_lo, quantile_cont(weekly_return, 0.99) as r_hi,
           quantile_cont(trends_interest, 0.01) as t_lo, quantile_cont(trends_interest, 0.99) as t_hi
    from panel group by 1""",
    "wins": """
    select p.*, least(greatest(weekly_return, r_lo), r_hi) as weekly_return_wins,
           case when trends_interest is not null then least(greatest(trends_interest, t_lo), t_hi) end
               as trends_interest_wins
    from panel p join bounds using (week_ending_friday)"""}


@query("c15_winsorize", sql(f"""
    select week_ending_friday, ticker, {r('weekly_return_wins')}, {r('trends_interest_wins')} from wins""", **WINS_SQL))
def c15(spark, sf):
    out = X.winsorize(T.panel(spark, sf), ["weekly_return", "trends_interest"])
    return rounded(out.select("week_ending_friday", "ticker", "weekly_return_wins", "trends_interest_wins"))


@query("c16_rank_standardize", sql(f"""
    select week_ending_friday, ticker, {r(sql_pct('weekly_return'), 'weekly_return_rank')},
           {r(sql_pct('trends_interest'), 'trends_interest_rank')} from panel"""))
def c16(spark, sf):
    out = X.rank_standardize(T.panel(spark, sf), ["weekly_return", "trends_interest"])
    return rounded(out.select("week_ending_friday", "ticker", "weekly_return_rank", "trends_interest_rank"))


@query("c17_group_neutralize", sql(f"""
    select week_ending_friday, ticker,
           {r('weekly_return - avg(weekly_return) over (partition by week_ending_friday, sector)', 'weekly_return_sector_neutral')}
    from panel"""))
def c17(spark, sf):
    out = X.neutralize(T.panel(spark, sf), ["weekly_return"])
    return rounded(out.select("week_ending_friday", "ticker", "weekly_return_sector_neutral"))


CHAIN_SQL = {**WINS_SQL, "chain": f"""
    select *, {sql_pct('weekly_return_wins')} as weekly_return_wins_rank,
           {sql_pct('trends_interest_wins')} as trends_interest_wins_rank from wins"""}
CHAIN_OUT = f"""
    select week_ending_friday, ticker, sector, {r('weekly_return')}, {r('trends_interest')},
           {r('weekly_return_wins')}, {r('trends_interest_wins')}, {r('weekly_return_wins_rank')},
           {r('trends_interest_wins_rank')},
           {r('weekly_return_wins_rank - avg(weekly_return_wins_rank) over s', 'weekly_return_wins_rank_sector_neutral')},
           {r('trends_interest_wins_rank - avg(trends_interest_wins_rank) over s', 'trends_interest_wins_rank_sector_neutral')}
    from chain window s as (partition by week_ending_friday, sector)"""


def standardized_panel(spark, sf) -> DataFrame:
    """Flagship: the weekly panel winsorized, ranked and neutralized per date."""
    panel = T.panel(spark, sf)
    out, _ = X.standardize(panel, ["weekly_return", "trends_interest", "not_there"])
    return rounded(out.drop("gdelt_tone", "gdelt_volume"))


@query("c18_standardize_panel", sql(CHAIN_OUT, **CHAIN_SQL))
def c18(spark, sf):
    return standardized_panel(spark, sf)


@query("c18_standardize_report", sql("""
    select 'winsorize_standardize' as step, 0.01 + 0.0::double as lower, 0.99 + 0.0::double as upper,
           'weekly_return,trends_interest' as columns_processed, true as sector_neutralized,
           count(distinct week_ending_friday) as n_dates, count(distinct ticker) as n_tickers,
           'trends_interest_wins,trends_interest_wins_rank,trends_interest_wins_rank_sector_neutral,'
           || 'weekly_return_wins,weekly_return_wins_rank,weekly_return_wins_rank_sector_neutral' as output_columns
    from panel"""))
def c18_report(spark, sf):
    _, report = X.standardize(T.panel(spark, sf), ["weekly_return", "trends_interest"])
    return report.withColumn("columns_processed", F.array_join("columns_processed", ",")).withColumn(
        "output_columns", F.array_join("output_columns", ","))


@query("c19_panel_assembly", sql(f"""
    select week_ending_friday, p.ticker, sector, {r('weekly_return')}, trends_interest,
           {r('g.tone', 'gdelt_tone')}, g.volume as gdelt_volume
    from panel p left join (select ticker, date + 5 as d, search_interest - 50 as tone, search_interest * 2 as volume
                            from interest where search_interest > 60) g
         on g.ticker = p.ticker and g.d = week_ending_friday"""))
def c19(spark, sf):
    weekly = A.weekly_returns(A.daily_log_returns(T.prices_daily(spark, sf)), 1, 0.0)
    interest = A.weekly_interest(T.interest_weekly(spark, sf))
    # Busy weeks stand in for news here, since events cover another period.
    tone = interest.where("trends_interest > 60").select(
        "ticker", "week_ending_friday", (F.col("trends_interest") - 50).alias("gdelt_tone"),
        (F.col("trends_interest") * 2).alias("gdelt_volume"))
    return rounded(A.assemble_panel(weekly, T.members(spark, sf), interest, tone))


@query("c20_short_history", sql("""
    select ticker, count(daily_return) as history_days from returns group by 1
    having count(daily_return) between 1 and 999"""))
def c20(spark, sf):
    return A.short_history(A.daily_log_returns(T.prices_daily(spark, sf)), 1000)
