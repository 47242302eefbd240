"""Missing-data policies, news parsing and file validation on hand-made rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import alignment as A
from crosspanel.operators import policies as P
from crosspanel.operators import quality as Q
from crosspanel.operators import rescale as R
from crosspanel.sources import entity_csv, files, news, universe


def metrics(report):
    return {r.metric: r.value for r in report.collect()}


@pytest.fixture(scope="module")
def starts(spark):
    return universe.starts_table(spark)


def test_fixed_values():
    assert len(universe.SECTORS) == 11 and all(len(m) == 8 for m in universe.SECTORS.values())
    tickers = [t for m in universe.SECTORS.values() for t, _ in m]
    assert len(set(tickers)) == 88 and set(universe.NEWS_PHRASES) <= set(tickers)


def test_universe_queries(spark):
    m = universe.flatten_universe(universe.universe_table(spark))
    q = {r.ticker: r.query for r in universe.resolve_news_queries(
        m, universe.mapping_table(spark, universe.NEWS_PHRASES, "phrase")).collect()}
    assert q["AAPL"] == '"Apple Inc" ' + universe.FINANCE_CLAUSE + " sourcelang:eng"
    assert q["NVDA"] == '"Nvidia" ' + universe.FINANCE_CLAUSE + " sourcelang:eng"
    plain = universe.resolve_news_queries(
        m, universe.mapping_table(spark, universe.NEWS_PHRASES, "phrase"), finance_filter=False)
    assert plain.where("ticker = 'NVDA'").first().query == '"Nvidia" sourcelang:eng'
    k = {r.ticker: r.keyword for r in universe.resolve_keywords(
        m, universe.mapping_table(spark, universe.INVESTOR_KEYWORDS, "investor_keyword")).collect()}
    assert k["WMT"] == "Walmart stock" and k["MSFT"] == "Microsoft" and len(k) == 88


def test_price_policy(spark, starts):
    df = spark.createDataFrame([
        ("2022-01-18", "AAPL", None), ("2022-01-19", "AAPL", .01), ("2022-01-19", "CEG", None),
        ("2022-01-20", "CEG", .02), ("2021-09-01", "CEG", .05)], "date string, ticker string, daily_return double"
    ).withColumn("date", F.col("date").cast("date"))
    out, report = P.price_policy(df, starts)
    got = {(r.ticker, str(r.date)): r.daily_return for r in out.collect()}
    assert got[("CEG", "2021-09-01")] is None and got[("CEG", "2022-01-20")] == .02
    assert got[("AAPL", "2022-01-18")] is None and got[("AAPL", "2022-01-19")] == .01 and len(got) == 5
    assert metrics(report) == {"n_nan_before": 2, "n_nan_after": 3, "n_structural_nan_added": 1}


def zeros(spark):
    return spark.createDataFrame([
        ("2021-08-06", "CEG", 0.0), ("2021-08-13", "CEG", 6.0), ("2022-02-04", "CEG", 0.0),
        ("2021-08-06", "GE", 0.0), ("2021-08-13", "GE", 50.0)],
        "date string, ticker string, search_interest_rescaled double").withColumn("date", F.col("date").cast("date"))


def test_interest_policy(spark, starts):
    out, report = P.interest_policy(zeros(spark), starts)
    got = {(r.ticker, str(r.date)): r.search_interest_rescaled for r in out.collect()}
    assert got[("CEG", "2021-08-06")] is None and got[("CEG", "2021-08-13")] == 6.0
    assert got[("CEG", "2022-02-04")] == 0.0 and got[("GE", "2021-08-06")] == 0.0
    assert metrics(report) == {"n_zero_before": 3, "n_zero_after": 2, "n_structural_replaced": 1}
    off, report = P.interest_policy(zeros(spark), starts, recode_structural_zeros=False)
    assert off.where("search_interest_rescaled is null").count() == 0
    assert metrics(report)["n_structural_replaced"] == 0


def test_replaced_counts_add_up_over_entities(spark):
    two = universe.starts_table(spark, [("CEG", "2022-01-19"), ("GE", "2022-01-19")])
    _, report = P.interest_policy(zeros(spark), two)
    assert metrics(report)["n_structural_replaced"] == 2


def test_news_policy(spark):
    df = spark.createDataFrame([("2024-01-01", "A", 1.5, 10.0), ("2024-01-02", "A", None, None)],
                               "date string, ticker string, tone double, volume double")
    out, report = P.news_policy(df)
    assert [tuple(r)[2:] for r in out.orderBy("date").collect()] == [(1.5, 10.0), (0.0, 0.0)]
    assert metrics(report) == {"n_tone_nan_before": 1, "n_volume_nan_before": 1,
                               "n_tone_nan_after": 0, "n_volume_nan_after": 0}
    out, report = P.news_policy(df, "nan")
    assert out.where("tone is null").count() == 1 and metrics(report)["n_tone_nan_after"] == 1
    with pytest.raises(ValueError):
        P.news_policy(df, "mean")
    assert P.imputation_report(report, report).count() == 8


def checked(spark, *payloads):
    rows = [(f"T{i}", mode, 1, json.dumps(p)) for i, (mode, p) in enumerate(payloads)]
    return news.check_timelines(spark.createDataFrame(
        rows, "ticker string, mode string, chunk_no long, payload string"))


def line(*points):
    return {"timeline": [{"series": "a"}, {"series": "b", "data": [{"date": d, "value": v} for d, v in points]}]}


def test_timeline_shapes(spark):
    out = checked(
        spark, ("tone", line(("20240101T000000Z", 1.5))), ("tone", {}), ("tone", {"timeline": "x"}),
        ("tone", {"timeline": []}), ("tone", {"timeline": [{"series": "a"}]}), ("tone", line(("nope", 1))),
        ("tone", line(("20240101T000000Z", "x"))), ("volume", line(("20240101T000000Z", -1))),
        ("tone", {"timeline": [{"data": [{"date": "20240101T000000Z"}]}]}), ("mood", line()))
    errors = {r.ticker: r.error for r in out.select("ticker", "error").collect()}
    assert errors == {
        "T0": None, "T1": "no timeline list", "T2": "no timeline list", "T3": None,
        "T4": "no series with a data list", "T5": "invalid date or value", "T6": "invalid date or value",
        "T7": "negative article count", "T8": "invalid date or value", "T9": "unknown series"}
    assert news.timeline_errors(out).count() == 8
    assert [tuple(r) for r in news.daily_points(out).collect()] == [("T0", "tone", 1, dt.date(2024, 1, 1), 1.5)]


def test_tone_averages_and_volume_adds(spark):
    points = [("2024-01-01T00:00:00Z", "2"), ("2024-01-01T12:00:00Z", 4)]
    out = checked(spark, ("tone", line(*points)), ("volume", line(*points)))
    got = {r.mode: r.value for r in news.daily_points(out).collect()}
    assert got == {"tone": 3.0, "volume": 6.0}


def test_assembly_keeps_last_chunk_and_aligns(spark):
    rows = [("A", "tone", 1, "2024-01-01", 1.0), ("A", "tone", 2, "2024-01-01", 9.0),
            ("A", "volume", 1, "2024-01-02", 5.0)]
    points = spark.createDataFrame(rows, "ticker string, mode string, chunk_no long, date string, value double")
    got = {r.date: (r.tone, r.volume) for r in news.assemble_daily(points).collect()}
    assert got == {"2024-01-01": (9.0, None), "2024-01-02": (None, 5.0)}
    members = spark.createDataFrame([("A",), ("B",)], "ticker string")
    assert [r.ticker for r in news.uncovered(members, news.assemble_daily(points)).collect()] == ["B"]


def test_feeds(spark):
    rows = [("A", '{"feed": [{"t": 1}, {"t": 2}]}'), ("B", '{"feed": []}'), ("C", '{"Note": "slow"}'),
            ("D", '{"Error Message": "bad"}'), ("E", '{"x": 1}')]
    got = {r.ticker: (r.articles, r.message, r.failed) for r in news.check_feeds(
        spark.createDataFrame(rows, "ticker string, payload string")).collect()}
    assert got == {"A": (2, None, False), "B": (0, None, False), "C": (None, "slow", True),
                   "D": (None, "bad", True), "E": (None, '{"x": 1}', True)}


def test_chunks(spark):
    got = [(str(r.chunk_start), str(r.chunk_end)) for r in A.calendar_chunks(
        spark, "2024-01-15", "2024-03-20", 1).collect()]
    assert got == [("2024-01-15", "2024-02-14"), ("2024-02-15", "2024-03-14"), ("2024-03-15", "2024-03-20")]
    one = A.calendar_chunks(spark, "2024-01-15", "2024-01-15", 3).collect()
    assert len(one) == 1 and one[0].chunk_end == dt.date(2024, 1, 15)
    whole = A.calendar_chunks(spark, "2020-01-31", "2024-12-31", 1).orderBy("chunk_no").collect()
    assert all((b.chunk_start - a.chunk_end).days == 1 for a, b in zip(whole, whole[1:]))
    assert whole[0].chunk_start == dt.date(2020, 1, 31) and whole[-1].chunk_end == dt.date(2024, 12, 31)
    for bad in (("2024-01-01", "2024-02-01", 0), ("2024-02-01", "2024-01-01", 1)):
        with pytest.raises(ValueError):
            A.calendar_chunks(spark, *bad)


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)


def test_news_directory(spark, tmp_path):
    write(tmp_path, "GOOD.csv", "date,tone,volume\n2024-01-01,1.0,3\n2024-01-02,2.0,4\n")
    write(tmp_path, "BAD.csv", "date,tone,volume\n2024-01-02,1.0,2.5\n2024-01-02,,-1\n2024-01-01,1,1\nxx,1,1\n")
    rows = files.scan_entity_csv(spark, str(tmp_path), ["date", "tone", "volume"])
    write(tmp_path, "HALF.csv", "date,count\n2024-01-02,1\n")
    rows = files.scan_entity_csv(spark, str(tmp_path), ["date", "tone", "volume"])
    lacking = files.files_lacking(spark, str(tmp_path), ["date", "tone", "volume"])
    expected = spark.createDataFrame([("GOOD",), ("BAD",), ("GONE",), ("HALF",)], "ticker string")
    got = {r.ticker: r.errors for r in Q.validate_news_directory(rows, expected, "2024-01-01", "2024-01-02", lacking).collect()}
    assert got == {"GONE": ["file is missing"], "HALF": ["missing column(s): tone, volume"], "BAD": [
        "1 invalid date(s)", "1 invalid/missing tone value(s)", "1 duplicate date(s)",
        "dates are not sorted ascending", "negative volume value(s)", "non-integer article count(s)"]}
    stats = {r.ticker: r for r in Q.validate_news(rows, "2024-01-01", "2024-01-02").collect()}
    assert stats["GOOD"].rows == 2 and stats["GOOD"].volume_max == 4.0 and stats["GOOD"].errors == []
    late = Q.validate_news(rows.where("ticker = 'GOOD'"), "2023-12-01", "2024-01-01").first().errors
    assert late == ["coverage starts after 2023-12-01", "date(s) outside requested window"]
    with pytest.raises(ValueError):
        Q.validate_news_directory(rows, expected, "2024-01-02", "2024-01-01")


def test_wide_files(spark, tmp_path):
    """Any number of columns in any order; one wording of the header reads the wanted columns only."""
    names = [f"x{k}" for k in range(40)]
    write(tmp_path, "W.csv", ",".join([*names, "date", '"tone"', "volume"]) + "\n" + ",".join(["0"] * 40 + ["2024-01-01", "1.5", "3"]) + "\n")
    fields = ["date", "tone", "volume"]
    one = files.scan_entity_csv(spark, str(tmp_path), fields)
    assert [tuple(r) for r in one.select("ticker", *fields).collect()] == [("W", "2024-01-01", "1.5", "3")]
    plan = one.select("tone")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_c41:string>" in plan
    write(tmp_path, "N.csv", "volume,tone,date\n4,2.5,2024-01-02\n")
    both = files.scan_entity_csv(spark, str(tmp_path), fields).select("ticker", *fields).collect()
    assert sorted(map(tuple, both)) == [("N", "2024-01-02", "2.5", "4"), ("W", "2024-01-01", "1.5", "3")]
    assert files.files_lacking(spark, str(tmp_path), ["x39"]).first().ticker == "N"


def test_order_is_checked_across_blocks(spark):
    rows = [("A", 0, 0, "2024-01-03"), ("A", 0, 1, "2024-01-04"), ("A", 1, 2, "2024-01-01"), ("A", 1, 3, "2024-01-02")]
    df = spark.createDataFrame(rows, "ticker string, block long, position long, date string").selectExpr(
        "*", "'1' as tone", "'1' as volume")
    assert Q.validate_news(df, "2024-01-01", "2024-01-04").first().unsorted


def test_entity_files(spark, tmp_path):
    write(tmp_path, "BRK-B.csv", "Date,Close,Adj Close,Volume\n2024-01-02,10,9,0\n2024-01-03,nan,,5\n")
    write(tmp_path, "X.csv", "Volume,Date,Adj Close,Close\n7,2024-01-02,1.5,2.5\n")
    write(tmp_path, "NOVOL.csv", "Date,Close\n2024-01-02,1\n")
    write(tmp_path, "provenance.csv", "Date,Close,Adj Close,Volume\n2024-01-02,1,1,1\n")
    got = {(r.ticker, str(r.date)): (r.close, r.adj_close, r.volume)
           for r in files.read_prices(spark, str(tmp_path)).collect()}
    assert got == {("BRK-B", "2024-01-02"): (10.0, 9.0, 0.0), ("BRK-B", "2024-01-03"): (None, None, 5.0),
                   ("X", "2024-01-02"): (2.5, 1.5, 7.0)}
    assert files.read_prices(spark, str(tmp_path), ("Date", "Close")).select("ticker").distinct().count() == 3


def test_hidden_anchor_files(spark, tmp_path):
    write(tmp_path, "_anchor_batch1.csv", "date,search_interest\n2024-01-07,50\n")
    write(tmp_path, "_anchor_batch12.csv", "date,search_interest\n2024-01-07,60\n")
    write(tmp_path, "_anchor_batchX.csv", "date,search_interest\n2024-01-07,70\n")
    got = {r.batch: r.search_interest for r in files.read_anchors(spark, f"{tmp_path}/_anchor_batch*.csv").collect()}
    assert got == {1: 50.0, 12: 60.0}


def test_files_by_their_own_headers(spark, tmp_path, monkeypatch):
    """Every file by its own header, in tasks of bounded bytes; awkward files and cells have defined results."""
    for k in range(30):
        extra = ",".join(f"c{k}_{j}" for j in range(k))
        write(tmp_path, f"E{k}.csv", f"{extra}{',' if extra else ''}Value,Date\n{'0,' * k}{k},2024-01-01\n")
    write(tmp_path, "_U.csv", "date,value\n2024-01-02,u\n")
    write(tmp_path, "EMPTY.csv", "")
    write(tmp_path, "HEAD.csv", "date,value\n")
    write(tmp_path, "LACK.csv", "date\n2024-01-02\n")
    write(tmp_path, "AWK.csv", '\ufeff"Date", VALUE \n2024-01-03,"a,""b"""\n\n2024-01-04\n2024-01-05,\n')
    (tmp_path / "ticker=B%2FC").mkdir()
    (tmp_path / "ticker=B%2FC" / "part-0.csv").write_text("value,date\n9,2024-01-06\n")
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "X.csv").write_text("value,date\n9,2024-01-06\n")
    monkeypatch.setattr(entity_csv, "PARTITION_BYTES", 5 << 20)
    rows = entity_csv.read_entity_csv(spark, str(tmp_path), ["date", "value"])
    assert rows.rdd.getNumPartitions() > 5
    got = sorted((r.ticker, r.date, r.value) for r in rows.collect() if not r.ticker.startswith("E"))
    assert got == sorted([("_U", "2024-01-02", "u"), ("AWK", "2024-01-03", 'a,"b"'), ("AWK", "2024-01-04", None),
                          ("AWK", "2024-01-05", None), ("B/C", "2024-01-06", "9")], key=str)
    assert {r.ticker: r.value for r in rows.where("ticker like 'E%'").collect()} == {f"E{k}": str(k) for k in range(30)}
    assert rows.where("modified is null").count() == 0
    assert files.scan_entity_csv(spark, str(tmp_path), ["date", "value"]).where("ticker = '_U'").count() == 0
    assert entity_csv.read_entity_csv(spark, f"{tmp_path}/none", ["date"]).count() == 0


def interest(spark, values, ticker="A"):
    rows = [(ticker, f"2024-01-{7 + i:02d}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date string, search_interest double").withColumn(
        "date", F.col("date").cast("date"))


def test_zero_anchor_handling(spark):
    raw = interest(spark, [10, 20, 30, 40])
    anchor = interest(spark, [0, 4, 0, 8]).select("ticker", "date", F.col("search_interest").alias("anchor"),
                                                  F.lit("batch_1").alias("anchor_source"))
    def got(how):
        return [r[0] for r in R.rescale(raw, anchor, how).orderBy("date").select("search_interest_rescaled").collect()]
    assert got("ffill") == [2.5, 5.0, 7.5, 5.0]
    assert got("clip") == [10.0, 5.0, 30.0, 5.0]
    assert got("drop") == [5.0, 5.0]
    with pytest.raises(ValueError):
        R.rescale(raw, anchor, "mean")
    half = anchor.withColumn("anchor", F.col("anchor") / 16 + 0.25)
    assert R.rescale(raw, half, "clip").orderBy("date").first().search_interest_rescaled == 40.0
    stats = R.rescale_stats(R.rescale(raw, anchor, "drop")).first()
    assert stats.rows == 2 and stats.n_zero_weeks == 2 and stats.mean_raw == 30.0


def test_anchor_choice_without_average(spark):
    days = interest(spark, [1, 2]).unionByName(interest(spark, [3], "B"))
    entities = spark.createDataFrame([("A", 1), ("B", 9)], "ticker string, batch int")
    anchors = interest(spark, [5, 6]).select(F.lit(1).alias("batch"), "date", "search_interest")
    assert R.anchor_for_entities(days, entities, anchors, use_average=False).select("ticker").distinct().count() == 1
    both = R.anchor_for_entities(days, entities, anchors).where("ticker = 'B'").first()
    assert both.anchor_source == "average" and both.anchor == 5.0


def test_nearest_batch(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)           # noqa: E731
    anchors = spark.createDataFrame([(1, at(0)), (2, at(9)), (3, at(30)), (4, at(30))], "batch int, at timestamp")
    asked = [("a", None, at(4)), ("b", None, at(4.9)), ("c", None, at(5)), ("d", None, at(20)), ("e", 7, at(0)),
             ("f", None, at(31)), ("g", None, at(14)), ("h", None, at(25.1)), ("i", None, None)]
    got = {r.ticker: r.batch for r in R.match_batches(
        spark.createDataFrame(asked, "ticker string, batch int, at timestamp"), anchors).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": None, "e": 7, "f": 3, "g": None, "h": 3, "i": None}
