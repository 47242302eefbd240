"""Landing of files: unchanged ones are not read, changed ones rewrite their weeks only."""

import os
import time

import pandas as pd
from pyspark.sql import functions as F

from crosspanel.functions.calendar import week_ending_friday
from crosspanel.sources import files, ledger


def put(folder, ticker, days, shift=0.0):
    close = [100.0 + i + shift for i in range(len(days))]
    pd.DataFrame({"Date": days.date, "Close": close, "Adj Close": close, "Volume": 10}).to_csv(folder / f"{ticker}.csv", index=False)


def state(table):
    return {str(p.relative_to(table)): p.stat().st_mtime_ns for p in table.rglob("*.parquet")}


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select("ticker", "date", "close", "adj_close", "volume", "week_ending_friday").collect())


def test_landing(spark, tmp_path):
    source, table, book = tmp_path / "prices", tmp_path / "table", str(tmp_path / "ledger")
    source.mkdir()
    days = pd.bdate_range("2022-01-03", periods=30)
    for i, t in enumerate(("AA", "BB", "CC")):
        put(source, t, days, i)
    land = lambda: ledger.land_prices(spark, str(source), str(table), book)          # noqa: E731

    def full():
        return files.read_prices(spark, str(source)).where("date is not null").withColumn(
            "week_ending_friday", week_ending_friday(F.col("date")))

    def landed():
        return spark.read.parquet(str(table)).withColumn("week_ending_friday", F.col("week_ending_friday").cast("date"))

    assert land() == ledger.Landed(3, 0, 6) and rows_of(landed()) == rows_of(full())
    before = state(table)
    assert land() == ledger.Landed(0, 0, 0) and state(table) == before

    # Only the time of a file moves: its bytes are checked, nothing is scanned, and it is known from then on.
    later = time.time() + 60
    os.utime(source / "AA.csv", (later, later))
    assert land() == ledger.Landed(0, 0, 0) and state(table) == before
    assert ledger.pending(ledger.listing(spark, str(source)), ledger.read_ledger(spark, book)).count() == 0

    # One day of one file changes: one week is rewritten.
    text = (source / "BB.csv").read_text().replace("2022-01-12,108.0,108.0", "2022-01-12,1.5,108.0")
    (source / "BB.csv").write_text(text)
    assert land() == ledger.Landed(1, 0, 1) and rows_of(landed()) == rows_of(full())
    moved = {k for k, v in state(table).items() if before.get(k) != v}
    assert moved and all("2022-01-14" in k for k in moved)

    # A new file with a week of its own, a shorter one, and one that vanishes.
    put(source, "DD", pd.bdate_range("2022-03-07", periods=3))
    put(source, "CC", days[:10], 2)
    assert land().scanned == 2 and rows_of(landed()) == rows_of(full())
    (source / "DD.csv").unlink()
    assert land() == ledger.Landed(0, 1, 1) and rows_of(landed()) == rows_of(full())
    assert not (table / "week_ending_friday=2022-03-11").exists()
    assert land() == ledger.Landed(0, 0, 0)
