"""Incremental landing of entity files: only what changed is read, only weeks that differ are rewritten.

A ledger remembers every file that has landed: path, length, modification time
and a checksum of its bytes. A run lists the folder, which reads no file,
leaves out what the ledger knows by length and time, checks the bytes of the
rest, and scans what truly changed. The landed table has a folder per week;
old and new rows of the changed entities are compared and only weeks in which
they differ are replaced, others' rows in them included unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.calendar import week_ending_friday
from crosspanel.session import stage, unstage
from crosspanel.sources.files import read_prices

WEEK = "week_ending_friday"
ENTRY = "file string, length long, modified timestamp, checksum string, run long"


@dataclass
class Landed:
    """What a run did: files scanned, entities without a file any more, weeks rewritten."""
    scanned: int
    vanished: int
    weeks: int


def listing(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(file, length, modified, content) below ``path``; the bytes are read only where asked for."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
            .select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), "content"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of each file; none where there is no ledger yet."""
    try:
        entries = spark.read.schema(ENTRY).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)
    newest = entries.groupBy("file").agg(F.max_by(F.struct("length", "modified", "checksum"), "run").alias("e"))
    return newest.select("file", "e.*").where(F.col("checksum").isNotNull())


def pending(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file, length, modified, checksum, changed) of files that the ledger doesn't know as they are.

    ``changed`` is false where only the time moved and the bytes are the same.
    """
    fresh = files.join(known.select("file", "length", "modified"), ["file", "length", "modified"], "left_anti")
    summed = fresh.select("file", "length", "modified", F.sha2("content", 256).alias("checksum"))
    same = known.select("file", "checksum", F.lit(True).alias("_same"))
    return summed.join(same, ["file", "checksum"], "left").select(
        "file", "length", "modified", "checksum", F.col("_same").isNull().alias("changed"))


def _entity(file):
    return F.regexp_extract(file, r"([^/]+)\.[^./]+$", 1)


def land_prices(spark: SparkSession, path: str, table: str, ledger: str) -> Landed:
    """Bring the weekly folders of ``table`` up to the price files below ``path``.

    Rows are those of ``read_prices`` with their week; rows without a date have
    no week and are left out. A repeated run over the same files reads none of
    them; if a run dies before the ledger is written, the next one does its
    work again and finds nothing to differ.
    """
    known = stage(read_ledger(spark, ledger), "ledger")
    files = listing(spark, path)
    new = stage(pending(files, known), "pending")
    gone = stage(known.select("file").join(files.select("file"), "file", "left_anti"), "vanished")
    changed = [r["file"] for r in new.where("changed").select("file").collect()]
    vanished, weeks = gone.count(), 0
    if changed or vanished:
        weeks = _replace(spark, changed, new.where("changed").select(_entity(F.col("file")).alias("ticker")).unionByName(
            gone.select(_entity(F.col("file")).alias("ticker"))).distinct(), table)
    run = F.lit(spark._jvm.System.currentTimeMillis())
    entries = new.drop("changed").withColumn("run", run).unionByName(
        gone.select("file", F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"),
                    F.lit(None).cast("string").alias("checksum"), run.alias("run")))
    if new.count() or vanished:
        entries.coalesce(1).write.mode("append").parquet(ledger)
    return Landed(len(changed), vanished, weeks)


def _replace(spark: SparkSession, changed: list[str], entities: DataFrame, table: str) -> int:
    """Rewrite the weeks in which rows of ``entities`` differ between ``table`` and the changed files."""
    fields = ["ticker", "date", "close", "adj_close", "volume"]
    schema = "ticker string, date date, close double, adj_close double, volume double"
    fresh = read_prices(spark, changed) if changed else spark.createDataFrame([], schema)
    fresh = stage(fresh.where("date IS NOT NULL").withColumn(WEEK, week_ending_friday(F.col("date"))), "fresh-rows")
    try:
        old = spark.read.schema(f"{schema}, {WEEK} date").parquet(table)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        old = fresh.where("1 = 0")
    mine = old.join(F.broadcast(entities), "ticker", "left_semi")
    # Rows on one side only, repeated rows counted, name the weeks to rewrite.
    tally = (mine.select(*fields, WEEK, F.lit(-1).alias("s")).unionByName(fresh.select(*fields, WEEK, F.lit(1).alias("s")))
             .groupBy(*fields, WEEK).agg(F.sum("s").alias("s")).where("s <> 0"))
    weeks = stage(tally.select(WEEK).distinct(), "touched-weeks")
    n = weeks.count()
    if n:
        keep = old.join(F.broadcast(weeks), WEEK, "left_semi").join(F.broadcast(entities), "ticker", "left_anti")
        rows = stage(keep.select(*fields, WEEK).unionByName(
            fresh.join(F.broadcast(weeks), WEEK, "left_semi").select(*fields, WEEK)), "rewritten-weeks")
        (rows.repartition(WEEK).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(WEEK).parquet(table))
        emptied = weeks.join(rows.select(WEEK).distinct(), WEEK, "left_anti")
        for r in emptied.collect():                     # a folder per week that lost its last row
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{WEEK}={r[0]}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        unstage(rows)
    return n
