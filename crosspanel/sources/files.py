"""File-per-entity CSV scans, and the Parquet, CSV and JSON sinks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.numeric import finite
from crosspanel.sources.entity_csv import read_entity_csv

NOT_SERIES = ["provenance", "cross_sectional_summary", "manifest"]


def _origin() -> list[Column]:
    """The entity (folder or file name), and where a row comes from."""
    folder = F.regexp_extract("_metadata.file_path", r"/ticker=([^/]+)/", 1)
    stem = F.regexp_extract("_metadata.file_name", r"(.+)\.csv$", 1)
    return [
        F.when(folder != "", F.url_decode(folder)).otherwise(stem).alias("ticker"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.monotonically_increasing_id().alias("position")]


def _files(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, file, line) with each file's first line."""
    lines = _files(spark).text(path).select(*_origin(), "value").where("block = 0")
    return lines.groupBy("ticker", "file").agg(F.min_by("value", "position").alias("line"))


def _cells(line: str) -> list[str]:
    return [c.strip().lower() for c in next(csv.reader([line]), [])]


def files_lacking(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(ticker, file, missing) of files whose header lacks a wanted field, with those fields."""
    have = F.transform(F.split("line", ","), lambda c: F.lower(F.trim(F.regexp_replace(c, '"', ""))))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(f.lower()) for f in fields]), have))
    return file_headers(spark, path).select("ticker", "file", missing.alias("missing")).where(F.size("missing") > 0)


def scan_entity_csv(spark: SparkSession, path: str, fields: list[str],
                    layout: list[str] | None = None) -> DataFrame:
    """Rows of one-CSV-per-entity files, the entity taken from the file name.

    A ``ticker=`` folder, as the per-entity sink writes, names the entity too.
    Columns are matched by each file's own header, whatever its width or order;
    files whose header lacks a wanted field are left out (``files_lacking``
    names them). The headers are read first, as lines. With one wording a single
    scan reads the wanted columns only. With several, tasks open the files and
    pick by each one's own header, however many wordings there are. Where all
    files are known to share one, pass it as ``layout``.

    Fields come back as text together with ``block`` and ``position`` (byte
    offset of the split, order inside it), ``file`` and ``modified``.
    """
    if layout:
        raw = _files(spark).schema(", ".join(f"`{c}` string" for c in layout)).option("header", True).csv(path)
        return raw.select(*_origin(), *[F.col(f"`{f}`") for f in fields])
    wanted = [f.lower() for f in fields]
    heads = file_headers(spark, path).select("file", "line")
    wordings = [_cells(r.line) for r in heads.select("line").where("line is not null").distinct().limit(2).collect()]
    if len(wordings) == 1 and set(wanted) <= set(wordings[0]):
        cells, = wordings
        names = [f"_c{i}" for i in range(len(cells))]
        raw = _files(spark).schema(", ".join(f"{n} string" for n in names)).option("header", True).option(
            "enforceSchema", True).csv(path)
        picked = [F.col(names[cells.index(w)]).alias(f) for f, w in zip(fields, wanted)]
        return raw.select(*_origin(), *picked).drop("file")
    return read_entity_csv(spark, path, fields).where(~F.element_at(F.split("file", "/"), -1).startswith("_")).select(
        "ticker", "block", "position", "modified", *(f"`{f}`" for f in fields))


def read_prices(spark: SparkSession, path: str, fields: tuple[str, ...] = (
        "Date", "Close", "Adj Close", "Volume"), layout: list[str] | None = None) -> DataFrame:
    """Daily prices: (ticker, date, close, adj_close, volume) as far as asked for."""
    rows = scan_entity_csv(spark, path, list(fields), layout).where(~F.col("ticker").isin(NOT_SERIES))
    out = ["ticker"]
    for f in fields:
        name = f.lower().replace(" ", "_")
        col = F.col(f"`{f}`")
        out.append((col.try_cast("date") if name == "date"
                    else finite(col.try_cast("double"))).alias(name))
    return rows.select(*out)


def read_interest(spark: SparkSession, path: str, layout: list[str] | None = None) -> DataFrame:
    """Weekly search interest: (ticker, date, search_interest, modified)."""
    rows = scan_entity_csv(spark, path, ["date", "search_interest"], layout)
    keep = ~F.col("ticker").isin(NOT_SERIES) & ~F.col("ticker").startswith("_")
    return rows.where(keep).select(
        "ticker", F.col("date").try_cast("date").alias("date"),
        finite(F.col("search_interest").try_cast("double")).alias("search_interest"), "modified")


def parse_batch(stem):
    """Batch number of an anchor file name; null when it has none."""
    return F.regexp_extract(stem, r"^_?anchor_batch(\d+)$", 1).try_cast("int")


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Anchor series per batch: (batch, date, search_interest, modified).

    One small file per request batch, whose name may begin with an underscore;
    ``path`` is their folder or a pattern of their names.
    """
    rows = read_entity_csv(spark, path, ["date", "search_interest"])
    return rows.select(
        parse_batch("ticker").alias("batch"), F.col("date").try_cast("date").alias("date"),
        finite(F.col("search_interest").try_cast("double")).alias("search_interest"),
        "modified").where(F.col("batch").isNotNull())


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, per_entity: bool = False) -> None:
    """CSV sink: one folder per entity, or one long table. Replaces old files."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy("ticker") if per_entity else writer).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
