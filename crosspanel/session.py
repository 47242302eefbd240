"""Session helpers: defaults for a new session, and staged tables.

An operator that reads an intermediate result more than once stages it: the
rows are written once as Parquet to the shared folder named by
``spark.checkpoint.dir`` and read back. That cuts the lineage (a lost executor
re-reads files, not the whole history), keeps column pruning and filter
pushdown for every later reader, and gives the planner real sizes to pick
broadcast or shuffle joins from.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "crosspanel") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's, or a fresh one in local mode."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def stage(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader over it.

    Rows are counted while they are written, so later steps know the size.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/crosspanel/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._row_bound, out._stage_path = seen.get["rows"], path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the files of a table that ``stage`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_bound(df: DataFrame) -> int | None:
    """Rows ``df`` has at most, where staging made that known."""
    return df.__dict__.get("_row_bound")


def bounded_like(out: DataFrame, source: DataFrame) -> DataFrame:
    """``out``, which has no more rows than ``source``, inheriting its bound."""
    out._row_bound = row_bound(source)
    return out
