"""A Spark data source over one-CSV-per-entity files, each read by its own header.

Spark's file scans skip names with a leading underscore, and give all files one
layout. This source lists a pattern once, deals the files into partitions by
size, and opens them where the tasks run, through the file system that the
path's scheme names. A file is read line by line, so none is held whole.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import posixpath
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES, FILE_BYTES = 32 << 20, 1 << 20
_COLUMNS = "ticker string, file string, block long, modified timestamp, position long, header string"


def _file_system(path: str):
    """The file system of a qualified path and the path inside it."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def _plain(path: str, root: str) -> bool:
    """Not below a folder of unfinished or internal files, and no such file itself."""
    *folders, name = path[len(root):].strip("/").split("/")
    return not name.startswith(".") and not any(x.startswith((".", "_")) for x in folders)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        """(path inside the file system, place of the file in the listing)."""
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.pattern = options["roots"].split("\n"), options.get("pattern", "*.csv")
        self.fields = [f for f in options.get("fields", "").split("\n") if f]

    def partitions(self) -> list[Files]:
        from pyarrow import fs
        found = []
        for where in self.roots:
            system, root = _file_system(where)
            found += [x for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
                      if x.is_file and _plain(x.path, root) and fnmatch.fnmatchcase(x.base_name, self.pattern)]
        dealt, held = [], PARTITION_BYTES
        for k, x in enumerate(sorted(found, key=lambda x: x.path)):
            # Opening a file costs about as much as reading a megabyte.
            if held + x.size + FILE_BYTES > PARTITION_BYTES:
                dealt.append([])
                held = 0
            dealt[-1].append((x.path, k))
            held += x.size + FILE_BYTES
        return [Files(x) for x in dealt] or [Files([])]

    def read(self, partition: Files):
        system, _ = _file_system(self.roots[0])
        wanted = [f.lower() for f in self.fields]
        for path, k in partition.files:
            modified = system.get_file_info(path).mtime
            folder = re.search(r"/ticker=([^/]+)/", path)
            name = unquote(folder[1]) if folder else posixpath.basename(path).removesuffix(".csv")
            with system.open_input_stream(path) as raw, io.TextIOWrapper(
                    raw, "utf-8-sig", errors="replace", newline="") as lines:
                rows = csv.reader(lines)
                header = next(rows, [])
                cells = [c.strip().lower() for c in header]
                if not set(wanted) <= set(cells):
                    continue
                at = [cells.index(f) for f in wanted]
                for i, row in enumerate(r for r in rows if r):
                    values = [row[j] if j < len(row) and row[j] != "" else None for j in at]
                    yield (name, path, 0, modified, (k << 40) + i, ",".join(header), *values)


class EntityCsv(DataSource):
    """Options: roots (folders of one file system, one a line), pattern (of file names), fields (one a line)."""

    @classmethod
    def name(cls) -> str:
        return "entity_csv"

    def schema(self) -> str:
        fields = [f for f in self.options.get("fields", "").split("\n") if f]
        return ", ".join([_COLUMNS, *(f"`{f}` string" for f in fields)])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_entity_csv(spark: SparkSession, path: str, fields: list[str], pattern: str = "*.csv") -> DataFrame:
    """(ticker, file, block, modified, position, header, *fields) of every row of the files that have the fields.

    ``path`` is a folder, or a pattern of folders, or one of files that ends with .csv.
    Names that begin with an underscore are read too. An empty cell or one
    beyond a short row is null, rows without cells are left out, files without a
    row give none, and no file gives an empty table.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    if path.endswith(".csv"):
        path, pattern = posixpath.split(path)
    folder = hadoop.Path(path or ".")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    roots = [x.getPath().toString() for x in system.globStatus(folder) or []] or [system.makeQualified(folder).toString()]
    spark.dataSource.register(EntityCsv)
    return spark.read.format("entity_csv").options(
        roots="\n".join(roots), pattern=pattern, fields="\n".join(fields)).load()
