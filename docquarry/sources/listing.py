"""A folder's files as a data source that lists and does not read: names, sizes and times.

The driver lists folders level by level until there are enough of them to deal out; each is then walked by a task of
its own. Folders that are skipped are never entered. Filters on size and extension are taken over, so what they
exclude leaves no row. Files are opened by ``read_files``, which gets the paths that are wanted.

Arrow's file systems do the listing, on driver and executors; a URI that Arrow cannot open is an error.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

LISTING = "path string, file_name string, ext string, size long, modified_at long"
FOLDERS = 64  # folders that the driver deals out, about
ROWS = 4096
BYTES = 16 << 20  # of files in an Arrow batch, about


def opened(uri: str):
    """Arrow's file system for a path or URI, the path in it, and what its paths need in front to be URIs."""
    from pyarrow import fs

    plain = uri.removeprefix("file://").removeprefix("file:") if uri.startswith("file:") else uri
    if "://" in plain:
        system, path = fs.FileSystem.from_uri(plain)
        return system, path, plain[: len(plain) - len(path)] if plain.endswith(path) else plain.split("://")[0] + "://"
    return fs.LocalFileSystem(), plain, "file:"


def extension_of(name: str) -> str:
    """Lower case, without the dot; none for names that only begin with one."""
    head, dot, tail = name.rpartition(".")
    return tail.lower() if dot and head else ""


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class ListingReader(DataSourceReader):
    def __init__(self, root: str, skip: list[str]):
        self.root, self.skip = root, set(skip)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes comparisons of size and ext with constants; the others stay Spark's."""
        names = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in names and f.attribute in (("size",), ("ext",)):
                self.tests.append((f.attribute[0], names[type(f)], f.value))
            else:
                yield f

    def wanted(self, row: tuple) -> bool:
        values = {"ext": row[2], "size": row[3]}
        for column, test, value in self.tests:
            x = values[column]
            if not (x == value if test == "=" else x > value if test == ">" else x >= value if test == ">=" else x < value if test == "<" else x <= value if test == "<=" else x in value):
                return False
        return True

    def entered(self, name: str) -> bool:
        return not name.startswith(".") and name.lower() not in self.skip

    def listed(self, system, folder: str) -> tuple[list, list[str]]:
        """A folder's files, and the folders below it that are not skipped."""
        from pyarrow import fs

        infos = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [i for i in infos if i.type == fs.FileType.File], [i.path for i in infos if i.type == fs.FileType.Directory and self.entered(i.base_name)]

    def partitions(self):
        system, root, _ = opened(self.root)
        parts, waiting = [], deque([root.rstrip("/") or "/"])
        while waiting and len(waiting) + len(parts) < FOLDERS:
            folder = waiting.popleft()
            parts.append(Part(folder, False))
            waiting += self.listed(system, folder)[1]
        return parts + [Part(f, True) for f in waiting]

    def read(self, partition: Part):
        import pyarrow as pa

        system, _, front = opened(self.root)
        rows, waiting = [], [partition.folder]

        def batch():
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "file_name", "ext", "size", "modified_at"])

        while waiting:
            files, folders = self.listed(system, waiting.pop())
            if partition.deep:
                waiting += folders
            for i in files:
                row = (front + i.path, i.base_name, extension_of(i.base_name), i.size, i.mtime_ns // 1_000_000_000)
                if self.wanted(row):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()


class FolderListing(DataSource):
    """Options: path; skip - a JSON list of names of folders, in lower case, that are not entered."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], json.loads(self.options.get("skip", "[]")))


def listing(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path, file_name, ext, size, modified_at of the files below root."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("skip", json.dumps([s.lower() for s in skip])).load(root)


def read_files(paths: DataFrame) -> DataFrame:
    """paths: path. path, content, content_hash (SHA-256) of each; a file that is gone by now gives no row."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], names=["path", "content", "content_hash"])

        for b in batches:
            for path in b.column("path").to_pylist():
                system, at, _ = opened(path)
                try:
                    with system.open_input_stream(at) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                rows.append((path, content, hashlib.sha256(content).hexdigest()))
                size += len(content)
                if size >= BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(n, "path").mapInArrow(run, "path string, content binary, content_hash string")
