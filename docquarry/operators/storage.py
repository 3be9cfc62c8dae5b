"""Tables that are written once and read back, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without one a temporary folder, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docquarry.shared.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("docquarry.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows from files: what is used several times is computed once, and a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(rows: DataFrame, key: list[str], most: int) -> list[DataFrame]:
    """rows in blocks of about ``most`` by a hash of the key: a request of any size comes to the driver in parts.

    rows should be written; its number of rows is counted first.
    """
    from pyspark.sql import functions as F

    n = max(1, -(-rows.count() // most))
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64(*key), F.lit(n)) == k) for k in range(n)]


def filesystem(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that the program itself keeps small; none where it does not exist."""
    fs, at = filesystem(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = filesystem(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file that must not exist yet: a second writer of the same name is refused."""
    fs, at = filesystem(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
