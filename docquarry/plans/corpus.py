"""The input tables seen as the engine's own: documents with paths, chunks (lines), queries, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH, DAY = 1_704_067_200, 86_400


#: Tables of long texts with the key that deals them out where they are a file or two.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Texts in fewer files than there are cores (a file of one row group is one task) are dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, TEXTS[name])
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dir_path, file_name, path, modified_at, text."""
    d = table(spark, sf_dir, "documents")
    name = F.format_string("doc-%d.txt", "doc_id")
    directory = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"))
    return d.select("doc_id", F.concat(F.lit("/corpus/"), "source").alias("dir_path"), name.alias("file_name"), F.concat(directory, F.lit("/"), name).alias("path"), (F.col("doc_id") * DAY + EPOCH).alias("modified_at"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document: doc_id, seq, chunk_id, path, file_name, heading, snippet, modified_at."""
    d = documents(spark, sf_dir)
    lines = d.select("doc_id", "path", "file_name", "modified_at", F.posexplode(F.split("text", "\n")).alias("seq", "snippet"))
    return lines.select("doc_id", F.col("seq").cast("long").alias("seq"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seq").cast("string")).alias("chunk_id"), "path", "file_name", F.col("file_name").alias("heading"), "snippet", "modified_at")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query_text: the benchmark's passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, k, ts (unix seconds)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
