"""Streams: files taken in as they appear, logs folded batch by batch; both restart from their checkpoint."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def stream_documents(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Parquet files of documents as they appear."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes tokens per document; a batch goes to a folder of its own number, so a repeated one replaces itself."""
    from docquarry.operators.retrieval import postings

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str = "path", order: tuple[str, ...] = ("modified_at",), buckets: int = 64) -> StreamingQuery:
    """Keeps the last version of every document, by ``order`` (then by all columns, so that a repeated batch agrees).

    The table is dealt into buckets of the key; a batch writes anew only the buckets that it touches, each under
    the batch's number, and ``latest_version`` reads the newest of each. A batch that is repeated replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        first = [F.desc(c) for c in order] + [F.desc(c) for c in batch.columns if c not in order]
        last = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*first))).filter("_n = 1").drop("_n")
        last = last.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        old = latest_version(batch.sparkSession, target, batch.schema, before=number)
        touched = old.join(last.select("bucket").distinct(), "bucket", "left_semi")
        both = touched.unionByName(last)
        newest = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*first))).filter("_n = 1").drop("_n")
        newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, target: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The rows of the newest version of every bucket (of those below ``before``), with their bucket."""
    full = StructType([*schema.fields, StructField("version", LongType()), StructField("bucket", IntegerType())])
    try:
        rows = spark.read.schema(full).option("basePath", target).parquet(target)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], full)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each bucket
    return rows.join(F.broadcast(newest), ["bucket", "version"]).select(*schema.names, "bucket")


def activity_counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """ts (timestamp), event_type: counts per window and type, late rows up to the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
