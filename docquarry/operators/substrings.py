"""An index for containment recall: which chunks hold a term anywhere inside their words.

Two steps of look-up tables stand in for reading all chunks. ``grams`` has every word of the collection under each of its
runs of one to ``GRAM`` characters; a term is looked up by the rarest of its own, and a word that has that run is
compared with the whole term. ``postings`` has the chunks of each word by field, with the weight of the best field. So a
request reads the buckets of its terms' runs, then those of the words they are in; what it makes is a row for each
chunk and term that meet, not one for each chunk and term.

A word is a run without white space of a field in lower case. A term with white space between its parts is found
by its longest part, and the chunks that has are compared with the whole term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.storage import shared_folder, written

GRAM = 3
#: Weights of the fields (fixed values).
WEIGHTS = {"file_name": 3, "heading": 3, "path": 2, "snippet": 1}
WHITE = r"(?U)\s+"


@dataclass
class Index:
    spark: SparkSession
    path: str
    chunk_type: str
    buckets: int

    def grams(self) -> DataFrame:
        return self.spark.read.schema("gram string, word string, bucket int").parquet(f"{self.path}/grams")

    def counts(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.path}/counts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"word string, chunk_id {self.chunk_type}, weight int, modified_at long, bucket int").parquet(f"{self.path}/postings")


def bucket_of(x: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")


def words_of(text: Column | str) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE)), "")


def grams_of(word: Column | str, sizes: range) -> Column:
    """The runs of a word of these sizes, each once."""
    n = F.char_length(word)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, sizes)))


def build(chunks: DataFrame, path: str | None = None, buckets: int | None = None) -> Index:
    """chunks: chunk_id, file_name, heading, path, snippet, modified_at. Words of a name or path that a document's
    chunks share are posted for each of them."""
    spark = chunks.sparkSession
    path = path or f"{shared_folder(spark)}/substrings-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = F.array(*(F.struct(F.lit(w).alias("weight"), words_of(f).alias("words")) for f, w in WEIGHTS.items()))
    rows = chunks.select("chunk_id", "modified_at", F.explode(each).alias("f")).select("chunk_id", "modified_at", "f.weight", "f.words")
    rows = rows.select("chunk_id", "modified_at", "weight", F.explode("words").alias("word"))
    rows = rows.groupBy("word", "chunk_id").agg(F.max("weight").alias("weight"), F.max("modified_at").alias("modified_at")).withColumn("bucket", bucket_of("word", buckets))
    # Dealt by bucket and chunk, so that a word that all chunks have is several files.
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(4)))
    dealt.sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{path}/postings")
    out = Index(spark, path, chunks.schema["chunk_id"].dataType.simpleString(), buckets)
    words = out.postings().select("word").distinct()
    runs = words.select("word", F.explode(grams_of("word", range(1, GRAM + 1))).alias("gram")).withColumn("bucket", bucket_of("gram", buckets))
    dealt = runs.repartition("bucket", F.pmod(F.xxhash64("word"), F.lit(4)))
    dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")
    counts = out.grams().groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return out


def buckets_in(rows: DataFrame, column: str, buckets: int) -> list[int]:
    """The buckets that a request needs: as many numbers as there are buckets, at most."""
    return sorted(r[0] for r in rows.select(bucket_of(column, buckets).alias("b")).distinct().collect())


def holders(terms: DataFrame, index: Index, chunks: DataFrame) -> DataFrame:
    """terms: term (lower case, each once). term, chunk_id, weight, modified_at of every chunk that holds a term, with the
    weight of its best field."""
    parts = F.split(F.trim("term"), WHITE)
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p: F.struct((-F.char_length(p)).alias("n"), p.alias("p")))), 1)["p"]
    asked = written(terms.filter("term <> ''").select("term", F.when(F.trim("term") == "", "").otherwise(longest).alias("piece")), "terms")
    pieces = asked.select("piece").distinct()
    size = F.least(F.char_length("piece"), F.lit(GRAM))
    runs = F.transform(F.sequence(F.lit(1), F.char_length("piece") - size + 1), lambda i: F.substring("piece", i, size))
    runs = written(pieces.filter("piece <> ''").select("piece", F.explode(F.array_distinct(runs)).alias("gram")), "runs")
    counts = index.counts().filter(F.col("bucket").isin(buckets_in(runs, "gram", index.buckets)))
    # A run that no word has: no word has the term either.
    known = runs.join(counts.select("gram", "n"), "gram", "left").groupBy("piece").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("missing"))
    rarest = written(known.filter("missing = 0").select("piece", "gram"), "rarest")
    grams = index.grams().filter(F.col("bucket").isin(buckets_in(rarest, "gram", index.buckets)))
    words = grams.join(rarest, "gram").filter(F.contains("word", F.col("piece"))).select("piece", "word")
    words = written(words, "words")
    posted = index.postings().filter(F.col("bucket").isin(buckets_in(words, "word", index.buckets))).join(words, "word")
    found = posted.groupBy("piece", "chunk_id").agg(F.max("weight").alias("weight"), F.max("modified_at").alias("modified_at"))
    rows = asked.join(found, "piece")
    whole = rows.filter(F.col("term") == F.col("piece")).select("term", "chunk_id", "weight", "modified_at")
    low = {f: F.lower(F.coalesce(f, F.lit(""))) for f in WEIGHTS}
    best = F.greatest(*(F.when(F.contains(low[f], F.col("term")), w).otherwise(0) for f, w in WEIGHTS.items()))
    long = rows.filter(F.col("term") != F.col("piece")).select("term", "chunk_id", "modified_at").join(chunks.select("chunk_id", *WEIGHTS), "chunk_id")
    long = long.select("term", "chunk_id", best.cast("int").alias("weight"), "modified_at").filter("weight > 0")
    return whole.unionByName(long)


def containment_scores(chunks: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """query_id, part, chunk_id, modified_at, raw, overlap, core of every chunk that holds a term of a part, by the index.

    asked: query_id, part, terms, core. raw: the terms' weights; overlap: 3 for file name and heading, else 1, of terms of
    two characters and more; core: core terms found.
    """
    lower = lambda c: F.array_distinct(F.transform(c, F.lower))
    each = asked.select("query_id", "part", lower("terms").alias("terms"), lower("core").alias("core"))
    each = each.select("query_id", "part", F.explode(F.array_distinct(F.concat("terms", "core"))).alias("term"), "terms", "core")
    each = written(each.select("query_id", "part", "term", F.array_contains("terms", F.col("term")).alias("is_term"), F.array_contains("core", F.col("term")).alias("is_core")), "parts")
    found = holders(each.select("term").distinct(), index, chunks)
    long = F.char_length("term") >= 2
    rows = each.join(found, "term").groupBy("query_id", "part", "chunk_id").agg(
        F.max("modified_at").alias("modified_at"),
        F.sum(F.when(F.col("is_term"), F.col("weight")).otherwise(0)).alias("raw"),
        F.sum(F.when(F.col("is_term") & long, F.when(F.col("weight") == 3, 3).otherwise(1)).otherwise(0)).alias("overlap"),
        F.sum(F.when(F.col("is_core"), 1).otherwise(0)).alias("core"),
    )
    return rows.filter("raw > 0")
