"""The corpus pipeline: quality, near duplicates, repeated passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

1. quality: documents whose score is under 0.3 go (the classifier learns from the labels of the corpus).
2. near_duplicates: one document of each group stays, the one with the smallest doc_id; of equal rows with
   a doc_id one stays.
3. repeats: passages of 100 bytes and more that an earlier document has are cut out of the texts; n_chars
   follows; a character that is cut through goes whole; a document may become empty and stays as such.
4. mixture: documents are put in the order of the interleaved sources (range-partitioned files, sorted); all
   rows stay, also those with a null or repeated doc_id.
5. token_ids: the ids of every text with digests of ids and decoded text.

Cases: null texts count as empty; empty tables pass; of equal rows stage 2 keeps one; different texts under one
doc_id are documents of their own there and parts of one in stage 3, where none loses what only another has repeated
(rows without a doc_id are not compared and stay).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, mixing, near_dup, quality, repeats
from docquarry.llm.common import stored, table, width

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=COLUMNS).filter(F.col("score") >= quality.CUT).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    known = docs.filter("doc_id IS NOT NULL")
    found = near_dup.classified(docs)[0]
    # What goes: texts other than their class's first, and of equal texts all rows but those with its smallest id.
    gone = found.filter("key <> winner OR doc_id <> class_id").select("doc_id", F.col("key").alias("gone")).distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    gone, again = stored(gone, "gone"), stored(again, "repeated")
    same = (known["doc_id"] == gone["doc_id"]) & (near_dup.text_key(known["text"]) == gone["gone"])
    kept = known.join(gone, same, "left_anti")
    if not again.isEmpty():
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once)
    return kept.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL"))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(docs, keep=("lang", "source"), with_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The mixture calls a null source ''; the documents keep theirs.
    mixed = mixing.mix(docs.withColumn("own_source", F.col("source")), keep=("text", "lang", "n_chars", "own_source")).withColumn("source", F.col("own_source"))
    return mixed.repartitionByRange(width(spark), "place").sortWithinPartitions("place").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, bpe.vocabulary("word_bpe_49k.json"), keep=("lang", "source"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("mixture", mixture_stage),
    ("token_ids", token_stage),
]

#: SQL can express neither the classifier nor the byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
