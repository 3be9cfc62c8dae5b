"""A keyword index by field: postings dealt into buckets by their term, BM25 over six fields.

What is found is a chunk. Name, path, extension and content belong to a document and hold for all of its chunks;
heading and snippet (which repeats name, path and heading) are the chunk's own. Postings of a document stand
once, with its number of chunks as their weight, so a term of a long document costs one row, not one for each chunk.

An index is a list of segments, each written once: ``postings`` by level (document, chunk) and bucket, sorted by field
and term; ``terms`` with the number of chunks that have a term in a field; ``units``, the chunks. A request reads
only the buckets of its terms. Documents that were replaced or deleted stay in their segment until it is merged; rows
of theirs are left out by ``live``.

A chunk has a term if any of its fields has it. Chunks with all terms of a query count, where there is none those with
any; the score adds BM25 over fields and terms.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import scoring as S
from docquarry.functions import text as X
from docquarry.operators.ranking import DIGITS, TERM_BYTES, strict_or_loose, top_k
from docquarry.operators.storage import shared_folder, written

#: Fields by their numbers in the postings.
FIELDS = ("file_name", "path_text", "ext", "content", "heading", "snippet")
OF_DOCUMENT = 4  # the first fields are the document's
SPLIT = 4  # files of a bucket at most: a term that all documents have is no single task's
BITS = 62  # terms of a query in one mask

POSTINGS = "field int, term string, document_id {id}, chunk_id {chunk}, length int, weight long"
TERMS = "field int, term string, df long"


@dataclass
class Index:
    """Where the segments are and how many buckets they have."""

    spark: SparkSession
    document_type: str
    chunk_type: str
    segments: list[str] = field(default_factory=list)
    buckets: int = 1

    def read(self, name: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{s}/{name}").withColumn("segment", F.lit(s)) for s in self.segments]
        out = parts[0] if parts else self.spark.createDataFrame([], schema + ", segment string")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def postings(self) -> DataFrame:
        return self.read("postings", POSTINGS.format(id=self.document_type, chunk=self.chunk_type) + ", level string, bucket int")

    def terms(self) -> DataFrame:
        return self.read("terms", TERMS + ", bucket int")

    def units(self) -> DataFrame:
        return self.read("units", f"document_id {self.document_type}, chunk_id {self.chunk_type}")


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def indexable(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.octet_length(t) <= TERM_BYTES)


def fields_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, chunk_id, weight, fields: the terms of every document and of every chunk by field."""
    of = lambda n, tokens: F.struct(F.lit(n).alias("field"), indexable(tokens).alias("terms"))
    about = chunks.groupBy("document_id").agg(F.count("*").alias("weight"), F.min("chunk_id").alias("chunk_id"), *(F.first(c).alias(c) for c in ("file_name", "path", "ext")))
    whole = about.join(documents.select("document_id", "content"), "document_id")
    ext = X.search_tokens("ext")
    ext = F.when(F.size(ext) > 0, F.array(F.array_join(ext, " "))).otherwise(ext)  # one term, as it stands
    shared = F.array(of(0, X.search_tokens("file_name")), of(1, X.search_tokens("path")), of(2, ext), of(3, X.search_tokens("content")))
    own = F.array(of(4, X.search_tokens("heading")), of(5, X.search_tokens(F.concat_ws(" ", "file_name", "path", "heading", "snippet"))))
    columns = ["document_id", "chunk_id", "weight"]
    return whole.select(*columns, F.lit("document").alias("level"), shared.alias("fields")).unionByName(chunks.withColumn("weight", F.lit(1).cast("long")).select(*columns, F.lit("chunk").alias("level"), own.alias("fields")))


def build(chunks: DataFrame, documents: DataFrame, path: str | None = None, buckets: int | None = None) -> Index:
    """Writes a segment of these documents. chunks: chunk_id, document_id, file_name, path, ext, heading, snippet;
    documents: document_id, content. Chunks without their document are not found.

    buckets: of all segments of an index, as many as the session has shuffle partitions if not given.
    """
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or f"{shared_folder(spark)}/segment-{uuid.uuid4().hex}"
    each = fields_of(chunks, documents).select("document_id", "chunk_id", "weight", "level", F.explode("fields").alias("f"))
    each = each.select("document_id", "chunk_id", "weight", "level", "f.field", F.size("f.terms").alias("length"), "f.terms")
    rows = each.select("field", F.explode("terms").alias("term"), "document_id", "chunk_id", "length", "weight", "level")
    rows = rows.withColumn("bucket", bucket_of("term", buckets))
    dealt = rows.repartition("level", "bucket", F.pmod(F.xxhash64("document_id"), F.lit(SPLIT)))
    dealt.sortWithinPartitions("level", "bucket", "field", "term").write.partitionBy("level", "bucket").parquet(f"{path}/postings")
    out = Index(spark, chunks.schema["document_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString(), [path], buckets)
    df = out.postings().groupBy("bucket", "field", "term").agg(F.sum("weight").alias("df"))
    df.repartition("bucket").sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    chunks.select("document_id", "chunk_id").write.parquet(f"{path}/units")
    return out


def merge(index: Index, live: DataFrame, path: str) -> Index:
    """One segment of all, without the rows of documents that are gone. live: document_id, segment."""
    rows = index.postings().join(live, ["document_id", "segment"], "left_semi").drop("segment")
    dealt = rows.repartition("level", "bucket", F.pmod(F.xxhash64("document_id"), F.lit(SPLIT)))
    dealt.sortWithinPartitions("level", "bucket", "field", "term").write.partitionBy("level", "bucket").parquet(f"{path}/postings")
    index.units().join(live, ["document_id", "segment"], "left_semi").drop("segment").write.parquet(f"{path}/units")
    out = Index(index.spark, index.document_type, index.chunk_type, [path], index.buckets)
    df = out.postings().groupBy("bucket", "field", "term").agg(F.sum("weight").alias("df"))
    df.repartition("bucket").sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    return out


@dataclass
class Matches:
    """What a request finds, before it is ranked.

    documents: query_id, document_id, n_terms, units (score times 10**12), masks, n_chunks, first_chunk.
    chunks: query_id, chunk_id, document_id, n_terms, units, masks of chunks that have a term in a field of their own,
    their document's share included.
    """

    documents: DataFrame
    chunks: DataFrame
    masks: list[str]
    index: Index
    live: DataFrame | None


def complete(masks: list[str]) -> Column:
    return sum((F.bit_count(m) for m in masks[1:]), F.bit_count(masks[0])) == F.col("n_terms")


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, n_terms, slot, bit, term: the distinct terms of each query, each with its place in the masks."""
    terms = queries.select("query_id", X.search_tokens("query_text").alias("terms"))
    terms = terms.select("query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("at", "term"))
    return terms.select("query_id", "n_terms", F.expr(f"at DIV {BITS}").alias("slot"), F.expr(f"shiftleft(1L, at % {BITS})").alias("bit"), "term")


def matches(queries: DataFrame, index: Index, live: DataFrame | None = None) -> Matches:
    """queries: query_id, query_text. live: document_id, segment of what is not gone (all, if not given).

    The request's buckets and its longest query come to the driver: at most as many numbers as the index has
    buckets, and one.
    """
    asked = written(asked_terms(queries).withColumn("bucket", bucket_of("term", index.buckets)), "asked")
    about = asked.agg(F.collect_set("bucket").alias("buckets"), F.max("n_terms").alias("longest")).first()
    wanted, n_masks = sorted(about["buckets"]), -(-(about["longest"] or 1) // BITS)
    masks = [f"mask{j}" for j in range(n_masks)]
    n_chunks = index.units() if live is None else index.units().join(live, ["document_id", "segment"], "left_semi")
    sizes = index.terms().groupBy("field").agg(F.sum("df").alias("total"))  # a row for each field
    sizes = sizes.crossJoin(F.broadcast(n_chunks.agg(F.count("*").alias("n"))))  # one row
    known = index.terms().filter(F.col("bucket").isin(wanted)).groupBy("field", "term").agg(F.sum("df").alias("df"))
    known = asked.drop("bucket").join(known, "term").join(F.broadcast(sizes), "field")
    known = known.select("query_id", "n_terms", "slot", "bit", "term", "field", S.idf(F.least("df", "n"), "n").alias("idf"), (F.col("total") / F.col("n")).alias("mean"))

    def scored(level: str, keys: list[str]) -> DataFrame:
        rows = index.postings().filter((F.col("level") == level) & F.col("bucket").isin(wanted))
        if live is not None:
            rows = rows.join(live, ["document_id", "segment"], "left_semi")
        units = F.floor(S.bm25("idf", "length", "mean") * DIGITS + 0.5)
        bits = [F.bit_or(F.when(F.col("slot") == j, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(m) for j, m in enumerate(masks)]
        more = [F.max("weight").alias("n_chunks"), F.min("chunk_id").alias("first_chunk")] if level == "document" else []
        return rows.join(known, ["field", "term"]).groupBy("query_id", *keys).agg(F.max("n_terms").alias("n_terms"), F.sum(units).alias("units"), *bits, *more)

    documents = written(scored("document", ["document_id"]), "documents")
    theirs = documents.select("query_id", "document_id", F.col("units").alias("shared"), *(F.col(m).alias(f"of_{m}") for m in masks))
    both = scored("chunk", ["document_id", "chunk_id"]).join(theirs, ["query_id", "document_id"], "left")
    joined = [F.col(m).bitwiseOR(F.coalesce(f"of_{m}", F.lit(0).cast("long"))).alias(m) for m in masks]
    chunks = both.select("query_id", "chunk_id", "document_id", "n_terms", (F.col("units") + F.coalesce("shared", F.lit(0).cast("long"))).alias("units"), *joined)
    return Matches(documents, chunks, masks, index, live)


def search(queries: DataFrame, index: Index, limit: int, live: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score (six decimals), complete, rank: the first chunks of each query by score, then chunk_id.

    Of the chunks that only share their document's terms, those of the first ``limit`` documents are enough: any other
    document's come behind one chunk at least of each of these (ties go by a document's first chunk).
    """
    found = matches(queries, index, live)
    score = F.round(F.col("units") / F.lit(DIGITS), 6)
    keys = ["query_id", "complete"]
    scored = lambda rows: rows.withColumns({"score": score, "complete": complete(found.masks)})
    own = top_k(scored(found.chunks), limit, [F.desc("score"), F.asc("chunk_id")], keys).select("query_id", "chunk_id", "units", "n_terms", *found.masks)
    first = top_k(scored(found.documents), limit, [F.desc("score"), F.asc("first_chunk")], keys)
    units = index.units() if live is None else index.units().join(live, ["document_id", "segment"], "left_semi")
    shared = first.join(units, "document_id").select(*own.columns)
    # A chunk that is in both has its full score in the first.
    every = own.unionByName(shared).groupBy("query_id", "chunk_id").agg(F.max("units").alias("units"), F.max("n_terms").alias("n_terms"), *(F.bit_or(m).alias(m) for m in found.masks))
    ranked = top_k(scored(every).select("query_id", "chunk_id", "score", "complete"), limit, [F.desc("score"), F.asc("chunk_id")], keys)
    return strict_or_loose(ranked)


def mode_counts(queries: DataFrame, index: Index, live: DataFrame | None = None) -> DataFrame:
    """query_id, complete, hits: chunks of the mode that counts, those with all terms or else those with any."""
    found = matches(queries, index, live)
    own = written(found.chunks.select("query_id", "document_id", complete(found.masks).alias("complete")), "own")
    taken = own.groupBy("query_id", "document_id").agg(F.count("*").alias("taken"))
    rest = found.documents.join(taken, ["query_id", "document_id"], "left")
    rest = rest.select("query_id", complete(found.masks).alias("complete"), (F.col("n_chunks") - F.coalesce("taken", F.lit(0))).alias("hits"))
    every = own.groupBy("query_id", "complete").agg(F.count("*").alias("hits")).unionByName(rest.groupBy("query_id", "complete").agg(F.sum("hits").alias("hits")))
    return strict_or_loose(every.groupBy("query_id", "complete").agg(F.sum("hits").alias("hits")).filter("hits > 0"))
