"""Keeping an index: incremental plans, replacing and deleting documents, directory roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators.storage import written


def incremental_plan(found: DataFrame, known: DataFrame) -> DataFrame:
    """path, action: insert, update (size, time or hash differ), delete or skip. Both: path, size, modified_at, hash."""
    a = found.select("path", F.struct("size", "modified_at", "hash").alias("new"))
    b = known.select("path", F.struct("size", "modified_at", "hash").alias("old"))
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("new") != F.col("old"), "update").otherwise("skip")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def replace_documents(base: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Rows of changed documents stand in for all rows of the same path."""
    return base.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed.select(*base.columns))


def delete_directory(rows: DataFrame, directory: str) -> DataFrame:
    return rows.filter(~X.in_directory("path", F.lit(directory)))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """All tables without the rows of the documents that go."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def rollup(documents: DataFrame, path: str = "path", chunks: str = "n_chunks") -> DataFrame:
    """dir, docs, chunks of every ancestor directory."""
    each = documents.select(F.explode(X.ancestors(path)).alias("dir"), F.col(chunks).alias("c"))
    return each.groupBy("dir").agg(F.count("*").alias("docs"), F.sum("c").cast("long").alias("chunks")).withColumn("status", F.when(F.col("docs") > 0, "indexed").otherwise("empty"))


def children(dirs: DataFrame) -> DataFrame:
    """dir, parent: the nearest ancestor that is itself in the list (null at a root), and its number of steps down."""
    up = dirs.select("dir", F.posexplode(X.ancestors("dir")).alias("steps", "parent"))
    near = up.join(dirs.select(F.col("dir").alias("parent")), "parent").groupBy("dir").agg(F.min_by("parent", "steps").alias("parent"))
    return dirs.select("dir").join(near, "dir", "left")


def inherit_enabled(dirs: DataFrame, explicit: DataFrame) -> DataFrame:
    """dir with the flag of the nearest explicit directory (itself or an ancestor); true without one."""
    up = dirs.select("dir", F.posexplode(F.concat(F.array("dir"), X.ancestors("dir"))).alias("steps", "at"))
    near = up.join(explicit.select(F.col("dir").alias("at"), "enabled"), "at").groupBy("dir").agg(F.min_by("enabled", "steps").alias("enabled"))
    return dirs.select("dir").join(near, "dir", "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def resolve_directory(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """path with the longest listed directory above it: an equi-join on exploded ancestors, no theta join."""
    up = paths.select("path", F.posexplode(X.ancestors("path")).alias("steps", "dir"))
    near = up.join(dirs.select("dir"), "dir").groupBy("path").agg(F.min_by("dir", "steps").alias("dir"))
    return paths.join(near, "path", "left")


def tree_rows(dirs: DataFrame) -> DataFrame:
    """dir, depth, position in depth-first order: the order of the path's parts.

    Directories are dealt by ranges of that order and numbered inside; one row for each range, its size, gives
    the ranges their first numbers.
    """
    spark = dirs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = F.split("dir", "/")
    rows = dirs.select("dir", parts.alias("parts"), (F.size(parts) - 2).cast("long").alias("depth"))
    dealt = written(rows.repartitionByRange(n, "parts").withColumn("range", F.spark_partition_id()), "tree")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))  # as many rows as ranges
    inside = F.row_number().over(Window.partitionBy("range").orderBy("parts"))
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), "range").select("dir", "depth", (F.col("start") + F.col("inside")).cast("long").alias("position"))


def document_ids(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """path, document_id of the paths that are indexed."""
    return paths.select("path").distinct().join(documents.select("path", "document_id"), "path")


def blocks_of(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """The blocks of listed documents (document_id), by document and index."""
    return blocks.join(ids.select("document_id").distinct(), "document_id", "left_semi").orderBy("document_id", "block_index")


def block_view(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks as a preview shows them: an image's file stands beside its document unless its place is absolute."""
    joined = blocks.join(documents.select("document_id", "path"), "document_id")
    return joined.withColumn("asset", F.when(F.col("kind") == "image", X.resolve_asset("text", "path"))).drop("path")


def without_term(index: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Index rows less those whose column (dir_path, path) is exactly one of the values; subdirectories stay."""
    return index.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_anti")


def needs_repair(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """One row: whether there are chunks but no index."""
    a, b = chunks.limit(1).agg(F.count("*").alias("chunks")), index.limit(1).agg(F.count("*").alias("rows"))
    return a.crossJoin(b).select(((F.col("chunks") > 0) & (F.col("rows") == 0)).alias("needs_repair"))


def index_status(documents: DataFrame, chunks: DataFrame, failures: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of totals."""
    out = documents.agg(F.count("*").alias("documents"))
    for name, df in (("chunks", chunks), ("failures", failures), ("queued", queue)):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    return out


def to_chunks(texts: DataFrame, key: str = "document_id", text: str = "text", file_name: str = "file_name", limit: int = 240, compat: bool = False) -> DataFrame:
    """The fallback chunker: a chunk for each paragraph, cut to ``limit`` characters; headings from '#' lines.

    compat: white space is collapsed before the paragraphs are cut, so a document is one chunk, whose heading is
    the whole text if that begins with '#'.
    """
    body = X.normalize_whitespace(text) if compat else F.col(text)
    parts = texts.select(key, file_name, F.posexplode(X.split_paragraphs(body)).alias("seq", "paragraph"))
    return parts.select(F.concat_ws(":", F.col(key).cast("string"), F.col("seq").cast("string")).alias("chunk_id"), key, F.col("seq").cast("long").alias("chunk_seq"), X.derive_heading("paragraph", file_name).alias("heading"), X.truncate_chars(X.normalize_whitespace("paragraph"), limit).alias("snippet"))
