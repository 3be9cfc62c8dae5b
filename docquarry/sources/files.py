"""Folders of files as documents: discovery predicates, snapshots, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.sources import listing

#: Directories that are never read (fixed values).
SKIPPED = ("git", "node_modules", "target", "library", "caches", "application support")
SUPPORTED = "txt md markdown html htm docx pptx xlsx epub csv json xml yaml yml toml ini log py js ts tsx jsx vue rs go java c h cpp hpp cs rb sh sql css".split()


def found(spark: SparkSession, root: str, max_mb: int = 50, exclude_exts: tuple[str, ...] = (), exclude_dirs: tuple[str, ...] = ()) -> DataFrame:
    """path, file_name, ext, size, modified_at of every supported file below root; no file is opened, no skipped
    folder entered, and what is excluded by extension or size is left out where files are listed."""
    kept = listing.listing(spark, root, (*SKIPPED, *exclude_dirs)).filter(F.col("ext").isin([e for e in SUPPORTED if e not in exclude_exts]))
    return kept.filter(F.col("size") <= max_mb * 1024 * 1024) if max_mb > 0 else kept


def scan(spark: SparkSession, root: str, max_mb: int = 50, exclude_exts: tuple[str, ...] = (), exclude_dirs: tuple[str, ...] = ()) -> DataFrame:
    """``found`` files with content_hash and content."""
    files = found(spark, root, max_mb, exclude_exts, exclude_dirs)
    return files.join(listing.read_files(files), "path").select("path", "file_name", "ext", "size", "modified_at", "content_hash", "content")


def classify_imports(paths: DataFrame, known_dirs: DataFrame) -> DataFrame:
    """paths: path, is_dir, exists. Directory, file below a known directory, loose file, unsupported or skipped."""
    up = paths.select("path", F.explode(X.ancestors("path")).alias("dir")).join(known_dirs.select("dir"), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    kind = F.when(~F.col("exists"), "skipped").when(F.col("is_dir"), "directory").when(~X.extension("path").isin(*SUPPORTED), "unsupported").when(F.col("dir").isNotNull(), "known").otherwise("virtual")
    return paths.join(up, "path", "left").select("path", kind.alias("kind"), F.when(kind == "virtual", "virtual://临时导入").otherwise(F.col("dir")).alias("dir"))
