"""Folds over event logs: history, recents, favourites, failures; statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as X


def fold_history(log: DataFrame) -> DataFrame:
    """log: query, hits, ts. Per query: hits added up, first and last time; blank queries are ignored."""
    used = log.filter(X.normalize_search_text("query") != "")
    return used.groupBy("query").agg(F.sum("hits").alias("hit_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_hit_at"))


def fold_recents(log: DataFrame) -> DataFrame:
    """log: path, title, ts, seq. Per path: times opened, title and time of the last opening."""
    return log.groupBy("path").agg(F.count("*").alias("open_count"), F.max_by("title", F.struct("ts", "seq")).alias("title"), F.max("ts").alias("last_opened_at"))


def fold_views(log: DataFrame) -> DataFrame:
    """log: target_type, target_id, title, ts, seq. The last view of each target; unknown types count as chunk."""
    kind = F.lower(F.trim("target_type"))
    kind = F.when(kind.isin("document", "collection", "qa", "chunk"), kind).otherwise("chunk")
    return log.withColumn("target_type", kind).groupBy("target_type", "target_id").agg(F.max_by("title", F.struct("ts", "seq")).alias("title"), F.max("ts").alias("viewed_at"))


def toggled(log: DataFrame) -> DataFrame:
    """log: target, ts, seq. Targets toggled an odd number of times, with the time of the last one."""
    return log.groupBy("target").agg(F.count("*").alias("n"), F.max("ts").alias("updated_at")).filter("n % 2 = 1").drop("n")


def fold_failures(log: DataFrame) -> DataFrame:
    """log: file, reason, ts, seq. Per file: failures, first and last time, last reason."""
    return log.groupBy("file").agg(F.count("*").alias("retry_count"), F.min("ts").alias("first_failed_at"), F.max("ts").alias("last_failed_at"), F.max_by("reason", F.struct("ts", "seq")).alias("reason"))


def histogram(rows: DataFrame, by: str) -> DataFrame:
    """Counts and percent (one decimal) of each value; the total is one row, joined."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))


def history_terms(history: DataFrame, current: DataFrame, limit: int = 4, least: int = 2) -> DataFrame:
    """history: user, query, hit_count; current: user, term. Terms of past queries (two bytes and more) that are not in
    use, by weight."""
    terms = history.select("user", F.explode(X.search_tokens("query")).alias("term"), F.greatest("hit_count", F.lit(1)).alias("w")).filter(F.octet_length("term") >= 2)
    weights = terms.join(current, ["user", "term"], "left_anti").groupBy("user", "term").agg(F.sum("w").alias("weight")).filter(F.col("weight") >= least)
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= limit)


RANGES = 64


def nearest_rank(rows: DataFrame, value: str, by: str, percents: tuple[int, ...]) -> DataFrame:
    """Nearest-rank percentiles (place round((n-1) p), halves up), number, minimum and maximum of each group.

    A group is dealt into ranges of like size by approximate quantiles; the ranges' exact counts tell which one
    holds a place, and only inside ranges are rows numbered, so no task sorts a whole group.
    """
    steps = [k / RANGES for k in range(1, RANGES)]
    known = rows.select(by, value).filter(F.col(value).isNotNull())
    cuts = known.groupBy(by).agg(F.percentile_approx(value, steps, 10_000).alias("cuts"))
    # A row belongs to the first range whose upper cut is not below it: equal values share a range.
    dealt = known.join(cuts, by).select(by, value, F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("range"))
    sizes = dealt.groupBy(by, "range").agg(F.count("*").alias("size"))
    upto = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "range", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(by, "range").orderBy(value)) - 1
    total = known.groupBy(by).agg(F.count("*").alias("n"))
    placed = dealt.withColumn("i", inside).join(starts, [by, "range"]).join(total, by)
    at = F.col("start") + F.col("i")
    pick = lambda p: F.max(F.when(at == F.floor((F.col("n") - 1) * p / 100.0 + 0.5), F.col(value)))
    return placed.groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"), *[pick(p).alias(f"p{p}") for p in percents])
