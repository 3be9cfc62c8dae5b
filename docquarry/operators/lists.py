"""Lists as an application shows them: their orders, limits and filters. All over DataFrames of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators.ranking import top_k

#: What each list is sorted by (fixed values; '-' is descending).
ORDERS = {
    "history": ("-last_hit_at", "-hit_count", "query"),
    "recents": ("-last_opened_at", "-open_count", "path"),
    "views": ("-viewed_at", "title"),
    "favorites": ("-updated_at", "-created_at", "title"),
    "collections": ("sort_order", "-updated_at", "name"),
    "items": ("sort_order", "-updated_at", "title"),
    "tags": ("-updated_at", "-created_at", "name"),
    "target_tags": ("-updated_at", "name"),
    "sessions": ("-updated_at", "-created_at", "title"),
    "messages": ("created_at",),
    "failures": ("category", "file"),
    "latest_failures": ("-last_failed_at", "file"),
    "directories": ("bytes", "path"),
    "documents": ("path",),
    "profiles": ("-is_default", "-updated_at", "-created_at", "name"),
}


def order_of(name: str) -> list[Column]:
    """The sort columns of a list; strings go by bytes."""
    return [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[name]]


def listed(rows: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """A list in its order; with a limit (1 at least) Spark keeps the first rows of every partition only."""
    out = rows.withColumn("bytes", F.octet_length("path")) if name == "directories" else rows
    out = out.orderBy(*order_of(name))
    out = out if limit is None else out.limit(max(1, limit))
    return out.drop("bytes") if name == "directories" else out


def listed_per(rows: DataFrame, name: str, by: str | list[str], limit: int) -> DataFrame:
    """The first rows of a list for each user (or whatever ``by`` names), with their place as ``rank``."""
    out = rows.withColumn("bytes", F.octet_length("path")) if name == "directories" else rows
    out = top_k(out, max(1, limit), order_of(name), by)
    return out.drop("bytes") if name == "directories" else out


def not_blank(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.trim(F.coalesce(column, F.lit(""))) != "")


def holding(rows: DataFrame, keyword: str, fields: list[str], apart: bool = False) -> DataFrame:
    """Rows one of whose fields (apart) or whose joined fields hold the keyword, in any case; a blank one keeps all."""
    low = keyword.strip().lower()
    if not low:
        return rows
    shown = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    hay = F.array(*map(F.lower, shown)) if apart else F.array(F.lower(F.concat_ws(" ", *shown)))
    return rows.filter(F.exists(hay, lambda h: F.contains(h, F.lit(low))))


def favorites_only(rows: DataFrame, favorites: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(favorites.select(*([key] if isinstance(key, str) else key)), key, "left_semi")


def with_tag(items: DataFrame, item_tags: DataFrame, tag_id, key: str = "item_id") -> DataFrame:
    """Items that carry a tag."""
    return items.join(item_tags.filter(F.col("tag_id") == tag_id).select(key), key, "left_semi")


def tags_of(item_tags: DataFrame, tags: DataFrame, key: str = "item_id") -> DataFrame:
    """key, tag_id, name, updated_at and the tag's place (rank) among its target's tags."""
    return top_k(item_tags.select(key, "tag_id").join(tags, "tag_id"), 2**31 - 1, order_of("target_tags"), key)


def tag_facets(item_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """tag_id, name, n of every tag in use, most items first, then by name."""
    counts = item_tags.groupBy("tag_id").agg(F.count("*").alias("n"))
    return counts.join(tags.select("tag_id", "name"), "tag_id").orderBy(F.desc("n"), "name")


def pending_paths(tasks: DataFrame, states: tuple[str, ...] = ("pending", "running")) -> DataFrame:
    """document_path of tasks in the given states, the one that waited longest first."""
    held = not_blank(tasks.filter(F.col("status").isin(*states)), "document_path")
    return held.groupBy("document_path").agg(F.max("updated_at").alias("waiting_since")).orderBy("waiting_since", "document_path")


def remove_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows without the one of that key; a blank key removes nothing."""
    return rows if not (value or "").strip() else rows.filter(~F.col(key).eqNullSafe(F.lit(value)))


def latest_enabled(models: DataFrame, name: str = "available") -> DataFrame:
    """One row: the flag of the default model that was updated last, false without one."""
    flag = F.max_by(name, F.struct("updated_at", "name"))
    return models.filter("is_default").agg(F.coalesce(flag, F.lit(False)).alias(name))


def merged_spans(text, spans, query) -> Column:
    """Given spans and those of the words of a query, as one list of spans that do not touch."""
    words = F.filter(F.split(X.col(query), r"[\s,，.。;；:：、|/\\]+"), lambda w: F.trim(w) != "")
    own = X.highlight_spans(text, F.transform(words, lambda w: F.lower(F.trim(w))))
    return X.merge_spans(F.concat(F.filter(X.col(spans), lambda s: s["end"] > s["start"]), own))
