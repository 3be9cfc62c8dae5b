"""Collections, tags, sessions and model profiles: counts, upserts, patches, last messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as X


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, child_id: str, name: str = "n") -> DataFrame:
    """Parents with the number of their children, 0 included. Children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(child_id).alias(name))
    return parents.join(counts, parent_key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def next_sort_order(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.groupBy(by).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).cast("long").alias("next_order"))


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of base replaced by the last change of the same key; new keys are added."""
    newest = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").select(*base.columns)
    return base.join(newest.select(*key), key, "left_anti").select(*base.columns).unionByName(newest)


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A change's non-null fields replace the old ones."""
    fields = [c for c in base.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields if c in changes.columns])
    return base.join(new, key, "left").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in fields])


def assign_tags(tags: DataFrame, items: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted: target, name. Finds tags by name in any case or creates them; each triple once."""
    named = wanted.select("target", X.display_name("name", "未命名").alias("name")).withColumn("low", F.lower("name"))
    new = named.join(tags.select(F.lower("name").alias("low")), "low", "left_anti").groupBy("low").agg(F.min("name").alias("name")).select(F.sha2("low", 256).alias("tag_id"), "name")
    every = tags.select("tag_id", "name").unionByName(new)
    added = named.join(every.select("tag_id", F.lower("name").alias("low")), "low").select("target", "tag_id")
    return every, items.select("target", "tag_id").unionByName(added).dropDuplicates(["target", "tag_id"])


def last_messages(messages: DataFrame, session: str, order: list[Column], n: int) -> DataFrame:
    return messages.withColumn("rank", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)


def session_context(turns: DataFrame, pairs: int = 3, question: int = 80, answer: int = 140) -> DataFrame:
    """turns: conv_id, turn, question, answer. The last exchanges of a session as text, oldest first."""
    last = last_messages(turns, "conv_id", [F.desc("turn")], pairs)
    line = F.concat(F.lit("Q: "), X.truncate_chars("question", question), F.lit("\nA: "), X.truncate_chars("answer", answer))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def single_default(profiles: DataFrame) -> DataFrame:
    """profiles: id, is_default, enabled, updated_at. One default: the latest marked one, else the latest of all."""
    rank = F.row_number().over(Window.orderBy(F.desc("is_default"), F.desc("updated_at"), "id"))
    return profiles.withColumn("_n", rank).withColumn("is_default", F.col("_n") == 1).withColumn("enabled", F.col("enabled") | F.col("is_default")).drop("_n")


def export_markdown(collections: DataFrame, items: DataFrame) -> DataFrame:
    """collections: id, name, description; items: collection_id, sort_order, title, note, citation. One text each."""
    entry = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.concat_ws("\n\n", F.when(F.trim("note") != "", F.col("note")), F.when(F.trim("citation") != "", F.concat(F.lit("> "), F.col("citation")))))
    texts = items.groupBy(F.col("collection_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort_order", entry.alias("entry")))), lambda x: x["entry"]), "\n\n").alias("body"))
    return collections.join(texts, "id", "left").select("id", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("name")), F.when(F.trim("description") != "", F.col("description")), "body").alias("markdown"))
