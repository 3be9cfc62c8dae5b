"""Registered queries of lists, index jobs, settings, prompts and answers, each with the SQL that checks it.

The tables stand for the engine's: events for logs, customers for collections, orders for sessions and tasks,
parts for tags, documents and pages for files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import settings
from docquarry.functions import text as X
from docquarry.operators import answers, indexing, library, lists, retrieval, tasks
from docquarry.plans import corpus as C
from docquarry.plans.registry import query

EVENTS = "e AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)"
DOCS = f"""docs AS (SELECT doc_id, '/corpus/' || source AS dir_path, 'doc-' || doc_id || '.txt' AS file_name, lang,
  '/corpus/' || source || '/' || lang || '/doc-' || doc_id || '.txt' AS path, doc_id * {C.DAY} + {C.EPOCH} AS modified_at, text FROM documents)"""
FIRST = 7


# --- lists ----------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS}, h AS (SELECT event_type AS \"user\", 'user ' || user_id AS query, CAST(sum(k) AS BIGINT) AS hit_count, max(ts) AS last_hit_at FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY last_hit_at DESC, hit_count DESC, query) AS rank FROM h) SELECT * FROM r WHERE rank <= {FIRST}")
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.events(spark, sf_dir)
    rows = e.groupBy(F.col("event_type").alias("user"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query")).agg(F.sum("k").alias("hit_count"), F.max("ts").alias("last_hit_at"))
    return lists.listed_per(rows, "history", "user", FIRST)


@query(f"WITH {EVENTS} SELECT user_id AS path, max(ts) AS last_opened_at, count(*) AS open_count FROM e GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50")
def recents_list(spark, sf_dir):
    """The recents of a search: the first fifty."""
    rows = C.events(spark, sf_dir).groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("last_opened_at"), F.count("*").alias("open_count"))
    return lists.listed(rows, "recents", retrieval.RECENT_CAP)


@query(f"WITH {EVENTS}, v AS (SELECT event_type AS kind, user_id AS title, max(ts) AS viewed_at FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY viewed_at DESC, title) AS rank FROM v) SELECT * FROM r WHERE rank <= {FIRST}")
def views_list(spark, sf_dir):
    rows = C.events(spark, sf_dir).groupBy(F.col("event_type").alias("kind"), F.col("user_id").alias("title")).agg(F.max("ts").alias("viewed_at"))
    return lists.listed_per(rows, "views", "kind", FIRST)


@query(f"WITH {EVENTS} SELECT user_id AS title, max(ts) AS updated_at, min(ts) AS created_at FROM e WHERE event_type = 'click' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 200")
def favorites_list(spark, sf_dir):
    """The favourites of a search: the first two hundred."""
    rows = C.events(spark, sf_dir).filter("event_type = 'click'").groupBy(F.col("user_id").alias("title")).agg(F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"))
    return lists.listed(rows, "favorites", retrieval.FAVORITE_CAP)


@query(f"WITH r AS (SELECT c_mktsegment, c_name AS name, c_nationkey AS sort_order, c_custkey AS updated_at, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey DESC, c_name) AS rank FROM customer) SELECT * FROM r WHERE rank <= {FIRST}")
def collections_list(spark, sf_dir):
    rows = C.table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_name").alias("name"), F.col("c_nationkey").alias("sort_order"), F.col("c_custkey").alias("updated_at"))
    return lists.listed_per(rows, "collections", "c_mktsegment", FIRST)


@query("WITH r AS (SELECT l_orderkey, l_linenumber AS title, l_suppkey AS sort_order, l_partkey AS updated_at, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey DESC, l_linenumber) AS rank FROM lineitem) SELECT * FROM r WHERE rank <= 3")
def items_list(spark, sf_dir):
    rows = C.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("title"), F.col("l_suppkey").alias("sort_order"), F.col("l_partkey").alias("updated_at"))
    return lists.listed_per(rows, "items", "l_orderkey", 3)


@query(f"WITH r AS (SELECT o_custkey, o_clerk AS title, o_orderkey AS updated_at, o_orderkey AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_clerk) AS rank FROM (SELECT o_custkey, o_orderpriority AS o_clerk, o_orderkey FROM orders)) SELECT * FROM r WHERE rank <= {FIRST}")
def sessions_list(spark, sf_dir):
    rows = C.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("updated_at"), F.col("o_orderkey").alias("created_at"))
    return lists.listed_per(rows, "sessions", "o_custkey", FIRST)


@query(f"WITH {DOCS}, d AS (SELECT DISTINCT dir_path || '/' || lang AS path FROM docs UNION SELECT DISTINCT dir_path FROM docs) SELECT path, row_number() OVER (ORDER BY strlen(path), path) AS rank FROM d")
def directories_list(spark, sf_dir):
    d = C.documents(spark, sf_dir)
    rows = d.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).union(d.select("dir_path")).distinct()
    return lists.listed_per(rows.withColumn("one", F.lit(0)), "directories", "one", 2**31 - 1).select("path", "rank")


FAILED = f"WITH {EVENTS}, f AS (SELECT user_id AS file, 'code ' || max_by(k, (ts, event_id)) AS category, max(ts) AS last_failed_at FROM e WHERE event_type = 'error' GROUP BY 1)"


def failed_files(spark, sf_dir):
    e = C.events(spark, sf_dir).filter("event_type = 'error'")
    return e.groupBy(F.col("user_id").alias("file")).agg(F.concat(F.lit("code "), F.max_by("k", F.struct("ts", "event_id")).cast("string")).alias("category"), F.max("ts").alias("last_failed_at"))


@query(FAILED + " SELECT * FROM f ORDER BY last_failed_at DESC, file LIMIT 5")
def latest_failures(spark, sf_dir):
    return lists.listed(failed_files(spark, sf_dir), "latest_failures", 5)


@query(FAILED + ", r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY category, file) AS rank FROM f) SELECT * FROM r WHERE rank <= 3")
def failures_list(spark, sf_dir):
    return lists.listed_per(failed_files(spark, sf_dir), "failures", "category", 3)


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE contains(lower(file_name), 'c-1') OR contains(lower(path), 'c-1') OR contains(lower(lang), 'c-1')")
def keyword_documents(spark, sf_dir):
    d = C.documents(spark, sf_dir).withColumn("lang", F.element_at(F.split("path", "/"), 4))
    return lists.holding(d, " C-1 ", ["file_name", "path", "lang"], apart=True).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment || ' ' || c_nationkey), 'machinery 1')")
def keyword_collections(spark, sf_dir):
    return lists.holding(C.table(spark, sf_dir, "customer"), "Machinery 1", ["c_name", "c_mktsegment", "c_nationkey"]).select("c_custkey")


@query(f"WITH {DOCS} SELECT doc_id, path FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def favorites_only(spark, sf_dir):
    liked = C.table(spark, sf_dir, "labels").filter("quality = 1")
    return lists.favorites_only(C.documents(spark, sf_dir), liked, "doc_id").select("doc_id", "path")


ITEM_TAGS = "it AS (SELECT DISTINCT l_orderkey AS item_id, p_brand AS tag_id FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT p_brand AS tag_id, lower(p_brand) AS name, max(p_partkey) AS updated_at FROM part GROUP BY 1, 2)"


def item_tags(spark, sf_dir):
    part = C.table(spark, sf_dir, "part")
    items = C.table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(F.col("l_orderkey").alias("item_id"), F.col("p_brand").alias("tag_id")).distinct()
    return items, part.groupBy(F.col("p_brand").alias("tag_id"), F.lower("p_brand").alias("name")).agg(F.max("p_partkey").alias("updated_at"))


@query(f"WITH {ITEM_TAGS}, x AS (SELECT max(tag_id) AS tag FROM t) SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey IN (SELECT item_id FROM it, x WHERE tag_id = tag)")
def items_with_tag(spark, sf_dir):
    items, tags = item_tags(spark, sf_dir)
    tag = tags.agg(F.max("tag_id")).first()[0]  # one row
    return lists.with_tag(C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")), items, tag)


@query(f"WITH {ITEM_TAGS} SELECT item_id, tag_id, name, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC, name) AS rank FROM it JOIN t USING (tag_id)")
def tags_of_items(spark, sf_dir):
    return lists.tags_of(*item_tags(spark, sf_dir)).select("item_id", "tag_id", "name", "rank")


@query(f"WITH {ITEM_TAGS} SELECT tag_id, name, count(*) AS n FROM it JOIN t USING (tag_id) GROUP BY 1, 2")
def tag_facet_counts(spark, sf_dir):
    return lists.tag_facets(*item_tags(spark, sf_dir))


@query("SELECT o_custkey AS document_path, max(o_orderkey) AS waiting_since FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def pending_paths(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_path"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("updated_at"))
    return lists.pending_paths(o, ("O", "P"))


@query("SELECT coalesce(max_by(p_size > 25, (p_partkey, p_brand)), false) AS available FROM part WHERE p_size > 5")
def default_model(spark, sf_dir):
    p = C.table(spark, sf_dir, "part").select((F.col("p_size") > 5).alias("is_default"), (F.col("p_size") > 25).alias("available"), F.col("p_partkey").alias("updated_at"), F.col("p_brand").alias("name"))
    return lists.latest_enabled(p)


@query("SELECT n_name FROM nation WHERE n_name <> 'FRANCE'")
def remove_by_key(spark, sf_dir):
    names = C.table(spark, sf_dir, "nation").select("n_name")
    return lists.remove_key(lists.remove_key(names, "n_name", "FRANCE"), "n_name", "  ")


@query("WITH t AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(low, '(?:ch|tion)+')) AS BIGINT) AS spans FROM t")
def highlight_union(spark, sf_dir):
    """Spans of one term given, those of another by a query; the two never overlap but may touch."""
    d = C.table(spark, sf_dir, "documents").withColumn("given", X.highlight_spans("text", F.array(F.lit("ch"))))
    return d.select("doc_id", F.size(lists.merged_spans("text", "given", F.lit("Tion, "))).cast("long").alias("spans"))


# --- index jobs -----------------------------------------------------------------------------------------


DIRS = f"WITH {DOCS}, dirs AS (SELECT DISTINCT dir_path AS path FROM docs)"


def directories(spark, sf_dir):
    d = C.documents(spark, sf_dir)
    every = d.select(F.col("dir_path").alias("path")).distinct()
    return d, every.select("path", F.lit(False).alias("enabled"), F.lit(5).cast("long").alias("docs"), F.lit(5).cast("long").alias("chunks"), F.lit("indexed").alias("status"))


@query(DIRS + " SELECT path, path = '/corpus/src1' AS enabled, CASE WHEN path = '/corpus/src1' THEN 0 ELSE 5 END AS docs, CASE WHEN path = '/corpus/src1' THEN 'pending' ELSE 'indexed' END AS status FROM dirs UNION ALL SELECT '/corpus/new', true, 0, 'pending'")
def add_directories(spark, sf_dir):
    _, dirs = directories(spark, sf_dir)
    paths = spark.createDataFrame([("/corpus/src1",), ("/corpus/new",), ("/corpus/new",)], "path string")
    return tasks.add_directories(dirs, paths).select("path", "enabled", F.col("docs").cast("int").alias("docs"), "status")


@query(f"WITH {DOCS} SELECT doc_id, path FROM docs WHERE NOT (starts_with(path, '/corpus/src1/') OR starts_with(path, '/corpus/src2/en/'))")
def remove_directories(spark, sf_dir):
    """The documents that stay when a directory and a subdirectory of another go."""
    gone = spark.createDataFrame([("/corpus/src1",), ("\\\\corpus\\\\src2/en/".replace("\\\\", "\\"),)], "path string")
    return tasks.not_below(C.documents(spark, sf_dir), gone).select("doc_id", "path")


@query(DIRS + " SELECT path FROM dirs WHERE path <> '/corpus/src1'")
def enabled_directories(spark, sf_dir):
    _, dirs = directories(spark, sf_dir)
    changes = dirs.select("path", (F.col("path") != "/corpus/src1").alias("enabled")).union(spark.createDataFrame([("/none", True)], "path string, enabled boolean"))
    return tasks.enabled(tasks.set_enabled(dirs, changes)).select("path")


@query(DIRS + ", n AS (SELECT dir_path AS path, count(*) AS docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS chunks FROM docs GROUP BY 1) SELECT path, coalesce(docs, 0) AS docs, coalesce(chunks, 0) AS chunks, CASE WHEN docs > 0 THEN 'indexed' ELSE 'empty' END AS status FROM (SELECT * FROM dirs UNION ALL SELECT '/corpus/none') LEFT JOIN n USING (path)")
def refresh_directories(spark, sf_dir):
    d, dirs = directories(spark, sf_dir)
    dirs = dirs.union(spark.createDataFrame([("/corpus/none", True, 1, 1, "indexed")], tasks.DIRECTORY))
    return tasks.refreshed(dirs, d.withColumn("n_chunks", F.size(F.split("text", "\n")))).select("path", "docs", "chunks", "status")


PLAN = "p AS (SELECT doc_id, 'd' || doc_id AS path, CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'update' WHEN quality = 0 THEN 'insert' ELSE 'skip' END AS action FROM documents LEFT JOIN labels USING (doc_id))"


def planned(spark, sf_dir):
    rows = C.table(spark, sf_dir, "documents").select("doc_id").join(C.table(spark, sf_dir, "labels"), "doc_id", "left")
    action = F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 1, "update").when(F.col("quality") == 0, "insert").otherwise("skip")
    return rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), action.alias("action"))


def marks(spark, sf_dir):
    """The checkpoint of a run: what the log says of each file."""
    return C.events(spark, sf_dir).select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("path"), (F.col("event_type") != "error").alias("ok"))


@query(f"WITH {PLAN}, m AS (SELECT 'd' || user_id AS path, bool_or(event_type <> 'error') AS ok FROM events GROUP BY 1) SELECT path, action, CASE WHEN ok IS NULL THEN 'waiting' WHEN ok THEN 'done' ELSE 'failed' END AS state FROM p LEFT JOIN m USING (path) WHERE action <> 'skip'")
def plan_progress(spark, sf_dir):
    return tasks.progress(planned(spark, sf_dir), marks(spark, sf_dir))


@query(f"WITH {PLAN} SELECT path, action, CASE WHEN action = 'delete' THEN 0 ELSE 1 END AS turn FROM p WHERE action <> 'skip' AND path NOT IN (SELECT 'd' || user_id FROM events)")
def plan_remaining(spark, sf_dir):
    return tasks.remaining(planned(spark, sf_dir), marks(spark, sf_dir))


@query(f"WITH {PLAN} SELECT path, CASE WHEN action = 'delete' THEN 'delete' ELSE 'update' END AS action FROM p WHERE path IN (SELECT 'd' || user_id FROM events WHERE event_type = 'error')")
def retry_failed(spark, sf_dir):
    return tasks.retried(planned(spark, sf_dir), marks(spark, sf_dir).filter("NOT ok").select(F.col("path").alias("file")))


@query(f"WITH {PLAN}, c AS (SELECT count(*) FILTER (action = 'delete') AS deletes, count(*) FILTER (action IN ('insert', 'update')) AS updates, count(*) FILTER (action <> 'delete') AS found FROM p) SELECT deletes, updates, greatest(found - deletes - updates, 0) AS skipped FROM c")
def plan_counts(spark, sf_dir):
    return tasks.plan_counts(planned(spark, sf_dir))


@query(f"WITH {DOCS}, w AS (SELECT 'p' || user_id AS path, count(*) AS pages, CAST(floor(min(epoch(ts))) AS BIGINT) AS queued_at FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT * FROM w WHERE path IN (SELECT 'p' || doc_id FROM docs)")
def ocr_queue(spark, sf_dir):
    e = C.events(spark, sf_dir)
    waiting = e.select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_type") == "view", "none").otherwise("no_text_layer").alias("reason"), F.col("ts").alias("queued_at"))
    return tasks.ocr_queue(C.table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path")), waiting)


@query(f"WITH {DOCS} SELECT path AS file FROM docs WHERE NOT starts_with(path, '/corpus/src3/')")
def clear_failures(spark, sf_dir):
    failures = C.documents(spark, sf_dir).select(F.col("path").alias("file"))
    return tasks.clear_failures(failures, spark.createDataFrame([("/corpus/src3/",)], "path string"))


@query("SELECT 'd' || user_id AS file, max_by('timeout ' || event_type, event_id) AS reason, '处理超时' AS category, 'timeout' AS code FROM events GROUP BY 1")
def replace_failures(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    fresh = e.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("file"), F.concat(F.lit("timeout "), "event_type").alias("reason"), F.col("event_id").alias("seq"))
    return tasks.replace_failures(spark.createDataFrame([], "file string, reason string, category string, code string"), fresh)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'index.dir.' WHEN 'view' THEN 'index.pdfOcr.' WHEN 'error' THEN 'index.fulltextRepair.' ELSE 'index.all.' END || event_type AS code FROM events")
def progress_codes(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    scope = F.when(F.col("event_type") == "click", "dir").when(F.col("event_type") == "view", "pdf-ocr").when(F.col("event_type") == "error", "fulltext-repair").otherwise("all")
    return e.select("event_id", tasks.progress_code(scope, "event_type").alias("code"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'index.parser.chunk' WHEN 'view' THEN 'index.parser.ocrQueue' WHEN 'error' THEN 'index.parser.unknown' ELSE 'index.parser.start' END AS code, CASE event_type WHEN 'click' THEN '正在生成切片 · ' || user_id WHEN 'view' THEN '正在排队 OCR · 3/9' WHEN 'error' THEN 'own' ELSE '正在开始解析' END AS message FROM events")
def stage_messages(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    stage = F.when(F.col("event_type") == "click", "chunk").when(F.col("event_type") == "view", "ocr_queue").when(F.col("event_type") == "error", "odd").otherwise("start")
    own = F.when(F.col("event_type") == "error", " own ")
    return e.select("event_id", tasks.stage_code(stage).alias("code"), tasks.stage_message(stage, own, F.col("user_id").cast("string"), F.lit(3), F.lit(9)).alias("message"))


@query("SELECT event_id, CAST(least(greatest(round((event_id % 10 + (user_id % 101) / 100.0::DOUBLE) / 10.0::DOUBLE * 100.0::DOUBLE), 0), 100) AS INT) AS percent FROM events")
def stream_percents(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    return e.select("event_id", tasks.stream_percent(F.col("event_id") % 10, F.lit(10), F.col("user_id") % 101).alias("percent"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'searching' WHEN 'view' THEN 'generating' WHEN 'error' THEN 'failed' ELSE 'running' END AS state FROM events")
def answer_states(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    stage = F.when(F.col("event_type") == "click", "rank").when(F.col("event_type") == "view", "final_stream").when(F.col("event_type") == "error", "failed").otherwise("odd")
    return e.select("event_id", tasks.answer_state(stage).alias("state"))


# --- documents, blocks, index ---------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT path, doc_id AS document_id FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)")
def document_ids(spark, sf_dir):
    d = C.documents(spark, sf_dir)
    asked = d.join(C.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path").union(spark.createDataFrame([("/nowhere",)], "path string"))
    return indexing.document_ids(d.withColumnRenamed("doc_id", "document_id"), asked)


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)"


def line_blocks(spark, sf_dir):
    c = C.chunks(spark, sf_dir)
    return c.select(F.col("doc_id").alias("document_id"), F.col("seq").cast("int").alias("block_index"), F.lit("paragraph").alias("kind"), F.col("snippet").alias("text"))


@query(f"WITH {LINES} SELECT doc_id AS document_id, CAST(seq AS INT) AS block_index, line AS text FROM lines WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def blocks_of_documents(spark, sf_dir):
    ids = C.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return indexing.blocks_of(line_blocks(spark, sf_dir), ids).select("document_id", "block_index", "text")


@query(f"WITH {LINES}, n AS (SELECT doc_id, max(seq) AS last FROM lines GROUP BY 1), w AS (SELECT doc_id, last FROM n) SELECT w.doc_id AS document_id, md5(coalesce(b.line, '') || '|' || a.line) AS digest FROM w JOIN lines a ON a.doc_id = w.doc_id AND a.seq = 0 LEFT JOIN lines b ON b.doc_id = w.doc_id AND b.seq = 1")
def chunk_previews(spark, sf_dir):
    """Previews that name the second, a missing and the first block: the order is kept, what is missing is left out."""
    rows = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.array(F.lit(1), F.lit(1_000_000), F.lit(0)).alias("block_indexes"))
    found = retrieval.preview_blocks(rows, line_blocks(spark, sf_dir))
    first = F.when(F.size("blocks") == 2, F.col("blocks")[0]).otherwise("")
    return found.select("document_id", F.md5(F.concat(first, F.lit("|"), F.element_at("blocks", -1)).cast("binary")).alias("digest"))


@query(f"WITH {DOCS} SELECT doc_id AS document_id, CASE WHEN lang = 'en' THEN '/corpus/' || regexp_extract(path, '/corpus/([^/]*)/', 1) || '/en/img/a.png' ELSE 'https://x/y.png' END AS asset FROM docs")
def block_assets(spark, sf_dir):
    d = C.documents(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    english = F.element_at(F.split("path", "/"), 4) == "en"
    blocks = d.select("document_id", F.lit("image").alias("kind"), F.when(english, "./img/a.png").otherwise("https://x/y.png").alias("text"))
    return indexing.block_view(blocks, d).select("document_id", "asset")


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE dir_path <> '/corpus/src1'")
def delete_by_term(spark, sf_dir):
    """Exactly that directory: documents whose own directory is another one stay."""
    gone = spark.createDataFrame([("/corpus/src1",), ("/corpus",)], "dir_path string")
    return indexing.without_term(C.documents(spark, sf_dir), "dir_path", gone).select("doc_id")


@query("SELECT count(*) > 0 AS needs_repair FROM documents")
def index_repair(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents")
    return indexing.needs_repair(d, retrieval.postings(d).limit(0))


@query("SELECT doc_id || ':0' AS chunk_id, CASE WHEN starts_with(t, '#') AND trim(regexp_replace(t, '^#+', '')) <> '' THEN trim(regexp_replace(t, '^#+', '')) ELSE 'f' END AS heading FROM (SELECT doc_id, CASE WHEN quality = 1 THEN '# ' ELSE '' END || trim(regexp_replace(text, '[\\t\\n\\x0b\\f\\r\\x{85}\\p{Z}]+', ' ', 'g')) AS t, text FROM documents LEFT JOIN labels USING (doc_id)) WHERE trim(t) <> ''")
def collapsed_chunks(spark, sf_dir):
    """The fallback chunker as it was: one line, one chunk."""
    d = C.table(spark, sf_dir, "documents").join(C.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    text = F.concat(F.when(F.col("quality") == 1, "#\n").otherwise(""), "text")
    return indexing.to_chunks(d.select(F.col("doc_id").alias("document_id"), text.alias("text"), F.lit("f").alias("file_name")), compat=True).select("chunk_id", "heading")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'A heading' ELSE left(regexp_extract(text, '[^\\t\\n\\x0b\\f\\r\\x{85}\\p{Z}]+'), 80) END AS title FROM documents LEFT JOIN labels USING (doc_id) WHERE trim(text) <> ''")
def inferred_titles(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").filter("trim(text) <> ''").join(C.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    heading = F.col("quality") == 1
    kinds = F.when(heading, F.array(F.lit("paragraph"), F.lit("heading"))).otherwise(F.array(F.lit("paragraph")))
    texts = F.when(heading, F.array(F.lit(""), F.lit("A heading"))).otherwise(F.array("text"))
    return d.select("doc_id", X.inferred_title(kinds, texts).alias("title"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'parse_failed' WHEN 'click' THEN 'file_not_found' ELSE 'my_' || event_type END AS code, 'linux-' || lower(event_type) AS platform FROM events")
def error_codes(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", " Parse-Failed ").when(F.col("event_type") == "click", "FileNotFound").otherwise(F.concat(F.lit("MY-"), "event_type"))
    return e.select("event_id", X.error_code(raw).alias("code"), X.platform_key(F.lit("Linux "), "event_type").alias("platform"))


# --- settings -------------------------------------------------------------------------------------------


@query("SELECT event_id, least(greatest(value, 0.0::DOUBLE), 2.0::DOUBLE) AS temperature FROM events")
def settings_clamps(spark, sf_dir):
    return C.table(spark, sf_dir, "events").select("event_id", settings.clamp(F.col("value"), 0.0, 2.0).alias("temperature"))


@query("SELECT n_nationkey, n_name, 'pending' AS status, CAST(0 AS BIGINT) AS chunks FROM nation")
def migrated_columns(spark, sf_dir):
    n = C.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return settings.migrated(n, {"n_name": ("string", ""), "status": ("string", "pending"), "chunks": ("long", 0)})


@query("SELECT r_name FROM region")
def seeded_rows(spark, sf_dir):
    """Defaults go only into an empty table."""
    regions = C.table(spark, sf_dir, "region").select("r_name")
    return settings.seeded(settings.seeded(regions.limit(0), regions), spark.createDataFrame([("extra",)], "r_name string"))


# --- answers --------------------------------------------------------------------------------------------


@query(f"WITH {DOCS}, s AS (SELECT user_id AS query_id, '/corpus/src' || (user_id % 20) AS scope FROM events GROUP BY 1, 2) SELECT query_id, doc_id AS chunk_id FROM s JOIN docs ON lower(path) = lower(scope) OR starts_with(lower(path), lower(scope) || '/')")
def scoped_chunks(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    scopes = e.select(F.col("user_id").alias("query_id"), F.concat(F.lit("/CORPUS\\src"), (F.col("user_id") % 20).cast("string"), F.lit("/")).alias("scope")).distinct()
    return answers.in_scope(C.documents(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), scopes)


@query("SELECT event_id, 'SQL相关性 ' || printf('%.1f', user_id::DOUBLE) || ' · 核心词 ' || (event_id % 3) || ' · 词重叠 ' || (event_id % 7) || CASE WHEN event_id % 4 > 1 THEN ' · 多路召回 ' || (event_id % 4) ELSE '' END || ' · 总分 ' || printf('%.2f', (event_id % 50)::DOUBLE) AS reason FROM events")
def evidence_reasons(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("best"), (F.col("event_id") % 3).alias("core"), (F.col("event_id") % 7).alias("overlap"), (F.col("event_id") % 4).alias("hits"), (F.col("event_id") % 50).cast("double").alias("score"))
    return e.select("event_id", answers.evidence_reason().alias("reason"))


@query("SELECT conv_id, turn, md5('[' || turn || ']' || chr(10) || '文件: f' || chr(10) || '路径: /p/f' || chr(10) || '位置: ' || role || chr(10) || '上下文:' || CASE WHEN trim(coalesce(p, '')) <> '' THEN chr(10) || '- 上一段: ' || trim(p) ELSE '' END || chr(10) || '- 当前段: ' || trim(text) || CASE WHEN trim(coalesce(n, '')) <> '' THEN chr(10) || '- 下一段: ' || trim(n) ELSE '' END) AS digest FROM (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def prompt_blocks(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    m = C.table(spark, sf_dir, "conversations").select("*", F.lag("text").over(w).alias("p"), F.lead("text").over(w).alias("n"))
    block = answers.prompt_block("turn", F.lit("f"), F.lit("/p/f"), "role", "p", "text", "n")
    return m.select("conv_id", "turn", F.md5(block.cast("binary")).alias("digest"))


@query(f"SELECT conv_id, turn, md5('{answers.RULES}' || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN '{answers.PARTS[0][1]}' || chr(10) || 's' || chr(10) || chr(10) ELSE '' END || text || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || '{answers.DEMANDS}') AS digest FROM conversations")
def system_prompts(spark, sf_dir):
    m = C.table(spark, sf_dir, "conversations")
    prompt = answers.system_prompt(F.array("text", F.lit("x")), session=F.when(F.col("turn") % 2 == 0, " s ").otherwise(" "), relation=F.lit(None).cast("string"))
    return m.select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("digest"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'a' || user_id WHEN 'view' THEN 'b' WHEN 'error' THEN 'c' ELSE '' END AS reply FROM events")
def reply_texts(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.format_string('{"choices":[{"message":{"content":"  "}},{"message":{"thinking":" a%d "},"text":"z"}]}', "user_id"))
        .when(kind == "view", '{"choices":[],"answer":"b","message":{"content":"no"}}')
        .when(kind == "error", '{"message":{"output":"c"}}')
        .otherwise("{broken")
    )
    return e.select("event_id", answers.reply_text(raw).alias("reply"))


@query("SELECT conv_id, md5('# ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) || chr(10)) AS digest FROM conversations GROUP BY conv_id")
def session_export(spark, sf_dir):
    return answers.export_session(C.table(spark, sf_dir, "conversations")).select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query("SELECT c_custkey, md5(concat_ws(chr(10) || chr(10), '# ' || c_name, c_mktsegment, string_agg('## ' || o_orderkey || chr(10) || chr(10) || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey))) AS digest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment")
def collection_export(spark, sf_dir):
    c = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    items = C.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("sort_order"), F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderpriority").alias("note"), F.lit(" ").alias("citation"))
    return library.export_markdown(c, items).select(F.col("id").alias("c_custkey"), F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') = 0 AS ok, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN count(*) FILTER (event_type = 'error') || ' / ' || count(*) || ' 个样本未通过回归' END AS warning FROM events")
def evaluation_report(spark, sf_dir):
    return answers.report(C.table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("passed")))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN false WHEN 'view' THEN true WHEN 'error' THEN true ELSE false END AS factual FROM events")
def factual_sentences(spark, sf_dir):
    """A preamble, a preamble before a figure, a marker word, and a label."""
    kind = F.col("event_type")
    said = F.when(kind == "click", "好的，我们需要先看看").when(kind == "view", "总之，这个端口在服务器上的编号为 8080").when(kind == "error", "系统支持多种格式").otherwise("说明：")
    return C.table(spark, sf_dir, "events").select("event_id", answers.factual(said).alias("factual"))


def states(spark, sf_dir):
    """One question for each benchmark passage: with a good source, with a source the answerer ignores, with none."""
    q = C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    sources = q.filter("query_id % 3 <> 0").select("query_id", F.lit(1).cast("long").alias("source_id"), F.concat(F.lit("Port 80 is needed by "), F.col("query_id").cast("string"), F.lit(".")).alias("text"))
    return q, sources


def stubborn(question: str, sources: list[str]) -> str:
    """An answerer that cites only when it is told to, and never for some."""
    told = "规则校验提示" in question
    cites = len(question) % 2 == 0
    return f"Value 4711 follows{' [1]' if told and cites else ''}."


@query(
    """WITH a AS (SELECT item_id AS query_id, item_id % 3 = 0 AS bare, (length(text) + length('规则校验提示：答案有 1 个事实句缺少有效来源标注，建议重新生成。。请只保留被来源直接支撑的句子，删掉未被来源支撑的内容。') + 2) % 2 = 0 AS cites FROM benchmark)
SELECT query_id, CASE WHEN bare THEN 'insufficient_evidence' ELSE 'answered' END AS state, NOT bare AS ok, NOT bare AS repaired, bare OR NOT cites AS warned FROM a"""
)
def answer_graph(spark, sf_dir):
    """Draft, verify, judge, one repair, verify again; refusal without sources."""
    found = answers.answer(*states(spark, sf_dir), stubborn)
    return found.select("query_id", "state", "ok", "repaired", F.col("warning").isNotNull().alias("warned"))
