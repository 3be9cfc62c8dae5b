"""Search over many queries at once: containment, vectors, fusion, re-ranking, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import scoring as S
from docquarry.functions import text as X
from docquarry.operators import activity, containment, inverted, lists, scan
from docquarry.operators.ranking import TERM_BYTES, exact_sum, top_k
from docquarry.operators.storage import blocks, written

QUERY_BLOCK = 1024  # vector queries that are answered together
TERM_BLOCK = 1 << 20  # terms of a containment request that are looked for together


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, terms (each once), length: what an index keeps of a document."""
    return docs.select(key, X.search_tokens(text).alias("terms")).select(key, "terms", F.size("terms").alias("length"))


def exploded(index: DataFrame, key: str = "doc_id") -> DataFrame:
    return index.select(key, "length", F.explode("terms").alias("term")).filter(F.octet_length("term") <= TERM_BYTES)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, length, term: a row for each distinct token of a document."""
    return exploded(tokenized(docs, key, text), key)


def containment_scores(chunks: DataFrame, asked: DataFrame, keep: int, scoped: bool = False) -> DataFrame:
    """query_id, part, chunk_id, modified_at, raw, overlap, core of every chunk that holds a term of a part.

    asked: query_id, part, terms, core - the request; it comes to the driver in blocks of about ``TERM_BLOCK`` terms,
    and every block is one pass over all chunks (``substrings`` reads an index instead). An Aho-Corasick automaton over a
    block's terms reads every distinct word of a slice of chunks; what it finds is added up by chunk and part.
    raw: file name and heading 3, path 2, snippet 1; overlap: file name and heading 3, else 1 (terms of two
    characters and more); core: core terms found anywhere. Of each part only rows that can be among the first
    ``keep`` by raw, then modified_at, of what the task has read are sent (ties with the last one stay).
    scoped: asked has scopes as well (null: all chunks), chunks has above, the paths that a scope may name; a part is
    given only chunks that one of its scopes is above of.
    """
    asked = written(asked.select("query_id", "part", "terms", "core", *(["scopes"] if scoped else [])), "asked")
    size = F.size("terms") + F.size("core") + 1
    mean = asked.agg(F.avg(size).alias("n")).first()["n"] or 1
    found = None
    for block in blocks(asked, ["query_id", "part"], max(1, int(TERM_BLOCK / mean))):
        part = containment.contained(chunks, containment.request_of(block.collect(), scoped), keep, scoped)
        found = part if found is None else found.unionByName(part)
    return found


def cosine_search(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", distance: bool = True) -> DataFrame:
    """Exact search: every vector against the queries (query_id, query): query_id, key, score, rank.

    distance: score 1 / (1 + cosine distance), else the cosine; 0 for empty vectors, other lengths and zero norms.
    The request comes to the driver in blocks of ``QUERY_BLOCK`` queries; a block is a matrix product in double
    precision with every Arrow batch of vectors, of which each query's first k (and ties) go on.
    """
    asked = written(queries.select("query_id", F.col("query").cast("array<double>").alias("query")), "asked")
    found = None
    for block in blocks(asked, ["query_id"], QUERY_BLOCK):
        part = _nearest(vectors, block.collect(), k, key)
        found = part if found is None else found.unionByName(part)
    cosine = F.col("cosine")
    score = S.distance_score(1.0 - cosine) if distance else cosine
    return top_k(found.select("query_id", key, F.round(score, 6).alias("score")), k, [F.desc("score"), F.asc(key)])


def _nearest(vectors: DataFrame, request: list, k: int, key: str) -> DataFrame:
    """One block of queries against all vectors: query_id, key, cosine of what can be among the first k."""
    import numpy as np
    import pyarrow as pa

    def unit(rows: list) -> np.ndarray:
        x = np.array(rows, np.float64).reshape(len(rows), -1)
        norm = np.sqrt((x * x).sum(1))
        return np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)

    sizes: dict[int, list[int]] = {}
    for j, r in enumerate(request):
        sizes.setdefault(len(r["query"] or ()), []).append(j)
    units = {n: unit([request[j]["query"] for j in js]) for n, js in sizes.items() if n}
    ids = np.array([r["query_id"] for r in request], np.int64)
    schema = f"query_id long, {key} {vectors.schema[key].dataType.simpleString()}, cosine double"

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                column = part.column("embedding")
                length = np.diff(np.array(column.offsets))
                cosine = np.zeros((part.num_rows, len(ids)))
                for n in np.unique(length).tolist():
                    if n in units:
                        rows = np.flatnonzero((length == n) & np.array(column.is_valid()))
                        x = np.array(column.take(pa.array(rows)).flatten().cast("double").fill_null(float("nan"))).reshape(len(rows), n)
                        cosine[np.ix_(rows, sizes[n])] = unit(x) @ units[n].T
                keep = np.ones(cosine.shape, bool)
                if part.num_rows > k:
                    keep = cosine >= np.partition(cosine, part.num_rows - k, axis=0)[part.num_rows - k] - 1e-5
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), part.column(key).take(pa.array(i)), pa.array(cosine[i, j])], names=["query_id", key, "cosine"])

    return vectors.select(key, "embedding").mapInArrow(run, schema)


def recall_limit(limit: int) -> int:
    return min(200, max(50, 8 * limit))


def fuse(keyword: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Full outer join of two ranked lists by reciprocal ranks: query_id, key, ranks and fused score."""
    a = keyword.select("query_id", key, F.col("rank").alias("keyword_rank"))
    b = semantic.select("query_id", key, F.col("rank").alias("semantic_rank"))
    return a.join(b, ["query_id", key], "full_outer").withColumn("fused", S.rrf("keyword_rank", "semantic_rank"))


def document_cap(limit: int) -> int:
    return 2 if limit <= 5 else 3


def diversify(rows: DataFrame, limit: int, cap: int, score: str, group: str, tie: list[Column]) -> DataFrame:
    """At most cap rows of a group first, the rest only where places are left; then by score.

    Adds original_rank, final_rank and rank_delta.
    """
    q = Window.partitionBy("query_id")
    rows = rows.withColumn("original_rank", F.row_number().over(q.orderBy(F.desc(score), *tie)).cast("long"))
    rows = rows.withColumn("over_cap", F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.desc(score), *tie)) > cap)
    rows = rows.withColumn("place", F.row_number().over(q.orderBy("over_cap", F.desc(score), *tie))).filter(F.col("place") <= limit)
    rows = rows.withColumn("final_rank", F.row_number().over(q.orderBy(F.desc(score), "over_cap", *tie)).cast("long"))
    return rows.withColumn("rank_delta", F.col("original_rank") - F.col("final_rank")).drop("place")


def origin(snippet, heading, file_name, path, terms) -> Column:
    """Where the terms are found first."""
    has = lambda c: F.exists(terms, lambda t: (t != "") & F.contains(F.lower(X.col(c)), t))
    return F.when(has(snippet), "正文摘要命中").when(has(heading), "标题命中").when(has(file_name), "文件名命中").when(has(path), "路径命中").otherwise("正文摘要命中")


#: How many of a user's recent documents, favourites and past queries a search looks at (fixed values).
RECENT_CAP, FAVORITE_CAP, HISTORY_CAP = 50, 200, 30


def with_user(rows: DataFrame) -> DataFrame:
    """Lists without a user are one user's, who asks all queries."""
    return rows if "user" in rows.columns else rows.withColumn("user", F.lit(0))


def preferred(rows: DataFrame, name: str, cap: int) -> DataFrame:
    """The first rows of a user's list, in the list's own order."""
    return lists.listed_per(with_user(rows), name, "user", cap).drop("rank")


def past_terms(queries: DataFrame, history: DataFrame) -> DataFrame:
    """query_id, past: up to four terms of the user's last queries that the query does not have, by weight.

    queries: query_id, query_text (and user). history: query, hit_count, last_hit_at (and user).
    """
    q = with_user(queries).select("query_id", "user", X.rewrite_terms("query_text").alias("terms"))
    last = preferred(history, "history", HISTORY_CAP)
    mine = q.select("query_id", "user").join(last, "user").select(F.col("query_id").alias("user"), "query", "hit_count")
    current = q.select(F.col("query_id").alias("user"), F.explode("terms").alias("term")).select("user", F.lower(F.trim("term")).alias("term"))
    found = activity.history_terms(mine, current)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return found.groupBy(F.col("user").alias("query_id")).agg(F.array_join(in_order, " ").alias("past"))


def hybrid_search(queries: DataFrame, chunks: DataFrame, index: inverted.Index | scan.Collection, limit: int, now: int, semantic: DataFrame | None = None, favorites: DataFrame | None = None, opens: DataFrame | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), history: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """The whole search: recall by fields, fusion, boosts, cap, final ranks.

    queries: query_id, query_text (and user). chunks: chunk_id, path, file_name, heading, snippet, modified_at,
    chunk_score. index: of these chunks, or the documents themselves for a pass over them; live: document_id, segment of an
    index that are not gone. semantic: query_id, chunk_id, rank.
    A user's lists, each cut to its cap: favorites: path, title, created_at, updated_at; opens: path, open_count,
    last_opened_at; history: query, hit_count, last_hit_at, whose terms are searched as well (rows of such a query get a
    small bonus and a reason).
    """
    queries = with_user(queries)
    expanded = queries.select("query_id", F.array_join(X.rewrite_terms("query_text"), " ").alias("query_text"))
    if history is not None:
        expanded = expanded.join(past_terms(queries, history), "query_id", "left").select("query_id", F.concat_ws(" ", "query_text", "past").alias("query_text"), F.col("past").isNotNull().alias("grown"))
        expanded = written(expanded, "expanded")
    keyword = scan.search(expanded, index, limit) if isinstance(index, scan.Collection) else inverted.search(expanded, index, limit, live)
    if semantic is None:
        semantic = keyword.select("query_id", "chunk_id", "rank").limit(0)
    # Both lists hold a few rows for each query; they are used by the join and by what follows.
    fused = fuse(keyword, semantic, "chunk_id")
    if history is not None:
        fused = fused.join(expanded.select("query_id", "grown"), "query_id")
    else:
        fused = fused.withColumn("grown", F.lit(False))
    # Written, so that its size is known: a few rows for each query are sent to the chunks, not the chunks to them.
    rows = written(fused, "fused").join(chunks, "chunk_id").join(queries, "query_id")
    if favorites is not None:
        rows = rows.join(preferred(favorites, "favorites", FAVORITE_CAP).select("user", "path", F.lit(True).alias("favorite")), ["user", "path"], "left")
    else:
        rows = rows.withColumn("favorite", F.lit(False))
    if opens is not None:
        rows = rows.join(preferred(opens, "recents", RECENT_CAP).select("user", "path", "open_count"), ["user", "path"], "left")
    else:
        rows = rows.withColumn("open_count", F.lit(0))
    rows = rows.withColumns({"favorite": F.coalesce("favorite", F.lit(False)), "open_count": F.coalesce("open_count", F.lit(0)), "terms": X.search_tokens("query_text")})
    found = F.when(F.col("keyword_rank").isNull(), "语义命中").otherwise(origin("snippet", "heading", "file_name", "path", F.col("terms")))
    rows = rows.withColumn("match_origin", found)
    base = F.col("fused") * F.least(F.greatest(F.col("chunk_score"), F.lit(0.25)), F.lit(1.0))
    wp, wt, wf = weights
    final = (
        S.boosted(base, "match_origin", "modified_at", F.lit(now))
        + S.preference("favorite", "open_count", F.col("grown")) * wp
        + S.name_bonus("heading", F.col("terms"), 0.32, 0.18) * wt
        + S.name_bonus("file_name", F.col("terms"), 0.45, 0.25) * wf
    )
    rows = rows.withColumn("final_score", F.round(final, 6))
    return diversify(rows, limit, document_cap(limit), "final_score", "path", [F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("semantic_rank"), F.asc("chunk_id")])


def rank_reason(now: int | None = None) -> Column:
    """Why a row of ``hybrid_search`` stands where it does, as labels joined by a dot."""
    t = F.col("terms")
    both = F.when(F.col("keyword_rank").isNotNull() & F.col("semantic_rank").isNotNull(), "全文+语义共同命中").when(F.col("semantic_rank").isNotNull(), "语义召回")
    name = F.when(X.contains_all("file_name", t), "文件名完整命中").when(X.contains_all("heading", t), "标题完整命中").when(X.contains_all("path", t), "路径完整命中")
    opened = F.when(F.col("open_count") >= 3, F.concat(F.lit("最近打开 "), F.col("open_count").cast("string"), F.lit(" 次"))).when(F.col("open_count") > 0, "最近打开")
    grown = F.when(F.col("grown"), "历史扩展")
    fresh = F.when((F.col("modified_at") > 0) & (F.lit(now) > F.col("modified_at")) & (F.lit(now) - F.col("modified_at") < 30 * 86_400), "最近更新")
    parts = F.array(F.col("match_origin"), name, both, F.when(F.col("favorite"), "已收藏优先"), opened, grown, fresh)
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p.isNotNull())), " · ")


def group_by_document(rows: DataFrame, score: str) -> DataFrame:
    """Per query and path: hits, total score, best chunk and score."""
    best = F.max_by("chunk_id", F.struct(score, F.col("final_rank") * -1))
    return rows.groupBy("query_id", "path").agg(F.count("*").alias("hits"), F.round(exact_sum(score), 6).alias("total_score"), F.max(score).alias("top_score"), best.alias("top_chunk"))


def preview_blocks(rows: DataFrame, blocks: DataFrame, key: str = "chunk_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """key, document_id, blocks: what block_indexes names, in that order, misses left out; one field as itself,
    several as a struct."""
    wanted = rows.select(key, "document_id", F.posexplode("block_indexes").alias("pos", "block_index"))
    value = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
    found = wanted.join(blocks, ["document_id", "block_index"]).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("value")))), lambda x: x["value"]).alias("blocks"))
    out = rows.select(key, "document_id").join(found, key, "left")
    return out.withColumn("blocks", F.coalesce("blocks", F.array().cast(found.schema["blocks"].dataType)))


def neighbours(chunks: DataFrame, key: str, group: str, seq: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(seq)
    return chunks.select(group, key, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next"))


def islands(rows: DataFrame, by: list[str], seq: str, text: str) -> DataFrame:
    """Runs of neighbouring rows merged; a run of several gets numbered paragraphs."""
    w = Window.partitionBy(*by).orderBy(seq)
    runs = rows.withColumn("island", F.col(seq) - F.row_number().over(w))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(text).alias("text")))), lambda x: x["text"])
    merged = runs.groupBy(*by, "island").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("parts"), parts.alias("texts"))
    numbered = F.array_join(F.transform("texts", lambda t, i: F.concat(F.lit("连续段落 "), (i + 1).cast("string"), F.lit(": "), t)), "\n")
    return merged.withColumn("text", F.when(F.col("parts") == 1, F.col("texts")[0]).otherwise(numbered)).drop("island", "texts")
