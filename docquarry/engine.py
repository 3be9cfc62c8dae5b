"""One object for a collection: ingest, search, browse, ask; tables are Parquet below one folder.

A commit writes new files, then a manifest that names all files which belong together; a manifest is created once
under its version's number, so a reader never sees a half written table and of two writers one is told. Tables of
documents are dealt into buckets by document; a commit writes anew the buckets that it touches, the manifest keeps the
paths of the others. The keyword index is a list of segments, one for each commit that brought documents, merged when
there are more than ``SEGMENTS``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import activity, answers, indexing, inverted, lists, retrieval, substrings, tasks
from docquarry.operators.storage import children, create, read_text, written
from docquarry.settings import AnswerSettings, IndexSettings
from docquarry.sources import chunking, embedding, files, listing

SCHEMAS = {
    "documents": "document_id long, path string, file_name string, ext string, size long, modified_at long, hash string, dir_path string, parser string, warning string",
    "chunks": "chunk_id string, document_id long, chunk_seq long, path string, file_name string, heading string, snippet string, modified_at long, chunk_score double, block_indexes array<int>",
    "blocks": "document_id long, block_index int, kind string, text string, heading string, level int, page int, section string",
    "live": "document_id long, segment string",
    "vectors": "chunk_id string, document_id long, text_hash string, embedding array<float>",
    "failures": "file string, reason string, category string, code string, retry_count long, last_failed_at long",
    "dirs": tasks.DIRECTORY,
    "history": "query string, hit_count long, created_at long, last_hit_at long",
    "recents": "path string, open_count long, title string, last_opened_at long",
    "favorites": "path string, title string, created_at long, updated_at long",
}
#: Tables that are dealt into buckets by document_id.
PER_DOCUMENT = ("documents", "chunks", "blocks", "live", "vectors")
BUCKETS = 16
SEGMENTS = 8


def bucket_of(document: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document), F.lit(buckets)).cast("int")


def columns(name: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[name].split(", ")]


class Engine:
    def __init__(self, spark: SparkSession, root: str, dimension: int = 512, embedder=None, settings: IndexSettings | None = None, buckets: int = BUCKETS):
        """buckets: of a new collection; one that exists keeps its own."""
        self.spark, self.root, self.dimension, self.embedder = spark, root.rstrip("/"), dimension, embedder
        self.settings = (settings or IndexSettings()).clamped()
        self.buckets = self.manifest().get("buckets", buckets)

    # tables

    def manifest(self) -> dict:
        """The last commit: version, the tables' paths, the index's segments, what is known of the vectors. Only a
        collection that does not exist yet has none; any other error is raised, not taken for an empty collection."""
        names = sorted(n for n in children(self.spark, f"{self.root}/_manifests") if n.endswith(".json"))
        if not names:
            return {"version": 0, "tables": {}, "segments": [], "vectors": {"model": "", "status": "empty"}}
        return json.loads(read_text(self.spark, f"{self.root}/_manifests/{names[-1]}"))

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as of the last commit; of a table by document only the given buckets."""
        at = self.manifest()["tables"].get(name, {})
        paths = [p for k, p in at.items() if buckets is None or k == "all" or int(k) in buckets]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def commit(self, changes: dict[str, DataFrame], vectors: dict | None = None, touched: list[int] | None = None, segments: list[str] | None = None) -> None:
        """Writes new versions of the tables, then the manifest that makes them the current ones together.

        touched: the buckets that a table by document is given for (all, if not told); the others stay as they are.
        """
        last, tables = self.manifest(), {}
        for name, df in changes.items():
            path, df = f"{self.root}/{name}/v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", df.select(*columns(name))
            if name not in PER_DOCUMENT:
                df.write.parquet(path)
                tables[name] = {"all": path}
                continue
            every = list(range(self.buckets)) if touched is None else touched
            df.withColumn("_bucket", bucket_of("document_id", self.buckets)).filter(F.col("_bucket").isin(every)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
            kept = {k: p for k, p in last["tables"].get(name, {}).items() if int(k) not in every}
            tables[name] = kept | {d.split("=")[1]: f"{path}/{d}" for d in children(self.spark, path) if d.startswith("_bucket=")}
        now = {"version": last["version"] + 1, "buckets": self.buckets, "tables": last["tables"] | tables, "segments": last["segments"] if segments is None else segments, "vectors": last["vectors"] | (vectors or {})}
        create(self.spark, f"{self.root}/_manifests/v-{now['version']:012d}.json", json.dumps(now))

    def touched(self, documents: DataFrame) -> list[int]:
        """The buckets of some documents: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in documents.select(bucket_of("document_id", self.buckets).alias("b")).distinct().collect())

    def index(self) -> inverted.Index:
        return inverted.Index(self.spark, "bigint", "string", self.manifest()["segments"], self.buckets)

    # ingest

    def _listed(self, folder: str) -> DataFrame:
        """What the folder holds: names, sizes and times."""
        s = self.settings
        return files.found(self.spark, folder, s.max_file_size_mb, s.exclude_exts, s.exclude_dirs)

    def plan(self, folder: str, found: DataFrame | None = None, thorough: bool = False) -> DataFrame:
        """What a refresh of the folder would do: path, action. A file whose size and time are the known ones counts as
        unchanged and is not opened; thorough: all files are read and their hashes compared as well."""
        found = self._listed(folder) if found is None else found
        known = self.table("documents").filter(X.in_directory("path", F.lit(folder)) | F.startswith("path", F.lit(f"file:{folder}")))
        if thorough:
            found = found.join(listing.read_files(found).select("path", F.col("content_hash").alias("hash")), "path")
        else:
            found, known = found.withColumn("hash", F.lit("")), known.withColumn("hash", F.lit(""))
        return indexing.incremental_plan(found, known)

    def refresh(self, folder: str, only: DataFrame | None = None, virtual: str | None = None, thorough: bool = False) -> dict[str, int]:
        """Takes in new and changed files, removes deleted ones; returns how many of each.

        only: path - read these again whatever the plan says (retry). A file that cannot be read becomes a row of
        ``failures``; its older version stays. The folder is listed once, and only new and changed files are opened.
        """
        snapshot = written(self._listed(folder), "listing")
        return self._apply(snapshot, self.plan(folder, snapshot, thorough), only, virtual)

    def _apply(self, snapshot: DataFrame, plan: DataFrame, only: DataFrame | None, virtual: str | None = None) -> dict[str, int]:
        """Works off a plan over a listing, all of it or the paths of ``only`` whatever it says of them."""
        plan = written(plan if only is None else tasks.retried(plan, only.withColumnRenamed("path", "file")), "plan")
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        if not counts.keys() - {"skip"}:
            return counts
        changed = plan.filter("action IN ('insert', 'update')").select("path")
        fresh = snapshot.join(changed, "path", "left_semi").withColumn("document_id", F.xxhash64("path"))
        contents = listing.read_files(fresh).join(fresh.select("path", "document_id", "ext", "file_name"), "path")
        hashed = contents.select("document_id", "ext", F.col("file_name").alias("stem"), F.col("content").alias("text"))
        parsed = written(chunking.outcomes(hashed).join(contents.select("document_id", F.col("content_hash").alias("hash")), "document_id"), "parsed")
        known = fresh.select("document_id", "path", "file_name", "ext", "size", "modified_at")
        read = parsed.filter("reason IS NULL").join(known, "document_id")
        documents = read.withColumn("dir_path", F.lit(virtual) if virtual else F.regexp_replace("path", "/[^/]*$", ""))
        chunks = read.select("document_id", "path", "file_name", "modified_at", F.inline("chunks")).select(
            F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_seq").cast("string")).alias("chunk_id"),
            "document_id", "chunk_seq", "path", "file_name", "heading", X.truncate_chars("snippet", 800).alias("snippet"), "modified_at",
            F.least(F.greatest("score", F.lit(0.25)), F.lit(1.0)).alias("chunk_score"), "block_indexes",
        )
        chunks = written(chunks, "chunks")
        made = {"documents": documents, "chunks": chunks, "blocks": chunking.blocks_of(parsed)}
        # What goes: deleted files, and the old rows of those that were read anew.
        gone = written(plan.filter("action = 'delete'").select(F.xxhash64("path").alias("document_id")).unionByName(read.select("document_id")), "gone")
        touched = self.touched(gone)
        segments, merged = self._segments(chunks, read, gone)
        made["live"] = read.select("document_id", F.lit(segments[-1] if segments else "").alias("segment"))
        ready = self.manifest()["vectors"]["status"] == "ready"
        if ready:  # vectors come with their documents once the collection has some
            made["vectors"] = self._embedded(chunks)
        kept = indexing.cascade({n: self.table(n, touched) for n in PER_DOCUMENT}, gone)
        changes = {n: kept[n].select(*columns(n)).unionByName(made[n].select(*columns(n))) if n in made else kept[n] for n in PER_DOCUMENT}
        changes["failures"] = self._failures(parsed.filter("reason IS NOT NULL").join(known, "document_id").select(F.col("path").alias("file"), "reason"), plan)
        self.commit(changes, {} if ready else {"status": "needs_rebuild"}, touched, segments)
        if merged:
            self.merge_segments()
        return counts

    def _segments(self, chunks: DataFrame, read: DataFrame, gone: DataFrame) -> tuple[list[str], bool]:
        """The index's segments with a new one for what was read, and whether there are too many of them."""
        contents = read.select("document_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("content"))
        with_ext = chunks.join(read.select("document_id", "ext"), "document_id")
        path = f"{self.root}/index/s-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        inverted.build(with_ext, contents, path, self.buckets)
        segments = [*self.manifest()["segments"], path]
        return segments, len(segments) > SEGMENTS

    def index_substrings(self) -> None:
        """Builds the index for containment recall over the chunks as they are; the next change of chunks makes it old."""
        path = f"{self.root}/substrings/v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        substrings.build(self.table("chunks"), path, self.buckets)
        self.commit({}, {"substrings": path, "of_chunks": self.manifest()["tables"].get("chunks", {})})

    def substring_index(self) -> substrings.Index | None:
        """The index of the chunks as they are, if there is one."""
        m = self.manifest()
        known = m["vectors"].get("substrings")
        return substrings.Index(self.spark, known, "string", self.buckets) if known and m["vectors"]["of_chunks"] == m["tables"].get("chunks", {}) else None

    def merge_segments(self) -> None:
        """All segments become one, without what was replaced or deleted."""
        path, live = f"{self.root}/index/s-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", self.table("live")
        inverted.merge(self.index(), live, path)
        self.commit({"live": live.select("document_id", F.lit(path).alias("segment"))}, segments=[path])

    def _failures(self, fresh: DataFrame, plan: DataFrame) -> DataFrame:
        """Failed files: counted up where they fail again, gone where they were read or deleted."""
        old = self.table("failures")
        category, code = X.classify_failure("reason", "file")
        again = fresh.join(old.select("file", F.col("retry_count").alias("before")), "file", "left").select("file", "reason", category.alias("category"), code.alias("code"), (F.coalesce("before", F.lit(0)) + 1).alias("retry_count"), F.lit(int(time.time())).alias("last_failed_at"))
        return old.join(plan.filter("action <> 'skip'").select(F.col("path").alias("file")), "file", "left_anti").unionByName(again)

    ingest = refresh

    def retry(self, folder: str) -> dict[str, int]:
        """Reads the folder's failed files again."""
        return self.refresh(folder, self.table("failures").select(F.col("file").alias("path")))

    def import_paths(self, paths: DataFrame) -> DataFrame:
        """paths: path, is_dir, exists. How each would be taken in: kind, dir."""
        return files.classify_imports(paths, self.table("dirs").select(F.col("path").alias("dir")))

    def run(self, folder: str, batches: int, task: tasks.Task, paused: Callable[[], bool], mark: Callable[[dict[str, bool]], None], done: DataFrame | None = None) -> tasks.Task:
        """Works a plan off in so many batches of files, each a commit of its own; what ``done`` (path) names is left out."""
        done = done if done is not None else self.spark.createDataFrame([], "path string")
        snapshot = written(self._listed(folder), "listing")
        plan = written(self.plan(folder, snapshot), "plan")
        todo = written(tasks.remaining(plan, done).withColumn("batch", F.when(F.col("action") == "delete", -1).otherwise(F.pmod(F.xxhash64("path"), F.lit(batches)))), "todo")

        def step(batch: list[tuple[str, str]]) -> dict[str, bool]:
            paths = self.spark.createDataFrame([(p,) for p, _ in batch], "path string")
            self._apply(snapshot, plan, paths)
            failed = {r["file"] for r in self.table("failures").join(paths.withColumnRenamed("path", "file"), "file", "left_semi").select("file").collect()}
            return {p: p not in failed for p, _ in batch}

        def parts():
            # A batch's paths at a time reach the driver, as many as the caller wants in a commit; deletes come first.
            for k in range(-1, batches):
                if part := [(r["path"], r["action"]) for r in todo.filter(F.col("batch") == k).select("path", "action").collect()]:
                    yield part

        return tasks.run_plan(parts(), todo.count(), step, task, mark, paused, lambda: int(time.time()))

    # vectors

    def _texts(self) -> DataFrame:
        return self._embeddable(self.table("chunks"))

    @staticmethod
    def _embeddable(chunks: DataFrame) -> DataFrame:
        text = X.normalize_embedding_text(F.concat_ws("\n", "file_name", "heading", "snippet"))
        return chunks.select("chunk_id", "document_id", text.alias("text"))

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        none = self.spark.createDataFrame([], SCHEMAS["vectors"])
        return embedding.embed(embedding.stale(self._embeddable(chunks), none, "chunk_id", "text"), "text", self.dimension, self.embedder)

    def rebuild_vectors(self) -> None:
        """Embeds the chunks whose text is new; vectors of chunks that are gone go."""
        chunks, old = written(self._texts(), "texts"), self.table("vectors")
        new = embedding.embed(embedding.stale(chunks, old, "chunk_id", "text"), "text", self.dimension, self.embedder)
        hashed = chunks.select("chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
        new, gone = written(new.select(*old.columns), "vectors"), written(old.join(hashed, ["chunk_id", "text_hash"], "left_anti").select("chunk_id", "document_id"), "stale")
        touched = self.touched(new.select("document_id").unionByName(gone.select("document_id")))
        kept = self.table("vectors", touched).join(gone, "chunk_id", "left_anti")
        self.commit({"vectors": kept.unionByName(new)}, {"status": "ready"}, touched)

    def use_model(self, model: str) -> None:
        """Another model: no vector of the old one stays, all have to be made anew."""
        self.dimension = embedding.dimension_of(model, self.dimension)
        self.commit({"vectors": self.table("vectors").limit(0)}, {"model": model, "dimension": self.dimension, "status": "needs_rebuild"})

    # upkeep

    def needs_repair(self) -> bool:
        """Whether there are chunks but no index."""
        return not self.manifest()["segments"] and not self.table("chunks").isEmpty()

    def repair(self) -> None:
        """Makes the keyword index anew: chunks from their table, contents from the blocks."""
        blocks = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"])
        contents = self.table("blocks").groupBy("document_id").agg(F.array_join(blocks, "\n").alias("content"))
        documents, path = self.table("documents"), f"{self.root}/index/s-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        inverted.build(self.table("chunks").join(documents.select("document_id", "ext"), "document_id"), contents, path, self.buckets)
        self.commit({"live": documents.select("document_id", F.lit(path).alias("segment"))}, segments=[path])

    def delete(self, directory: str) -> None:
        """Removes a directory's documents and failed files with all that belongs to them."""
        gone = self.table("documents").filter(X.in_directory("path", F.lit(directory), "dir_path")).select("document_id")
        touched = self.touched(gone)
        kept = indexing.cascade({n: self.table(n, touched) for n in PER_DOCUMENT}, gone)
        kept["failures"] = self.table("failures").filter(~X.in_directory("file", F.lit(directory)))
        self.commit(kept, touched=touched)

    def clear(self) -> None:
        """Everything but the directories goes."""
        self.commit(tasks.cleared({n: self.table(n) for n in SCHEMAS}), {"status": "empty"}, segments=[])

    # what users do

    def opened(self, rows: DataFrame) -> None:
        """rows: path, title, ts. Documents that were opened, counted up."""
        new = activity.fold_recents(rows.withColumn("seq", F.monotonically_increasing_id()))
        both = self.table("recents").unionByName(new.select(*columns("recents")))
        self.commit({"recents": both.groupBy("path").agg(F.sum("open_count").alias("open_count"), F.max_by("title", "last_opened_at").alias("title"), F.max("last_opened_at").alias("last_opened_at"))})

    def toggle_favorites(self, rows: DataFrame) -> None:
        """rows: path, title, ts. A favourite goes if toggled an odd number of times, another path becomes one."""
        odd = activity.toggled(rows.withColumnRenamed("path", "target")).withColumnRenamed("target", "path")
        old = self.table("favorites")
        titles = rows.groupBy("path").agg(F.max_by("title", "ts").alias("title"))
        new = odd.join(old, "path", "left_anti").join(titles, "path").select("path", "title", F.col("updated_at").alias("created_at"), "updated_at")
        self.commit({"favorites": old.join(odd, "path", "left_anti").unionByName(new)})

    def record(self, hits: DataFrame) -> None:
        """hits: query, hits, ts. Searches, added to the history."""
        new = activity.fold_history(hits)
        both = self.table("history").unionByName(new.select(*columns("history")))
        self.commit({"history": both.groupBy("query").agg(F.sum("hit_count").alias("hit_count"), F.min("created_at").alias("created_at"), F.max("last_hit_at").alias("last_hit_at"))})

    def add_directories(self, paths: list[str]) -> None:
        self.commit({"dirs": tasks.add_directories(self.table("dirs"), self._paths(paths))})

    def remove_directory(self, path: str) -> None:
        self.delete(path)
        self.commit({"dirs": tasks.remove_directories(self.table("dirs"), self._paths([path]))})

    def enable(self, path: str, on: bool = True) -> None:
        self.commit({"dirs": tasks.set_enabled(self.table("dirs"), self._paths([path]).withColumn("enabled", F.lit(on)))})

    def refresh_directories(self) -> None:
        self.commit({"dirs": tasks.refreshed(self.table("dirs"), self._counted())})

    def _paths(self, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "path string")

    def _counted(self) -> DataFrame:
        counts = self.table("chunks").groupBy("document_id").agg(F.count("*").alias("n_chunks"))
        return self.table("documents").join(counts, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))

    def status(self) -> DataFrame:
        vectors = self.table("vectors").agg(F.count("*").alias("vectors"))
        totals = self.table("documents").agg(F.count("*").alias("documents")).crossJoin(self.table("chunks").agg(F.count("*").alias("chunks"))).crossJoin(vectors)
        return totals.crossJoin(self.table("failures").agg(F.count("*").alias("failures"))).withColumn("needs_rebuild", F.col("chunks") != F.col("vectors"))

    # browse

    def documents(self, directory: str | None = None) -> DataFrame:
        d = self.table("documents")
        return lists.listed(d.filter(X.in_directory("path", F.lit(directory), "dir_path")) if directory else d, "documents")

    def chunks(self, path: str) -> DataFrame:
        """A document's chunks in order, each with its preview blocks (kind, text, page, asset); none for an unknown path."""
        rows = self.table("chunks").filter(F.col("path") == path)
        view = indexing.block_view(self.table("blocks").join(rows.select("document_id").distinct(), "document_id", "left_semi"), self.table("documents"))
        shown = retrieval.preview_blocks(rows, view, fields=("kind", "text", "page", "asset"))
        return rows.join(shown.select("chunk_id", "blocks"), "chunk_id").orderBy("chunk_seq")

    def blocks(self, ids: DataFrame) -> DataFrame:
        return indexing.blocks_of(self.table("blocks"), ids)

    def dirs(self) -> DataFrame:
        return indexing.rollup(self._counted())

    # search and answers

    def _semantic(self, queries: DataFrame, limit: int, threshold: float) -> DataFrame:
        texts = queries.select("query_id", F.array_join(X.rewrite_terms("query_text"), " ").alias("t"))
        asked = embedding.embed(texts, "t", self.dimension, self.embedder).select("query_id", F.col("embedding").alias("query"))
        vectors = self.table("vectors").join(self.table("chunks").select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "embedding")
        return retrieval.cosine_search(asked, vectors, retrieval.recall_limit(limit), "chunk_id").filter(F.col("score") >= threshold)

    def _ranked(self, queries: DataFrame, limit: int, now: int | None, semantic: bool, threshold: float, **signals) -> DataFrame:
        if self.needs_repair():
            raise RuntimeError("the keyword index is empty: call repair() first")
        found = self._semantic(queries, limit, threshold) if semantic else None
        now = now or int(time.time())
        s = self.settings
        own = {"favorites": self.table("favorites") if s.prefer_favorites_enabled else None, "opens": self.table("recents") if s.prefer_recent_enabled else None, "history": self.table("history") if s.prefer_history_enabled else None, "weights": (s.preference_weight, s.title_weight, s.filename_weight)}
        rows = retrieval.hybrid_search(queries, self.table("chunks"), self.index(), limit, now, found, live=self.table("live"), **own | signals)
        return rows.withColumn("reason", retrieval.rank_reason(now))

    def search(self, queries: DataFrame, limit: int = 20, now: int | None = None, semantic: bool = True, threshold: float | None = None, record: bool = False, **signals) -> DataFrame:
        """queries: query_id, query_text. Ranked chunks with origin, reason, snippet and highlights.

        Favourites, opened documents and past queries are the collection's own where the settings want them;
        signals stand in for them. record: the queries become history with their numbers of hits.
        """
        rows = self._ranked(queries, limit, now, semantic, self.settings.semantic_threshold if threshold is None else threshold, **signals)
        if record:
            rows = written(rows, "ranked")
            counts = rows.groupBy("query_id").agg(F.count("*").alias("hits"))
            asked = queries.join(counts, "query_id", "left").select(F.col("query_text").alias("query"), F.coalesce("hits", F.lit(0)).alias("hits"), F.lit(now or int(time.time())).cast("long").alias("ts"))
            self.record(asked)
        rows = rows.withColumn("cut", X.search_snippet("snippet", X.highlight_spans("snippet", F.col("terms"))))
        return rows.select("query_id", "final_rank", "rank_delta", "chunk_id", "path", "heading", "final_score", "keyword_rank", "semantic_rank", "match_origin", "reason", F.col("cut.text").alias("shown"), F.col("cut.spans").alias("highlights"))

    def explain_search(self, queries: DataFrame, limit: int = 20, now: int | None = None) -> DataFrame:
        """For each query: terms, rewritten terms, the query vector's norm, hits by list and in all, and the
        collection's numbers."""
        threshold = self.settings.semantic_threshold
        rows = written(self._ranked(queries, limit, now, True, threshold), "explained")
        hits = rows.groupBy("query_id").agg(F.count("keyword_rank").alias("keyword_hits"), F.count("semantic_rank").alias("semantic_hits"), F.count_if(F.col("keyword_rank").isNotNull() & F.col("semantic_rank").isNotNull()).alias("both"), F.count("*").alias("hits"))
        asked = queries.select("query_id", X.search_tokens("query_text").alias("terms"), X.rewrite_terms("query_text").alias("rewritten"))
        vector = embedding.embed(asked.select("query_id", F.array_join("rewritten", " ").alias("t")), "t", self.dimension, self.embedder)
        norm = vector.select("query_id", F.size("embedding").alias("dimension"), F.round(retrieval.S.norm("embedding"), 6).alias("norm"))
        out = asked.join(norm, "query_id").join(hits, "query_id", "left").fillna(0, ["keyword_hits", "semantic_hits", "both", "hits"])
        return out.crossJoin(F.broadcast(self.status()))  # one row

    def ask(self, questions: DataFrame, limit: int | None = None, answerer=answers.extractive, rules=answers.INTENTS, scopes: DataFrame | None = None, settings: AnswerSettings | None = None) -> DataFrame:
        """questions: query_id, question (and context, a session's text). scopes: query_id, scope. Answers with sources,
        state and citation warning; the settings give the number of sources, the least score and rules of the user's."""
        s = (settings or AnswerSettings()).clamped()
        limit, rules = limit or s.context_chunk_limit, [*rules, *answers.rules_from_json(s.intent_synonym_rules_json)]
        chunks = self.table("chunks")
        found = answers.recall(questions, chunks, max(6 * limit, 50), rules, "context" in questions.columns, scopes, self.substring_index()).join(chunks.select("chunk_id", "path", "chunk_seq", "snippet"), "chunk_id")
        return answers.answer(questions, answers.pack_context(answers.select_evidence(found, limit, s.min_retrieval_score), limit), answerer)
