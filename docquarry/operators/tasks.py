"""Index jobs: what a plan still has to do, directories, failed files, the state of the running task, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as X

DIRECTORY = "path string, enabled boolean, docs long, chunks long, status string"


# Directories


def add_directories(dirs: DataFrame, paths: DataFrame) -> DataFrame:
    """paths: path. An added directory replaces the row of the same path: enabled, no counts, pending."""
    fresh = paths.select("path").distinct().select("path", F.lit(True).alias("enabled"), F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("chunks"), F.lit("pending").alias("status"))
    return dirs.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def remove_directories(dirs: DataFrame, paths: DataFrame) -> DataFrame:
    return dirs.join(paths.select("path"), "path", "left_anti")


def below(rows: DataFrame, dirs: DataFrame, column: str = "path") -> DataFrame:
    """Rows at or below one of the directories (dirs: path), by an equality join on every path's ancestors."""
    up = rows.select(F.col(column).alias("_at"), F.explode(F.concat(F.array(X.normalize_path(column)), X.ancestors(column))).alias("path"))
    hit = up.join(dirs.select(X.normalize_path("path").alias("path")), "path", "left_semi").select(F.col("_at").alias(column)).distinct()
    return rows.join(hit, column, "left_semi")


def not_below(rows: DataFrame, dirs: DataFrame, column: str = "path") -> DataFrame:
    """What a removed directory leaves: documents, failed files and what else has a path."""
    return rows.join(below(rows.select(column), dirs, column).distinct(), column, "left_anti")


def set_enabled(dirs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: path, enabled; directories that are not listed are not made."""
    new = changes.groupBy("path").agg(F.max("enabled").alias("_enabled"))
    return dirs.join(new, "path", "left").withColumn("enabled", F.coalesce("_enabled", "enabled")).drop("_enabled")


def enabled(dirs: DataFrame) -> DataFrame:
    return dirs.filter("enabled").orderBy("path")


def refreshed(dirs: DataFrame, documents: DataFrame) -> DataFrame:
    """Directories with the numbers of their documents (path, n_chunks) and the status that follows."""
    up = documents.select("n_chunks", F.explode(X.ancestors("path")).alias("path"))
    counts = up.groupBy("path").agg(F.count("*").alias("_docs"), F.sum("n_chunks").cast("long").alias("_chunks"))
    out = dirs.join(counts, "path", "left").withColumns({"docs": F.coalesce("_docs", F.lit(0)).cast("long"), "chunks": F.coalesce("_chunks", F.lit(0)).cast("long")})
    return out.withColumn("status", F.when(F.col("docs") > 0, "indexed").otherwise("empty")).drop("_docs", "_chunks")


# Failed files


def clear_failures(failures: DataFrame, dirs: DataFrame | None = None, file: str | None = None) -> DataFrame:
    """Failed files without those below the directories, or without one file, or without all."""
    if dirs is not None:
        return not_below(failures, dirs, "file")
    return failures.filter(F.col("file") != file) if file is not None else failures.filter("false")


def replace_failures(failures: DataFrame, fresh: DataFrame) -> DataFrame:
    """A new list in place of the old one; of a file that is on it twice the last reason (by seq)."""
    last = fresh.groupBy("file").agg(F.max_by("reason", "seq").alias("reason"))
    category, code = X.classify_failure("reason", "file")
    return last.select("file", "reason", category.alias("category"), code.alias("code")).select(*[c for c in failures.columns if c in ("file", "reason", "category", "code")])


# Plans


def progress(plan: DataFrame, done: DataFrame) -> DataFrame:
    """path, action, state of each step: done where the checkpoint (done: path, ok) names it, failed, else waiting."""
    marks = done.groupBy("path").agg(F.max("ok").alias("ok"))
    state = F.when(F.col("ok").isNull(), "waiting").when(F.col("ok"), "done").otherwise("failed")
    return plan.filter("action <> 'skip'").join(marks, "path", "left").select("path", "action", state.alias("state"))


def remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run does: steps without a mark; deletes come before the others."""
    order = F.when(F.col("action") == "delete", 0).otherwise(1)
    return plan.filter("action <> 'skip'").join(done.select("path"), "path", "left_anti").withColumn("turn", order)


def retried(plan: DataFrame, failures: DataFrame, path: str | None = None) -> DataFrame:
    """The steps of failed files (file), or of one path: read again whatever the plan said."""
    wanted = failures.select(F.col("file").alias("path")).distinct() if path is None else failures.sparkSession.createDataFrame([(path,)], "path string")
    return plan.join(wanted, "path").select("path", F.when(F.col("action") == "delete", "delete").otherwise("update").alias("action"))


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: deletes, updates (with inserts) and skips; skips are what was found less deletes and updates, 0 at least."""
    n = plan.agg(F.count_if(F.col("action") == "delete").alias("deletes"), F.count_if(F.col("action").isin("insert", "update")).alias("updates"), F.count_if(F.col("action") != "delete").alias("found"))
    return n.select("deletes", "updates", F.greatest(F.col("found") - F.col("deletes") - F.col("updates"), F.lit(0)).alias("skipped"))


def ocr_queue(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """path and pages that wait for recognition: pages of living documents whose decision is not none, oldest first."""
    waiting = tasks.filter(F.col("reason") != "none").groupBy("path").agg(F.count("*").alias("pages"), F.min("queued_at").alias("queued_at"))
    return waiting.join(documents.select("path"), "path", "left_semi").orderBy("queued_at", "path")


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table empty; of directories the rows stay, without counts, pending."""
    out = {name: df.limit(0) for name, df in tables.items()}
    if "dirs" in tables:
        out["dirs"] = tables["dirs"].withColumns({"docs": F.lit(0).cast("long"), "chunks": F.lit(0).cast("long"), "status": F.lit("pending")})
    return out


# The running task


@dataclass(frozen=True)
class Task:
    """The one running task: running, paused, done or failed; it keeps its start while it runs or waits."""

    label: str = ""
    state: str = "idle"
    path: str = ""
    done: int = 0
    total: int = 0
    failed: int = 0
    started_at: int = 0
    warning: str = ""
    pause_requested: bool = False

    def moved(self, now: int, **changes) -> Task:
        keep = self.started_at if self.state in ("running", "paused") and self.started_at > 0 else now
        return replace(self, **changes, started_at=keep)

    def pause(self) -> Task:
        return replace(self, pause_requested=True)

    def resumed(self) -> Task:
        return replace(self, pause_requested=False)

    def recovered(self, checkpoint: bool) -> Task | None:
        """What a restart makes of it: an interrupted run is paused if it can go on, else there is no task."""
        if self.state != "running":
            return self
        return replace(self, state="paused", warning="上次任务被中断", pause_requested=True) if checkpoint else None

    @property
    def percent(self) -> int:
        return 0 if self.total <= 0 else max(0, min(100, round(100 * self.done / self.total)))


def run_plan(batches: Iterable[list[tuple[str, str]]], steps: int, step: Callable[[list[tuple[str, str]]], dict[str, bool]], task: Task, mark: Callable[[dict[str, bool]], None], paused: Callable[[], bool], now: Callable[[], int]) -> Task:
    """Works a plan off batch by batch (path, action): each batch is one Spark job, its marks are kept before the
    next one begins, so a run that is paused or dies goes on after the last mark. steps: of all batches, which come in
    the order they are worked off in, deletes first."""
    task = task.moved(now(), state="running", total=task.done + steps)
    for batch in batches:
        if paused():
            return task.moved(now(), state="paused", pause_requested=True)
        marks = step(batch)
        mark(marks)
        task = task.moved(now(), done=task.done + len(batch), failed=task.failed + sum(not ok for ok in marks.values()), path=batch[-1][0] if batch else task.path)
    return task.moved(now(), state="done")


# Codes and messages of progress (fixed values)

SCOPES = (("pdf-ocr", "pdfOcr"), ("dir", "dir"), ("fulltext-repair", "fulltextRepair"))
STAGES = (("start", "start"), ("extract", "extract"), ("normalize", "normalize"), ("ocr_queue", "ocrQueue"), ("chunk", "chunk"), ("done", "done"))
MESSAGES = (("start", "正在开始解析"), ("extract", "正在提取内容块"), ("normalize", "正在整理内容块"), ("ocr_queue", "正在排队 OCR"), ("chunk", "正在生成切片"), ("done", "解析完成"))
#: Stages of an answer and the states that a user sees (fixed values).
ANSWER_STATES = (
    ("searching", ("bootstrap", "retrieve", "rank", "pack_evidence")),
    ("generating", ("prompt", "generate", "final_stream")),
    ("streaming", ("answer_delta", "final_answer_delta")),
    ("verifying", ("verify", "judge", "repair", "refuse", "finalize", "finish")),
    ("failed", ("failed",)),
)


def _picked(column, pairs, other) -> Column:
    out = None
    for key, value in pairs:
        hit = X.col(column) == key
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(other)


def progress_code(scope, state) -> Column:
    return F.concat(F.lit("index."), _picked(scope, SCOPES, F.lit("all")), F.lit("."), X.col(state))


def stage_code(stage) -> Column:
    return F.concat(F.lit("index.parser."), _picked(stage, STAGES, F.lit("unknown")))


def stage_message(stage, message, current, processed, total, fallback: str = "") -> Column:
    """The event's own message, else the stage's, with what is at hand where the stage shows it."""
    own, at = F.trim(F.coalesce(X.col(message), F.lit(""))), F.trim(F.coalesce(X.col(current), F.lit("")))
    stage = X.col(stage)
    behind = F.when((stage == "chunk") & (at != ""), F.concat(F.lit(" · "), at)).when((stage == "ocr_queue") & (at != "") & (X.col(total) > 0) & (own == ""), F.concat(F.lit(" · "), X.col(processed).cast("string"), F.lit("/"), X.col(total).cast("string"))).otherwise("")
    return F.concat(F.when(own != "", own).otherwise(_picked(stage, MESSAGES, F.lit(fallback))), behind)


def stream_percent(before, total, percent) -> Column:
    """Files done before this one and this one's own percent, of all; 0 without files."""
    value = F.round((X.col(before) + X.col(percent) / 100.0) / X.col(total) * 100.0)
    return F.when(X.col(total) == 0, 0).otherwise(F.least(F.greatest(value, F.lit(0)), F.lit(100))).cast("int")


def answer_state(stage) -> Column:
    return _picked(stage, [(s, name) for name, stages in ANSWER_STATES for s in stages], F.lit("running"))
