"""The engine end to end on a small folder, and its SQL functions."""

from docquarry.engine import Engine
from docquarry.functions.register import register


def test_engine(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Harbour\nThe harbour port is 8080 and needs a pilot.\n")
    (folder / "b.txt").write_text("Weather notes about rain and wind.")
    e = Engine(spark, f"file://{tmp_path}/store", dimension=64, buckets=2)
    assert e.refresh(str(folder)) == {"insert": 2}
    assert e.refresh(str(folder)) == {"skip": 2}
    e.rebuild_vectors()
    assert e.status().first().asDict() == {"documents": 2, "chunks": 2, "vectors": 2, "failures": 0, "needs_rebuild": False}
    queries = spark.createDataFrame([(1, "harbour port"), (2, "rain")], "query_id long, query_text string")
    got = {(r["query_id"], r["final_rank"]): r for r in e.search(queries, 5, now=2_000_000_000).collect()}
    assert got[1, 1]["path"].endswith("a.md") and got[2, 1]["path"].endswith("b.txt")
    assert got[1, 1]["highlights"]
    answer = e.ask(spark.createDataFrame([(1, "harbour port")], "query_id long, question string")).first()
    assert answer["state"] == "answered" and "8080" in answer["answer"]
    (folder / "b.txt").unlink()
    (folder / "a.md").write_text("# Harbour\nChanged words here.\n")
    assert e.refresh(str(folder)) == {"update": 1, "delete": 1}
    assert [r["snippet"] for r in e.table("chunks").collect()] == ["Changed words here."]


def test_failures_previews_and_directories(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("# Harbour\n\nThe harbour needs a pilot.\n\n![map](img/map.png)\n")
    (folder / "sub" / "bad.docx").write_bytes(b"not a zip")
    e = Engine(spark, f"file://{tmp_path}/store", dimension=32, buckets=2)
    assert e.manifest()["version"] == 0 and e.table("chunks").count() == 0
    assert e.refresh(str(folder)) == {"insert": 2}
    failed = e.table("failures").collect()
    assert [(r["file"].endswith("bad.docx"), r["retry_count"]) for r in failed] == [(True, 1)]
    assert e.retry(str(folder)) == {"update": 1} and e.table("failures").first()["retry_count"] == 2
    path = e.documents().first()["path"]
    shown = e.chunks(path).collect()
    assert [b["kind"] for r in shown for b in r["blocks"]] == ["paragraph", "image"]
    assert shown[0]["blocks"][1]["asset"].endswith("/docs/map") and e.chunks("nowhere").count() == 0
    e.add_directories([f"file:{folder}"])
    e.refresh_directories()
    row = e.table("dirs").first()
    assert (row["docs"], row["chunks"], row["status"], row["enabled"]) == (1, 1, "indexed", True)
    e.enable(f"file:{folder}", False)
    assert not e.table("dirs").first()["enabled"]
    e.commit({}, segments=[])
    assert e.needs_repair()
    e.repair()
    assert not e.needs_repair()
    e.rebuild_vectors()
    q = spark.createDataFrame([(1, "harbour pilot")], "query_id long, query_text string")
    told = e.explain_search(q, 5, now=2_000_000_000).first()
    assert told["keyword_hits"] == 1 and told["hits"] >= 1 and told["dimension"] == 32
    scopes = spark.createDataFrame([(1, "/elsewhere"), (2, f"FILE:{folder}")], "query_id long, scope string")
    asked = spark.createDataFrame([(1, "harbour pilot"), (2, "harbour pilot"), (3, "harbour pilot")], "query_id long, question string")
    states = {r["query_id"]: r["state"] for r in e.ask(asked, scopes=scopes).collect()}
    assert states == {1: "insufficient_evidence", 2: "answered", 3: "answered"}
    e.use_model("BAAI/bge-small-zh-v1.5")
    assert e.table("vectors").count() == 0 and e.manifest()["vectors"]["dimension"] == 512
    e.remove_directory(f"file:{folder}")
    assert e.table("documents").count() == e.table("failures").count() == e.table("dirs").count() == 0
    e.clear()
    assert e.status().first()["chunks"] == 0


def test_a_paused_run_goes_on(spark, tmp_path):
    from docquarry.operators.tasks import Task

    folder = tmp_path / "docs"
    folder.mkdir()
    for k in range(9):
        (folder / f"{k}.txt").write_text(f"text number {k}")
    e, marks = Engine(spark, f"file://{tmp_path}/store", dimension=16, buckets=2), {}
    stop = iter([False, True])
    task = e.run(str(folder), 3, Task("all"), lambda: next(stop, True), marks.update)
    assert task.state == "paused" and 0 < len(marks) < 9 and all(marks.values())
    done = spark.createDataFrame([(p,) for p in marks], "path string")
    started = task.started_at
    task = e.run(str(folder), 3, task.resumed(), lambda: False, marks.update, done)
    assert task.state == "done" and len(marks) == 9 and task.started_at == started and task.percent == 100
    assert e.table("documents").count() == 9


def test_read_errors_are_not_empty_collections(spark, tmp_path):
    (tmp_path / "store" / "_manifests").mkdir(parents=True)
    (tmp_path / "store" / "_manifests" / "v-000000000001.json").write_text("{broken\n")
    import pytest

    with pytest.raises(ValueError):
        Engine(spark, f"file://{tmp_path}/store").table("documents")


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT search_tokens('A b 中文字') AS t, cosine(array(1D, 0D), array(1D, 0D)) AS c, citation_ids('x [1] [2] [1]') AS i, truncate_chars('abc', 2) AS s, size(hash_embed('x y', 8)) AS h").first()
    assert (row["t"], row["c"], row["i"], row["s"], row["h"]) == (["a", "b", "中文", "文字"], 1.0, ["1", "2"], "ab…", 8)
    rows = spark.sql("SELECT kind, text FROM parse_markdown('# T\n\nbody')").collect()
    assert [tuple(r) for r in rows] == [("heading", "T"), ("paragraph", "body")]
    assert spark.sql("SELECT snippet FROM chunk_text('<p>one two three four</p>', 'html', 800)").first()["snippet"] == "one two three four"


def test_a_change_rewrites_its_bucket_only(spark, tmp_path):
    """One changed file of eight: its bucket of every table is new, the others' files stay; the index gains a segment."""
    folder = tmp_path / "docs"
    folder.mkdir()
    for k in range(8):
        (folder / f"{k}.txt").write_text(f"text number {k} about harbours")
    e = Engine(spark, f"file://{tmp_path}/store", dimension=16, buckets=4)
    e.refresh(str(folder))
    e.rebuild_vectors()
    before = e.manifest()
    (folder / "3.txt").write_text("something else entirely, lighthouses")
    assert e.refresh(str(folder)) == {"update": 1, "skip": 7}
    after = e.manifest()
    for name in ("documents", "chunks", "blocks", "live", "vectors"):
        old, new = before["tables"][name], after["tables"][name]
        assert len([k for k in new if new[k] != old.get(k)]) == 1, name
    assert len(after["segments"]) == 2 and after["vectors"]["status"] == "ready"
    assert e.table("documents").count() == e.table("vectors").count() == 8
    q = spark.createDataFrame([(1, "lighthouses"), (2, "number 3")], "query_id long, query_text string")
    rows = [(r["query_id"], r["path"].rsplit("/", 1)[1]) for r in e.search(q, 20, now=2_000_000_000, semantic=False, record=True).collect()]
    assert (1, "3.txt") in rows and rows.count((1, "3.txt")) == 1 and (2, "3.txt") in rows
    e.merge_segments()
    assert len(e.manifest()["segments"]) == 1
    # The search's own history, favourites and opened documents.
    assert {r["query"] for r in e.table("history").collect()} == {"lighthouses", "number 3"}
    path = next(r["path"] for r in e.table("documents").collect() if r["path"].endswith("5.txt"))
    log = spark.createDataFrame([(path, "five", 10), (path, "five!", 20), ("/x", "x", 5), ("/x", "x", 6)], "path string, title string, ts long")
    e.opened(log)
    e.toggle_favorites(log.filter("ts <> 20"))
    assert [tuple(r) for r in e.table("favorites").collect()] == [(path, "five", 10, 10)]
    found = e.search(spark.createDataFrame([(1, "harbours")], "query_id long, query_text string"), 20, now=2_000_000_000, semantic=False).collect()
    reason = next(r["reason"] for r in found if r["path"] == path)
    assert "已收藏优先" in reason and "最近打开" in reason and "历史扩展" in reason


def test_two_writers(spark, tmp_path):
    """Of two commits on one version the second is refused."""
    import pytest
    from py4j.protocol import Py4JJavaError

    e = Engine(spark, f"file://{tmp_path}/store", buckets=2)
    known = e.manifest()
    e.commit({})
    e.manifest = lambda: known
    with pytest.raises(Py4JJavaError, match="exist"):
        e.commit({})
