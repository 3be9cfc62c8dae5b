"""Operators on small fixtures, against plain Python where there is a loop to compare with."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from docquarry.operators import activity, answers, indexing, library, retrieval
from docquarry.sources import chunking, embedding, files, parsers


def test_cap_equals_the_loop(spark):
    r = random.Random(3)
    rows, expected = [], {}
    for q in range(40):
        items = [(q, f"p{r.randint(0, 3)}", round(r.choice([0.1, 0.2, 0.3, r.random()]), 3), i) for i in range(r.randint(1, 20))]
        rows += items
        limit, cap = 8, 3
        ranked = sorted(items, key=lambda x: (-x[2], x[3]))
        taken, over, seen = [], [], {}
        for x in ranked:
            seen[x[1]] = seen.get(x[1], 0) + 1
            (taken if seen[x[1]] <= cap else over).append(x)
        taken = taken[:limit]
        filled = taken + over[: limit - len(taken)]
        late = {x[3] for x in over}
        expected[q] = [x[3] for x in sorted(filled, key=lambda x: (-x[2], x[3] in late, x[3]))]
    df = spark.createDataFrame(rows, "query_id int, path string, score double, i int")
    got = retrieval.diversify(df, 8, 3, "score", "path", [F.asc("i")]).orderBy("query_id", "final_rank").collect()
    for q, want in expected.items():
        assert [x["i"] for x in got if x["query_id"] == q] == want


def test_synonym_recall_finds_the_note(spark):
    chunks = spark.createDataFrame(
        [("off:0", "off", "离职流程.md", "离职流程", "/a/离职流程.md", "员工离职需要办理工作交接手续", 1, 0), ("exp:0", "exp", "报销.md", "报销", "/a/报销.md", "差旅报销说明", 1, 0), ("com:0", "com", "公司.md", "公司介绍", "/a/公司.md", "公司概况", 1, 0)],
        "chunk_id string, document_id string, file_name string, heading string, path string, snippet string, modified_at long, chunk_seq long",
    )
    q = spark.createDataFrame([(1, "离开公司怎么办理"), (2, "费用怎么处理")], "query_id long, question string")
    found = answers.recall(q, chunks, 50).orderBy("query_id", F.desc("score")).collect()
    first = [r["chunk_id"] for r in found if r["query_id"] == 1]
    assert first[0] == "off:0" and "com:0" not in first
    rules = answers.rules_from_json('[{"name":"expense","markers":["费用"],"recall_terms":["报销"],"noise_terms":["处理"]}]')
    found = answers.recall(q, chunks, 50, rules=rules).filter("query_id = 2").collect()
    assert [r["chunk_id"] for r in found] == ["exp:0"]
    assert answers.rules_from_json("{broken") == [] and answers.rules_from_json('[{"markers":["x"]}]') == []


def test_answers_and_states(spark):
    context = spark.createDataFrame([(1, 1, "The port is 8080. More."), (1, 2, "Second source")], "query_id long, source_id long, text string")
    q = spark.createDataFrame([(1, "port?"), (2, "nothing")], "query_id long, question string")
    got = {r["query_id"]: r for r in answers.answer(q, context).collect()}
    assert got[1]["state"] == "answered" and got[1]["warning"] is None and "[1]" in got[1]["answer"]
    assert got[2]["state"] == "insufficient_evidence"
    bad = answers.answer(q, context, lambda question, sources: "Port 1234 needs restart.").filter("query_id = 1").first()
    assert bad["warning"]
    cases = spark.createDataFrame([(1, "answered", 5, "8080", "secret"), (2, "insufficient_evidence", 0, None, None)], "query_id long, expected_state string, min_answer_chars int, must_contain string, must_not_contain string")
    assert all(r["passed"] for r in answers.evaluate(cases, answers.answer(q, context)).collect())


def test_follow_up(spark):
    df = spark.createDataFrame([("这两者有什么关系", ["什么是WBS？", "甘特图是什么"]), ("普通问题", ["a", "b"]), ("它们", ["one"])], "q string, e array<string>")
    assert [r[0] for r in df.select(answers.rewrite_follow_up("q", "e")).collect()] == ["WBS 与 甘特图 的关系", "普通问题", "它们"]


def test_incremental_plan_applied_twice_changes_nothing(spark):
    found = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 2, "y"), ("c", 3, 3, "z")], "path string, size long, modified_at long, hash string")
    known = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 9, "y"), ("d", 1, 1, "w")], "path string, size long, modified_at long, hash string")
    plan = {r["path"]: r["action"] for r in indexing.incremental_plan(found, known).collect()}
    assert plan == {"a": "skip", "b": "update", "c": "insert", "d": "delete"}
    assert {r["action"] for r in indexing.incremental_plan(found, found).collect()} == {"skip"}


def test_folds(spark):
    log = spark.createDataFrame([("t", 1, 1), ("t", 2, 2), ("u", 3, 3)], "target string, ts long, seq long")
    assert [(r["target"], r["updated_at"]) for r in activity.toggled(log).collect()] == [("u", 3)]
    hist = spark.createDataFrame([("q", 2, 1), ("q", 3, 5), (" ", 9, 1)], "query string, hits long, ts long")
    assert [tuple(r) for r in activity.fold_history(hist).collect()] == [("q", 5, 1, 5)]


def test_library(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n int")
    assert sorted(tuple(r) for r in library.patch(base, spark.createDataFrame([(1, None, 9)], "id long, name string, n int"), "id").collect()) == [(1, "a", 9), (2, "b", 6)]
    profiles = spark.createDataFrame([("p", False, True, 1), ("q", True, False, 2), ("r", True, True, 3)], "id string, is_default boolean, enabled boolean, updated_at long")
    assert [r["id"] for r in library.single_default(profiles).filter("is_default").collect()] == ["r"]
    tags = spark.createDataFrame([("t1", "Work")], "tag_id string, name string")
    items = spark.createDataFrame([("x", "t1")], "target string, tag_id string")
    every, all_items = library.assign_tags(tags, items, spark.createDataFrame([("x", "WORK"), ("y", "new")], "target string, name string"))
    assert every.count() == 2 and all_items.count() == 2


def test_islands(spark):
    rows = spark.createDataFrame([("p", s, f"t{s}") for s in (1, 2, 4)], "path string, seq long, text string")
    got = sorted((r["first_seq"], r["last_seq"], r["text"]) for r in retrieval.islands(rows, ["path"], "seq", "text").collect())
    assert got == [(1, 2, "连续段落 1: t1\n连续段落 2: t2"), (4, 4, "t4")]


def test_markdown():
    text = "# A\nintro\n\n## B\n- x\n- y\n\n```\ncode  here\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> said\n\n![pic](i.png)\n"
    got = [(b.kind, b.heading) for b in parsers.parse("md", text)]
    assert got == [("heading", "A"), ("paragraph", "A"), ("heading", "A > B"), ("list", "A > B"), ("code", "A > B"), ("table", "A > B"), ("quote", "A > B"), ("image", "A > B")]


def test_html_tables_and_scripts():
    html = "<title>T</title><script>var t='</p>'</script><h2>H</h2><p>one <b>two</b><table><tr><td>a</td><td>b</td></tr></table><img src='x.png' alt='X'>"
    got = parsers.parse("html", html)
    assert [b.kind for b in got] == ["heading", "paragraph", "table", "image"]
    assert got[2].text.splitlines()[0] == "| 列 1 | 列 2 |"


def test_epub_in_spine_order():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<p>first file</p>")
        z.writestr("o/b.xhtml", "<p>second file</p>")
    assert [b.text for b in parsers.parse("epub", buf.getvalue())] == ["second file", "first file"]
    assert parsers.safe_parse("docx", b"not a zip")[0].kind == "error"


def test_chunks_stay_in_bounds():
    r = random.Random(5)
    found = [parsers.Block(r.choice(["paragraph", "list", "table"]), " ".join("word" for _ in range(r.randint(1, 400)))) for _ in range(60)]
    chunks = chunking.build(chunking.merged(chunking.normalized(found)), "doc", 300)
    assert all(len(c[2]) <= 300 for c in chunks)
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    assert chunking.build([parsers.Block("heading", "only", "only")], "doc")[0][2] == "only"


def test_hash_vectors():
    v = embedding.hash_vector("alpha beta 中文", 64)
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and embedding.hash_vector("", 8) == [0.0] * 8


def test_scan_folder(spark, tmp_path):
    for name in ("a.md", "sub/b.txt", ".git/c.txt", "sub/node_modules/d.md", "e.bin"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("hello")
    got = sorted(r["file_name"] for r in files.scan(spark, str(tmp_path)).collect())
    assert got == ["a.md", "b.txt"]


def test_stream_equals_batch(spark, tmp_path):
    from docquarry.streaming import ingest

    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(30)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.stream_documents(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = sorted((r["doc_id"], r["term"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r["doc_id"], r["term"]) for r in retrieval.postings(docs).collect())
