"""Expressions and small operators that no registered query covers, against plain Python or worked cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry import settings
from docquarry.functions import scoring as S
from docquarry.functions import text as X
from docquarry.operators import activity, answers, indexing, lists, retrieval, tasks
from docquarry.sources import chunking, embedding, files, parsers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_han_tokens_and_order(spark):
    rows = spark.createDataFrame([(1, "Ab 中文字 ab 中 x1"), (2, "b a B"), (3, None), (4, "　"), (5, "𠀀𠀁"), (6, "İx ß")], "i int, t string")
    got = {r["i"]: r["k"] for r in rows.select("i", X.search_tokens("t").alias("k")).collect()}
    assert got == {1: ["ab", "中文", "文字", "中", "x1"], 2: ["b", "a"], 3: [], 4: [], 5: ["𠀀𠀁"], 6: ["x"]}


def test_quality_gates_and_ocr_reasons(spark):
    r = one(spark, a=X.ocr_reason(F.lit("  ")), b=X.ocr_reason(F.lit("This is a page of ordinary words and sentences.")), c=X.ocr_reason(F.lit("#### 123 .... 99")), d=X.ocr_reason(F.lit("AB1 CDE F2G HIJ KLM N3O PQR STU VW4 XYZ")), e=X.meaningful(F.lit("中文内容")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("no_text_layer", "none", "meaningless_text_layer", "noisy_text_layer", True)


def test_labels_and_numbers(spark):
    r = one(
        spark,
        a=X.citation(F.lit("f.md"), F.lit(" "), F.lit(3), F.lit(None).cast("int")),
        b=X.display_name(F.lit("  a   b "), "none"),
        c=X.display_name(F.lit(" "), "none"),
        d=F.array(*[X.format_score(F.lit(v)) for v in (2.001, 2.5, 0.1234)]),
        e=X.progress_percent(F.lit(1), F.lit(3)),
        f=X.progress_percent(F.lit(0), F.lit(0)),
        g=X.source_location(F.lit(" "), F.lit("f")),
        h=S.relevance_share(F.lit(9), F.array(F.lit("a"), F.lit("b"))),
    )
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"]) == ("《f.md》 / Page 3", "a b", "none", ["2", "2.50", "0.123"], 33, 100, "f", 1.0)


def test_terms_and_recall_queries(spark):
    r = one(spark, a=answers.core_terms(F.lit("WBS 流程怎么办理")), b=answers.session_terms(F.lit("这个 Gantt 图表 什么")), c=answers.recall_queries(F.lit(" Q "), F.array(F.lit("x"), F.lit("y"))), d=answers.recall_queries(F.lit("q"), F.array().cast("array<string>")))
    assert r["a"][0] == "wbs" and "流程" not in r["a"] and "gantt" in r["b"] and "什么" not in r["b"]
    assert r["c"] == ["Q", "Q x y", "x y"] and r["d"] == ["q"]


def test_support_and_facts(spark):
    sources = F.array(F.lit("The server port is 8080 and needs a restart."), F.lit("服务器需要重启"))
    cases = [("port 8080 [1]", True), ("bananas grow here", False), ("服务器需要重启", True), ("", True)]
    df = spark.createDataFrame(cases, "s string, want boolean").select("want", answers.supported("s", sources).alias("got"))
    assert all(r["got"] == r["want"] for r in df.collect())
    facts = [("首先", False), ("首先，系统需要管理员在控制台里创建一个新的账户", True), ("好的，下面我来介绍这个系统的整体情况吧朋友们", False), ("总之，该服务监听在 8080 端口上面并且一直在运行", True), ("说明：", False), ("路径在 /etc", True), ("天气很好", False), ("特点：", False)]
    got = spark.createDataFrame(facts, "s string, want boolean").select("s", "want", answers.factual("s").alias("got")).collect()
    assert [r["s"] for r in got if r["got"] != r["want"]] == []


def test_a_failing_model_fails_its_question_only(spark):
    q = spark.createDataFrame([(1, "bad"), (2, "good")], "query_id long, question string")
    context = spark.createDataFrame([(1, 1, "s"), (2, 1, "Port 80.")], "query_id long, source_id long, text string")

    def model(question, sources):
        if question.startswith("bad"):
            raise OSError("down")
        return "Port 80 [1]."

    got = {r["query_id"]: r for r in answers.answer(q, context, model).collect()}
    assert (got[1]["state"], got[1]["ok"], got[1]["error"]) == ("failed", False, "OSError: down")
    assert (got[2]["state"], got[2]["warning"], got[2]["repaired"]) == ("answered", None, False)
    none = answers.answer(q, context.limit(0), model).collect()
    assert {r["answer"] for r in none} == {answers.REFUSAL} and {r["state"] for r in none} == {"insufficient_evidence"}
    empty = spark.range(1).select(*answers.failure(F.lit(1), "code", "text")).first()
    assert (empty["state"], empty["ok"], empty["code"]) == ("failed", False, "code")


def test_a_failed_repair_keeps_the_draft(spark):
    q = spark.createDataFrame([(1, "q")], "query_id long, question string")
    context = spark.createDataFrame([(1, 1, "s")], "query_id long, source_id long, text string")

    def repair(question, sources):
        raise TimeoutError("late")

    got = answers.answer(q, context, lambda question, sources: "Value 4711 follows.", repair).first()
    assert (got["answer"], got["state"], got["repaired"]) == ("Value 4711 follows.", "answered", True) and got["warning"]


def test_import_paths(spark):
    known = spark.createDataFrame([("/data",)], "dir string")
    paths = spark.createDataFrame([("/data/x/a.md", False, True), ("/o/b.txt", False, True), ("/o", True, True), ("/o/c.bin", False, True), ("/gone", False, False)], "path string, is_dir boolean, exists boolean")
    got = {r["path"]: (r["kind"], r["dir"]) for r in files.classify_imports(paths, known).collect()}
    assert got["/data/x/a.md"] == ("known", "/data") and got["/o/b.txt"] == ("virtual", "virtual://临时导入")
    assert (got["/o"][0], got["/o/c.bin"][0], got["/gone"][0]) == ("directory", "unsupported", "skipped")


def test_odd_folder_names(spark, tmp_path):
    folder = tmp_path / "a+b (c)"
    (folder / ".hidden").mkdir(parents=True)
    (folder / "x.md").write_text("x")
    (folder / ".hidden" / "y.md").write_text("y")
    assert [r["file_name"] for r in files.scan(spark, str(folder)).collect()] == ["x.md"]


def archive(parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buf.getvalue()


W = "xmlns:w='urn:w' xmlns:a='urn:a' xmlns:r='urn:r' xmlns:p='urn:p'"


def test_docx():
    p = lambda text, style="": f"<w:p><w:pPr><w:pStyle w:val='{style}'/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    data = archive({"word/document.xml": f"<w:document {W}><w:body>{p('cover')}{p('Title', 'Heading1')}{p('body')}{p('item', 'ListBullet')}{table}</w:body></w:document>"})
    got = [(b.kind, b.text, b.section) for b in parsers.parse("docx", data)]
    assert got[:4] == [("paragraph", "cover", "frontmatter"), ("heading", "Title", "body"), ("paragraph", "body", "body"), ("list", "item", "body")]
    assert got[4][0] == "table"
    assert [c[2] for c in chunking.build(parsers.parse("docx", data), "d")][0].startswith("body item")


def test_pptx_in_the_order_of_the_presentation():
    slide = lambda t: f"<p:sld {W}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>"
    data = archive(
        {
            "ppt/presentation.xml": f"<p:presentation {W}><p:sldIdLst><p:sldId id='1' r:id='r2'/><p:sldId id='2' r:id='r1'/></p:sldIdLst></p:presentation>",
            "ppt/_rels/presentation.xml.rels": "<Relationships><Relationship Id='r1' Target='slides/slide1.xml'/><Relationship Id='r2' Target='slides/slide2.xml'/></Relationships>",
            "ppt/slides/slide1.xml": slide("first file"),
            "ppt/slides/slide2.xml": slide("second file"),
        }
    )
    assert [b.text for b in parsers.parse("pptx", data)] == ["Slide 1", "second file", "Slide 2", "first file"]


def test_xlsx_and_images():
    data = archive({"xl/sharedStrings.xml": "<sst><si><t>one</t></si><si><t>two</t></si></sst>"})
    assert [b.text for b in parsers.parse("xlsx", data)] == ["one", "two"]
    assert parsers.image_html('a"b', "<x>") == '<img src="a&quot;b" alt="&lt;x&gt;" />'


def test_fallback_and_reasons():
    broken = archive({"word/document.xml": "<w:document><w:p><w:t>text &amp; more</w:t>"})
    found = parsers.read("docx", broken)
    assert found.parser == "fallback" and found.warning and [b.text for b in found.blocks] == ["text & more"]
    assert parsers.read("docx", b"no").parser == "none" and parsers.read("pdf", b"").reason
    assert parsers.read("md", "# T").parser == "default"
    with pytest.raises(ValueError):
        parsers.fallback("txt", b"\xff\xfe\xfd")


def test_split_is_what_the_loop_gives():
    import random

    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("ab,.;。 \n") for _ in range(r.randint(0, 90)))
        most, want, rest = r.randint(3, 20), [], text
        while len(rest.rstrip()) > most:
            rest = rest.rstrip()
            window = rest[:most]
            cut = next((at + len(s) for s in chunking.SEPARATORS if (at := window.rfind(s)) > 0), most)
            want.append(window[:cut].strip() if cut <= most else window)
            rest = rest[cut:].lstrip()
        want = [p for p in [*want, rest.strip()] if p]
        assert chunking.split(text, most) == want
    assert len(chunking.split("word " * 400_000, 800)) == 2500


def test_covers():
    assert chunking.is_cover("编制 | 校对") and chunking.is_cover("文档版本 1") and not chunking.is_cover("ordinary | text")


def test_settings(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert settings.load(spark, folder, "answers") == (settings.AnswerSettings(), 0)
    settings.save(spark, folder, settings.AnswerSettings(temperature=9.0, context_chunk_limit=0, model=" m "), 77)
    got, at = settings.load(spark, folder, "answers")
    assert (got.temperature, got.context_chunk_limit, got.model, got.answer_tokens, at) == (2.0, 1, "m", 1200, 77)
    settings.save(spark, folder, settings.IndexSettings(exclude_exts=("log",), semantic_threshold=4.0), 1)
    index, _ = settings.load(spark, folder, "index")
    assert index.exclude_exts == ("log",) and index.semantic_threshold == 1.0
    r = settings.Request.of({"question": " q ", "temperature": "x", "options": {"max_output_tokens": "9", "enabled": "yes"}, "scope_paths": [" a ", None, ""], "recent_questions": "no"})
    assert (r.question, r.settings.temperature, r.settings.max_output_tokens, r.settings.enabled, r.scope_paths, r.recent_questions) == ("q", 0.2, 9, True, ["a"], [])
    assert [settings.fitted(v, True) for v in ("off", 0, None, "?", True)] == [False, False, True, True, True]


def test_the_running_task():
    t = tasks.Task("all").moved(10, state="running", total=4)
    assert t.moved(20, done=1).started_at == 10 and t.moved(20, done=1).percent == 25
    assert t.recovered(True).state == "paused" and t.recovered(False) is None and tasks.Task(state="done").recovered(False).state == "done"
    assert t.pause().pause_requested and not t.pause().resumed().pause_requested


def test_models():
    assert embedding.dimension_of("BAAI/bge-small-zh-v1.5") == 512 and embedding.dimension_of("other") == 384


def test_percentiles_of_skewed_groups(spark):
    import random

    r = random.Random(1)
    rows = [("hot", round(r.choice([0.0, 1.0, r.random() ** 9]), 3)) for _ in range(5000)] + [("one", 7.0), ("none", None)]
    got = {x["g"]: x for x in activity.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", "g", (1, 50, 95, 99)).collect()}
    values = sorted(v for g, v in rows if g == "hot")
    for p in (1, 50, 95, 99):
        assert got["hot"][f"p{p}"] == values[int((len(values) - 1) * p / 100 + 0.5)]
    assert (got["one"]["n"], got["one"]["p99"]) == (1, 7.0) and "none" not in got


def test_tree_positions(spark):
    names = ["/a", "/a/b", "/a-b", "/a/b/c", "/b", "/a/z"]
    got = [r["dir"] for r in indexing.tree_rows(spark.createDataFrame([(n,) for n in names], "dir string")).orderBy("position").collect()]
    assert got == sorted(names, key=lambda n: n.split("/"))


def test_many_queries_come_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(f"c{k}", f"f{k}", "h", "/p", f"word{k} common", k) for k in range(30)], "chunk_id string, file_name string, heading string, path string, snippet string, modified_at long")
    asked = spark.createDataFrame([(k, 0, [f"word{k}"], [f"word{k}"]) for k in range(20)], "query_id long, part int, terms array<string>, core array<string>")
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(50)] + [(99, [0.0, 0.0]), (98, [1.0])], "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, retrieval.containment_scores(docs, asked, 5).collect())), sorted(map(tuple, retrieval.cosine_search(queries, vectors, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert whole == (sorted(map(tuple, retrieval.containment_scores(docs, asked, 5).collect())), sorted(map(tuple, retrieval.cosine_search(queries, vectors, 3).collect())))
    first = {q: k for q, k, _, rank in whole[1] if rank == 1}
    assert first == {k: k for k in range(20)}


def test_upserts_keep_the_last_version(spark, tmp_path):
    from docquarry.streaming import ingest

    schema = "path string, modified_at long, text string"
    source, target, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in ([("a", 1, "old"), ("b", 5, "kept"), ("a", 3, "new")], [("b", 2, "late"), ("c", 1, "c"), ("a", 9, "newest")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        from pyspark.sql.types import StructType

        ingest.upsert_stream(ingest.stream_documents(spark, source, schema), target, ck).awaitTermination()
    got = {r["path"]: r["text"] for r in ingest.latest_version(spark, target, StructType.fromDDL(schema)).collect()}
    assert got == {"a": "newest", "b": "kept", "c": "c"}


def test_windowed_counts(spark, tmp_path):
    from docquarry.streaming import ingest

    spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 10:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 13:00:00', 'b'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = ingest.activity_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"]) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]


def test_directory_removal_by_path(spark):
    rows = spark.createDataFrame([("/a/b/x",), ("/a/bc/x",), ("/a/b",), ("/z",)], "path string")
    left = tasks.not_below(rows, spark.createDataFrame([("/a/b/",)], "path string"))
    assert sorted(r[0] for r in left.collect()) == ["/a/bc/x", "/z"]
    assert [r[0] for r in indexing.delete_directory(rows, "/a").collect()] == ["/z"]


def test_lists(spark):
    rows = spark.createDataFrame([("a", 1), ("é", 2), ("zz", 3), ("ab", 4)], "path string, n int")
    assert [r["path"] for r in lists.listed(rows, "directories").collect()] == ["a", "ab", "zz", "é"]
    assert lists.holding(rows, " ", ["path"]).count() == 4 and lists.not_blank(spark.createDataFrame([(" ",), ("x",), (None,)], "s string"), "s").count() == 1
