"""Scopes inside the containment pass: against recall by the index, which judges them afterwards."""

from pyspark.sql import functions as F

from docquarry.operators import answers, retrieval, substrings
from docquarry.plans import corpus as C


def test_scoped_pass_is_what_the_index_gives(spark, sf_dir, monkeypatch):
    chunks = C.chunks(spark, sf_dir)
    q = C.queries(spark, sf_dir).select("query_id", F.col("query_text").alias("question")).limit(9)
    # Some questions have one scope, some two, one an empty one (which lets nothing in), some none.
    folder = lambda n: F.concat(F.lit("/Corpus\\src"), n.cast("string"))
    n = F.col("query_id")
    scopes = q.filter(n % 4 < 3).select("query_id", F.explode(F.when(n % 4 == 2, F.array(F.lit(" "))).when(n % 4 == 1, F.array(folder(n % 20), folder((n + 1) % 20))).otherwise(F.array(folder(n % 20)))).alias("scope"))
    by_pass = answers.recall(q, chunks, 50, scopes=scopes)
    by_index = answers.recall(q, chunks, 50, scopes=scopes, index=substrings.build(chunks))
    rows = lambda d: sorted(map(tuple, d.select(*sorted(d.columns)).collect()))
    assert rows(by_pass) == rows(by_index) != []


def test_rows_outside_a_scope_leave_no_task(spark, sf_dir):
    chunks = C.chunks(spark, sf_dir).withColumn("above", answers.scopes_above("path"))
    asked = spark.createDataFrame([(1, 0, ["the", "txt"], ["the"], ["/corpus/src3"]), (2, 0, ["txt"], ["txt"], None)], "query_id long, part int, terms array<string>, core array<string>, scopes array<string>")
    found = retrieval.containment_scores(chunks, asked, 5, scoped=True).join(chunks.select("chunk_id", "path"), "chunk_id")
    assert {p.split("/")[2] for (p,) in found.filter("query_id = 1").select("path").collect()} == {"src3"}
    assert found.filter("query_id = 2").select("path").distinct().count() > 1


def test_a_result_is_not_exchanged(spark):
    """Nested scopes of a question give a chunk once, and no row of the result passes an exchange."""
    chunks = spark.createDataFrame([(1, "/a/b/c/x.txt"), (2, "/a/y.txt"), (3, "/ab/z.txt")], "chunk_id long, path string")
    scopes = spark.createDataFrame([(7, "/a"), (7, "/A/b/"), (7, "/a/b/c"), (8, "/a/b"), (9, "/a/y.txt"), (9, " ")], "query_id long, scope string")
    found = answers.in_scope(chunks, scopes)
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 2), (8, 1), (9, 2)]
    top = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(top) if "Join" in line)
    assert not any("Aggregate" in line for line in top[:join])


def test_a_result_is_dealt_as_lists(spark, monkeypatch):
    """What tasks are sent are lists of chunks and questions, not a row for each; nulls and copies count as in a join."""
    monkeypatch.setattr(answers, "CHUNK_LIST", 16)
    monkeypatch.setattr(answers, "QUESTION_LIST", 8)
    monkeypatch.setattr(answers, "BATCH_ROWS", 20)
    paths = [(f"c{k}" if k else None, f"/a/{'b' if k % 3 else 'c'}/{k}.txt") for k in range(90)]
    chunks = spark.createDataFrame([*paths, *paths[:5]], "chunk_id string, path string").repartition(3)
    asked = [(q, s) for q in [*range(40), None] for s in (("/A",) if (q or 0) % 2 else ("/a\\b/", "/a/b", "/a/c/9.txt", "/x", " "))]
    found = answers.in_scope(chunks, spark.createDataFrame(asked, "query_id long, scope string"))
    below = lambda p, s: bool(s.strip()) and (p + "/").startswith(s.lower().replace("\\", "/").rstrip("/") + "/")
    want = {(q, c) for q, s in asked for c, p in paths if below(p, s)}
    rows = list(map(tuple, found.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want
    sent = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "MapInArrow" in sent[0] and "Repartition" in sent[1]
    assert answers.in_scope(chunks, spark.createDataFrame([(1, "/x"), (2, " ")], "query_id long, scope string")).collect() == []
