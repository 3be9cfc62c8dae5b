"""Containment recall by the index against plain loops and against the scan."""

import random
import re

from pyspark.sql import functions as F

from docquarry.operators import answers, retrieval, substrings

CHUNK = "chunk_id string, file_name string, heading string, path string, snippet string, modified_at long"
TERMS = ["a", "an", "ana", "anab", "bananab", "local repo", "local  repo", "中", "文件", "zzz", "AN", "l r", "o", "f3", "é"]


def collection(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "ab", "ba", "na", "x", "中", "文件", "É", "local", "repo"]) for _ in range(r.randint(1, 5)))
    rows = []
    for k in range(120):
        text = r.choice([" ", "\t", "\n", "  "]).join(word() for _ in range(r.randint(0, 8)))
        rows.append((f"c{k}", r.choice([f"f{k}.txt", None]), r.choice([word(), None]), f"/dir {word()}/f{k}", r.choice([text, text + " local repo", None, ""]), k % 9))
    return rows


def loops(rows, terms, core):
    out = {}
    for c, name, heading, path, snippet, _ in rows:
        name, heading, path, snippet = ((x or "").lower() for x in (name, heading, path, snippet))
        weight = lambda t: 3 if t in name or t in heading else 2 if t in path else 1 if t in snippet else 0  # noqa: B023, E731
        low, cores = {t.lower() for t in terms}, {t.lower() for t in core}
        raw = sum(weight(t) for t in low)
        if raw:
            out[c] = (raw, sum((3 if weight(t) == 3 else 1) for t in low if weight(t) and len(t) >= 2), sum(1 for t in cores if weight(t)))
    return out


def test_against_loops(spark):
    r = random.Random(1)
    rows = collection(1)
    chunks = spark.createDataFrame(rows, CHUNK).repartition(3)
    index = substrings.build(chunks, buckets=2)
    parts = [(q, p, r.sample(TERMS, r.randint(0, 5)), r.sample(TERMS, r.randint(0, 3))) for q in range(5) for p in (-1, 0)] + [(9, 0, TERMS, TERMS), (10, 0, ["zzz"], [])]
    asked = spark.createDataFrame(parts, "query_id long, part int, terms array<string>, core array<string>")
    got = {}
    for x in substrings.containment_scores(chunks, asked, index).collect():
        got.setdefault((x["query_id"], x["part"]), {})[x["chunk_id"]] = (x["raw"], x["overlap"], x["core"])
    scan = {}
    for x in retrieval.containment_scores(chunks, asked, 1000).collect():
        scan.setdefault((x["query_id"], x["part"]), {})[x["chunk_id"]] = (x["raw"], x["overlap"], x["core"])
    for q, p, terms, core in parts:
        want = loops(rows, terms, core)
        assert got.get((q, p), {}) == want == scan.get((q, p), {}), (q, p, terms)


def test_a_request_reads_its_buckets(spark):
    chunks = spark.createDataFrame(collection(2), CHUNK)
    index = substrings.build(chunks, buckets=6)
    found = substrings.holders(spark.createDataFrame([("xxab",)], "term string"), index, chunks)
    words = {w for x in chunks.collect() for f in x[1:5] for w in re.split(r"\s+", (f or "").lower()) if "xxab" in w}
    want = {b["b"] for b in spark.createDataFrame([(w,) for w in words], "w string").select(substrings.bucket_of("w", 6).alias("b")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    listed = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert listed and {int(b) for b in (listed[1] or listed[2]).split(",")} == want and 0 < len(want) < 6


def test_scopes_by_index_and_by_scan(spark):
    chunks = spark.createDataFrame(collection(3), CHUNK).withColumn("path", F.concat(F.lit("/top/"), F.substring("chunk_id", 2, 1), "path"))
    index = substrings.build(chunks, buckets=2)
    q = spark.createDataFrame([(1, "bananab an"), (2, "repo local"), (3, "an")], "query_id long, question string")
    scopes = spark.createDataFrame([(1, "/TOP/1"), (1, "/top/2/"), (3, "/nowhere")], "query_id long, scope string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    a, b = rows(answers.recall(q, chunks, 10, scopes=scopes, index=index)), rows(answers.recall(q, chunks, 10, scopes=scopes))
    assert a == b and {x[0] for x in a} == {1, 2}
    inside = {r["chunk_id"] for r in chunks.collect() if r["path"].startswith(("/top/1/", "/top/2/"))}
    assert {x[1] for x in a if x[0] == 1} <= inside


def test_empty_collection(spark):
    chunks = spark.createDataFrame([], CHUNK)
    asked = spark.createDataFrame([(1, 0, ["a", "bcd"], [])], "query_id long, part int, terms array<string>, core array<string>")
    assert substrings.containment_scores(chunks, asked, substrings.build(chunks, buckets=1)).collect() == []
