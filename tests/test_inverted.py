"""The keyword index by field against plain loops; what a search reads; segments."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docquarry.operators import inverted

CHUNK = "chunk_id string, document_id long, file_name string, path string, ext string, heading string, snippet string"


def tokens(text):
    return list(dict.fromkeys(t.lower() for t in re.findall(r"[A-Za-z0-9]+", text or "")))


def loops(queries, chunks, contents):
    """query_id -> ranked [(chunk_id, score)], and (complete, hits)."""
    fields = {}
    for c, d, name, path, ext, heading, snippet in chunks:
        if d in contents:
            fields[c] = {0: tokens(name), 1: tokens(path), 2: [" ".join(tokens(ext))] if tokens(ext) else [], 3: tokens(contents[d]), 4: tokens(heading), 5: tokens(" ".join(x or "" for x in (name, path, heading, snippet)))}
            fields[c] = {f: [t for t in ts if len(t) <= 40] for f, ts in fields[c].items()}
    n = len(fields)
    df, total = defaultdict(int), defaultdict(int)
    for by in fields.values():
        for f, ts in by.items():
            total[f] += len(ts)
            for t in ts:
                df[f, t] += 1
    out, counts = {}, {}
    for q, text in queries:
        asked, rows = tokens(text), []
        for c, by in fields.items():
            score, met = 0.0, set()
            for f, ts in by.items():
                for t in asked:
                    if t in ts:
                        met.add(t)
                        score += math.log(1 + (n - df[f, t] + 0.5) / (df[f, t] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(ts) / (total[f] / n)))
            if met:
                rows.append((len(met) == len(asked), -round(score, 6), c))
        rows = [r for r in rows if r[0]] or rows
        out[q] = sorted((s, c) for _, s, c in rows)
        if rows:
            counts[q] = (rows[0][0], len(rows))
    return out, counts


def collection(seed, n_docs=30, words=40):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.expovariate(0.12)), words)}"
    chunks, contents = [], {}
    for d in range(n_docs):
        contents[d] = " ".join(word() for _ in range(r.randint(0, 40)))
        about = f"f{d} {word()}.TXT", f"/a/{word()}/f{d}", r.choice(["txt", "tar.gz", "", None])
        for k in range(r.choice([1, 1, 2, 7])):
            chunks.append((f"{d}:{k}", d, *about, r.choice([word(), None]), " ".join(word() for _ in range(r.randint(0, 6)))))
    queries = [(q, " ".join(word() for _ in range(r.choice([1, 2, 3, 80])))) for q in range(14)] + [(90, "absent"), (91, ""), (92, "txt"), (93, "x" * 41), (94, "tar gz w1")]
    return chunks, contents, queries


@pytest.mark.parametrize(("seed", "limit", "buckets"), [(1, 5, 3), (2, 40, 1)])
def test_against_loops(spark, seed, limit, buckets):
    chunks, contents, queries = collection(seed)
    index = inverted.build(spark.createDataFrame(chunks, CHUNK).repartition(3), spark.createDataFrame(list(contents.items()), "document_id long, content string"), buckets=buckets)
    q = spark.createDataFrame(queries, "query_id long, query_text string")
    want, counts = loops(queries, chunks, contents)
    got = defaultdict(list)
    for x in inverted.search(q, index, limit).collect():
        got[x["query_id"]].append((x["rank"], -x["score"], x["chunk_id"]))
    for k, rows in want.items():
        assert [(round(s, 5), c) for _, s, c in sorted(got[k])] == [(round(s, 5), c) for s, c in rows[:limit]], k
    assert {x["query_id"]: (x["complete"], x["hits"]) for x in inverted.mode_counts(q, index).collect()} == counts


def test_a_search_reads_the_buckets_of_its_terms(spark):
    chunks, contents, _ = collection(5)
    index = inverted.build(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(list(contents.items()), "document_id long, content string"), buckets=5)
    q = spark.createDataFrame([(1, "w1")], "query_id long, query_text string")
    found = inverted.matches(q, index)
    wanted = spark.createDataFrame([("w1",)], "term string").select(inverted.bucket_of("term", 5)).first()[0]
    plan = found.chunks._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {wanted}\b", plan), plan
    assert {x["bucket"] for x in index.postings().filter(F.col("term") == "w1").select("bucket").collect()} == {wanted}


def test_segments_and_documents_that_went(spark, tmp_path):
    """Two segments, one document replaced, one deleted: as if only what is live had been indexed, once merged."""
    chunks, contents, queries = collection(6)
    make = lambda keep, text, name: inverted.build(spark.createDataFrame([c for c in chunks if keep(c[1])], CHUNK), spark.createDataFrame([(d, text(t)) for d, t in contents.items() if keep(d)], "document_id long, content string"), f"file://{tmp_path}/{name}", 2)
    first = make(lambda d: True, lambda t: t, "one")
    second = make(lambda d: d == 3, lambda t: t + " w1 fresh", "two")
    both = inverted.Index(spark, "bigint", "string", [*first.segments, *second.segments], 2)
    live = spark.createDataFrame([(d, (second if d == 3 else first).segments[0]) for d in contents if d != 7], "document_id long, segment string")
    now = {d: t + (" w1 fresh" if d == 3 else "") for d, t in contents.items() if d != 7}
    kept = [c for c in chunks if c[1] != 7]
    q = spark.createDataFrame([*queries, (95, "fresh")], "query_id long, query_text string")
    want, counts = loops([*queries, (95, "fresh")], kept, now)
    # Before the merge the counts of documents per term still hold what went, as they do in such indexes: same chunks.
    found = inverted.search(q, both, 10_000, live).collect()
    for k, rows in want.items():
        assert {x["chunk_id"] for x in found if x["query_id"] == k} == {c for _, c in rows}, k
    merged = inverted.merge(both, live, f"file://{tmp_path}/merged")
    assert {x["query_id"]: (x["complete"], x["hits"]) for x in inverted.mode_counts(q, merged).collect()} == counts
    for x in inverted.search(q, merged, 3).collect():
        assert abs(-want[x["query_id"]][x["rank"] - 1][0] - x["score"]) < 2e-6


def test_empty_index(spark):
    index = inverted.build(spark.createDataFrame([], CHUNK), spark.createDataFrame([], "document_id long, content string"), buckets=1)
    q = spark.createDataFrame([(1, "w1")], "query_id long, query_text string")
    assert inverted.search(q, index, 5).collect() == [] and inverted.mode_counts(q, index).collect() == []
