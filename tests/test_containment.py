"""The containment pass: a request of many parts reads chunks once and gives what plain loops give."""

import random
from collections import defaultdict

import pytest

from docquarry.operators import containment, retrieval

CHUNK = "chunk_id string, file_name string, heading string, path string, snippet string, modified_at long"


def numbers(terms, core, chunk):
    _, name, heading, path, snippet, _ = chunk
    top, p, s = [(x or "").lower() for x in (name, heading)], (path or "").lower(), (snippet or "").lower()
    weight = lambda t: 3 if any(t in x for x in top) else 2 if t in p else 1 if t in s else 0
    overlap = sum(3 if weight(t) == 3 else weight(t) > 0 for t in terms if len(t) >= 2)
    return sum(map(weight, terms)), overlap, sum(weight(t) > 0 for t in core)


@pytest.mark.parametrize(("seed", "rows", "first", "pending"), [(1, 2048, 64, 1 << 21), (2, 16, 2, 60)])
def test_many_parts_are_one_pass(spark, monkeypatch, seed, rows, first, pending):
    for name, value in (("ROWS", rows), ("FIRST_ROWS", first), ("PENDING", pending)):
        monkeypatch.setattr(containment, name, value)
    r = random.Random(seed)
    words = "the of then THE a n Über K中文 中文字 re-do x1 1 é İi of the".split(" ")
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) if n else None
    chunks = [(f"c{k}", f"doc-{k // 3}.txt", r.choice([None, "The h", ""]), r.choice(["/p/en/x", "/p/Of", None]), text(r.randrange(7)), r.choice([k // 3, 5, None]) if seed == 2 else k // 3) for k in range(300)]
    asked = [(k, k % 2, terms := sorted(set(r.sample(["the", "of", "a", "n", "k", "i", "über", "中", "中文", "re-do", "x1", "doc-7", "en", "zz", "h", "of the", "1"], r.randrange(5)))), terms[:1]) for k in range(1100)]
    asked.append((5000, 0, [f"w{k}" for k in range(90)] + ["the"], []))
    c = spark.createDataFrame(chunks, CHUNK).repartition(3)
    found = retrieval.containment_scores(c, spark.createDataFrame(asked, "query_id long, part int, terms array<string>, core array<string>"), 4)
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    got = defaultdict(list)
    for x in found.collect():
        got[x["query_id"], x["part"]].append(x)
    for q, part, terms, core in asked:
        want = {k[0]: (k[5], *n) for k in chunks if (n := numbers(terms, core, k))[0]}
        have = {x["chunk_id"]: (x["modified_at"], x["raw"], x["overlap"], x["core"]) for x in got[q, part]}
        assert len(have) == len(got[q, part]) and have.items() <= want.items()
        order = lambda d: sorted((-n[1], -(n[0] or 0), k) for k, n in d.items())[:4]
        assert order(have) == order(want)
    # What is sent does not grow with the chunks: of each task and part the first ones and ties.
    assert all(len(x) <= 6 * 4 * 3 for x in got.values())
