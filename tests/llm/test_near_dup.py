"""Near duplicates against brute force, and the estimator's bias."""

import random
from collections import Counter

import numpy as np

from docquarry.llm import near_dup as N


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(k, t, bag(t)) for k, t in rows]
    for i, (a, ta, ba) in enumerate(bags):
        for b, tb, bb in bags[:i]:
            if (ta or "") == (tb or "") or similarity(ba, bb) >= 0.8 - 1e-9 and ba & bb:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in parent}


def group(r, n, words, edits, first):
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    rows = []
    for k in range(n):
        w = base[:]
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((first + k, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    r = random.Random(7)
    rows = group(r, 90, 120, 9, 0) + group(r, 5, 60, 1, 1000) + [(2000 + k, " ".join(f"x{r.randrange(10**6)}" for _ in range(r.randrange(1, 80)))) for k in range(40)]
    rows += [(3000, None), (3001, ""), (3002, "  "), (3003, "same text"), (3004, "same text"), (3005, "a b c"), (3006, "a  b c"), (3007, "long " * 60_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, rep long")  # a clashing name beside
    got = {x["doc_id"]: x["class_id"] for x in N.duplicate_classes(df).collect()}
    assert got == brute(rows)


def test_blocks_find_what_the_star_leaves_apart(spark, monkeypatch):
    """A hub that is far from a chain of copies: links among the others join the classes."""
    r = random.Random(11)
    rows = group(r, 150, 150, 14, 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "CHUNK", 16)
    got = {x["doc_id"]: x["class_id"] for x in N.duplicate_classes(df).collect()}
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.duplicate_classes(df).collect() == []
    df = spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")
    assert {(x["doc_id"], x["class_id"]) for x in N.duplicate_classes(df).collect()} == {(None, None), (1, 1)}


def test_every_row_has_its_row(spark):
    """Repeated rows, one id with two texts, null ids beside equal texts."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(5, words(1)), (5, words(1)), (5, words(2)), (3, words(2)), (9, words(1)), (None, words(1)), (None, words(1)), (7, None), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"] or 0, x["class_id"] or 0) for x in N.duplicate_classes(df).collect()))
    assert got == sorted([(5, 5), (5, 5), (5, 3), (3, 3), (9, 5), (0, 0), (0, 0), (7, 7), (8, 7), (8, 7)])


def test_a_crowd_of_copies(spark):
    """One text on a third of all rows and one on many near copies: keys that a broadcast serves."""
    r = random.Random(3)
    rows = [(k, "the same text over and over again in every row") for k in range(600)] + group(r, 300, 100, 4, 1000) + [(5000 + k, " ".join(f"q{r.randrange(10**6)}" for _ in range(30))) for k in range(300)]
    got = {x["doc_id"]: x["class_id"] for x in N.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_estimator_is_unbiased():
    r = np.random.default_rng(0)
    texts, true = [], []
    for _ in range(150):
        base = [f"w{x}" for x in r.integers(0, 10**6, 60)] * 3
        other = base[:]
        for _ in range(r.integers(0, 14)):
            other[r.integers(len(other))] = "zz"
        texts += [" ".join(base), " ".join(other)]
        true.append(similarity(bag(texts[-2]), bag(texts[-1])))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    times = N.bag_min_hash(*N.shingles(data, bounds), len(texts))
    estimate = (times[0::2] == times[1::2]).mean(1)
    assert abs((estimate - np.array(true)).mean()) < 0.02


def test_join_by_key_passes_each_row_once(spark, monkeypatch):
    """Hot keys (a few, many, none) and rare ones: the rows of a plain join, and no join that hands on all rows."""
    from docquarry.llm import common

    sizes = {bytes([k]): 40 if k < 14 else 2 for k in range(40)}
    rows = spark.createDataFrame([(bytearray(k), i) for k, n in sizes.items() for i in range(n)] + [(bytearray(b"no group"), 0)], "bucket binary, u long")
    groups = spark.createDataFrame([(bytearray(k), k.hex(), n) for k, n in sizes.items()], "bucket binary, v string, n long")
    want = sorted((bytes(r["bucket"]), r["u"], r["v"]) for r in rows.join(groups, "bucket").collect())
    for share in (1, 16, 4096):
        monkeypatch.setattr(common, "HOT", share)
        got = common.by_key(rows, groups, "bucket", rows.count())
        assert got.columns == ["bucket", "u", "v"]
        assert sorted((bytes(r["bucket"]), r["u"], r["v"]) for r in got.collect()) == want
        assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
