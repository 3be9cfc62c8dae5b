"""Whitening against numpy with exact whole numbers."""

import math
import random

import numpy as np
import pytest

from docquarry.llm import whitening as W

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(vectors, most=W.COMPONENTS):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    y = np.array([[(n * r[k] - sums[k]) / n for k in range(d)] for r in x])
    e, a = np.linalg.eigh(y.T @ y / n)
    e, a = e[::-1][:most], a[:, ::-1][:, :most]
    return n, deviation, y @ a / np.sqrt(e), e / np.trace(y.T @ y / n)


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))


@pytest.mark.parametrize(("n", "d", "parts"), [(300, 40, 5), (90, 3, 4), (50, 64, 1)])
def test_against_numpy(spark, n, d, parts):
    r = np.random.default_rng(n)
    vectors = (r.normal(size=(n, d)) @ r.normal(size=(d, d))).astype(np.float32).tolist()
    vectors[1] = vectors[0]  # a repeated vector counts twice
    bad = [None, [*vectors[0][:-1], NAN], [INF, *vectors[0][1:]], [None, *vectors[0][1:]], []]
    rows = [(k, v, "x") for k, v in enumerate(vectors)] + [(1000 + k, v, "x") for k, v in enumerate(bad)]
    got = rows_of(W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts)))
    count, deviation, white, explained = brute(vectors)
    assert [g["vec_id"] for g in got] == list(range(n))
    assert [g["deviation"] for g in got] == deviation and {g["n"] for g in got} == {count}
    real = [k for k, v in enumerate(got[0]["whitened"]) if v is not None]
    assert real == list(range(min(d, W.COMPONENTS, n - 1))) or n > d
    own = np.array([[g["whitened"][k] for k in real] for g in got])
    sign = np.sign((own * white[:, real]).sum(0))
    assert np.abs(own * sign - white[:, real]).max() < 1e-8
    assert np.abs(np.array(got[0]["explained"])[real] / explained[real] - 1).max() < 1e-9
    assert got[0]["identity_error"] < 1e-9
    assert np.abs(own.T @ own / n - np.eye(len(real))).max() < 1e-9


def test_states_merge_to_the_whole():
    """Chan's formula in any order and cut, far from zero."""
    r = random.Random(2)
    x = np.array([[r.randrange(10**9, 10**9 + 40) for _ in range(6)] for _ in range(400)], np.int64)
    whole = W.state_of(x)
    cuts = sorted(r.sample(range(1, 400), 12))
    parts = [W.state_of(p) for p in np.split(x, cuts)]
    r.shuffle(parts)
    while len(parts) > 1:
        parts.append(W.merged(parts.pop(0), parts.pop(0)))
    n, sums, scatter = parts[0]
    assert n == 400 and sums == whole[1] == [int(c) for c in x.sum(0)]
    exact = np.array([[float(sum((400 * int(a) - sums[i]) * (400 * int(b) - sums[j]) for a, b in zip(x[:, i], x[:, j])) / 400**2) for j in range(6)] for i in range(6)])  # noqa: B905
    assert np.abs(scatter - exact).max() < 1e-7 and np.abs(whole[2] - exact).max() < 1e-7


def test_defined_cases(spark):
    make = lambda rows: rows_of(W.whiten(spark.createDataFrame(rows, SCHEMA), keep=("n",) if False else ()))
    assert make([]) == []
    assert make([(1, None, "a"), (2, [], "a")]) == []
    one = make([(1, [1.0, 2.0], "a")])[0]
    assert (one["n"], one["deviation"], one["whitened"], one["explained"], one["identity_error"]) == (1, 0, [None, None], [None, None], None)
    # A constant dimension has no scale, the other one has; null ids stay.
    got = make([(1, [0.0, 5.0], "a"), (None, [2.0, 5.0], "a")])
    assert [g["whitened"][1] for g in got] == [None, None] and sorted(abs(g["whitened"][0]) for g in got) == [1.0, 1.0]
    assert got[0]["identity_error"] < 1e-12 and got[0]["explained"] == [1.0, 0.0]
    # Lengths apart.
    got = make([(1, [1.0, 2.0], "a"), (2, [3.0, 5.0], "a"), (3, [1.0], "a"), (4, [4.0], "a"), (5, [9.0], "a")])
    assert [g["n"] for g in got] == [2, 2, 3, 3, 3] and [len(g["whitened"]) for g in got] == [2, 2, 1, 1, 1]


def test_large_entries(spark):
    """Deviations beyond 64 bits are null, the others exact."""
    got = rows_of(W.whiten(spark.createDataFrame([(1, [1e12], "a"), (2, [0.0], "a"), (3, [-1e12], "a"), (4, [3e38], "a")], SCHEMA)))
    assert [g["vec_id"] for g in got] == [1, 2, 3] and [g["deviation"] for g in got][1] is not None
    assert got[0]["deviation"] is None
    got = rows_of(W.whiten(spark.createDataFrame([(1, [2.0**20], "a"), (2, [0.0], "a")], SCHEMA)))
    assert [g["deviation"] for g in got] == [2**52, 2**52]


def test_query(spark, sf_dir):
    got = W.op12_whitening(spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert got.count() == n * 32 and got.first()["identity_error"] < 1e-4
