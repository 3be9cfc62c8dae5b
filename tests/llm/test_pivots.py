"""The pivot index against all pairs."""

import numpy as np

from docquarry.llm import pivots


def brute(rows):
    ids = [k for k, _ in rows]
    good = [v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = np.array([v if g else [1.0] * 16 for g, (_, v) in zip(good, rows, strict=True)], float)
    x /= np.abs(x).max(1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.9) & np.outer(good, good) & ~np.eye(len(x), dtype=bool)
    label = pivots.forest(links)
    return {k: (int(n), ids[m]) for k, n, m in zip(ids, links.sum(1), label, strict=True)}


def planted(r, cosine, like):
    """Rows at exactly this cosine to the given unit rows, turned in random directions."""
    w = r.normal(size=like.shape)
    w -= (w * like).sum(1)[:, None] * like
    return cosine * like + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1)[:, None]


def test_against_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=16).tolist()) for k in range(300)]
    center = r.normal(size=16)
    rows += [(1000 + k, (center + 0.05 * r.normal(size=16)).tolist()) for k in range(120)]
    rows += [(3000 + k, center.tolist()) for k in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] * 16), (2005, [1.0] * 8), (2006, rows[0][1]), (2007, [1e300 * v for v in rows[1][1]]), (2008, [float("inf")] + [1.0] * 15)]
    monkeypatch.setattr(pivots, "CHUNK", 32)
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, n_links long")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in pivots.near_vectors(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_planted_pairs_at_the_threshold(spark):
    """Recall of links at set cosines from the threshold on, among all vectors of a table."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    r = np.random.default_rng(6)
    x = np.array([row["embedding"] for row in e], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows, pairs = [(row["vec_id"], v.tolist()) for row, v in zip(e, x, strict=True)], {}
    for k, cosine in enumerate((0.9001, 0.92, 0.95)):
        at = r.choice(len(x), 600, replace=False)
        for i, v in zip(at, planted(r, cosine, x[at]), strict=True):
            new = 10**6 * (k + 1) + int(i)
            rows.append((new, v.tolist()))
            pairs.setdefault(cosine, []).append((rows[i][0], new))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {g["vec_id"]: g["n_links"] for g in pivots.near_vectors(df).collect()}
    y = np.array([v for _, v in rows])
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = (y @ y.T >= 0.9).sum(1) - 1
    true = dict(zip([k for k, _ in rows], links.tolist(), strict=True))
    assert all(got[k] <= true[k] for k in true)
    assert sum(got.values()) >= 0.98 * sum(true.values())
    for cosine, made in pairs.items():
        assert sum(got[new] == true[new] for _, new in made) >= 0.97 * len(made), cosine


def test_lengths_are_indexed_apart(spark):
    r = np.random.default_rng(2)
    a, b, c = r.normal(size=8), r.normal(size=12), r.normal(size=3)
    rows = [(1, a), (2, a * 2), (3, b), (4, b + 1e-3), (5, c), (6, None)]
    df = spark.createDataFrame([(k, None if v is None else v.tolist()) for k, v in rows], "vec_id long, embedding array<double>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in pivots.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_a_sample_of_unusable_vectors_hides_nothing(spark):
    zeros = [(k, [0.0] * 4) for k in range(400)]
    df = spark.createDataFrame([*zeros, (1000, [1.0, 2.0, 3.0, 4.0]), (1001, [1.0, 2.0, 3.0, 4.1])], "vec_id long, embedding array<float>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in pivots.near_vectors(df).collect()}
    assert got[1000] == got[1001] == (1, 1000) and got[5] == (0, 5)


def test_empty(spark):
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    got = pivots.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert [tuple(x) for x in got] == [(1, 0, 1, True)]


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(x) for x in pivots.near_vectors(df).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


def test_settings_grow_with_the_data():
    assert [pivots.wanted_pivots(n) for n in (0, 100, 51_282, 10**7)] == [64, 64, 512, 8192]
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for count in (64, 256, 512):
        chosen, prefix = pivots.choose_pivots(x, count, 0.9)
        for cosine, least in ((0.9, 0.985), (0.92, 0.99), (0.95, 0.995), (0.99, 0.999)):
            a, b = (pivots.nearest(v, chosen, prefix) for v in (x, planted(r, cosine, x)))
            met = (a[:, :, None] == b[:, None, :]).sum((1, 2)) >= pivots.SHARED
            assert met.mean() >= least, (count, prefix, cosine, met.mean())
