"""The mixture against its SQL and its bound."""

from collections import defaultdict

from docquarry.llm import mixing


def test_sql(spark, sf_dir, duck):
    df = mixing.op5_mixing(spark, sf_dir)
    assert tuple(df.columns) == mixing.COLUMNS
    found = duck.execute(mixing.ORACLE)
    assert [c[0] for c in found.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_deviation_is_under_one_block(spark):
    rows = [(k, "abc"[0 if k % 10 < 6 else 1 if k % 10 < 9 else 2]) for k in range(600)] + [(1000, None), (1001, None)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, source string, place long")
    got = mixing.mix(df, {"a": 5, "b": 3, "c": 2}, period=50, block_docs=2).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(k for k, _ in rows)
    assert len({r["place"] for r in got}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    q = defaultdict(set)
    for r in got:
        q[r["source"]].add(r["slot"])
    horizon = min(max(s) for s in q.values())
    share = {s: len([x for x in v if x < 50]) / 50 for s, v in q.items() if max(v) >= 50}
    for s, w in share.items():
        for t in range(1, horizon + 1):
            assert abs(len([x for x in q[s] if x < t]) - w * t) < 1


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).collect() == []
