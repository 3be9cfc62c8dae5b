"""The pipeline stage by stage on the smallest tables."""

import corpus_pipeline as P


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = P.quality_stage(spark, docs, sf_dir)
    assert tuple(kept.columns) == P.COLUMNS
    after = P.near_duplicate_stage(spark, kept, sf_dir)
    assert after.count() < kept.count() <= len(texts)
    cut = P.repeat_stage(spark, after, sf_dir).collect()
    assert len(cut) == after.count() and all(len(r["text"]) <= len(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in cut)
    assert len(P.STAGES) == 5


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_repeated_rows(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    one, two = (1, words(1), "en", "a", 9), (2, words(2), "en", "b", 9)
    docs = spark.createDataFrame([one, one, two, (None, words(3), "en", None, 9), (None, words(3), "en", None, 9)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    after = P.near_duplicate_stage(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in after.collect()) == [(0, words(3)), (0, words(3)), (1, words(1)), (2, words(2))]
    # The stage on its own: repeated rows do not empty each other.
    cut = P.repeat_stage(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in cut) == [(0, words(3))] * 2 + [(1, words(1))] * 2 + [(2, words(2))]


def test_mixture_keeps_every_row(spark):
    rows = [(k, f"t{k}", "en", "ab"[k % 2], 2) for k in range(20)] + [(7, "t7", "en", "b", 2)] * 2 + [(None, f"n{k}", None, None if k % 2 else "a", 2) for k in range(5)] + [(50, None, "de", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = P.mixture_stage(spark, docs, "")
    assert tuple(got.columns) == P.COLUMNS
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(rows, key=key)


def test_empty_tables_and_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = docs.limit(30).selectExpr("*", "1 AS key", "2 AS class_id", "3 AS winner", "4 AS score", "5 AS place", "6 AS kept", "7 AS ranges", "8 AS own")
    for name, stage in P.STAGES[:-1]:
        assert tuple(stage(spark, docs.limit(0), sf_dir).columns) == P.COLUMNS, name
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
        got = stage(spark, few, sf_dir)
        assert tuple(got.columns) == P.COLUMNS and got.count() <= 30, name
    assert P.token_stage(spark, docs.limit(0), sf_dir).collect() == []


def test_null_columns_and_ids(spark, sf_dir):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, words(1), None, None, 3), (3, words(1), "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[1:4]:
        got = stage(spark, docs, sf_dir).collect()
        # Texts 1 (null) and 2 (empty) are equal, so one of them goes with the near duplicates; nothing else does.
        assert len(got) == (4 if name == "near_duplicates" else 5), name
        assert sum(r["doc_id"] is None for r in got) == 2, name
    assert P.token_stage(spark, docs, sf_dir).count() == 5


def test_texts_that_share_an_id_lose_nothing(spark):
    """A unique text stays whole although another text of its doc_id repeats an earlier document."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(0, words(1), "en", "a", 9), (1, words(1) + " " + words(2), "en", "a", 9), (1, words(3), "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = P.repeat_stage(spark, P.near_duplicate_stage(spark, docs, ""), "").collect()
    kept = sorted((r["doc_id"], r["text"]) for r in after)
    assert [d for d, _ in kept] == [0, 1, 1] and (1, words(3)) in kept and (0, words(1)) in kept
    assert any(d == 1 and t.endswith(words(2)) and len(t) < len(rows[1][1]) for d, t in kept)
