"""Token counts against the library."""

import random

import pytest

from docquarry.llm import token_counts as K
from docquarry.llm.bpe import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
PARTS = [" ", " ", "  ", "\n", "▁", "a", "b", "the", "ing", "é", "中", "文", "12", ".", "<s>", "</s>", "\t", "\xa0", "\x00", "𐍈", "é", "\r\n", "�"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_pre_tokens_stand_alone(library):
    pieces = K.Pieces(PATH)
    for t in odd_texts(3000, 1):
        assert pieces.counts(K.pre_tokens(t)).sum() == len(library.encode(t)), t


@pytest.mark.parametrize("most", [4, 1 << 14])
def test_against_the_library(spark, sf_dir, library, most):
    """The real texts, odd ones, a long text without spaces, nulls, repeated rows; with a table too small for most."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + odd_texts(200, 2)
    texts += ["中文" * 40_000, "x" * 50_000, " " * 999, "", None, "the the the"]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(0, texts[0], "en"), (None, "two words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)
    got = K.count_tokens(df, PATH, most=most, keep=())
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for d, t, _ in rows:
        n = len(library.encode(t or ""))
        want.append((d, len((t or "").encode()), n, n > 4096))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[3] for w in want) >= 2


def test_frequent_pieces_hold_what_is_frequent(spark):
    """Whatever is more than one in ``most`` of all pre-tokens survives, from whichever task."""
    r = random.Random(4)
    texts = [" ".join([f"rare{r.random()}" for _ in range(60)] + ["often"] * 12 + ["much"] * 9) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    found = K.frequent_pieces(df, most=16)
    assert len(found) <= 16 and {"often", "much"} <= set(found)
    assert found["often"] <= 720


def test_compact_form():
    table = {"a": 1, "": 1, "中文": 2, "\nx": 3, "\x00": 1}
    assert K.unpacked(K.packed(table)) == table
    assert K.unpacked(K.packed({})) == {}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert K.count_tokens(df, PATH, keep=("lang",)).collect() == []
