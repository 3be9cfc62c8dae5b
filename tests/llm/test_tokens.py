"""Encoders against the tokenizers library, the file format by round trips."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from docquarry.llm import bpe, rans

ODD = ["", " ", "\n", "a\n", " a", "a  b\n\nc \n d", "x<|endoftext|>y", "<|startoftext|>", "don't WE'LL ''s", "a\tb c\n1 2", "漢字かな 한국어 😀 é ﬁ", "İstanbul ΟΔΟΣ Σ", "\x00​٣Ⅷª²", "x\x1cy z\x85w", "aaaa" * 300, "y" * 100_000]


def samples():
    r = random.Random(2)
    return ODD + ["".join(r.choice("aeinrst hlo.!'’é漢😀1 \n\t<|>") for _ in range(r.randint(1, 60))) for _ in range(1500)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary(name))


def test_word_bpe_is_the_library_s():
    texts, t = samples(), library("word_bpe_49k.json")
    codec = bpe.codec(bpe.vocabulary("word_bpe_49k.json"))
    ids, at = codec.encode(texts)
    decoded = codec.decode(ids, at)
    for k, text in enumerate(texts):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert decoded[k].decode() == t.decode(want, skip_special_tokens=False)


def test_byte_bpe_is_the_library_s():
    texts, t = samples(), library("byte_bpe_50k.json")
    ids, at = rans.byte_bpe(bpe.vocabulary("byte_bpe_50k.json")).encode(texts)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


def test_byte_bpe_cuts_as_the_library_does():
    r, t = random.Random(5), library("byte_bpe_50k.json")
    signs = ["ab '\n\t", "a'srevldtm  ", " \n\t\r\x0b\x0ca.", "aé×÷ªº²¼\x7f\x80\xadɏɐɿʀ '1\n", "a b\x00\x01\x1f\x1c\u3000\u200b \x85\xa0 \n", "word Ж’,.1٣ \n"]
    texts = ["".join(r.choice(x) for _ in range(r.randint(0, 30))) for x in signs for _ in range(300)]
    r.shuffle(texts)
    texts += ["x <|endoftext|>", "'s", "<|endoftext|>"]
    ids, at = rans.byte_bpe(bpe.vocabulary("byte_bpe_50k.json")).encode(texts)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_byte_bpe_remembers_pieces_not_what_stands_between_spaces():
    words = ["".join(x) for x in itertools.product("bdfgk", "aeiou", "lmnrt")]
    codec = rans.ByteBpe(bpe.vocabulary("byte_bpe_50k.json"))
    held = sum(len(x) for x in vars(codec).values() if isinstance(x, dict))
    codec.encode([" ".join(f"{a}-{b}" for b in words) for a in words] + ["漢字" * 1000])
    assert sum(len(x) for x in vars(codec).values() if isinstance(x, dict)) - held <= 2 * len(words) + 1
    assert all(len(x) <= rans.CACHE_BYTES for x in codec.words)


@pytest.mark.parametrize("n", [1, 5, rans.LANES, rans.LANES * rans.CHECKPOINT * 2 + 17])
def test_blocks_round_trip_from_any_checkpoint(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 50_000).astype(np.uint32)
    freq = rans.quantize(np.bincount(ids, minlength=50_257))
    assert freq.sum() == 1 << rans.SCALE and freq.min() >= 1
    data = rans.pack(rans.Coder(freq), np.array([7]), np.array([n]), ids)
    block, coder = rans.Block(data), rans.Coder(freq, decoder=True)
    assert (block.ids(coder) == ids).all()
    last = len(block.offsets) - 1
    assert (block.part(coder, last) == ids[last * rans.CHECKPOINT * rans.LANES :]).all()
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.Block(bytes(broken))


def test_op3_rows(spark):
    rows = [(1, None), (2, "Hello  World"), (3, ""), (4, "Hello  World")]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, n_tokens long")
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, bpe.vocabulary("word_bpe_49k.json")).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (got[1]["n_tokens"], got[1]["ids_sha256"], got[1]["decoded_sha256"]) == (0, none, none)
    assert got[2]["ids_sha256"] == got[4]["ids_sha256"] == hashlib.sha256(" ".join(map(str, got[2]["ids"])).encode()).hexdigest()


def test_op4_files(spark, tmp_path):
    rows = [(5, "b c"), (1, None), (3, "x " * 5000), (2, "")]
    path = bpe.vocabulary("byte_bpe_50k.json")
    rans.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/c", path)
    got = {r["doc_id"]: tuple(r)[1:] for r in rans.read(spark, f"file://{tmp_path}/c").collect()}
    start, t = 0, library("byte_bpe_50k.json")
    for k, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rans.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", path)
    assert rans.read(spark, f"file://{tmp_path}/e").collect() == []
