"""Suffix sorting against sorted suffixes, removal of repeats against a plain loop."""

import hashlib
import random

import numpy as np
import pytest

from docquarry.llm import repeats
from docquarry.llm.gsaca import suffix_arrays


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for _ in range(120):
        sizes = r.integers(0, 40, r.integers(1, 30))
        symbols = r.integers(0, r.integers(1, 5), sizes.sum())
        want, at = [], 0
        for n in sizes:
            t = symbols[at : at + n].tolist()
            want += [at + i for i in sorted(range(n), key=lambda i: t[i:])]
            at += n
        assert suffix_arrays(symbols, sizes).tolist() == want


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        runs = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out[d] = (len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("most", "piece"), [(32, 1 << 20), (2, 1 << 20), (32, 1500)])
def test_against_brute_force(spark, monkeypatch, most, piece):
    """Copies, near copies, passages shared by many, periodic texts; few rows per block, small pieces."""
    r = random.Random(most + piece)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line, base = text(40), text(14), text(200)
    rows = [(k, f"{text(r.randint(0, 30))} {passage} {text(10)}") for k in range(40)]
    rows += [(100 + k, f"{text(12)}\n{line}\n{text(12)}") for k in range(60)]
    rows += [(200 + k, base[: 400 + 10 * k] + "!" + base[401 + 10 * k :]) for k in range(12)]
    rows += [(300, base), (301, base), (302, None), (303, ""), (304, "ab" * 300), (305, "x" * 99), (306, "x" * 100), (307, "x" * 101), (308, text(900)), (309, passage * 3)]
    rows.append((310, text(300) + rows[-3][1][2000:2600] + "z" * 250))
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats.texts_of, "__defaults__", (piece,))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: tuple(x)[1:] for x in repeats.remove_repeats(df).collect()}
    want = brute(rows)
    assert got == want
    assert sum(x[1] for x in want.values()) > 5000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert repeats.remove_repeats(df, keep=("kept",)).collect() == []


def test_text_and_columns_are_kept(spark):
    r = random.Random(3)
    t = "".join(r.choice("abcdefgh") for _ in range(150))
    df = spark.createDataFrame([(1, t, "a"), (2, t + "é", "b")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in repeats.remove_repeats(df, keep=("lang",), with_text=True).collect()}
    assert got[1]["kept"] == t and got[2]["kept"] == "é" and got[2]["lang"] == "b"


@pytest.mark.parametrize(("most", "parts"), [(32, 1), (32, 5), (2, 1), (2, 5)])
def test_repeated_rows_are_one_document(spark, monkeypatch, most, parts):
    """In one task and in several, folded, in blocks and by strings: a repeated row covers nothing of itself."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(150)
    rows = [(1, text(400))] * 3 + [(2, text(100))] * 2 + [(3, "xy" * 200)] * 2
    rows += [(10 + k, text(80) + passage + text(80)) for k in range(6)] * 2 + [(30, rows[0][1])] * 2
    r.shuffle(rows)
    monkeypatch.setattr(repeats, "MOST", most)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = repeats.remove_repeats(df, with_text=True).collect()
    want = brute(set(rows))
    assert sorted(tuple(x)[:5] for x in got) == sorted((d, *want[d]) for d, _ in rows)
    assert {x["kept"] for x in got if x["doc_id"] <= 2} == {t for d, t in rows if d <= 2}


def brute_rows(rows):
    """As ``brute``, by row: different texts of an id are parts of it, in the order of their MD5."""
    import hashlib as h

    texts = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda x: (x[0], h.md5(x[1].encode()).hexdigest()))
    one = brute([(k, t) for k, (_, t) in enumerate(texts)])
    number = {x: k for k, x in enumerate(texts)}
    whole = lambda t: (len(t.encode()), 0, 0, h.sha256(t.encode()).hexdigest())
    return sorted(((d, *(one[number[d, t or ""]] if d is not None else whole(t or ""))) for d, t in rows), key=repr)


@pytest.mark.parametrize(("most", "piece"), [(32, 1 << 20), (2, 1 << 20), (2, 600)])
def test_different_texts_under_one_id(spark, monkeypatch, most, piece):
    """Ids that repeat with other texts: a range found in one text takes nothing from another; null ids keep theirs."""
    r = random.Random(most + piece)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared, t = text(300), text(295)
    rows = [(0, t), (1, t), (1, text(280)), (None, t), (None, t), (2, None), (2, ""), (2, text(50))]
    for d in range(3, 12):
        rows += [(d, text(r.randint(0, 400)) + (shared if r.random() < 0.5 else shared[: r.randint(90, 299)]) + text(r.randint(0, 200))) for _ in range(r.randint(1, 4))]
    rows += [(12, t + shared), (12, shared + t), (13, text(101)), (13, text(100)), rows[9], rows[9]]
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats.texts_of, "__defaults__", (piece,))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(x)[:5] for x in repeats.remove_repeats(df).collect()), key=repr)
    assert got == brute_rows(rows)
    assert next(x for x in got if x[0] == 1 and x[1] == len(rows[2][1].encode()))[2] == 0


def test_a_passage_of_thousands(spark):
    """One passage in 3000 documents: far more surroundings than a block takes."""
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghijk ") for _ in range(n))
    passage = text(180)
    rows = [(k, text(60) + passage + text(60)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert {x["doc_id"]: tuple(x)[1:5] for x in repeats.remove_repeats(df).collect()} == want


def test_only_what_others_share_is_sorted(monkeypatch):
    """Surroundings of an anchor, with zero bytes: settle covers what a loop covers and sorts few of the symbols."""
    import pyarrow as pa

    r = random.Random(5)
    some = lambda n: bytes(r.choice(b"\0\1a") for _ in range(n))
    rows, texts = [], {}
    for h in range(30):
        base = some(160)
        for _ in range(r.randint(2, 20)):
            doc = len(texts)
            a, b = r.choice((0, 0, 10, 25, 45)), r.choice((0, 0, 10, 25, 45))
            raw = some(a) + base[a : 160 - b] + some(b)
            x, y = r.choice((0, 0, 0, 20)), r.choice((0, 0, 0, 30))
            texts[doc] = (h, raw[x : 160 - y])
            rows += [(h, repeats.BLOCK, doc, 7, 60 - x, raw[x : 160 - y])] * r.choice((1, 1, 2))
    rows.sort(key=lambda x: (x[0], x[4], x[2], x[3]))
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["h", "kind", "doc", "pos", "left", "around"])
    seen, want = set(), set()
    for doc, (h, raw) in texts.items():
        for i in range(len(raw) - 99):
            want |= {(doc, 7 + k) for k in range(i, i + 100)} if (h, raw[i : i + 100]) in seen else set()
            seen.add((h, raw[i : i + 100]))
    total = []
    monkeypatch.setattr(repeats, "suffix_arrays", lambda symbols, sizes: total.append(len(symbols)) or suffix_arrays(symbols, sizes))
    got = {(d, k) for b in repeats.settle(iter([batch.slice(0, 90), batch.slice(90)])) for d, s, e in zip(*(b.column(c).to_pylist() for c in ("doc", "pos", "c")), strict=True) for k in range(s, e)}
    assert got == want and len(want) > 5000
    assert sum(total) < 0.6 * sum(len(x[5]) for x in rows)
