"""The divergence audit against plain loops, and against its SQL on the tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from docquarry.llm import divergence as D

LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    tf, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [lower(t) for t in LETTER.findall(text)]
        langs[lang].add(source)
        tf[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        total = {s: sum(tf[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * v)  # noqa: B023, E731
        p = {s: {t: share(tf[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(tf[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            term = [(f(p[s][t], q[t]), t) for t in kept if tf[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found if part == "pair" else found[:top])]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "stride", "held"), [(32, 4096, 64, 400_000), (3, 7, 2, 50), (1, 1, 1, 1)])
def test_against_loops(spark, monkeypatch, block, chunk, stride, held):
    """Many sources, small tiles and chunks, nulls, groups without terms, terms beyond ASCII, repeated rows."""
    r = random.Random(block)
    words = [f"{a}{b}" for a in ("Ab", "cd", "éÉ", "日本", "z") for b in "ghijklm"]
    rows = []
    for k in range(160):
        lang, source = r.choice(["en", "de"]), f"s{r.randint(0, 8)}"
        rows.append((" ".join(r.choice(words[: 10 + 3 * len(source)] if source < "s4" else words) for _ in range(r.randint(0, 25))) + "-x9Y", lang, source))
    rows += [(None, None, None), ("", "en", None), ("one two", None, "lone"), ("12 34", "en", "empty"), ("rare", "xx", "a"), ("rare", "xx", "b")] + [rows[3]] * 4
    monkeypatch.setattr(D, "HELD", held)
    df = spark.createDataFrame([(7, *x, "c", 1) for x in rows], "doc_id long, text string, lang string, source string, term string, chunk int").repartition(3)
    got = D.audit(df, block=block, chunk=chunk, stride=stride)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_counts():
    """Counts whose product with 10**9 leaves 64 bits."""
    import numpy as np

    counts = np.array([0, 5, 10**12], np.int64)
    assert D.shares(counts, 10**12 + 5, 3).tolist() == [1 + 10**9 * (int(c) + 2) // (10**12 + 11) for c in counts]


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_sql(spark, duck, sf_dir):
    got = D.op13_divergence(spark, sf_dir)
    want = duck.execute(D.ORACLE)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
