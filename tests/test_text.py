"""Text and score expressions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import scoring as S
from docquarry.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("什么是WBS 工作流", ["什么", "么是", "wbs", "工作", "作流"]),
        ("中", ["中"]),
        ("", []),
        ("a1_b2", ["a1", "b2"]),
        ("Word word WORD", ["word"]),
        ("😀 x", ["x"]),
        ("𠀀𠀁", ["𠀀𠀁"]),
        (None, []),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, text, X.search_tokens) == tokens


@pytest.mark.parametrize(
    ("text", "strict", "loose"),
    [("md", True, True), ("the md file", True, True), ("cmd", False, True), ("plain", False, False)],
)
def test_markdown_trigger(spark, text, strict, loose):
    assert ("markdown" in one(spark, text, X.rewrite_terms)) == strict
    assert ("markdown" in one(spark, text, lambda c: X.rewrite_terms(c, substring_md=True))) == loose


def test_rewriting_keeps_order(spark):
    assert one(spark, "repo 向量", X.rewrite_terms) == ["repo", "向量", "offline", "repository", "local repository", "semantic search", "embedding", "vector"]


@pytest.mark.parametrize("text", ["a\u00a0b", "a\u3000 b", "\ta\r\nb ", " a  b"])
def test_white_space(spark, text):
    assert one(spark, text, X.normalize_whitespace) == "a b"


def test_lines_keep_their_digits(spark):
    """A line that begins or ends with the digit of its own number."""
    assert one(spark, "0 a 10\n 1b 21 \n\n0", X.split_paragraphs) == ["0 a 10\n1b 21", "0"]
    assert one(spark, "0 a 10! 1b 21", X.split_sentences) == ["0 a 10!", "1b 21"]


def test_highlight(spark):
    spans = lambda text, *terms: [(s["start"], s["end"]) for s in one(spark, text, lambda c: X.highlight_spans(c, F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")))]
    assert spans("aaa", "aa") == [(0, 2)]
    assert spans("abcd", "ab", "cd") == [(0, 4)]
    assert spans("x.*y", ".*") == [(1, 3)]
    assert spans("abc", "") == []
    assert spans("abc") == []


@pytest.mark.parametrize(("n", "at"), [(100, 10), (220, 0), (600, 0), (600, 300), (600, 590)])
def test_snippet(spark, n, at):
    text = "-" * at + "hit" + "-" * (n - at - 3)
    got = one(spark, text, lambda c: X.search_snippet(c, X.highlight_spans(c, F.array(F.lit("hit")))))
    assert len(got["text"].strip("…")) <= 220
    assert [got["text"][s["start"] : s["end"]] for s in got["spans"]] == ["hit"]
    assert got["text"].startswith("…") == (n > 220 and at > 200)


def test_scores(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    got = row.select(S.cosine("a", "a").alias("same"), S.cosine("a", "b").alias("right"), S.cosine("a", "z").alias("zero"), S.cosine("a", "s").alias("length")).first()
    assert tuple(got) == (1.0, 0.0, 0.0, 0.0)
    age = spark.createDataFrame([(0,), (2_000,), (1_000 - 30 * 86400,)], "m long").select(F.round(S.recency("m", F.lit(1_000)), 6).alias("r"))
    assert [r["r"] for r in age.collect()] == [0.05, 0.05, 0.05]
    month = spark.createDataFrame([(86400,)], "m long").select(S.recency("m", F.lit(31 * 86400)).alias("r")).first()["r"]
    assert month == pytest.approx(0.075)


@pytest.mark.parametrize(("a", "b", "newer"), [("1.10", "1.9", True), ("1.0", "1", False), ("v2.0.1", "2.0", True), ("1.x", "1.0", False)])
def test_versions(spark, a, b, newer):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(X.version_newer("a", "b").alias("n")).first()["n"] is newer


def test_paths(spark):
    row = spark.createDataFrame([("C:\\a\\b\\", "/x/y/z.txt")], "w string, p string")
    got = row.select(X.normalize_path("w").alias("n"), X.ancestors("p").alias("up"), X.in_directory("p", F.lit("/x/")).alias("inside"), X.in_directory("p", F.lit("/x/yy")).alias("sibling"), X.resolve_asset(F.lit("img/a.png"), "p").alias("asset")).first()
    assert tuple(got) == ("C:/a/b", ["/x/y", "/x"], True, False, "/x/y/img/a.png")


def test_snippet_values_are_computed_once(spark):
    """Spans at both ends, touching, overlapping, none; the expressions name the text a few times only."""
    from pyspark.sql import functions as F

    from docquarry.functions import text as X

    def plain(x, terms, limit=220):
        low = (x or "").lower()
        found = []
        for t in terms:
            at = low.find(t) if t else -1
            while at >= 0:
                found.append((at, at + len(t)))
                at = low.find(t, at + len(t))
        spans = []
        for a, b in sorted(found):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        x, n = x or "", len(x or "")
        if not spans or n <= limit:
            lo, hi = 0, min(n, limit)
        else:
            room = max(limit - (spans[-1][1] - spans[0][0]), 0)
            a = max(spans[0][0] - room * 2 // 5, 0)
            b = min(spans[-1][1] + room - room * 2 // 5, n)
            short = max(limit - (b - a), 0)
            lo = max(a - short // 2, 0)
            hi = min(b + short - short // 2, n, lo + limit)
        lead = int(lo > 0)
        return ("…" * lead + x[lo:hi] + "…" * (hi < n), [(max(a, lo) - lo + lead, min(b, hi) - lo + lead) for a, b in spans if b > lo and a < hi])

    terms = ["abc", "bcd", ".", "é", ""]
    fill = "x" * 150
    texts = [None, "", "none", "abcd", "ABCabcbcd", f"{fill}É{fill}", f"abc{fill}{fill}", f"{fill}{fill}bcd", f"{fill}abcd{fill}{fill}abc.{fill}", "é." * 300, f"{fill}{fill}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    spans = df.select("i", "t", X.highlight_spans("t", F.array(*[F.lit(t) for t in terms])).alias("s"))
    cut = spans.select("i", X.search_snippet("t", F.col("s")).alias("c"))
    got = {r["i"]: (r["c"]["text"], [tuple(s) for s in r["c"]["spans"]]) for r in cut.collect()}
    assert got == {i: plain(t, terms) for i, t in enumerate(texts)}
    plan = cut._jdf.queryExecution().analyzed().toString()
    assert plan.count("char_length(coalesce(t#") <= 2
