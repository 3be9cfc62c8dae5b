"""License scans, media archives, page texts, the classifier."""

import hashlib
import random
import re
import zipfile
import zlib

import pytest

from docquarry.llm import html_text, licenses, media, quality


def shingled(text):
    """Five-word shingles written apart from the module: lower-case runs of letters and digits."""
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_licenses(spark):
    """Texts, headers and notices, whole and edited, against every template by brute force."""
    r = random.Random(1)
    templates = licenses.license_templates()
    assert len({n for n, _, _ in templates}) > 20 and sum(kind == "text" for _, kind, _ in templates) >= 11
    rows, want = [(1000, None), (1001, ""), (1002, "four words are here")], set()
    for k in range(300):
        words = [f"x{r.randint(0, 9999)}" for _ in range(r.randint(0, 400))]
        name, kind, text = r.choice(templates) if k % 3 else r.choice([t for t in templates if t[1] != "notice"])
        notice = text.split()
        for _ in range(len(notice) // 60):
            notice[r.randrange(len(notice))] = "edited"
        at = r.randint(0, len(words))
        rows.append((k, " ".join(words[:at] + notice + words[at:]).replace(" ", "\n", 3)))
        want.add((k, name, kind))
    got = licenses.scan(spark.createDataFrame([(*x, "MIT") for x in rows], "doc_id long, text string, license string")).collect()
    found = {(x["doc_id"], x["license"], x["kind"]) for x in got}
    assert len(found) == len(got) and all(x["containment"] >= 0.8 for x in got) and not [x for x in got if x["doc_id"] >= 1000]
    sets = [(n, kind, shingled(t)) for n, kind, t in templates]
    brute = set()
    for k, text in rows:
        mine = shingled(text)
        brute |= {(k, n, kind) for n, kind, s in sets if len(s & mine) >= 0.8 * len(s) - 1e-9}
    assert found == brute and len(brute & want) >= 0.98 * len(want)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_lengthened_notice_is_found_at_every_offset():
    import numpy as np

    text = next(t for n, kind, t in licenses.license_templates() if (n, kind) == ("MPL-2.0", "header"))
    index, notice = licenses.Index([("MPL-2.0", "header", text)]), text.split()
    longer = notice[:17] + [f"put{k}" for k in range(9)] + notice[17:]
    share = len(shingled(text) & shingled(" ".join(longer))) / len(shingled(text))
    for before in range(32):
        raw = np.frombuffer(" ".join([f"x{k}" for k in range(before)] + longer + [f"y{k}" for k in range(200)]).encode(), np.uint8)
        doc, h, at = licenses.runs(raw, np.array([0, len(raw)]))
        assert index.matches(doc, h, at, 1)[0, 0] == (share, raw.tobytes().index(b"This"))


def test_media(spark, tmp_path):
    """What comes back against the payloads and images made here, with their features counted one by one."""
    rows = [(1, "abc"), (2, None), (3, "é" * 500), (4, "abc"), (None, "x"), (6, "z" * 300_000), (7, ""), (7, "")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, media long")
    archives = media.write_archives(df, f"file://{tmp_path}/m")
    for split, most in ((media.SPLIT_BYTES, media.MOST_GROUPS), (300, 3)):  # a range a group, many ranges a group
        every = media.describe(media.read_archives(spark, archives, split, most)).collect()
        assert len(every) == len(rows)
        got = {x["doc_id"]: x for x in every}
        for k, text in rows:
            raw = (text or "").encode()
            payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            image = media.to_png(payload, len(raw))
            assert media.from_png(image) == (payload, len(raw))
            n, mean = len(payload), sum(payload) / len(payload)
            spread = max(0.0, sum(b * b for b in payload) / n - mean * mean) ** 0.5
            shown = f"{n // 64}x64;mean={mean:.4f};sd={spread:.4f};hist=" + ",".join(str(sum(32 * h <= b < 32 * h + 32 for b in payload)) for h in range(8))
            assert tuple(got[k])[1:] == (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), shown)
    empty = media.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert media.read_archives(spark, empty).collect() == []


def test_a_split_archive_gives_every_member_once(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(50):
            z.writestr(str(k), media.to_png(*media.payload_of("t" * k)))
    spark.dataSource.register(media.ArchiveSource)
    rows = spark.read.format("archive_members").option("paths", str(tmp_path / "a.zip")).option("split", "700").load()
    assert rows.rdd.getNumPartitions() > 5 and sorted(r["doc_id"] for r in rows.select("doc_id").collect()) == list(range(50))


def test_a_damaged_member_is_told(tmp_path):
    image = media.to_png(*media.payload_of("hello"))
    with pytest.raises(ValueError, match="checksum"):
        media.from_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])
    from pyarrow import fs

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1", image)
    local = fs.LocalFileSystem()
    with local.open_input_file(str(tmp_path / "a.zip")) as f, pytest.raises(OSError, match="damaged"):
        media.member(local, str(tmp_path / "a.zip"), f, 0, len(image), 12345)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p><b>One<br>two<p>three</article><footer>F</footer>", "T & U\nOne two\nthree"),
        ("<article><p>a</p><div class='ad'>buy</div><aside>side</aside><p>b<script>x('</p>')</script></p><form>f</form></article><section id='comments'><p>me too</p></section>", "a\nb"),
        ("<article><header><h1>In</h1></header><p>t</p><div class=\"cookie-notice\">ok</div>", "In\nt"),
        ("<p>&lt;b&gt; 1 < 2", "<b> 1 < 2"),
        ("<!-- <p>no</p> --><article><p>a&nbsp;&nbsp;b\n\tc</p>", "a b c"),
        ("<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><div><p>" + "word " * 60 + "</p><p>" + "more " * 60 + "</p></div></div>", ("word " * 60).strip() + "\n" + ("more " * 60).strip()),
    ],
)
def test_pages(html, text):
    assert html_text.main_text(html) == text


def test_lines_before_the_surge_stay():
    long = "word " * 60
    page = f"<div><a href=1>Home</a></div><div><h1>T</h1><p>one</p><p>two</p><p>three</p><p>{long}</p></div>"
    assert html_text.main_text(page) == f"T\none\ntwo\nthree\n{long.strip()}"


def test_stretches_are_joined():
    one, two = "word " * 60, "more " * 80
    links = "".join(f"<p><a href={k}>Link {k}</a></p>" for k in range(4))
    assert html_text.main_text(f"<p>{one}</p>{links}<p>Short</p><p>{two}</p>{links}") == f"{one.strip()}\nShort\n{two.strip()}"
    plain = "<p>out</p>" * 4
    assert html_text.main_text(f"{plain}<article><p>a</p></article>{plain}<article><p>b</p><p>c</p></article>{plain}") == "a\nb\nc"


ARTICLE = "<article><h1>T</h1><p>one two three</p></article>"


@pytest.mark.parametrize(
    "html",
    [
        f'<div class="layout has-sidebar">{ARTICLE}</div>',
        f'<div id="search-results">{ARTICLE}</div>',
        f'<div class="sidebar"><div><p>side</p></div></div><div class="content-sidebar">{ARTICLE}</div>',
        f"{ARTICLE}<section id='comments'><h2>Comments</h2><article class='comment'><p>{'long remark ' * 40}</p></article></section>",
    ],
)
def test_wrappers_stay_and_asides_go(html):
    assert html_text.main_text(html) == "T\none two three"


def test_unmarked_pages_keep_all_parts():
    one, two = "word " * 40, "more " * 40
    menu = "<ul><li><a href=1>aa</a></li><li><a href=2>bb</a></li><li><a href=3>cc</a></li></ul>"
    assert html_text.main_text(f"{menu}<p>{one}</p>{menu}<p>{two}</p>{menu}") == f"{one.strip()}\n{two.strip()}"
    assert html_text.main_text(f"<p>{one}</p><p><a href=1>See the report</a></p><p>{two}</p>") == f"{one.strip()}\nSee the report\n{two.strip()}"


def test_cards_beside_a_long_article_go():
    body = "".join(f"<p>{'text ' * 60}{k}</p>" for k in range(6))
    cards = "".join(f"<section><div><a href={k}>All</a></div></section>" * 3 + f"<article><p><a href={k}>Card {k}</a></p><p>teaser</p></article>" for k in range(3))
    assert html_text.main_text(f"<main><article>{body}</article></main>{cards}").count("teaser") == 0


def test_gold_pages():
    """Unmarked pages by rule, with what surrounds an article in the wild: token F1 against the article."""
    r = random.Random(9)
    words = lambda n: " ".join(f"{r.choice('bcdfgl')}{r.randrange(10**5)}" for _ in range(n))
    menu = lambda n, c: f"<div class='{c}'><ul>" + "".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(n)) + "</ul></div>"
    scores = []
    for k in range(60):
        title, paragraphs = words(6), [words(r.randrange(20, 90)) for _ in range(r.randrange(3, 9))]
        middle = menu(4, "x") if k % 4 == 0 else ""
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" + (middle if i == 1 else "") for i, p in enumerate(paragraphs))
        wrapper = r.choice(["content", "post-body", "layout has-sidebar", "page-with-nav", "entry"])
        before = menu(r.randrange(4, 9), r.choice(["nav", "top", "menu-main", "navbar"])) + (f"<div class='cookie-notice'><p>{words(25)}</p></div>" if k % 3 else "")
        after = f"<div class='sidebar'>{menu(5, 'y')}<p>{words(15)}</p></div><div id='comments'><p>{words(40)}</p></div>" + f"<form><p>{words(9)}</p></form><div id='footer'><p>{words(12)}</p></div>"
        got = html_text.main_text(f"<html><body>{before}<div class='{wrapper}'>{body}</div>{after}</body></html>").split()
        gold = " ".join([title, *paragraphs]).split()
        both = len(set(got) & set(gold))
        scores.append(2 * both / (len(got) + len(gold)))
    assert sum(scores) / len(scores) >= 0.97, sum(scores) / len(scores)


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", "a", 1)]


def test_quality(spark):
    """Accuracy on rows that were held out, on the tables of sf0.1."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score(docs.join(labels, "doc_id").filter(quality.held_out()), model, ("doc_id", "quality")).collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 300 and len(bad) > 30
    assert sum(g >= 0.3 for g in good) >= 0.97 * len(good) and sum(b < 0.3 for b in bad) >= 0.75 * len(bad)
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    # The evidence is the difference alone: one text said twice keeps its score's side, whatever its length.
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (3, "x" * 200_000)], "doc_id long, text string")
    scores = [r["score"] for r in quality.score(odd, model).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] and scores[2] == scores[3] and all(0 <= s <= 1 for s in scores)
    none = quality.fit(docs, labels.filter("false"))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.score(odd, one).collect()} == {1.0}
    assert quality.score(docs.limit(0), model).collect() == []


def test_quality_on_few_labels(spark):
    """Too little to train a dictionary on: the texts themselves stand in."""
    docs = spark.createDataFrame([(k, "fine words of a fine text" if k % 2 else "### junk ### $$$") for k in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "0 AS text")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert min(got[k] for k in got if k % 2) > max(got[k] for k in got if k % 2 == 0)
