"""Main text of web pages by line-block distribution (op 8).

Method: markup is stripped into lines (one per block element), each with a text length; lengths are summed
over a sliding window of lines; a stretch of text reaches from a surge (the window sum rises over a threshold
taken from the page's largest window) to the dive (it falls to nothing), with the weighing lines right before
the surge. Every stretch that surges is kept, on marked pages and others alike. The markup only gives weights:
lines of menus, headers, footers, forms and the like are none; lines that are mostly links weigh nothing; where
a page marks its article, lines outside the mark weigh nothing, and a mark with a line in a surging stretch is
kept whole, so that short marked cards beside a long article fall to the threshold.

Names of classes, ids and roles (sidebar, comments, advert ..) take a container out only if it holds neither a
mark nor a first heading nor, but for comments, most of the page's text: a wrapper is never taken for what one
word of its name says.

Cases: null or empty html gives an empty text; unclosed elements, comments and tags end with the page; a page
whose lines are all links is weighed by plain lengths; pages of any length are read whole (memory per Arrow
batch); repeated rows give repeated results.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.common import table, tidy

WINDOW = 3
THRESHOLD = 80

#: Elements whose content is no text of the page.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "canvas", "xmp", "noembed", "noframes")
#: Elements that hold no part of an article.
ASIDE = frozenset("nav footer aside form fieldset button select option datalist label input menu dialog head audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that name something else than the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply pagination pager popup modal overlay copyright disclaimer complementary contentinfo banner search dialog".split()
)
#: Parts of a name that make it a layout's, not the thing's (has-sidebar, search-results).
LAYOUT = frozenset("has with without no page layout wrapper wrap container content main results site body root app grid row col columns".split())
REMARKS = frozenset("comment comments commentlist disqus respond replies reply".split())
MARKS = frozenset({"article", "main"})
LINKS = 3  # neighbouring lines of links that make a menu
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"  # these close themselves, unlike a script
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
CUT = re.compile(r"[\s_\-:]+")


def named(attrs: str) -> int:
    """What an element's class, id and role say: 0 nothing, 1 something else than the article, 2 readers' comments."""
    said = 0
    for _, a, b, c in NAMES.findall(attrs):
        for token in (a or b or c).lower().split():
            parts = CUT.split(token)
            if HINTS.isdisjoint(parts) or len(parts) > 1 and not LAYOUT.isdisjoint(parts):
                continue
            said = max(said, 1 if REMARKS.isdisjoint(parts) else 2)
    return said


class Line(NamedTuple):
    text: str
    links: int  # characters of it in links
    mark: int  # number of the innermost article mark it stands in, 0: none
    boxes: tuple[int, ...]  # open containers whose name says something else


class Box:
    """A container whose name says that it is not the article; the best mark it has inside: 2 an article's, 1 a heading."""

    def __init__(self, remarks: bool):
        self.remarks, self.mark = remarks, 0

    def holds(self, size: int, outside: int, headed: bool) -> bool:
        """Whether it holds the article all the same: a mark counts if less marked text stands outside all such
        containers, a heading if neither that nor a heading does."""
        return self.mark == 2 and size > outside or self.mark == 1 and not outside and not headed


def lines(html: str) -> list[Line]:
    """Blocks in page order, without those in containers that are something else than the article."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, ends the text, number of the mark, number of the box
    boxes: list[Box] = []
    open_boxes: list[int] = []
    marks: list[int] = []
    skipping = anchor = linked = made = 0
    headed = False  # a heading outside all boxes
    inside, around = 0, ()
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Line(text, linked, inside, around))
            parts.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal inside, around
        if not parts:
            inside, around = marks[-1] if marks else 0, tuple(open_boxes)
        parts.append(piece)

    def drop(k: int) -> None:
        nonlocal skipping
        for _, skip, mark, box in reversed(stack[k:]):
            skipping -= skip
            if mark:
                marks.pop()
            if box:
                open_boxes.pop()
        del stack[k:]

    for m in TOKEN.finditer(html):
        if m.start() > at and not skipping:
            piece = html[at : m.start()]
            take(piece)
            if anchor:
                linked += len(piece.strip())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name in ("br", "img", "wbr") and not skipping:
            parts.append(" ")
        if m["end"]:
            if name == "a":
                anchor = max(0, anchor - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    drop(k)
                    break
            continue
        attrs = m["attrs"]
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK and stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
            drop(len(stack) - 1)
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            drop(len(stack) - 1)
        if name == "a":
            anchor = 1
        skip = name in ASIDE or name == "header" and not marks or bool(attrs and HIDDEN.search(attrs))
        said = named(attrs) if attrs and name not in ("html", "body") else 0
        mark = said == 0 and not skip and (name in MARKS or 'role="main"' in attrs)
        if (mark or name == "h1" and not said) and not skipping and not skip:
            headed = headed or not mark and not open_boxes
            for k in open_boxes:
                if not boxes[k - 1].remarks:
                    boxes[k - 1].mark = max(boxes[k - 1].mark, 1 + mark)
        if name in BLOCK or skip or said:
            made += mark
            if mark:
                marks.append(made)
            if said:
                boxes.append(Box(said == 2))
                open_boxes.append(len(boxes))
            stack.append((name, skip, made if mark else 0, len(boxes) if said else 0))
            skipping += skip
    if at < len(html) and not skipping:
        take(html[at:])
    flush()
    if not boxes:
        return out
    size = [0] * (len(boxes) + 1)
    for line in out:
        size[0] += len(line.text)
        for k in set(line.boxes):
            size[k] += len(line.text)
    outside = sum(len(line.text) for line in out if line.mark and not line.boxes)
    # Where the page says elsewhere what it is about, such a container goes whatever its size; else the larger half stays.
    told = outside or headed
    gone = {k for k, box in enumerate(boxes, start=1) if not box.holds(size[k], outside, headed) and (box.remarks or told or 2 * size[k] <= size[0])}
    return [line for line in out if gone.isdisjoint(line.boxes)]


def main_text(html: str | None) -> str:
    """The texts between surges and dives, a block on each line."""
    found = lines(html or "")
    if not found:
        return ""
    n = len(found)
    marked = any(x.mark for x in found)
    linked = [2 * x.links > len(x.text) for x in found]
    weights = [0 if linked[i] or marked and not x.mark else len(x.text) for i, x in enumerate(found)]
    if not any(weights):
        weights = [len(x.text) * (x.mark > 0 or not marked) for x in found]
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    least = min(THRESHOLD, max(sums) // 4)
    kept: set[int] = set()
    i = end = 0
    while i < n:
        if sums[i] <= least or not weights[i]:
            i += 1
            continue
        start = i
        while start > end and weights[start - 1]:  # short lines right before the surge
            start -= 1
        j = end = i
        while j < n and sums[j] > 0:  # to the dive
            if weights[j]:
                end = j + 1
            j += 1
        kept.update(range(start, end))
        i = max(j, i + 1)
    if marked:  # a mark that has a line in a stretch is kept whole, what stands outside marks is not
        chosen = {found[k].mark for k in kept} - {0}
        return "\n".join(x.text for x in found if x.mark in chosen)
    menu = [False] * n
    i = 0
    while i < n:  # lines of links side by side are a menu, a single one is part of the text
        j = i
        while j < n and linked[j]:
            j += 1
        if j - i >= LINKS:
            menu[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return "\n".join(found[k].text for k in sorted(kept) if weights[k] or not menu[k])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars for every row; one map, no exchange."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select(*keep, html).mapInArrow(tidy(run), schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"))
