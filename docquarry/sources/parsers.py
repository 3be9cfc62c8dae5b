"""Documents to blocks: text, Markdown, HTML, DOCX, PPTX, XLSX and EPUB, with the standard library only.

A block is (kind, text, heading, level, page, section). ``blocks`` runs the parsers as one map over
documents; a document that its parser cannot read goes to a plainer reader, and what that cannot read either
gives one block of kind ``error`` instead of failing the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree import ElementTree

from pyspark.sql import DataFrame


class Block(NamedTuple):
    kind: str
    text: str
    heading: str = ""
    level: int = 0
    page: int | None = None
    section: str = ""


SCHEMA = "document_id long, block_index int, kind string, text string, heading string, level int, page int, section string"
ORDERED, BULLET = re.compile(r"^\s*\d+[.)]\s+"), re.compile(r"^\s*[-*+]\s+")
IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Headings:
    """The stack of open headings; the path is their texts from the top."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []

    def add(self, level: int, text: str) -> str:
        while self.open and self.open[-1][0] >= level:
            self.open.pop()
        self.open.append((level, text))
        return self.path

    @property
    def path(self) -> str:
        return " > ".join(t for _, t in self.open)


def table_text(rows: list[list[str]]) -> str:
    """A Markdown table: empty rows dropped, short rows filled up, a made-up header for a single row."""
    rows = [[squeeze(c) for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    if len(rows) == 1:
        rows.insert(0, [f"列 {k}" for k in range(1, width + 1)])
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def parse_text(text: str) -> Iterator[Block]:
    """Paragraphs between blank lines; '#' lines begin new ones; the first word is each one's heading."""
    for part in re.split(r"\n[ \t]*\n+|\n(?=#+\s)", text.replace("\r\n", "\n")):
        part = part.strip()
        if not part:
            continue
        first = part.split(maxsplit=1)[0][:80]
        yield Block("paragraph", part, first)


def parse_markdown(text: str) -> Iterator[Block]:
    """Headings, fenced code, tables (lines with a pipe), lists, quotes, images and paragraphs."""
    headings = Headings()
    held: list[str] = []
    kind = ""
    fence = ""

    def flush() -> Iterator[Block]:
        nonlocal kind
        if held:
            if kind == "table":
                rows = [[c for c in line.strip().strip("|").split("|")] for line in held if not re.fullmatch(r"[\s|:-]+", line)]
                body = table_text(rows)
            elif kind == "code":
                body = "\n".join(held)
            else:
                body = "\n".join(s for s in (line.strip() for line in held) if s)
            if body.strip():
                yield Block(kind, body, headings.path)
        held.clear()
        kind = ""

    for line in text.replace("\r\n", "\n").split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence:
            if mark and line.strip().startswith(fence):
                yield from flush()
                fence = ""
            else:
                held.append(line)
                kind = "code"
            continue
        if mark:
            yield from flush()
            fence, kind = mark[1][:3], "code"
            continue
        title = re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if title and title[2]:
            yield from flush()
            yield Block("heading", title[2], headings.add(len(title[1]), title[2]), len(title[1]))
            continue
        image = IMAGE.search(line)
        if image:
            yield Block("image", image[1] or image[2], headings.path)
            line = IMAGE.sub("", line)
        if not line.strip():
            if not image:
                yield from flush()
            continue
        now = "table" if "|" in line else "quote" if line.lstrip().startswith(">") else "list" if BULLET.match(line) or ORDERED.match(line) else "paragraph"
        if now == "paragraph" and kind == "list" and line[:1].isspace():
            now = "list"
        if kind and now != kind:
            yield from flush()
        kind = now
        held.append(re.sub(r"^\s*>\s?", "", line) if now == "quote" else line)
    yield from flush()


class HtmlBlocks(HTMLParser):
    """Blocks of p, li, h1-h6, pre, blockquote, tables and images; other text and scripts are left out."""

    KINDS = {"p": "paragraph", "li": "list", "pre": "code", "blockquote": "quote"} | {f"h{k}": "heading" for k in range(1, 7)}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.title = ""
        self.headings = Headings()
        self.tag, self.parts = "", []
        self.rows: list[list[str]] | None = None
        self.mute = ""

    def flush(self) -> None:
        text = "".join(self.parts)
        self.parts = []
        tag, self.tag = self.tag, ""
        text = text.strip("\n") if tag == "pre" else squeeze(text)
        if not tag or not text.strip():
            return
        if tag == "title":
            self.title = text
        elif tag in ("td", "th"):
            if self.rows:
                self.rows[-1].append(text)
        elif tag[0] == "h":
            self.out.append(Block("heading", text, self.headings.add(int(tag[1]), text), int(tag[1])))
        else:
            self.out.append(Block(self.KINDS[tag], text, self.headings.path))

    def handle_starttag(self, tag, attrs):
        if self.mute:
            return
        if tag in ("script", "style", "noscript"):
            self.mute = tag
        elif tag in self.KINDS or tag in ("title", "td", "th"):
            self.flush()
            self.tag = tag
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.flush()
            self.rows.append([])
        elif tag == "img":
            a = dict(attrs)
            if a.get("src"):
                self.out.append(Block("image", a.get("alt") or a["src"], self.headings.path))
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.mute:
            if tag == self.mute:
                self.mute = ""
            return
        if tag == self.tag:
            self.flush()
        elif tag == "table" and self.rows is not None:
            self.flush()
            body = table_text(self.rows)
            if body:
                self.out.append(Block("table", body, self.headings.path))
            self.rows = None
        elif tag in ("body", "html", "div", "ul", "ol", "article", "section", "tr"):
            self.flush()

    def handle_data(self, data):
        if not self.mute and self.tag:
            self.parts.append(data)

    def close(self):
        super().close()
        self.flush()


def parse_html(text: str) -> Iterator[Block]:
    p = HtmlBlocks()
    p.feed(text)
    p.close()
    return iter(p.out)


def image_html(src: str, alt: str = "") -> str:
    return f'<img src="{escape(src, quote=True)}" alt="{escape(alt, quote=True)}" />'


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(node, name: str) -> str:
    return next((v for k, v in node.attrib.items() if local(k) == name), "")


def texts(node, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if local(x.tag) == name)


def parse_docx(data: bytes) -> Iterator[Block]:
    """Headings by style, lists by style or numbering, tables; what stands before the first heading is front matter."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    headings, section = Headings(), "frontmatter"
    nodes = next((list(n) for n in body.iter() if local(n.tag) == "body"), [])
    has_headings = any(re.match(r"(?i)heading\s*\d", attribute(s, "val")) for n in nodes for s in n.iter() if local(s.tag) == "pStyle")
    if not has_headings:
        section = "body"
    for n in nodes:
        if local(n.tag) == "tbl":
            rows = [[squeeze(texts(c)) for c in r if local(c.tag) == "tc"] for r in n if local(r.tag) == "tr"]
            body_text = table_text(rows)
            if body_text:
                yield Block("table", body_text, headings.path, section=section)
        elif local(n.tag) == "p":
            style = next((attribute(s, "val") for s in n.iter() if local(s.tag) == "pStyle"), "")
            text = squeeze(texts(n))
            if any(local(s.tag) == "blip" for s in n.iter()):
                yield Block("image", text or "image", headings.path, section=section)
            if not text:
                continue
            level = re.match(r"(?i)heading\s*(\d)", style)
            if level:
                section = "body"
                yield Block("heading", text, headings.add(int(level[1]), text), int(level[1]), section=section)
            elif "list" in style.lower() or any(local(s.tag) == "numPr" for s in n.iter()):
                yield Block("list", text, headings.path, section=section)
            else:
                yield Block("paragraph", text, headings.path, section=section)


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    try:
        root = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    return {r.attrib["Id"]: posixpath.normpath(posixpath.join(folder, r.attrib["Target"])).lstrip("/") for r in root}


def parse_pptx(data: bytes) -> Iterator[Block]:
    """Slides in the order of the presentation: a heading 'Slide n', then texts and tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        main = "ppt/presentation.xml"
        targets = relations(z, main)
        ids = [next((v for k, v in n.attrib.items() if k.endswith("}id")), "") for n in ElementTree.fromstring(z.read(main)).iter() if local(n.tag) == "sldId"]
        order = [targets[i] for i in ids if i in targets]
        for k, part in enumerate(order, start=1):
            yield Block("heading", f"Slide {k}", f"Slide {k}", 1, k)
            root = ElementTree.fromstring(z.read(part))
            inside = set()
            for n in root.iter():
                if local(n.tag) == "tbl":
                    rows = [[squeeze(texts(c)) for c in r if local(c.tag) == "tc"] for r in n if local(r.tag) == "tr"]
                    inside.update(id(p) for p in n.iter())
                    body = table_text(rows)
                    if body:
                        yield Block("table", body, f"Slide {k}", page=k)
                elif local(n.tag) == "p" and id(n) not in inside:
                    text = squeeze(texts(n))
                    if text:
                        yield Block("paragraph", text, f"Slide {k}", page=k)
                elif local(n.tag) == "blip":
                    yield Block("image", "image", f"Slide {k}", page=k)


def parse_xlsx(data: bytes) -> Iterator[Block]:
    """The text of all shared strings and inline strings, a block each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in sorted(n for n in z.namelist() if n == "xl/sharedStrings.xml" or re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for n in ElementTree.fromstring(z.read(part)).iter():
                if local(n.tag) in ("si", "is"):
                    text = squeeze(texts(n))
                    if text:
                        yield Block("paragraph", text)


def parse_epub(data: bytes) -> Iterator[Block]:
    """The chapters in the order of the spine, else by file name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        order: list[str] = []
        try:
            box = ElementTree.fromstring(z.read("META-INF/container.xml"))
            opf = next(n.attrib["full-path"] for n in box.iter() if local(n.tag) == "rootfile")
            root = ElementTree.fromstring(z.read(opf))
            items = {n.attrib["id"]: n.attrib["href"] for n in root.iter() if local(n.tag) == "item"}
            order = [posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[n.attrib["idref"]])) for n in root.iter() if local(n.tag) == "itemref" and n.attrib.get("idref") in items]
        except (KeyError, StopIteration, ElementTree.ParseError):
            pass
        order = [n for n in order if n in names] or sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
        for n in order:
            yield from parse_html(z.read(n).decode("utf-8", "ignore"))


TEXT_PARSERS = {"txt": parse_text, "md": parse_markdown, "markdown": parse_markdown, "html": parse_html, "htm": parse_html}
UNREAD = ("pdf", "doc", "ppt")  # need a library or a host program
BINARY_PARSERS = {"docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "epub": parse_epub}


def raw_bytes(content: str | bytes) -> bytes:
    return content.encode() if isinstance(content, str) else bytes(content)


def parse(ext: str, content: str | bytes) -> list[Block]:
    """Blocks of one document; an unknown extension is read as plain text."""
    ext = (ext or "").lower().lstrip(".")
    if ext in UNREAD:
        raise ValueError(f"no reader for {ext} files")
    if ext in BINARY_PARSERS:
        return list(BINARY_PARSERS[ext](raw_bytes(content)))
    text = content if isinstance(content, str) else raw_bytes(content).decode("utf-8", "ignore")
    return list(TEXT_PARSERS.get(ext, parse_text)(text))


BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, StopIteration, EOFError, OSError)
#: Parts of an archive and the elements that hold text in them, for reading without a parser (fixed values).
LOOSE = {
    "docx": (r"word/(document|header\d*|footer\d*)\.xml", "w:t"),
    "pptx": (r"ppt/slides/slide\d+\.xml", "a:t"),
    "xlsx": (r"xl/(sharedStrings|worksheets/[^/]+)\.xml", "t"),
}


def fallback(ext: str, content: str | bytes) -> list[Block]:
    """The text as a plainer reader finds it: marked-up text without its marks, archives' text elements, other
    files as they are, which must be UTF-8. Raises ValueError where there is nothing to be had."""
    ext = (ext or "").lower().lstrip(".")
    if ext == "pdf":
        raise ValueError("PDF has no fallback")
    if ext in LOOSE:
        parts, tag = LOOSE[ext]
        with zipfile.ZipFile(io.BytesIO(raw_bytes(content))) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(parts, n)), key=lambda n: (len(n), n))
            found = [squeeze(unescape(t)) for n in names for t in re.findall(rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", z.read(n).decode("utf-8", "ignore"))]
        text = "\n".join(t for t in found if t)
    elif ext == "epub":
        with zipfile.ZipFile(io.BytesIO(raw_bytes(content))) as z:
            names = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
            text = "\n\n".join(strip_tags(z.read(n).decode("utf-8", "ignore")) for n in names)
    else:
        text = content if isinstance(content, str) else raw_bytes(content).decode("utf-8")
        text = strip_tags(text) if ext in ("html", "htm") else text
    if not text.strip():
        raise ValueError("no text found")
    return list(parse_text(text))


def strip_tags(text: str) -> str:
    return unescape(re.sub(r"<[^>]*(?:>|$)", "", text))


class Outcome(NamedTuple):
    """What reading a document came to: parser default, fallback (with a warning) or none (with a reason)."""

    parser: str
    warning: str | None
    reason: str | None
    blocks: list[Block]


def read(ext: str, content: str | bytes | None) -> Outcome:
    """The parser's blocks; where it fails, the fallback's with a warning; where that fails too, the reason."""
    content = content if content is not None else ""
    try:
        return Outcome("default", None, None, parse(ext, content))
    except BROKEN as e:
        first = f"{type(e).__name__}: {e}"
    try:
        return Outcome("fallback", f"主解析失败，已使用备用解析: {first}", None, fallback(ext, content))
    except BROKEN as e:
        return Outcome("none", None, f"{first}; {type(e).__name__}: {e}", [])


def safe_parse(ext: str, content) -> list[Block]:
    """The blocks that ``read`` finds; a document that cannot be read is one block of kind error."""
    found = read(ext, content)
    return found.blocks if found.reason is None else [Block("error", found.reason)]


def blocks(documents: DataFrame, content: str = "text") -> DataFrame:
    """documents: document_id, ext and content (text or bytes). Rows of SCHEMA, block_index from 1."""
    import pyarrow as pa

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = [(d, k, *b) for d, e, c in zip(*(part.column(n).to_pylist() for n in ("document_id", "ext", content)), strict=True) for k, b in enumerate(safe_parse(e, c), start=1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return documents.select("document_id", "ext", content).mapInArrow(run, SCHEMA)
