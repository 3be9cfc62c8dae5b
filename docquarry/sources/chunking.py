"""Blocks to chunks: noise dropped, short neighbours merged, greedy packing up to a number of characters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.sources.parsers import Block, read, safe_parse, squeeze

MAX_CHARS, LEAST_MAX, MERGE_BELOW = 800, 120, 120
#: Weights of kinds in a chunk's score; others weigh 1 (fixed values).
WEIGHTS = {"table": 0.55, "image": 0.7, "quote": 0.9, "list": 0.9, "blockquote": 0.9, "li": 0.9}
#: Where a long text is cut, best first (fixed values).
SEPARATORS = (". ", "。", "\n", "; ", "；", ", ", "，", " ")
WHOLE = ("heading", "code", "image")
NOISE = re.compile(r"page\s+\d+(\s+of\s+\d+)?|\d+|copyright|all rights reserved", re.I)
LETTER = re.compile(r"[a-zA-Z一-鿿]")
#: Words of a cover page (fixed values).
COVER = ("文档编号", "文档版本", "副标题", "编制", "校对", "审核", "批准", "年月日")
SIGN_OFFS = ("编制", "校对", "审核", "批准")


def is_noise(text: str) -> bool:
    return len(text) <= 1 or NOISE.fullmatch(text) is not None or len(text) <= 3 and not LETTER.search(text)


def normalized(found: list[Block]) -> list[Block]:
    """White space collapsed (code keeps its lines), noise dropped."""
    out = []
    for b in found:
        text = b.text.strip("\n") if b.kind == "code" else squeeze(b.text)
        if text.strip() and (b.kind in WHOLE or not is_noise(text)):
            out.append(b._replace(text=text))
    return out


def merged(found: list[Block], below: int = MERGE_BELOW) -> list[Block]:
    """Neighbours with the same kind, heading, page and section are joined while both together stay short."""
    out: list[Block] = []
    for b in found:
        last = out[-1] if out else None
        alike = last and b.kind not in WHOLE and (last.kind, last.heading, last.page, last.section) == (b.kind, b.heading, b.page, b.section)
        if alike and len(last.text) + len(b.text) + 1 < below:
            out[-1] = last._replace(text=f"{last.text} {b.text}")
        else:
            out.append(b)
    return out


def split(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last separator of the best kind in the window."""
    out, at, end = [], 0, len(text.rstrip())
    while end - at > most:
        cut = next((found + len(s) for s in SEPARATORS if (found := text.rfind(s, at, at + most)) > at), at + most)
        out.append(text[at:cut].strip())
        at = cut
        while at < end and text[at].isspace():
            at += 1
    return [p for p in [*out, text[at:end].strip()] if p]


def is_cover(text: str) -> bool:
    """A chunk of a cover page: a word of it, or two names of sign-offs in one short joined line."""
    return any(w in text for w in COVER) or " | " in text and len(text) < 260 and sum(w in text for w in SIGN_OFFS) >= 2


def build(found: list[Block], stem: str, most: int = MAX_CHARS, cover: bool = False) -> list[tuple[int, str, str, float, int | None, list[int]]]:
    """(sequence, heading, text, score, page, block indexes) of every chunk."""
    most = max(most, LEAST_MAX)
    out: list[tuple] = []
    held: list[str] = []
    indexes: list[int] = []
    score, heading, page, section = 1.0, "", None, ""

    def flush() -> None:
        nonlocal held, indexes, score
        text = squeeze(" ".join(held))
        if text and not (cover and is_cover(text)):
            out.append((len(out), heading or stem, text, score, page, indexes))
        held, indexes, score = [], [], 1.0

    for k, b in enumerate(found, start=1):
        if b.kind == "heading":
            flush()
            heading = b.heading or b.text
            section = b.section or "body"
            continue
        if b.section and section and b.section != section:
            flush()
        section = b.section or section
        heading = b.heading or heading
        page = b.page if b.page is not None else page
        if b.section == "frontmatter":
            continue
        for piece in [b.text] if b.kind in WHOLE else split(b.text, most):
            if held and len(squeeze(" ".join([*held, piece]))) > most:
                flush()
            held.append(piece)
            if k not in indexes:
                indexes.append(k)
            score = min(score, WEIGHTS.get(b.kind, 1.0))
            if len(squeeze(" ".join(held))) >= most:
                flush()
    flush()
    if not out and found:
        whole = squeeze(" ".join(b.text for b in found))
        if whole:
            out.append((0, heading or stem, whole, 1.0, None, list(range(1, len(found) + 1))))
    return out


SCHEMA = "document_id long, chunk_seq long, heading string, snippet string, score double, page int, block_indexes array<int>"


def chunks(documents: DataFrame, content: str = "text", most: int = MAX_CHARS) -> DataFrame:
    """documents: document_id, ext, stem and content. Parses and packs each document in one map."""
    import pyarrow as pa

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = []
                for d, e, s, c in zip(*(part.column(n).to_pylist() for n in ("document_id", "ext", "stem", content)), strict=True):
                    found = merged(normalized([b for b in safe_parse(e, c) if b.kind != "error"]))
                    rows += [(d, *r) for r in build(found, s, most, cover=e == "docx")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return documents.select("document_id", "ext", "stem", content).mapInArrow(run, SCHEMA)


BLOCK = "struct<block_index:int,kind:string,text:string,heading:string,level:int,page:int,section:string>"
CHUNK = "struct<chunk_seq:long,heading:string,snippet:string,score:double,page:int,block_indexes:array<int>>"
OUTCOME = f"document_id long, parser string, warning string, reason string, blocks array<{BLOCK}>, chunks array<{CHUNK}>"


def outcomes(documents: DataFrame, content: str = "text", most: int = MAX_CHARS) -> DataFrame:
    """One row for each document: how it was read, with a reason where it was not, and its blocks and chunks.

    documents: document_id, ext, stem and content. Write the result once and take blocks, chunks and failures of it.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(OUTCOME))
    block_names, chunk_names = (["block_index", *Block._fields], ["chunk_seq", "heading", "snippet", "score", "page", "block_indexes"])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = []
                for d, e, s, c in zip(*(part.column(n).to_pylist() for n in ("document_id", "ext", "stem", content)), strict=True):
                    found = read(e, c)
                    made = build(merged(normalized(found.blocks)), s, most, cover=e == "docx")
                    blocks = [dict(zip(block_names, (k, *b), strict=True)) for k, b in enumerate(found.blocks, start=1)]
                    rows.append({"document_id": d, "parser": found.parser, "warning": found.warning, "reason": found.reason, "blocks": blocks, "chunks": [dict(zip(chunk_names, m, strict=True)) for m in made]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents.select("document_id", "ext", "stem", content).mapInArrow(run, OUTCOME)


def blocks_of(parsed: DataFrame) -> DataFrame:
    """Blocks of ``outcomes``: document_id, block_index, kind, text, heading, level, page, section."""
    return parsed.select("document_id", F.inline("blocks"))


def chunks_of(parsed: DataFrame) -> DataFrame:
    """Chunks of ``outcomes``: document_id, chunk_seq, heading, snippet, score, page, block_indexes."""
    return parsed.select("document_id", F.inline("chunks"))


def failures_of(parsed: DataFrame) -> DataFrame:
    """Documents that could not be read: document_id, reason."""
    return parsed.filter("reason IS NOT NULL").select("document_id", "reason")
