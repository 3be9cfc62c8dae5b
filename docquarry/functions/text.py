"""Text expressions: tokens, rewriting, snippets, highlights, paths, labels. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode blocks that count as Han (fixed values).
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}"

#: Domain synonyms: substrings that trigger them, terms that are added (fixed values).
SYNONYMS = (
    (("离线仓库", "offline", "repo", "repository"), ("offline", "repo", "repository", "local repository")),
    (("语义搜索", "semantic", "embedding", "向量"), ("semantic search", "embedding", "vector")),
    (("切片", "chunk", "chunks"), ("chunk", "paragraph", "snippet")),
    (("markdown",), ("markdown", "md")),
    (("docx", "word"), ("docx", "word")),
    (("html",), ("html",)),
)

#: Failure categories and codes by keyword, first match wins (fixed values): words that are looked for as they
#: stand, words that are looked for in the lower-cased reason, category, code.
FAILURES = (
    (("文件过大",), (), "文件过大", "file_too_large"),
    (("暂不支持 PDF", "不支持的文件类型"), ("unsupported file type",), "不支持的格式", "unsupported_format"),
    (("权限",), ("permission denied", "access denied"), "权限不足", "permission_denied"),
    (("不存在", "找不到"), ("no such file", "not found"), "文件缺失", "file_missing"),
    (("目录",), ("is a directory", "invalid path", "not a file"), "路径无效", "invalid_path"),
    ((), ("timed out", "timeout"), "处理超时", "timeout"),
    ((), ("sqlite", "database", "pool timed out"), "数据库错误", "database_error"),
    ((), ("tantivy", "index"), "索引错误", "index_error"),
    ((), ("io error", "input/output"), "IO 错误", "io_error"),
)

WHITE = r"(?U)\s+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x) -> Column:
    return F.translate(col(x), UPPER, LOWER)


def search_tokens(x) -> Column:
    """Letters-and-digits runs in lower case, overlapping pairs of Han runs; each token once, in order.

    A text without Han characters is cut by one replacement, others run by run.
    """
    text = F.coalesce(col(x), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9]+|[{HAN}]+"), F.lit(0))
    split = lambda r: (
        F.when(r.rlike("^[A-Za-z0-9]"), F.array(F.lower(r)))
        .when(F.char_length(r) == 1, F.array(r))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    )
    words = F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))
    plain = F.array_remove(F.array_distinct(F.split(words, " ")), "")
    # One range is quicker to look for than all blocks; what it finds beyond them is cut right as well.
    return F.when(text.rlike(r"[\x{3400}-\x{10FFFF}]"), F.array_distinct(F.flatten(F.transform(runs, split)))).otherwise(plain)


def normalize_search_text(x) -> Column:
    return F.array_join(search_tokens(x), " ")


def rewrite_terms(x, substring_md: bool = False) -> Column:
    """Tokens and the synonyms that the text triggers. substring_md: 'md' anywhere counts, not only as a word."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    found = search_tokens(x)
    for triggers, added in SYNONYMS:
        hit = F.lit(False)
        for t in triggers:
            hit = hit | F.contains(low, F.lit(t))
        if "markdown" in triggers:
            word = F.contains(low, F.lit("md")) if substring_md else (low == "md") | F.contains(low, F.lit(" md ")) | F.startswith(low, F.lit("md ")) | F.endswith(low, F.lit(" md"))
            hit = hit | word
        found = F.concat(found, F.when(hit, F.array(*map(F.lit, added))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(found)


def normalize_whitespace(x) -> Column:
    """Runs of Unicode white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(col(x), WHITE, " "))


def normalize_embedding_text(x) -> Column:
    return ascii_lower(normalize_whitespace(x))


def split_paragraphs(x) -> Column:
    """Groups of non-blank lines, lines joined by one line end."""
    groups = F.split(F.replace(col(x), F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*(?:\n[ \t]*)+")
    clean = lambda g: F.array_join(F.filter(F.transform(F.split(g, "\n"), lambda line: F.trim(line)), lambda s: s != ""), "\n")
    return F.filter(F.transform(groups, clean), lambda g: g != "")


def derive_heading(text, file_name) -> Column:
    """The text of a leading '#' line, else the file name (whole texts that were collapsed to a line included)."""
    found = F.trim(F.regexp_extract(F.trim(col(text)), r"^#+([^\n]*)", 1))
    return F.when(found != "", found).otherwise(col(file_name))


def truncate_chars(x, limit: int) -> Column:
    c = col(x)
    return F.when(F.char_length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def contains_all(x, terms) -> Column:
    low = F.lower(col(x))
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(low, t))


def contains_any(x, terms) -> Column:
    low = F.lower(col(x))
    return (F.size(terms) > 0) & F.exists(terms, lambda t: F.contains(low, t))


def let(value, use) -> Column:
    """``use`` of a value that is computed once, however often it is named (lambdas share no common expressions)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def highlight_spans(x, terms) -> Column:
    """Half-open character spans of all terms in the lower-cased text, merged where they overlap or touch."""
    return let(F.lower(F.coalesce(col(x), F.lit(""))), lambda low: spans_of(low, terms))


def spans_of(low, terms) -> Column:
    span = "struct<start:int,end:int>"

    def of(term: Column) -> Column:
        size = F.char_length(term)
        parts = F.split(low, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)
        # The running total of the parts before gives each match's place.
        ends = lambda gaps: F.aggregate(
            F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))),
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")),
            lambda a, g: F.struct((a["at"] + g + size).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + g).alias("start"), (a["at"] + g + size).alias("end")))).alias("out")),
            lambda a: a["out"],
        )
        return F.when((size > 0) & F.contains(low, term), let(F.transform(parts, F.char_length), ends)).otherwise(F.array().cast(f"array<{span}>"))

    return merge_spans(F.flatten(F.transform(terms, of)))


def merge_spans(spans) -> Column:
    """Spans by their place, those that overlap or touch joined."""
    span = "struct<start:int,end:int>"
    last = lambda a: F.try_element_at(a, F.lit(-1))
    join = lambda a, s: (
        F.when(
            (F.size(a) > 0) & (s["start"] <= last(a)["end"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(s)))
    )
    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{span}>"), join)


def search_snippet(x, spans, limit: int = 220) -> Column:
    """struct(text, spans): a window around the spans, two fifths of the spare room before the first."""
    c = F.coalesce(col(x), F.lit(""))
    first = F.try_element_at(spans, F.lit(1))["start"]
    last = F.try_element_at(spans, F.lit(-1))["end"]

    def place(v):
        wide = F.greatest(F.lit(limit) - (v["last"] - v["first"]), F.lit(0))
        before = F.floor(wide * 2 / 5).cast("int")
        start = F.greatest(v["first"] - before, F.lit(0))
        end = F.least(v["last"] + (wide - before), v["n"])
        return let(F.struct(start.alias("start"), end.alias("end")), lambda w: filled(v, w))

    def filled(v, w):
        short = F.greatest(F.lit(limit) - (w["end"] - w["start"]), F.lit(0))
        start = F.greatest(w["start"] - F.floor(short / 2).cast("int"), F.lit(0))
        end = F.least(w["end"] + (short - F.floor(short / 2).cast("int")), v["n"])
        begin = F.when(F.size(spans) == 0, 0).when(v["n"] <= limit, 0).otherwise(start)
        stop = F.when(F.size(spans) == 0, F.least(v["n"], F.lit(limit))).when(v["n"] <= limit, v["n"]).otherwise(F.least(end, start + limit))
        return let(F.struct(begin.alias("begin"), stop.alias("stop")), lambda w: cut(v, w["begin"], w["stop"]))

    def cut(v, begin, stop):
        lead = F.when(begin > 0, 1).otherwise(0)
        body = F.concat(F.when(begin > 0, "…").otherwise(""), F.substring(c, begin + 1, stop - begin), F.when(stop < v["n"], "…").otherwise(""))
        moved = F.transform(
            F.filter(spans, lambda s: (s["end"] > begin) & (s["start"] < stop)),
            lambda s: F.struct((F.greatest(s["start"], begin) - begin + lead).alias("start"), (F.least(s["end"], stop) - begin + lead).alias("end")),
        )
        return F.struct(body.alias("text"), moved.alias("spans"))

    return let(F.struct(F.char_length(c).alias("n"), first.alias("first"), last.alias("last")), place)


def strip_html(x) -> Column:
    """Tags deleted (script text stays), five entities decoded."""
    c = F.regexp_replace(col(x), r"<[^>]*(?:>|$)", "")
    c = F.replace(c, F.lit(">"), F.lit(""))
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def display_timestamp(x, unknown: str = "未知") -> Column:
    """UTC date and time of unix seconds; what is not positive is unknown. The session's zone must be UTC."""
    return F.when(col(x) > 0, F.date_format(F.timestamp_seconds(col(x)), "yyyy-MM-dd HH:mm:ss")).otherwise(unknown)


def version_newer(a, b) -> Column:
    """Whether version a is newer than b: dotted numbers, compared as such, missing parts are 0."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(F.trim(col(v)), "^[vV]", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("long"), F.lit(0)))
    pa, pb = parts(a), parts(b)
    n = F.greatest(F.size(pa), F.size(pb))
    pad = lambda p: F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(p, i - 1), F.lit(0)))
    signs = F.filter(F.zip_with(pad(pa), pad(pb), lambda x, y: F.signum(x - y)), lambda s: s != 0)
    return F.coalesce(F.get(signs, F.lit(0)) > 0, F.lit(False))


def platform_key(system, machine) -> Column:
    return F.concat(F.lower(F.trim(col(system))), F.lit("-"), F.lower(F.trim(col(machine))))


#: Error codes of older callers (fixed values).
LEGACY_CODES = (("invalidrequest", "invalid_request"), ("filenotfound", "file_not_found"), ("parsefailed", "parse_failed"), ("internalerror", "internal_error"), ("unsupportedfiletype", "unsupported_file_type"))


def error_code(x) -> Column:
    """Lower case with underscores; older spellings by a table."""
    code = F.replace(F.lower(F.trim(col(x))), F.lit("-"), F.lit("_"))
    bare = F.replace(code, F.lit("_"), F.lit(""))
    out = None
    for old, new in LEGACY_CODES:
        out = F.when(bare == old, new) if out is None else out.when(bare == old, new)
    return out.otherwise(code)


def inferred_title(kinds, texts) -> Column:
    """The first block with text: a heading's whole text, of others the first word (80 characters at most)."""
    pairs = F.filter(F.zip_with(col(kinds), col(texts), lambda k, t: F.struct(k.alias("k"), t.alias("t"))), lambda p: F.coalesce(p["t"], F.lit("")) != "")
    first = F.get(pairs, F.lit(0))
    return F.when(first["k"] == "heading", first["t"]).otherwise(F.left(F.get(F.filter(F.split(first["t"], WHITE), lambda w: w != ""), F.lit(0)), F.lit(80)))


def classify_failure(reason, path) -> tuple[Column, Column]:
    """Category and code of a failure."""
    low = F.lower(col(reason))
    category = code = None
    for words, lowered, name, short in FAILURES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(col(reason), F.lit(w))
        for w in lowered:
            hit = hit | F.contains(low, F.lit(w))
        category = F.when(hit, name) if category is None else category.when(hit, name)
        code = F.when(hit, short) if code is None else code.when(hit, short)
    pdf = F.endswith(F.lower(col(path)), F.lit(".pdf"))
    return category.when(pdf, "PDF 解析失败").otherwise("解析失败"), code.otherwise("parse_error")


def progress_percent(done, total, empty: int = 100) -> Column:
    return F.when(col(total) <= 0, empty).otherwise(F.least(F.round(col(done) * 100.0 / col(total)), F.lit(100))).cast("int")


def normalize_path(x) -> Column:
    """Forward slashes, no slash at the end (but for the root)."""
    c = F.replace(col(x), F.lit("\\"), F.lit("/"))
    return F.when(c.rlike("^/+$"), "/").otherwise(F.regexp_replace(c, "/+$", ""))


def leaf_name(x) -> Column:
    return F.element_at(F.split(normalize_path(x), "/"), -1)


def extension(x) -> Column:
    return F.lower(F.regexp_extract(col(x), r"\.([^./\\]+)$", 1))


def ancestors(x) -> Column:
    """Every proper ancestor directory of an absolute path, longest first."""
    parts = F.split(normalize_path(x), "/")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(n - 1, F.lit(2), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def in_directory(path, directory, dir_path=None) -> Column:
    """Equality or a prefix up to a slash; virtual directories match by the stored directory."""
    p, d = normalize_path(path), normalize_path(directory)
    plain = (p == d) | F.startswith(p, F.concat(d, F.lit("/")))
    if dir_path is None:
        return plain
    return F.when(F.startswith(col(directory), F.lit("virtual://")), col(dir_path) == col(directory)).otherwise(plain)


def resolve_asset(asset, document) -> Column:
    """Absolute paths and URLs as they are, others beside the document."""
    a = col(asset)
    kept = a.rlike(r"^(?:https?|data|blob|file):|^/|^[A-Za-z]:[\\/]")
    parent = F.regexp_replace(normalize_path(document), "/[^/]*$", "")
    return F.when(F.coalesce(F.trim(a), F.lit("")) == "", "").when(kept, a).otherwise(F.concat(parent, F.lit("/"), F.regexp_replace(a, r"^\./", "")))


def display_name(x, default: str, limit: int = 40) -> Column:
    """White space collapsed, first characters, a default where nothing is left."""
    c = F.left(normalize_whitespace(x), F.lit(limit))
    return F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(c)


def citation(file_name, heading, page, paragraph) -> Column:
    """《file》 / heading / Page n / Para n, parts that are missing left out."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(" / ", F.concat(F.lit("《"), col(file_name), F.lit("》")), blank(col(heading)), F.concat(F.lit("Page "), col(page).cast("string")), F.concat(F.lit("Para "), col(paragraph).cast("string")))


def split_sentences(x) -> Column:
    """After an end mark that white space follows, and at line ends."""
    parts = F.split(F.trim(F.coalesce(col(x), F.lit(""))), r"(?<=[。！？.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda part: F.trim(part)), lambda s: s != "")


def citation_ids(x) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)))


def source_location(heading, file_name) -> Column:
    return F.when(F.trim(F.coalesce(col(heading), F.lit(""))) != "", col(heading)).otherwise(col(file_name))


def format_score(x) -> Column:
    """Whole where within .005 of one, else two decimals from 1 on, three below."""
    v = col(x)
    return F.when(F.abs(v - F.round(v)) < 0.005, F.format_string("%.0f", v)).when(F.abs(v) >= 1, F.format_string("%.2f", v)).otherwise(F.format_string("%.3f", v))


def meaningful(x) -> Column:
    """Text that reads like text: share of letters (Han counts twice), word lengths, words with vowels."""
    c = F.trim(F.coalesce(col(x), F.lit("")))
    han = F.char_length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", ""))
    letters = F.char_length(F.regexp_replace(c, r"\P{L}", ""))
    words = F.filter(F.split(c, WHITE), lambda w: w != "")
    n = F.size(words)
    mean = F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w)) / F.nullif(n, F.lit(0))
    vowels = F.size(F.filter(words, lambda w: (F.char_length(w) > 1) & w.rlike("(?i)[aeiou]")))
    return (c != "") & (letters + han > 0) & ~((mean > 25) & (han == 0)) & ((letters + han) / F.char_length(c) >= 0.25) & ~((n >= 3) & (vowels / n < 0.15) & (han == 0))


def layer_noise(x) -> Column:
    """A broken text layer: eight tokens and more, mostly short, many upper case, few lower case, mixed shapes."""
    c = normalize_whitespace(F.coalesce(col(x), F.lit("")))
    tokens = F.filter(F.split(c, " "), lambda t: t != "")
    alpha = F.filter(tokens, lambda t: t.rlike("[A-Za-z]"))
    pure = F.transform(alpha, lambda t: F.regexp_replace(t, "[^A-Za-z]", ""))
    n = F.nullif(F.size(alpha), F.lit(0))
    share = lambda arr, f: F.size(F.filter(arr, f)) / n
    return F.coalesce(
        ~c.rlike(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]")
        & (F.size(tokens) >= 8)
        & (share(pure, lambda t: F.char_length(t) <= 4) >= 0.7)
        & (share(pure, lambda t: t.rlike("^[A-Z]{3,}$")) >= 0.35)
        & (share(pure, lambda t: t.rlike("^[a-z]{4,}$")) <= 0.2)
        & (share(alpha, lambda t: ~t.rlike("^[A-Za-z]+$")) >= 0.25),
        F.lit(False),
    )


def ocr_reason(x) -> Column:
    """Why a page needs recognition: none, no_text_layer, noisy_text_layer or meaningless_text_layer."""
    return F.when(F.trim(F.coalesce(col(x), F.lit(""))) == "", "no_text_layer").when(layer_noise(x), "noisy_text_layer").when(~meaningful(x), "meaningless_text_layer").otherwise("none")
