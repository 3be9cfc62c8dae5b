"""Score expressions: cosine, fusion, boosts, relevance. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import col, contains_all, contains_any

#: Boost for where a hit was found (fixed values).
ORIGINS = {"文件名命中": 0.45, "标题命中": 0.32, "正文摘要命中": 0.18, "路径命中": 0.08}
OTHER_ORIGIN = 0.12
RRF_K, KEYWORD_WEIGHT, VECTOR_WEIGHT = 60, 0.7, 1.0
K1, B = 1.2, 0.75


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 for empty vectors, other lengths and zero norms."""
    n = norm(a) * norm(b)
    usable = (F.size(col(a)) > 0) & (F.size(col(a)) == F.size(col(b))) & (n > 0)
    return F.when(usable, dot(a, b) / n).otherwise(0.0)


def distance_score(distance) -> Column:
    return F.when(col(distance) <= 0, 1.0).otherwise(1.0 / (1.0 + col(distance)))


def idf(df, n_docs) -> Column:
    return F.log(1.0 + (col(n_docs) - col(df) + 0.5) / (col(df) + 0.5))


def bm25(idf, length, mean_length) -> Column:
    """A term's part, its frequency being 1."""
    return col(idf) * (K1 + 1) / (1.0 + K1 * (1 - B + B * col(length) / col(mean_length)))


def rrf(keyword_rank, vector_rank) -> Column:
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF_K + col(r)), F.lit(0.0))
    return part(KEYWORD_WEIGHT, keyword_rank) + part(VECTOR_WEIGHT, vector_rank)


def recency(modified_at, now) -> Column:
    age = F.least((col(now) - col(modified_at)) / 86400.0, F.lit(3650.0))
    return F.when((col(modified_at) > 0) & (col(now) > col(modified_at)), 0.15 / (1.0 + age / 30.0)).otherwise(0.05)


def origin_boost(origin) -> Column:
    out = None
    for name, value in ORIGINS.items():
        out = F.when(col(origin) == name, value) if out is None else out.when(col(origin) == name, value)
    return out.otherwise(OTHER_ORIGIN)


def boosted(base, origin, modified_at, now) -> Column:
    return col(base) + origin_boost(origin) + recency(modified_at, now)


def preference(favorite, opens, expanded) -> Column:
    n = col(opens)
    return F.when(col(favorite), 0.12).otherwise(0.0) + F.when(n >= 3, 0.06).when(n > 0, 0.04).otherwise(0.0) + F.when(col(expanded), 0.03).otherwise(0.0)


def name_bonus(text, terms, full: float, some: float) -> Column:
    return F.when(contains_all(text, terms), full).when(contains_any(text, terms), some).otherwise(0.0)


def relevance(terms, file_name, heading, path, snippet) -> Column:
    """Sum over terms of the best field: file name and heading 3, path 2, snippet 1."""
    low = {k: F.lower(col(v)) for k, v in {"f": file_name, "h": heading, "p": path, "s": snippet}.items()}
    best = lambda t: F.when(F.contains(low["f"], t) | F.contains(low["h"], t), 3).when(F.contains(low["p"], t), 2).when(F.contains(low["s"], t), 1).otherwise(0)
    return F.aggregate(terms, F.lit(0), lambda s, t: s + best(F.lower(t)))


def relevance_share(score, terms) -> Column:
    return F.when(F.size(terms) > 0, F.least(col(score) / (3.0 * F.size(terms)), F.lit(1.0))).otherwise(0.0)


def term_overlap(terms, file_name, heading, path, snippet) -> Column:
    head, rest = F.lower(F.concat_ws(" ", col(file_name), col(heading))), F.lower(F.concat_ws(" ", col(path), col(snippet)))
    return F.aggregate(F.filter(terms, lambda t: F.char_length(t) >= 2), F.lit(0), lambda s, t: s + F.when(F.contains(head, t), 3).when(F.contains(rest, t), 1).otherwise(0))


def answer_score(best, hits, overlap, core) -> Column:
    return col(best) + 0.18 * F.greatest(col(hits) - 1, F.lit(0)) + 0.08 * F.least(col(overlap), F.lit(8)) + 0.65 * F.least(col(core), F.lit(4))
