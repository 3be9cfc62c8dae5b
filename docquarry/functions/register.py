"""SQL functions and table functions of the engine, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docquarry.functions.text import HAN, SYNONYMS, WHITE

EMPTY = "''"
MD = ["lower(x) = 'md'", "contains(lower(x), ' md ')", "startswith(lower(x), 'md ')", "endswith(lower(x), ' md')"]

#: name -> (parameters, type, body); plain SQL, so Catalyst sees through them.
SCALARS = {
    "search_tokens": (
        "x STRING",
        "ARRAY<STRING>",
        f"array_distinct(flatten(transform(regexp_extract_all(coalesce(x, ''), r'[A-Za-z0-9]+|[{HAN}]+', 0), r -> CASE WHEN r RLIKE '^[A-Za-z0-9]' THEN array(lower(r)) WHEN char_length(r) = 1 THEN array(r) ELSE transform(sequence(1, greatest(char_length(r) - 1, 1)), i -> substring(r, i, 2)) END)))",
    ),
    "normalize_whitespace": ("x STRING", "STRING", f"trim(regexp_replace(x, r'{WHITE}', ' '))"),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN size(a) > 0 AND size(a) = size(b) THEN coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v), sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v))), 0D) ELSE 0D END",
    ),
    "distance_score": ("d DOUBLE", "DOUBLE", "CASE WHEN d <= 0 THEN 1D ELSE 1D / (1D + d) END"),
    "citation_ids": ("x STRING", "ARRAY<STRING>", r"array_distinct(regexp_extract_all(coalesce(x, ''), r'\[(\d+)\]', 1))"),
    "rewrite_terms": (
        "x STRING",
        "ARRAY<STRING>",
        "array_distinct(concat(search_tokens(x), "
        + ", ".join(
            f"CASE WHEN {' OR '.join([f'contains(lower(coalesce(x, {EMPTY})), {chr(39)}{t}{chr(39)})' for t in triggers] + (MD if 'markdown' in triggers else []))} THEN array({', '.join(chr(39) + a + chr(39) for a in added)}) ELSE cast(array() AS ARRAY<STRING>) END"
            for triggers, added in SYNONYMS
        )
        + "))",
    ),
    "highlight_spans": (
        "x STRING, terms ARRAY<STRING>",
        "ARRAY<STRUCT<start: INT, `end`: INT>>",
        """aggregate(array_sort(flatten(transform(filter(terms, t -> t <> ''), t -> filter(aggregate(
  slice(transform(split(lower(coalesce(x, '')), concat('\\\\Q', t, '\\\\E'), -1), g -> char_length(g)), 1, greatest(size(split(lower(coalesce(x, '')), concat('\\\\Q', t, '\\\\E'), -1)) - 1, 0)),
  named_struct('at', 0, 'out', cast(array() AS ARRAY<STRUCT<start: INT, `end`: INT>>)),
  (a, g) -> named_struct('at', a.at + g + char_length(t), 'out', concat(a.out, array(named_struct('start', a.at + g, 'end', a.at + g + char_length(t))))),
  a -> a.out), s -> s.`end` > s.start)))),
  cast(array() AS ARRAY<STRUCT<start: INT, `end`: INT>>),
  (a, s) -> CASE WHEN size(a) > 0 AND s.start <= try_element_at(a, -1).`end`
    THEN concat(slice(a, 1, greatest(size(a) - 1, 0)), array(named_struct('start', try_element_at(a, -1).start, 'end', greatest(try_element_at(a, -1).`end`, s.`end`))))
    ELSE concat(a, array(s)) END)""",
    ),
    "truncate_chars": ("x STRING, n INT", "STRING", "CASE WHEN char_length(x) > n THEN concat(left(x, n), '…') ELSE x END"),
}


def _blocks(ext: str):
    class Parse:
        def eval(self, text: str):
            from docquarry.sources.parsers import safe_parse

            for k, b in enumerate(safe_parse(ext, text or ""), start=1):
                yield k, b.kind, b.text, b.heading, b.level

    return udtf(Parse, returnType="block_index int, kind string, text string, heading string, level int")


class ChunkText:
    def eval(self, text: str, ext: str, most: int):
        from docquarry.sources import chunking
        from docquarry.sources.parsers import safe_parse

        for seq, heading, snippet, score, _, indexes in chunking.build(chunking.merged(chunking.normalized(safe_parse(ext, text or ""))), "", most):
            yield seq, heading, snippet, score, indexes


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, ext in (("parse_markdown", "md"), ("parse_html", "html"), ("parse_text", "txt")):
        spark.udtf.register(name, _blocks(ext))
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_seq int, heading string, snippet string, score double, block_indexes array<int>"))

    import pandas as pd
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    from docquarry.sources.embedding import hash_vector

    def hash_embed(texts, dimension):
        return pd.Series([hash_vector(t or "", int(n)) for t, n in zip(texts, dimension, strict=True)])

    spark.udf.register("hash_embed", pandas_udf(hash_embed, "array<float>", PandasUDFType.SCALAR))
