"""Audit of how far the sources of a language differ in their words (op 13).

A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps the terms of ``LEAST`` =
10 of its documents at least. Every group (language, source) and every language gives each kept term the share
p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); two shares differ by f = floor((p - q)**2 / (p + q)). Part ``pair``
adds f over all kept terms for any two sources of a language, part ``term`` ranks the terms that a group has more
often than its language does.

Method: a map counts the terms of a task's texts by group, so that what is exchanged is a row for each group and term
of a task. The kept counts are packed into vectors, one for each group and vocabulary chunk (about ``CHUNK`` terms).
Groups are dealt into blocks of about ``BLOCK``; a vector is sent to the tasks of all pairs of blocks that its
own block is in, and such a task goes through its chunks one after another, holding two blocks of one chunk, and adds
up its part of the matrix of pairs. Terms that neither block has cost nothing: they all give the same f. A tile with
more than ``STRIDE`` chunks is several tasks, whose matrices are added.

Work grows as groups**2 * V / 2 by language, as the result does with groups**2; no task has more than two blocks of
``STRIDE`` chunks.
All arithmetic is whole: 64 bits where it is sure to fit, else decimals and Python's integers.

Cases: null text, lang and source count as ''; a text without terms still makes its group; empty and very long texts
are counted whole (a task's counters are sent on at ``HELD`` entries); repeated rows count each as a document; doc_id is
not read; an empty table gives an empty result; a language without kept terms has pairs of value 0 and no terms; ties
are ranked by the item's UTF-8; further columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import binary_views, stored, table, tidy, width

LEAST = 10
UNIT = 1_000_000_000
TOP = 10
CHUNK = 4096
BLOCK = 32
STRIDE = 64
SALTS = 64
HELD = 400_000
I64 = np.int64

#: A-Z to a-z, other ASCII that is no letter to a space: then splitting at spaces leaves the terms.
LETTERS = bytes(b | 32 if chr(b).isascii() and chr(b).isalpha() else b if b > 127 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, tf, df: counts and documents by group and term, pre-added by task; a row with a null term
    for every group."""
    import pyarrow as pa

    def rows(counts: dict, documents: dict):
        for (lang, source), tf in counts.items():
            df, terms = documents[lang, source], list(tf)
            n = len(terms) + 1
            text = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([x])).dictionary_decode()  # noqa: B023, E731
            columns = [text(lang), text(source), pa.array([t.decode("utf-8", "replace") for t in terms] + [None], pa.string()), pa.array([*tf.values(), 0], pa.int64()), pa.array([df[t] for t in terms] + [0], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "tf", "df"])

    def run(batches):
        counts: dict = {}
        documents: dict = {}
        for batch in batches:
            data, bounds = binary_views(batch.column("text"))
            raw, at = data.tobytes(), bounds.tolist()
            for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                if group not in counts:
                    counts[group], documents[group] = Counter(), Counter()
                own = Counter(raw[at[k] : at[k + 1]].translate(LETTERS).split())
                counts[group].update(own)
                documents[group].update(own.keys())
            if sum(map(len, counts.values())) > HELD:
                yield from rows(counts, documents)
                counts, documents = {}, {}
        yield from rows(counts, documents)

    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    sent = texts.mapInArrow(tidy(run), "lang string, source string, term string, tf long, df long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def share(count: str, n: str, v: str) -> str:
    """p as SQL, whole numbers; decimals, as a count times 10**9 may leave 64 bits."""
    return f"1 + CAST((CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) DIV CAST({n} + 2 * {v} AS DECIMAL(20,0)) AS BIGINT)"


def f_of(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """p of a vector of counts."""
    below = total + 2 * v
    if (int(counts.max(initial=0)) + 2) * UNIT < 1 << 63:
        return 1 + UNIT * (counts + 2) // below
    return np.array([1 + UNIT * (int(c) + 2) // below for c in counts], I64)


def tiled(vectors: DataFrame, schema: str) -> DataFrame:
    """Rows of vectors sorted by lang, row, col, stride, chunk: for all pairs of sources that meet in a tile their
    values over a stride of chunks, to be added.

    A tile's groups come first (chunk -1, with their N and the language's V), then the vectors of its chunks.
    """
    import pyarrow as pa

    def finished(tile, groups, sums, seen):
        """The tile's pairs, from either side. On the diagonal both sides are one block."""
        (lang, row, col, stride), v = tile, groups[0][3]
        sides = [[k for k, g in enumerate(groups) if g[0] == b] for b in (row, col)]
        pairs = [(i, j) for i in sides[0] for j in sides[1] if row != col or i < j]
        if not pairs:
            return
        sums = np.zeros((len(groups), len(groups)), I64) if sums is None else sums
        none = np.array([int(shares(np.zeros(1, I64), g[2], v)[0]) if v else 1 for g in groups], I64)
        a, b = (np.array(x, I64) for x in zip(*pairs, strict=True))
        # Terms of chunks that nobody here has a vector for: the first stride adds all V terms, each takes off its own.
        value = sums[a, b] + ((0 if stride else v) - seen) * ((none[a] - none[b]) ** 2 // (none[a] + none[b]))
        names = [g[1] for g in groups]
        first, second = [names[i] for i in a], [names[j] for j in b]
        n = len(a)
        for x, y in ((first, second), (second, first)):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(x), pa.array(y), pa.array(value)], names=["lang", "source", "item", "value"])

    def add(sums, groups, place, row, col, held):
        """One chunk's part: held has source, positions and counts of the groups that have terms there."""
        if not held:
            return 0
        size, v = held[0][1], groups[0][3]
        dense = np.zeros((len(groups), size), I64)
        for source, _, positions, counts in held:
            dense[place[source], positions] = counts
        p = np.stack([shares(c, g[2], v) for c, g in zip(dense, groups, strict=True)])
        right = np.array([k for k, g in enumerate(groups) if g[0] == col], I64)
        for i, g in enumerate(groups):
            if g[0] == row:
                other = right[right > i] if row == col else right
                less = p[other] - p[i]
                sums[i, other] += (less * less // (p[other] + p[i])).sum(1)
        return size

    def run(batches):
        tile, chunk, groups, place, sums, seen, held = None, -1, [], {}, None, 0, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "row", "col", "stride", "chunk", "block", "source", "n", "v", "size")), strict=True)
            positions, counts = batch.column("positions"), batch.column("counts")
            for k, (lang, row, col, stride, at, block, source, n, v, size) in enumerate(keys):
                now = lang, row, col, stride
                if now != tile or at != chunk:
                    if held:
                        seen += add(sums, groups, place, tile[1], tile[2], held)
                        held = []
                    if now != tile:
                        if tile is not None:
                            yield from finished(tile, groups, sums, seen)
                        tile, groups, place, sums, seen = now, [], {}, None, 0
                    chunk = at
                if at < 0:
                    place[source] = len(groups)
                    groups.append((block, source, n, v))
                else:
                    if sums is None:
                        sums = np.zeros((len(groups), len(groups)), I64)
                    held.append((source, size, np.array(positions[k].values), np.array(counts[k].values)))
        if tile is not None:
            if held:
                seen += add(sums, groups, place, tile[1], tile[2], held)
            yield from finished(tile, groups, sums, seen)

    return vectors.mapInArrow(tidy(run), schema)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, stride: int = STRIDE) -> DataFrame:
    """lang, source, part, item, value, rank of all groups: pairs of sources, then the first terms of each."""
    spark = docs.sparkSession
    counts = stored(term_counts(docs), "terms")
    real = counts.filter("term IS NOT NULL")
    vocabulary = real.groupBy("lang", "term").agg(F.sum("tf").alias("in_lang"), F.sum("df").alias("df")).filter(F.col("df") >= least)
    size = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    # Every chunk numbers its own terms; it has about ``chunk`` of them, as terms are dealt by hash.
    # A language has more terms than a task should see, so its size goes to them by language and salt.
    spread = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = vocabulary.withColumn("salt", F.expr(f"CAST(pmod(xxhash64(term), {SALTS}) AS INT)"))
    numbered = salted.join(spread, ["lang", "salt"]).withColumn("chunk", F.expr(f"CAST(pmod(xxhash64(term), CAST(ceil(v / {chunk}) AS BIGINT)) AS INT)"))
    in_chunk = Window.partitionBy("lang", "chunk")
    numbered = numbered.withColumns({"position": F.row_number().over(in_chunk.orderBy("term")) - 1, "size": F.count("*").over(in_chunk)})
    numbered = stored(numbered.select("lang", "term", "in_lang", "lang_n", "v", "chunk", "position", "size"), "vocabulary")
    kept = stored(real.join(numbered, ["lang", "term"]).select("lang", "source", "term", "tf", "in_lang", "lang_n", "v", "chunk", "position", "size"), "kept")
    found = counts.filter("term IS NULL").select("lang", "source")
    per_lang = found.groupBy("lang").agg(F.count("*").alias("n_groups"))
    groups = found.join(kept.groupBy("lang", "source").agg(F.sum("tf").alias("n")), ["lang", "source"], "left")
    groups = groups.join(per_lang, "lang").join(size.select("lang", "v"), "lang", "left").fillna(0, ["n", "v"])
    groups = stored(groups.withColumns({"blocks": F.ceil(F.col("n_groups") / block).cast("int"), "block": F.expr(f"CAST(pmod(xxhash64(source), CAST(ceil(n_groups / {block}) AS BIGINT)) AS INT)")}), "groups")

    # part term: what a group has more often than its language
    terms = kept.join(groups.select("lang", "source", "n"), ["lang", "source"]).filter("tf > 0")
    terms = terms.select("lang", "source", F.col("term").alias("item"), F.expr(share("tf", "n", "v")).alias("p"), F.expr(share("in_lang", "lang_n", "v")).alias("q")).filter("p > q")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(f_of("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    # part pair: vectors to tiles
    packed = kept.groupBy("lang", "source", "chunk", "size").agg(F.collect_list("position").alias("positions"), F.collect_list("tf").alias("counts"))
    packed = packed.withColumn("stride", F.floor(F.col("chunk") / stride).cast("int"))
    strides = F.sequence(F.lit(0), F.greatest(F.ceil(F.ceil(F.col("v") / chunk) / stride).cast("int"), F.lit(1)) - 1)
    heads = groups.select("lang", "source", F.explode(strides).alias("stride"), F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("array<int>").alias("positions"), F.lit(None).cast("array<long>").alias("counts"))
    vectors = packed.unionByName(heads).join(groups.select("lang", "source", "n", "v", "blocks", "block"), ["lang", "source"])
    sent = vectors.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("lang", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "stride", "chunk", "block", "source", "n", "v", "size", "positions", "counts")
    dealt = sent.repartition(width(spark), "lang", "row", "col", "stride").sortWithinPartitions("lang", "row", "col", "stride", "chunk", "source")
    pairs = tiled(dealt, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return audit(table(spark, sf_dir, "documents"))


P_OF = "1 + ({unit} * (CAST({count} AS HUGEINT) + 2)) // (CAST({n} AS HUGEINT) + 2 * {v})"
ORACLE = rf"""WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT lang, source, row_number() OVER () AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
t AS (SELECT lang, source, doc, unnest(regexp_extract_all(low, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM w),
v AS (SELECT lang, term, count(*) AS in_lang FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST}),
s AS (SELECT lang, count(*) AS v, sum(in_lang) AS lang_n FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS tf FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(tf) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, in_lang, lang_n, v, coalesce(tf, 0) AS tf, {P_OF.format(unit=UNIT, count='coalesce(tf, 0)', n='n', v='v')} AS p FROM g JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT *, {P_OF.format(unit=UNIT, count='in_lang', n='lang_n', v='v')} AS q FROM p WHERE tf > 0),
m AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM q WHERE p > q),
a AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM m))
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM a WHERE part = 'pair' OR rank <= {TOP}"""
