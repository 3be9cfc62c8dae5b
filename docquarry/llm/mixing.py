"""Mixing sources to target weights by Pfair scheduling (op 5); DataFrame and SQL functions only.

Method. Every source gets an integer share q of a period of W slots (its target weight is q / W). Its k-th
block (k from 0) is released at slot floor(k W / q) and due before slot ceil((k+1) W / q). In each slot the
released block with the earliest deadline goes (ties: first source by name). As the shares fill the period
exactly, no deadline is missed, and after any number of slots each source has had its weight's number of
blocks to within less than one. The schedule repeats after W slots, so it is computed once for W slots by a
fold over a sequence, and is a table of W rows, a bound that does not depend on the data.

A source's documents are numbered in the order of md5(doc_id), which shuffles them; ``block_docs`` of them
make a block. Numbers come from counts per (source, leading digits of the md5), so that no source, however
large, is sorted in one task. Every document gets a place; none is dropped or repeated. A source that has no
more blocks leaves its slots empty; the others keep their order. The deviation bound holds up to the slot
where the first source ends.

Default target weights: in proportion to the whole square root of a source's number of documents, which
lifts small sources; explicit weights can be given. W is ``period``, or 8 slots for each source if more.

Cases: a null source counts as the source named ''; ties and repeated rows: rows with equal doc_id of one
source stand side by side in any order; an empty table gives an empty result; a source without a given
weight gets one slot a period; further columns may be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import stored, table

PERIOD = 1000
PER_SOURCE = 8
BLOCK_DOCS = 1
BUCKET_ROWS = 1_000
DIGITS = 5  # at most 16**5 buckets a source
COLUMNS = ("doc_id", "source", "block", "release", "deadline", "slot", "place")


def shares(sizes: DataFrame, period: int, weights: dict[str, int] | None) -> DataFrame:
    """One row: sources by name, their slots in a period (at least 1 each, W in all) and W."""
    if weights is None:
        weight: Column = F.greatest(F.floor(F.sqrt("docs")), F.lit(1))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))]) if weights else F.lit(None)
        weight = F.coalesce(F.element_at(given, F.col("source")), F.lit(0)) if weights else F.lit(0)
    # A row for each source: the list of sources is the parameter's size.
    rows = sizes.select("source", weight.cast("long").alias("weight"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("s")).select("s", F.greatest(F.lit(period), F.size("s") * PER_SOURCE).cast("long").alias("w"))
    total = F.greatest(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["weight"]), F.lit(1))
    free = F.col("w") - F.size("s")
    one = one.select("s", "w", total.alias("total"), free.alias("free"))
    base = F.transform("s", lambda x, i: F.struct(F.expr("0L").alias("zero"), i.alias("i"), (F.lit(1) + F.floor(x["weight"] * F.col("free") / F.col("total"))).cast("long").alias("q"), (x["weight"] * F.col("free") % F.col("total")).alias("rest")))
    one = one.withColumn("b", base).withColumn("left", F.col("w") - F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["q"]))
    ranked = F.array_sort(F.transform("b", lambda x: F.struct((-x["rest"]).alias("r"), x["i"].alias("i"))))
    one = one.withColumn("extra", F.transform(F.slice(ranked, 1, F.greatest(F.col("left"), F.lit(0)).cast("int")), lambda x: x["i"]))
    q = F.transform("b", lambda x: x["q"] + F.when(F.array_contains("extra", x["i"]), 1).otherwise(0))
    # What is left beyond one more for each source (all weights zero) goes to the first.
    spare = F.greatest(F.col("left") - F.size("s"), F.lit(0))
    q = F.transform(q, lambda x, i: x + F.when(i == 0, spare).otherwise(0))
    return one.select(F.transform("s", lambda x: x["source"]).alias("names"), q.alias("q"), "w")


#: Earliest deadline first among what is released: a fold over the slots of a period.
SCHEDULE = """
aggregate(
  sequence(0L, w - 1),
  named_struct('c', transform(q, x -> 0L), 'picks', cast(array() as array<int>)),
  (s, t) -> named_struct(
    'c', transform(s.c, (n, i) -> n + if(i = {pick}, 1L, 0L)),
    'picks', concat(s.picks, array({pick}))),
  s -> s.picks)
""".replace(
    "{pick}",
    "array_min(filter(transform(s.c, (m, j) -> named_struct('due', ceil((m + 1) * w / q[j]), 'j', j, 'free', (m * w) div q[j] <= t)), y -> y.free)).j",
)


def schedule(spread: DataFrame) -> DataFrame:
    """W rows: source, nth (its block within a period), at (slot), q, w."""
    slots = spread.filter("size(names) > 0").select("names", "q", "w", F.expr(SCHEDULE).alias("picks")).select("names", "q", "w", F.posexplode("picks").alias("at", "pick"))
    own = Window.partitionBy("pick").orderBy("at")
    return slots.select(F.element_at("names", F.col("pick") + 1).alias("source"), (F.row_number().over(own) - 1).cast("long").alias("nth"), F.col("at").cast("long").alias("at"), F.element_at("q", F.col("pick") + 1).alias("q"), "w")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, period: int = PERIOD, block_docs: int = BLOCK_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, source, block, release, deadline, slot, place (the order) and the kept columns."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), *[c for c in keep if c not in ("doc_id", "source")])
    sizes = rows.groupBy("source").agg(F.count("*").alias("docs"))
    total = docs.select("doc_id").count()
    digits = 0
    while digits < DIGITS and 16**digits * BUCKET_ROWS < total:
        digits += 1
    keyed = rows.withColumn("key", F.md5(F.col("doc_id").cast("string").cast("binary")))
    keyed = keyed.withColumn("bucket", F.coalesce(F.substring("key", 1, digits), F.lit("")))
    counts = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id")
    numbered = keyed.withColumn("n", F.row_number().over(inside) - 1).join(offsets, ["source", "bucket"]).withColumn("n", F.col("n") + F.col("offset"))
    blocks = numbered.withColumn("block", F.floor(F.col("n") / block_docs).cast("long")).withColumn("inside", F.col("n") % block_docs)
    # Both are written first: else every use of a share inside the fold would compute all shares again.
    spread = stored(shares(sizes, period, weights), "shares")
    # A period's slots: at most max(period, 8 slots for each source) rows.
    slots = F.broadcast(stored(schedule(spread), "schedule"))
    step = slots.select("source", "nth", "at").withColumnsRenamed({"source": "s2", "nth": "n2"})
    share = F.broadcast(schedule_shares(spread))
    placed = blocks.join(share, "source").withColumn("nth", F.col("block") % F.col("q"))
    placed = placed.join(step, (placed["source"] == step["s2"]) & (placed["nth"] == step["n2"]))
    slot = (F.floor(F.col("block") / F.col("q")) * F.col("w") + F.col("at")).cast("long")
    return placed.select(
        "doc_id",
        "source",
        "block",
        F.expr("(block * w) div q").alias("release"),
        F.expr("((block + 1) * w + q - 1) div q").alias("deadline"),
        slot.alias("slot"),
        (slot * block_docs + F.col("inside")).cast("long").alias("place"),
        *[c for c in keep if c not in ("doc_id", "source")],
    )


def schedule_shares(spread: DataFrame) -> DataFrame:
    """source, q, w: a row for each source."""
    return spread.select(F.explode(F.arrays_zip("names", "q")).alias("x"), "w").select(F.col("x.names").alias("source"), F.col("x.q").alias("q"), "w")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its block, release, deadline, slot and place in the mixture."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE n AS (
  SELECT coalesce(source, '') AS source, count(*) AS docs FROM documents GROUP BY 1
), r AS (
  SELECT source, greatest(CAST(floor(sqrt(docs)) AS BIGINT), 1) AS weight,
         row_number() OVER (ORDER BY source) - 1 AS i FROM n
), t AS (
  SELECT CAST(sum(weight) AS BIGINT) AS total, count(*) AS k, greatest({PERIOD}, count(*) * {PER_SOURCE}) AS w FROM r
), b AS (
  SELECT source, i, w, 1 + (weight * (w - k)) // total AS q, (weight * (w - k)) % total AS rest FROM r, t
), e AS (
  SELECT *, row_number() OVER (ORDER BY rest DESC, i) AS rank, w - CAST(sum(q) OVER () AS BIGINT) AS spare FROM b
), f AS (
  SELECT source, i, w, CAST(q + CASE WHEN rank <= spare THEN 1 ELSE 0 END AS BIGINT) AS q FROM e
), l AS (
  SELECT list(q ORDER BY i) AS q, list(source ORDER BY i) AS names, max(w) AS w FROM f
), s AS (
  SELECT CAST(-1 AS BIGINT) AS tick, CAST(-1 AS BIGINT) AS pick, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS c FROM l
  UNION ALL
  SELECT tick, pick, list_transform(c, lambda x, j: CASE WHEN j - 1 = pick THEN x + 1 ELSE x END)
  FROM (
    SELECT s.tick + 1 AS tick, s.c,
           CAST(list_min(list_filter(list_transform(s.c, lambda m, j:
             CASE WHEN (m * l.w) // l.q[j] <= s.tick + 1 THEN (((m + 1) * l.w + l.q[j] - 1) // l.q[j]) * 1000000 + j - 1 END),
             lambda y: y IS NOT NULL)) % 1000000 AS BIGINT) AS pick
    FROM s, l WHERE s.tick + 1 < l.w
  )
), p AS (
  SELECT l.names[pick + 1] AS source, tick, row_number() OVER (PARTITION BY pick ORDER BY tick) - 1 AS nth FROM s, l WHERE tick >= 0
), d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // {BLOCK_DOCS} AS block,
         (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % {BLOCK_DOCS} AS inside
  FROM documents
)
SELECT d.doc_id, d.source, CAST(d.block AS BIGINT) AS block,
       CAST((d.block * f.w) // f.q AS BIGINT) AS release,
       CAST(((d.block + 1) * f.w + f.q - 1) // f.q AS BIGINT) AS deadline,
       CAST((d.block // f.q) * f.w + p.tick AS BIGINT) AS slot,
       CAST(((d.block // f.q) * f.w + p.tick) * {BLOCK_DOCS} + d.inside AS BIGINT) AS place
FROM d JOIN f USING (source) JOIN p ON p.source = d.source AND p.nth = d.block % f.q
"""
