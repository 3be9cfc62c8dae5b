"""Near-duplicate documents by BagMinHash (op 2).

A document is the multiset of its ``SHINGLE``-word shingles (fewer words: all of them as one shingle); two
documents are linked when their weighted Jaccard similarity (sum of minima over sum of maxima of the
counts) is ``SIMILAR`` or more. Every connected group of links keeps its smallest doc_id.

Method. Counts are discretised weights: the levels (0,1], (1,2], (2,4], (4,8] ... Each shingle has a Poisson
process per level interval, its rate the interval's length; a point carries a register and a level inside
its interval, found by halving it, and counts if the level is at most the shingle's count. A register keeps
its earliest point, so two documents agree in a register with probability equal to their weighted Jaccard
similarity. Processes stop as soon as their next point comes later than every register's, which makes
signatures of long texts cost about one point for each shingle. ``BANDS`` bands of ``ROWS_PER_BAND``
registers bring candidates together: 0.8 meets with probability 1 - (1 - 0.8**4)**16 = 0.9998.

Skew. Equal texts are folded into one class first, whose id reaches its members by a join in which keys with a
share of 1/4096 of all rows or more (4096 keys at most) are broadcast. In a bucket of any size each class is compared with the
bucket's smallest one only (a star); links that are verified on whole multisets give components. Where a
bucket still holds several components, the classes outside its largest one are compared with all of the
bucket, chunk by chunk: a task takes ``CHUNK`` of either, counts the overlaps of all their pairs exactly
and sends a spanning forest of the links. So no link that changes a component is lost, no pairs leave a
task, and no task holds more than two chunks.

Cases: null text counts as empty; empty texts (no words) are linked with equal texts only; texts of any
length are one row (memory per Arrow batch); an empty table gives an empty result; a row with a null doc_id
is not compared; every input row gives one output row: repeated rows get equal results, rows with one doc_id
and different texts each their own text's class; further columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import PORTION, Prefix, binary_views, by_key, components, discard, mix64, portions, ragged, stored, table, tidy, width, words_of

SHINGLE = 5
SIMILAR = 0.8
BANDS = 16
ROWS_PER_BAND = 4
REGISTERS = BANDS * ROWS_PER_BAND
CHUNK = 512
SLICE = 2048
U64 = np.uint64


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts laid end to end: text number, hash, count; sorted by text and hash."""
    s, e, doc = words_of(data, bounds)
    z = np.zeros(0, np.int64)
    if not len(s):
        return z, z.astype(U64), z
    word = Prefix(data).spans(s, e)
    n_docs = len(bounds) - 1
    per = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(per) - per
    count = np.where(per >= size, per - size + 1, np.minimum(per, 1))
    start = ragged(first, count).astype(np.int64)
    owner = np.repeat(np.arange(n_docs), count)
    length = np.minimum(per, size)[owner]
    h = np.zeros(len(start), U64)
    for k in range(size):
        live = length > k
        at = np.minimum(start + k, len(word) - 1)
        h = np.where(live, mix64(h * U64(0x9E3779B97F4A7C15) + word[at]), h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], h[heads], np.diff(np.concatenate([heads, [len(h)]]))


def bag_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Earliest points: n_docs x REGISTERS doubles (infinite where a document has no shingle)."""
    registers = np.full(n_docs * REGISTERS, np.inf)
    if not len(h):
        return registers.reshape(n_docs, REGISTERS)
    # A process for each interval of levels that the weight reaches into: (0,1], (1,2], (2,4], ...
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    item = np.repeat(np.arange(len(h)), levels)
    j = ragged(np.zeros(len(h), np.int64), levels).astype(np.int64)
    low = np.where(j > 0, 1 << np.maximum(j - 1, 0), 0)
    span = np.where(j > 0, low, 1)
    own, w = doc[item], weight[item]
    seed = mix64(h[item] + (j.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03))
    time = np.zeros(len(item))
    k = 0
    while len(own):
        k += 1
        a = mix64(seed + U64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((a >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53) / span
        worst = registers.reshape(n_docs, REGISTERS).max(1)
        go = time < worst[own]
        if not go.all():
            own, w, seed, time, low, span, a = (x[go] for x in (own, w, seed, time, low, span, a))
        b = mix64(a ^ U64(0xA0761D6478BD642F))
        level = low + 1 + ((b >> U64(32)).astype(np.int64) * span >> 32)  # the bits halve the interval down to a level
        hit = level <= w
        np.minimum.at(registers, own[hit] * REGISTERS + (b[hit] & U64(REGISTERS - 1)).astype(np.int64), time[hit])
    return registers.reshape(n_docs, REGISTERS)


def text_key(text="text"):
    """What equal texts share: the first 16 bytes of their SHA-256 (null: as empty)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), signature (64 x 32 bits; null without words); one map."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in portions(batch.column("text")):
                doc, h, weight = shingles(data, bounds)
                times = bag_min_hash(doc, h, weight, j - i)
                bits = (mix64(times.view(U64)) >> U64(32)).astype("<u4")
                empty = np.isinf(times[:, 0])
                raw = pa.Array.from_buffers(pa.binary(4 * REGISTERS), j - i, [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pc.if_else(pa.array(empty), None, raw)], names=["doc_id", "key", "signature"])

    import pyarrow.compute as pc

    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(tidy(run), "doc_id long, key binary, signature binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose weighted Jaccard similarity is SIMILAR or more."""
    import pyarrow as pa

    def bags(column):
        data, bounds = binary_views(column)
        return shingles(data, bounds)

    def run(batches):
        for batch in batches:
            left, right = batch.column("a"), batch.column("b")
            size = np.cumsum(np.diff(binary_views(left)[1]) + np.diff(binary_views(right)[1]))
            i = 0
            while i < len(size):  # pairs whose texts, of both sides, stay within a portion
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PORTION, side="right")))
                n = j - i
                d1, h1, w1 = bags(left.slice(i, n))
                d2, h2, w2 = bags(right.slice(i, n))
                total = np.bincount(d1, w1, n) + np.bincount(d2, w2, n)
                d, h, w = np.concatenate([d1, d2]), np.concatenate([h1, h2]), np.concatenate([w1, w2])
                order = np.lexsort((h, d))
                d, h, w = d[order], h[order], w[order]
                same = np.flatnonzero((d[1:] == d[:-1]) & (h[1:] == h[:-1]))
                both = np.bincount(d[same], np.minimum(w[same], w[same + 1]), n)
                good = (both >= SIMILAR * (total - both) - 1e-9) & (both > 0)
                part = batch.slice(i, n).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"])
                i = j

    a = texts.select(F.col("key").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("key").alias("v"), F.col("text").alias("b"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(tidy(run), "u binary, v binary")


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """u and its shingles as a binary of 64-bit hashes, the k-th copy of a shingle being another element."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in portions(batch.column("text")):
                doc, h, weight = shingles(data, bounds)
                copy = ragged(np.zeros(len(h), np.int64), weight).astype(U64)
                elements = mix64(np.repeat(h, weight) + copy * U64(0xD6E8FEB86659FD93))
                ends = np.cumsum(np.bincount(np.repeat(doc, weight), minlength=j - i))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array([elements[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], names=["u", "elements"])

    return stored(texts.join(wanted.select(F.col("u").alias("key")).distinct(), "key", "left_semi").select("key", "text").mapInArrow(tidy(run), "u binary, elements binary"), "sets")


def linked_in_blocks(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges that join components: in every bucket, chunks of what is outside its main component against all chunks.

    mixed: u, bucket, root, main, pa, pb (numbers of chunks). A task holds two chunks; overlaps of all their
    pairs are counted exactly there and leave as a spanning forest, so no pairs are exchanged.
    """
    rows = mixed.join(sets, "u")
    whole = F.pmod(F.xxhash64("u"), F.col("pb")).cast("int")
    part = F.pmod(F.xxhash64("u", F.lit(1)), F.col("pa")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = rows.filter("root <> main").select("bucket", part.alias("ca"), every("pb").alias("cb"), F.lit(0).alias("side"), "u", "root", "elements")
    all_rows = rows.select("bucket", every("pa").alias("ca"), whole.alias("cb"), F.lit(1).alias("side"), "u", "root", "elements")
    dealt = out.unionByName(all_rows).repartition(width(mixed.sparkSession), "bucket", "ca", "cb").sortWithinPartitions("bucket", "ca", "cb", "side", "u")
    return dealt.mapInArrow(tidy(block_links), "u binary, v binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair shares, by products of 0/1 matrices over slices of the shared elements."""
    a, b = np.concatenate(left), np.concatenate(right)
    ia, ib = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right))
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    pa, pb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ka, kb = shared[np.minimum(pa, len(shared) - 1)] == a, shared[np.minimum(pb, len(shared) - 1)] == b
    ia, pa, ib, pb = ia[ka], pa[ka], ib[kb], pb[kb]
    order_a, order_b = np.argsort(pa, kind="stable"), np.argsort(pb, kind="stable")
    ia, pa, ib, pb = ia[order_a], pa[order_a], ib[order_b], pb[order_b]
    for at in range(0, len(shared), SLICE):
        x0, x1 = np.searchsorted(pa, [at, at + SLICE])
        y0, y1 = np.searchsorted(pb, [at, at + SLICE])
        n = min(SLICE, len(shared) - at)
        x, y = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        x[ia[x0:x1], pa[x0:x1] - at] = 1
        y[ib[y0:y1], pb[y0:y1] - at] = 1
        out += x @ y.T
    return out


def block_links(batches):
    """Sorted by bucket, chunks and side: the edges of a forest over the links between components."""
    import pyarrow as pa

    from docquarry.llm.pivots import forest

    def of(rows):
        left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        if not left or not right:
            return None
        sets = [[np.frombuffer(r[3], U64) for r in side] for side in (left, right)]
        both = overlaps(*sets)
        total = np.add.outer([len(x) for x in sets[0]], [len(x) for x in sets[1]])
        apart = np.not_equal.outer([r[2] for r in left], [r[2] for r in right])
        good = apart & (both > 0) & (both >= SIMILAR * (total - both) - 1e-6)
        if not good.any():
            return None
        n = len(left) + len(right)
        links = np.zeros((n, n), bool)
        links[: len(left), len(left) :] = good
        links[len(left) :, : len(left)] = good.T
        label = forest(links)
        i = np.flatnonzero(label != np.arange(n))
        ids = [r[1] for r in left + right]
        return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in i], pa.binary()), pa.array([ids[label[k]] for k in i], pa.binary())], names=["u", "v"])

    key, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "ca", "cb", "side", "u", "root", "elements")]
        for *k, side, u, root, elements in zip(*columns, strict=True):
            if k != key:
                if rows and (found := of(rows)) is not None:
                    yield found
                key, rows = k, []
            rows.append((side, u, root, elements))
    if rows and (found := of(rows)) is not None:
        yield found


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signed (doc_id, key: a row for each row with an id), texts' classes (key, rep: its smallest doc_id; n)
    and what links join (key, root: the smallest key that links reach)."""
    signed = stored(signatures(docs), "signatures")
    firsts = stored(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.count("*").alias("n")), "classes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * 4 * ROWS_PER_BAND + 1, F.lit(4 * ROWS_PER_BAND))))
    placed = stored(firsts.filter("signature IS NOT NULL").select(F.col("key").alias("u"), F.explode(bands).alias("bucket")), "bands")
    hubs = stored(placed.groupBy("bucket").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    crowd = stored(by_key(placed, hubs, "bucket", placed.count()), "buckets")  # u, bucket, v: buckets of two and more
    discard(placed, hubs)
    pairs = stored(crowd.filter("u <> v").select("u", "v").distinct(), "pairs")
    wanted = firsts.join(crowd.select(F.col("u").alias("key")).distinct(), "key", "left_semi").select("key", F.col("rep").alias("doc_id"))
    # A text's own row is the one with its class's smallest id and its key; repeated rows count once.
    texts = docs.join(wanted.withColumnRenamed("key", "own"), "doc_id").filter(text_key() == F.col("own")).select(F.col("own").alias("key"), "text").dropDuplicates(["key"])
    texts = stored(texts, "texts")
    links = stored(verified(pairs, texts), "links")
    discard(pairs)
    roots = components(links)

    # What a star leaves apart: buckets that still hold several components.
    placed = crowd.select("u", "bucket").join(roots.select(F.col("node").alias("u"), "root"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    per = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    most = per.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    most = most.select("bucket", F.col("most.root").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / CHUNK).cast("int").alias("pa"), F.ceil(F.col("n") / CHUNK).cast("int").alias("pb"), "n")
    most = stored(most, "several")
    mixed = stored(by_key(placed, most, "bucket", crowd.count()), "mixed")
    if not mixed.isEmpty():
        sets = shingle_sets(texts, mixed)
        more = stored(linked_in_blocks(mixed, sets), "links")
        discard(sets)
        discard(roots)
        roots = components(links.unionByName(more))
        discard(more)
    discard(crowd, texts, links, most, mixed)
    return signed.select("doc_id", "key"), firsts.select("key", "rep", "n"), roots.select(F.col("node").alias("key"), "root")


def class_table(firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """key, rep, n, class_id and winner (the key of the text that stays) for each distinct text.

    A class's members are pre-aggregated; only texts that have a link take part in the exchange by class.
    """
    linked = stored(firsts.join(roots, "key"), "linked")
    heads = stored(linked.groupBy("root").agg(F.min(F.struct("rep", "key")).alias("head"), F.count("*").alias("n")), "heads")
    own = by_key(linked.withColumnRenamed("n", "rows"), heads, "root", linked.count()).select("key", "rep", F.col("rows").alias("n"), F.col("head.rep").alias("class_id"), F.col("head.key").alias("winner"))
    alone = firsts.join(roots, "key", "left_anti").select("key", "rep", "n", F.col("rep").alias("class_id"), F.col("key").alias("winner"))
    return own.unionByName(alone)


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, class_id, winner for every row with an id, and the rows without one."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    signed, firsts, roots = text_classes(docs.filter("doc_id IS NOT NULL"))
    table_of = stored(class_table(firsts, roots).drop("rep"), "class-table")
    return by_key(signed, table_of, "key", signed.count()), docs.filter("doc_id IS NULL")


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its group): a row for each input row; a null id has a null class."""
    found, without = classified(docs)
    return found.select("doc_id", "class_id").unionByName(without.select("doc_id", F.lit(None).cast("long").alias("class_id")))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, kept (it has its class's smallest id; rows without an id stay)."""
    return duplicate_classes(table(spark, sf_dir, "documents")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
