"""Near-duplicate embeddings by a pivot-permutation index (op 7).

Method. A vector is described by its nearest reference points (pivots) in order of nearness, ``prefix`` of them.
Inverted lists hold, for every two pivots, the vectors that have both among their nearest, so two vectors meet
in a list exactly if they share ``SHARED`` = 2 pivots or more; a pair counts in the list of its two smallest
shared pivots only. Pairs that meet are verified by their cosine in double precision, ``SIMILAR`` or more.

Settings grow with the data: there are about 2 sqrt(n) pivots for n vectors (a power of two, ``LEAST_PIVOTS`` to
``MOST_PIVOTS``), so that lists stay short, and the prefix is the shortest that makes ``RECALL`` of simulated pairs
at exactly the threshold meet (pairs made from sampled vectors by a turn in a random direction); if ``LONGEST``
does not suffice, there are half as many pivots. Pivots are fitted on a bounded sample (``SAMPLE`` vectors for each
pivot, the first by a hash of the id among the vectors that can be linked; each pivot the farthest from those
before, so that a crowd of like vectors gives one). Every vector is indexed. Vectors of different lengths are
indexed apart. Measured recall against brute force: see the tests and the README.

Skew. Equal vectors are folded into one that stands for its number, and lists longer than ``CHUNK`` are cut into
chunks, every two chunks being compared in a task of their own; pairs are counted where they are found and
never leave as rows, only each vector's number of links and the edges of a spanning forest do.

Cases: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing and form
their own component; equal vectors are linked like others; an empty table gives an empty result; vec_id is a key
(rows that repeat one with their vector link with each other, a null one is returned without links); further
columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import by_key, components, discard, stored, table, tidy, width

SHARED = 2
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192
SAMPLE = 4
RECALL = 0.995
LONGEST = 16
TURNS = 4000
SIMILAR = 0.9
CHUNK = 512
TINY = 16
FEW = 50_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision and unit length (no zero rows)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(column: str = "embedding"):
    """Whether a vector can be linked."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(column) > 0) & finite & F.exists(column, lambda v: v != 0), F.lit(False))


def farthest(x: np.ndarray, count: int) -> np.ndarray:
    """So many of the rows, each the farthest from those before."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        k = int(np.argmin(near))
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    return x[chosen]


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each row's nearest pivots, by rising number."""
    far = -(x @ pivots.T)
    if prefix < pivots.shape[0]:
        far = np.argpartition(far, prefix - 1, axis=1)[:, :prefix]
        return np.sort(far, axis=1)
    return np.broadcast_to(np.arange(len(pivots)), (len(x), len(pivots))).copy()


def shortest_prefix(x: np.ndarray, pivots: np.ndarray, similar: float, recall: float = RECALL) -> int | None:
    """The shortest prefix by which pairs at the threshold meet often enough; None if LONGEST does not do."""
    if len(pivots) <= SHARED or x.shape[1] < 2:
        return min(len(pivots), SHARED)
    r = np.random.default_rng(0)
    a = x[r.integers(0, len(x), TURNS)]
    turn = r.normal(size=a.shape)
    turn -= (turn * a).sum(1)[:, None] * a
    b = similar * a + (1 - similar**2) ** 0.5 * turn / np.sqrt((turn * turn).sum(1))[:, None]
    most = min(LONGEST, len(pivots))
    na, nb = (np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :most] for v in (a, b))
    for prefix in range(SHARED, most + 1):
        both = (na[:, :prefix, None] == nb[:, None, :prefix]).sum((1, 2))
        if (both >= SHARED).mean() >= recall:
            return prefix
    return most if most == len(pivots) else None


def choose_pivots(x: np.ndarray, count: int, similar: float) -> tuple[np.ndarray, int]:
    """Pivots from a sample of unit vectors, and the prefix that goes with them."""
    while True:
        pivots = farthest(x, count)
        prefix = shortest_prefix(x, pivots, similar)
        if prefix is not None:
            return pivots, prefix
        count //= 2


def wanted_pivots(n: int) -> int:
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(2 * max(n, 1) ** 0.5)))))


def forest(links: np.ndarray) -> np.ndarray:
    """Smallest row number that each row reaches by links (a square matrix of booleans)."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(1, initial=len(links)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def meet(batches, similar: float, kind: str):
    """Sorted by list and chunks: counts of links (v null) and edges."""
    import pyarrow as pa

    names = ["dim", "key", "ci", "cj", "chunk", "vec_id", "weight"]

    def out(u, v, n):
        none = np.asarray(n) > 0
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64), mask=none), pa.array(np.asarray(n, np.int64))], names=["u", "v", "n"])

    def groups():
        held = None
        for batch in batches:
            now = [np.array(batch.column(c)) for c in names] + [batch.column(c).to_numpy(zero_copy_only=False) for c in ("near", "vec")]
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            new = np.ones(len(now[0]), bool)
            new[1:] = False
            for c in now[:4]:
                new[1:] |= c[1:] != c[:-1]
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield [x[:cut] for x in now], np.flatnonzero(new[:cut])
            held = [x[cut:] for x in now]
        if held is not None:
            yield held, np.zeros(1, np.int64)

    for (dim, key, ci, cj, chunk, ids, weight, near, vec), heads in groups():
        size = np.diff(np.concatenate([heads, [len(key)]]))
        split = ci[heads] != cj[heads]
        for d, m in np.unique(np.stack([dim[heads], size], 1)[size > 1], axis=0):
            which = np.flatnonzero((size == m) & (dim[heads] == d))
            step = max(1, 65_536 // (m * m))
            for a in range(0, len(which), step):
                g = which[a : a + step]
                rows = heads[g][:, None] + np.arange(m)
                flat = rows.ravel()
                x = unit(np.frombuffer(b"".join(vec[flat]), kind).reshape(len(flat), -1)).reshape(len(g), m, -1)
                here = (x @ x.transpose(0, 2, 1) >= similar) & ~np.eye(m, dtype=bool)
                if split[g].any():  # two chunks: only pairs across
                    c = chunk[rows]
                    here &= ~split[g][:, None, None] | (c[:, :, None] != c[:, None, :])
                gi, i, j = np.nonzero(here)
                if not len(gi):
                    continue
                # Of a pair's shared pivots the list's own must be the smallest ones.
                low = np.frombuffer(b"".join(near[flat]), "<i4").reshape(len(g), m, -1)
                first, last = key[heads[g]] >> 20, key[heads[g]] & 0xFFFFF
                low = np.where((low < last[:, None, None]) & (low != first[:, None, None]), low, -1)
                for at in range(0, len(gi), 100_000):
                    s = slice(at, at + 100_000)
                    p, q = low[gi[s], i[s]], low[gi[s], j[s]]
                    here[gi[s], i[s], j[s]] = ~((p[:, :, None] == q[:, None, :]) & (p[:, :, None] >= 0)).any((1, 2))
                n = (here * weight[rows][:, None, :]).sum(2)
                linked = n > 0
                if not linked.any():
                    continue
                yield out(ids[rows][linked], np.zeros(linked.sum()), n[linked])
                if m <= TINY:
                    gi, i, j = np.nonzero(here)
                    keep = i < j
                    yield out(ids[rows[gi[keep], i[keep]]], ids[rows[gi[keep], j[keep]]], np.zeros(keep.sum()))
                else:
                    for k in range(len(g)):
                        label = forest(here[k])
                        i = np.flatnonzero(label != np.arange(m))
                        yield out(ids[rows[k, i]], ids[rows[k, label[i]]], np.zeros(len(i)))


def fitted(known: DataFrame, pivots: int | None, similar: float) -> dict[int, tuple[np.ndarray, int]]:
    """By length: pivots and prefix. Reaching the driver: each length's count and its bounded sample."""
    counts = {r["dim"]: r["n"] for r in known.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in sorted(counts.items()):
        count = pivots or wanted_pivots(n)
        rows = known.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * count).select("embedding").collect()
        out[dim] = choose_pivots(unit(np.array([r["embedding"] for r in rows], np.float64)), count, similar)
    return out


def near_vectors(embeddings: DataFrame, pivots: int | None = None, similar: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    import pyarrow as pa

    spark = embeddings.sparkSession
    wide = embeddings.schema["embedding"].dataType.elementType == T.DoubleType()
    kind = "<f8" if wide else "<f4"
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>" if wide else "array<float>"))
    # Equal vectors have equal keys of 128 bits; one of them stands for all.
    same = F.concat(F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64(F.lit("second"), "embedding")))
    valid = stored(rows.filter(F.col("vec_id").isNotNull() & usable()).withColumn("same", same), "vectors")
    known = valid.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    known = stored(known, "distinct-vectors")
    points = fitted(known, pivots, similar)
    if not points:
        discard(valid, known)
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def describe(batches):
        names = ["vec_id", "weight", "dim", "p", "near", "vec"]
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for a in range(0, part.num_rows, 1000):
                    some = part.slice(a, 1000)
                    raw = np.array(some.column("embedding").flatten()).astype(kind).reshape(some.num_rows, dim)
                    near = nearest(unit(raw), *points[dim]).astype("<i4")
                    binary = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (near, raw)]
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("weight"), some.column("dim"), pa.array(near.astype(np.int64).tolist(), pa.list_(pa.int64())), *binary], names=names)

    # The numbers of a vector's pivots are stored once; lists are made of them by expressions.
    described = stored(known.select("vec_id", "weight", "dim", "embedding").mapInArrow(tidy(describe), "vec_id long, weight long, dim int, p array<long>, near binary, vec binary"), "described")
    pairs = F.flatten(F.transform(F.col("p"), lambda x, i: F.transform(F.filter(F.col("p"), lambda y: y > x), lambda y: F.shiftleft(x, 20) + y)))
    single = F.transform(F.col("p"), lambda x: F.shiftleft(x, 20) + x)
    keyed = described.withColumn("key", F.explode(F.when(F.size("p") > 1, pairs).otherwise(single))).drop("p")
    big = stored(keyed.groupBy("dim", "key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select("dim", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "long-lists")
    if big.count() <= FEW:
        big = F.broadcast(big)
    parts = F.coalesce("parts", F.lit(1))
    chunked = keyed.join(big, ["dim", "key"], "left").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    dealt = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select("dim", "key", F.least("chunk", "other").cast("int").alias("ci"), F.greatest("chunk", "other").cast("int").alias("cj"), "chunk", "vec_id", "weight", "near", "vec")
    order = ["dim", "key", "ci", "cj"]
    found = stored(dealt.repartition(width(spark), *order).sortWithinPartitions(*order, "vec_id").mapInArrow(tidy(lambda b: meet(b, similar, kind)), "u long, v long, n long"), "links")
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("v IS NOT NULL").select("u", "v"))
    each = known.select("same", "vec_id", F.col("weight").alias("n")).join(counts.withColumnRenamed("n", "links"), "vec_id", "left").join(roots.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left")
    each = stored(each.select("same", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")), "classes")
    linked = by_key(valid.select("vec_id", "same"), each, "same", valid.count()).select("vec_id", "n_links", "component_id")
    rest = rows.filter(F.col("vec_id").isNull() | ~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
