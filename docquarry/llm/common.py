"""What the training-data operators share: tables, shared folders, byte-level numpy helpers, components.

Shared folders: everything that one task writes and another reads goes below the folder that the
cluster names in ``spark.checkpoint.dir``; where that is unset on a cluster, it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
PORTION = 1 << 20
HOT = 4096


BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def lean(spark: SparkSession) -> None:
    """Small Arrow batches for the session, unless it has another size than Spark's own: a batch stands in the
    JVM's direct memory and in the worker at once, and neither gives back what a large one took."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to be able to read."""
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A machine-local one would lose data, so none is made up.

    On ``local`` masters, where there is no other machine, a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docquarry.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("docquarry.shared.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    lean(spark)
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes the frame to the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Removes the files of frames from ``stored`` when nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def tidy(run):
    """A map over Arrow batches that gives memory back to the system at a task's end, as Python workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def width(spark: SparkSession) -> int:
    """Partitions for an exchange: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit words (multiply and xor-shift rounds)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


_powers: dict[int, np.ndarray] = {}


def powers_of(base: int, n: int) -> np.ndarray:
    """The first n powers; one table for each base is kept, of two million entries at most."""
    if n > 1 << 21:
        return powers(base, n)
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = _powers[base] = powers(base, 1 << max(12, int(n - 1).bit_length()))
    return found[:n]


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Prefix:
    """Hashes of any spans of one byte string in O(1) each: sums of byte * BASE**i, scaled back."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        n = len(data)
        spread = mix64(np.arange(256, dtype=U64) + U64(0x1234567 + 977 * salt))
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(spread[data] * powers_of(BASE, n), out=self.sum[1:])
        self.back = powers_of(INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sum[end] - self.sum[start]) * self.back[start] + (end - start).astype(U64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, .. for each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    kind = np.int32 if total < 1 << 30 and (len(starts) == 0 or int(starts.max()) < 1 << 30) else np.int64
    shift = (starts - (np.cumsum(lengths) - lengths)).astype(kind)
    return np.arange(total, dtype=kind) + np.repeat(shift, lengths)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of texts laid end to end: starts, ends, text numbers.

    bounds: n+1 offsets of the texts in data. A word never crosses a text's border.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    begins[edge] |= solid[edge]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    stops[last] |= solid[last]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return s, e, np.searchsorted(bounds, s, side="right") - 1


def binary_views(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 bounds of an Arrow string or binary array (null: empty), without copying texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = column.type
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else b"")
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def portions(column, most: int = PORTION):
    """Rows of a text column in portions of about so many bytes: first row, last row, bytes, bounds."""
    data, bounds = binary_views(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def by_key(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to groups (one row for each key, ``n`` its number of rows), no key being one task's burden.

    Keys with a ``HOT``-th of all rows or more are ``HOT`` at most; they are named in the plan, and their groups are
    broadcast. The rows of the others are joined by an exchange. Without such keys it is a plain join.
    """
    hot = [r[0] for r in groups.filter(F.col("n") * HOT >= total).select(key).collect()]  # HOT keys at most
    groups = groups.drop("n")
    if not hot:
        return rows.join(groups, key)
    many = F.col(key).isin(hot)
    return rows.filter(many).join(F.broadcast(groups.filter(many)), key).unionByName(rows.filter(~many).join(groups.filter(~many), key))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(u, v)``: returns ``(node, root)``, root the smallest node.

    Rounds of contraction: every node is mapped to its smallest neighbour, the edges are mapped along
    and made distinct, until none is left; the maps are then chained. Each round is written to the
    shared folder, nothing but a count comes to the driver. Empty edges give an empty result.
    """
    cur = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    total = None
    while True:
        both = cur.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("to")))
        near = stored(both.groupBy("node").agg(F.min("to").alias("to")), label)
        if total is None:
            total = stored(near.select("node", F.col("to").alias("root")), label)
        else:
            step = near.select(F.col("node").alias("root"), F.col("to").alias("next"))
            chained = stored(total.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), label)
            discard(total)
            total = chained
        if near.isEmpty():
            discard(cur, near)
            return total
        a = near.select(F.col("node").alias("u"), F.col("to").alias("nu"))
        b = near.select(F.col("node").alias("v"), F.col("to").alias("nv"))
        mapped = cur.join(a, "u").join(b, "v").filter("nu <> nv")
        nxt = stored(mapped.select(F.greatest("nu", "nv").alias("u"), F.least("nu", "nv").alias("v")).distinct(), label)
        discard(cur, near)
        cur = nxt
        if cur.isEmpty():
            discard(cur)
            return total
