"""Whitening of vectors by their principal components (op 12).

Entries become whole numbers, x = floor(64 * c) + 1000000. Method: every task folds its rows into a state of count,
sums and centred scatter; Chan's pairwise formula merges states in a tree; the driver takes the eigenvectors of one
d x d matrix; a second pass over the rows measures the covariance of what was whitened, which ought to be the
identity; a third gives the rows out.

Precision: sums are whole numbers, and so are the differences of means that a merge needs (cross-multiplied before
they are divided); a batch is centred about its rounded mean first, so nothing is lost to the offset. Deviations are
whole numbers: in 64 bits where they are sure to fit, else in Python's integers.

Cases: a null vector, one with null or non-finite entries or with entries beyond 2**56 does not take part. Vectors of
different lengths are fitted apart, each length with its own n (states are kept by length: d * d doubles each, on
driver and workers); an empty vector has no component. A component whose eigenvalue is rounding error only
(constant or dependent dimensions, fewer rows than dimensions) has no scale: ``whitened`` is null there and it counts for
nothing in ``identity_error``; if all are so (one row, equal rows), ``explained`` and ``identity_error`` are null.
A deviation beyond 64 bits is null. Repeated rows count each; null and repeated ids give a row each; an empty table
gives an empty result; further columns are left out unless asked for with ``keep``.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import table, tidy

SCALE, OFFSET, HIGHEST = 64.0, 1_000_000, 2.0**56
COMPONENTS = 32
ROWS = 4096  # rows of a batch that are worked on at once
I64 = np.int64

# A state: n, sums (whole numbers), centred scatter of the rows seen, for each length.


def whole(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: which rows take part, and their entries as whole numbers."""
    import pyarrow as pa

    offsets = np.array(column.offsets)
    length = np.where(np.array(column.is_valid()), np.diff(offsets), -1)
    out = {}
    for d in np.unique(length[length >= 0]).tolist():
        rows = np.flatnonzero(length == d)
        c = np.array(column.take(pa.array(rows)).flatten().cast("double").fill_null(float("nan"))).reshape(len(rows), d)
        good = (np.abs(c) < HIGHEST).all(1)
        out[d] = rows[good], np.floor(SCALE * c[good]).astype(I64) + OFFSET
    return out


def state_of(x: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """Of some rows, whole numbers or not: count, sums, scatter about their own mean."""
    n = len(x)
    if x.dtype != I64:
        mean = x.mean(0)
        y = x - mean
        return n, (mean * n).tolist(), y.T @ y
    base = x[0].copy()  # near the others: what is left is small and its sum exact
    y = x - base
    if int(np.abs(y).max(initial=0)) >= 1 << 48:  # ROWS of them could leave 64 bits
        sums = y.astype(object).sum(0)
    else:
        sums = y.sum(0)
    z = y - np.array([int(s) / n for s in sums])
    return n, [int(b) * n + int(s) for b, s in zip(base, sums, strict=True)], z.T @ z


def merged(a, b):
    """Chan's formula for two states."""
    (na, sa, ma), (nb, sb, mb) = a, b
    # The difference of the means, over one denominator.
    delta = np.array([(y * na - x * nb) / (na * nb) for x, y in zip(sa, sb, strict=True)], np.float64)
    return na + nb, [x + y for x, y in zip(sa, sb, strict=True)], ma + mb + np.outer(delta, delta) * (na * nb / (na + nb))


def merged_by_length(a: dict, b: dict) -> dict:
    return {d: merged(a[d], b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def folded(vectors: DataFrame, column: str, rows_of) -> dict:
    """The states of all rows by length: one for each task, merged in a tree. rows_of: length and whole entries to
    the rows that are counted."""

    def run(batches):
        import pyarrow as pa

        state: dict = {}
        for batch in batches:
            for d, (_, x) in whole(batch.column(0)).items():
                for a in range(0, len(x) if d else 0, ROWS):
                    state = merged_by_length(state, {d: state_of(rows_of(d, x[a : a + ROWS]))})
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    parts = vectors.select(column).mapInArrow(tidy(run), "state binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeAggregate({}, merged_by_length, merged_by_length, 3)


def fitted(state, most: int) -> dict:
    """Of one length's state: n, sums, eigenvalues by falling size with their unit vectors, which of them are real."""
    n, sums, scatter = state
    values, axes = np.linalg.eigh(scatter / n)
    values, axes = np.maximum(values[::-1][:most], 0.0), axes[:, ::-1][:, :most]
    trace = float(np.trace(scatter / n))
    real = values > trace * len(sums) * np.finfo(float).eps * 8
    return {"n": n, "sums": sums, "values": values, "axes": axes, "real": real, "trace": trace}


def projected(fit: dict, x: np.ndarray) -> np.ndarray:
    """Rows on the components, each over its standard deviation; 0 where there is none."""
    base = [s // fit["n"] for s in fit["sums"]]
    rest = np.array([(s - b * fit["n"]) / fit["n"] for s, b in zip(fit["sums"], base, strict=True)])
    scale = np.divide(1.0, np.sqrt(fit["values"]), out=np.zeros(len(fit["values"])), where=fit["real"])
    return ((x - np.array(base, I64)) - rest) @ (fit["axes"] * scale)


def deviations(fit: dict, x: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)**2, exactly."""
    n, d = fit["n"], x.shape[1]
    base = [s // n for s in fit["sums"]]
    rest = np.array([s - b * n for s, b in zip(fit["sums"], base, strict=True)], object)  # below n
    y = x - np.array(base, I64)
    reach = (int(np.abs(y).max(initial=0)) + 1) * n
    if d * reach * reach < 1 << 63:
        z = n * y - rest.astype(I64)
        return (z * z).sum(1).tolist()
    z = n * y.astype(object) - rest
    return [k if k < 1 << 63 else None for k in (z * z).sum(1).tolist()]


def identity_error(fit: dict, state) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over the real components."""
    real = fit["real"]
    if not real.any():
        return None
    n, _, scatter = state
    return float(np.abs((scatter / n)[np.ix_(real, real)] - np.eye(int(real.sum()))).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = COMPONENTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each vector that takes part: its id, n, deviation, whitened and explained (arrays by component),
    identity_error, then the kept columns."""
    import pyarrow as pa

    spark = vectors.sparkSession
    fits = {d: fitted(s, most) for d, s in folded(vectors, column, lambda d, x: x).items()}
    shared = spark.sparkContext.broadcast(fits)  # d x d doubles for each length
    checks = folded(vectors, column, lambda d, x: projected(shared.value[d], x))
    errors = {d: identity_error(fits[d], checks[d]) for d in fits}
    arrays = T.ArrayType(T.DoubleType())
    fields = [vectors.schema[id_column], T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", arrays), T.StructField("explained", arrays), T.StructField("identity_error", T.DoubleType())]
    schema = T.StructType(fields + [vectors.schema[c] for c in keep])

    def lists(values: np.ndarray, real: np.ndarray):
        n, k = values.shape
        flat = pa.array(values.reshape(-1), mask=np.tile(~real, n))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), flat)

    def run(batches):
        for batch in batches:
            for d, (rows, x) in whole(batch.column(1)).items():
                for a in range(0, len(x) if d else 0, ROWS):
                    fit, part = shared.value[d], x[a : a + ROWS]
                    n, at = len(part), pa.array(rows[a : a + ROWS])
                    share = np.divide(fit["values"], fit["trace"], out=np.zeros(len(fit["values"])), where=fit["trace"] > 0)
                    columns = [
                        batch.column(0).take(at), pa.array(np.full(n, fit["n"], I64)), pa.array(deviations(fit, part), pa.int64()), lists(projected(fit, part), fit["real"]),
                        lists(np.tile(share, (n, 1)), np.full(len(share), fit["trace"] > 0)), pa.array([errors[d]] * n, pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns + [batch.column(c).take(at) for c in keep], names=schema.names)

    return vectors.select(id_column, column, *keep).mapInArrow(tidy(run), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
