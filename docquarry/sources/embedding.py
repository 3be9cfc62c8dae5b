"""Feature-hashed text vectors: the default embedder, and the hook for another one."""

import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[A-Za-z0-9_]+")
HAN = re.compile("[一-鿿㐀-䶿豈-﫿]")


def features(text: str) -> list[str]:
    """Words in lower case, single Han characters and pairs of consecutive ones (over gaps)."""
    han = HAN.findall(text)
    return [w.lower() for w in WORD.findall(text)] + han + [a + b for a, b in zip(han, han[1:])]


@lru_cache(maxsize=200_000)
def digest(feature: str) -> tuple[int, float]:
    """A feature's number (its place, modulo the dimension) and sign; kept for each worker's frequent ones."""
    h = hashlib.sha256(feature.encode()).digest()
    return int.from_bytes(h[:8], "little"), 1.0 if h[8] & 1 == 0 else -1.0


def hash_vector(text: str, dimension: int) -> list[float]:
    """Each feature adds or takes one at a place, both given by its SHA-256; then unit length.

    A weight of 1/sqrt(n) for each would cancel out; whole numbers cancel exactly.
    """
    found = features(text)
    v = np.zeros(dimension)
    for f, times in Counter(found).items():
        number, sign = digest(f)
        v[number % dimension] += sign * times
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


#: Dimensions of models by name (fixed values); others have 384.
DIMENSIONS = {
    "BAAI/bge-small-zh-v1.5": 512,
    "BAAI/bge-small-en-v1.5": 384,
    "sentence-transformers/all-MiniLM-L6-v2": 384,
    "jinaai/jina-embeddings-v2-small-en": 512,
    "jinaai/jina-embeddings-v2-base-zh": 768,
}


def dimension_of(model: str, default: int = 384) -> int:
    return DIMENSIONS.get(model.strip(), default)


def embed(rows: DataFrame, text: str, dimension: int = 512, embedder=None) -> DataFrame:
    """Adds ``embedding``. embedder: texts -> vectors, for a model of the caller's."""
    import pyarrow as pa
    from pyspark.sql import types as T

    model = embedder or (lambda ts: [hash_vector(t, dimension) for t in ts])
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):  # an operator of its own: an expression could be moved into a lambda, where Python cannot run
        for batch in batches:
            found = model([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(list, found)), pa.list_(pa.float32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def stale(rows: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text hash is not among the known ones: what has to be embedded anew."""
    return rows.withColumn("text_hash", F.sha2(F.col(text).cast("binary"), 256)).join(known.select(key, "text_hash"), [key, "text_hash"], "left_anti")
