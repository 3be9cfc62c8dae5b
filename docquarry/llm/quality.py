"""Quality classifier by compression (op 9).

Method: zstandard trains one dictionary on whole texts labelled good and one on whole texts labelled bad. A
text is compressed with either, in pieces of ``PIECE`` bytes so that it does not become its own dictionary;
the difference of the two sizes, normalised by the text's size, is the only evidence. A rising curve over it
(isotonic regression, with ``SMOOTH`` of a logistic curve so that it rises everywhere), fitted on labelled texts
that are in neither dictionary and weighted to the classes' shares of all labels, makes it a calibrated
probability of label 1.

Bounded sample (documented parameter): ``PER_CLASS`` labelled rows of each class, the first by a hash of the
id among the rows that may be learned from; every other one of them goes whole to the driver for a dictionary,
of the rest only the differences do. Scores cover whole texts.

Cases: null text counts as empty; an empty text gets the score of an average text; texts of any length are
scored in pieces; where zstandard finds too little to train on, the texts themselves are the dictionary; a
class without labels gives the other's share for every text, no labels at all 0.5; repeated rows get equal
scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import table, tidy

PER_CLASS = 1500
DICT_BYTES = 112_640
SEGMENT, RUN = 64, 6  # the trainer's segment and its least match, in bytes
PIECE = 256
LEVEL = 3
CUT = 0.3
SMOOTH = 0.03


@dataclass(frozen=True)
class Curve:
    """A rising curve from difference to probability: steps (places, heights) and a logistic part."""

    places: tuple[float, ...]
    heights: tuple[float, ...]
    slope: float
    intercept: float
    mean: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """NaN, an empty text, counts as the mean."""
        x = np.where(np.isnan(x), self.mean, x)
        smooth = 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * x, -30, 30)))
        return (1 - SMOOTH) * np.interp(x, self.places, self.heights) + SMOOTH * smooth


@dataclass(frozen=True)
class Model:
    """Dictionaries, the curve over the difference and the share of label 1; small, sent with the tasks."""

    good: bytes
    bad: bytes
    curve: Curve | None
    share: float


def dictionary(texts: list[bytes]) -> bytes:
    """What zstandard trains on whole texts; too few or too short ones stand for themselves."""
    import zstandard as zs

    try:
        return zs.train_dictionary(DICT_BYTES, texts, k=SEGMENT, d=RUN).as_bytes()
    except zs.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:]


class Sizes:
    """Compressed sizes of a text with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zs

        self.makers = []
        for content in (good, bad):
            d = zs.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.makers.append(zs.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def difference(self, text: bytes) -> float:
        """How much smaller the good dictionary makes a text, by its size (NaN: empty)."""
        if not text:
            return float("nan")
        good, bad = self.makers
        pieces = [text[at : at + PIECE] for at in range(0, len(text), PIECE)]
        return (sum(map(len, map(bad, pieces))) - sum(map(len, map(good, pieces)))) / len(text)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The rising step function nearest to the points: places and heights, two places for each step."""
    steps: list[list[float]] = []  # height, weight, first and last place
    for k in np.lexsort((y, x)):
        steps.append([y[k], w[k], x[k], x[k]])
        while len(steps) > 1 and steps[-2][0] >= steps[-1][0]:
            (h1, w1, first, _), (h2, w2, _, last) = steps[-2:]
            steps[-2:] = [[(h1 * w1 + h2 * w2) / (w1 + w2), w1 + w2, first, last]]
    return tuple(float(p) for s in steps for p in s[2:]), tuple(float(s[0]) for s in steps for _ in range(2))


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows that are not held out; only the bounded sample reaches the driver."""
    spark = docs.sparkSession
    usable = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return Model(b"", b"", None, shares.get(1, 0) / total if total else 0.5)
    sample = [(r["doc_id"], quality, k % 2) for quality in (0, 1) for k, r in enumerate(usable.filter(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS).select("doc_id").collect())]
    # At most 2 * PER_CLASS ids: a bounded side.
    wanted = F.broadcast(spark.createDataFrame(sample, "doc_id long, quality int, part int"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("text <> ''").join(wanted, "doc_id")
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(rows.filter("part = 0").select("doc_id", "quality", "text").collect(), key=lambda r: (r["doc_id"], r["text"])):
        texts[r["quality"]].append(r["text"].encode())
    if not texts[0] or not texts[1]:
        return Model(b"", b"", None, shares[1] / total)
    good, bad = dictionary(texts[1]), dictionary(texts[0])
    found = differences(rows.filter("part = 1"), good, bad, ("quality",)).collect()
    sizes = Sizes(good, bad)
    pairs = [(r["difference"], r["quality"]) for r in found]
    for q in (0, 1):
        if not any(quality == q for _, quality in pairs):
            pairs += [(sizes.difference(t), q) for t in texts[q]]
    x, y = (np.array(c, float) for c in zip(*pairs, strict=True))
    w = np.array([shares[int(q)] / total / (y == q).sum() for q in y]) * len(y)
    mean, spread = x.mean(), x.std() + 1e-9
    intercept, slope = logistic(np.stack([np.ones(len(x)), (x - mean) / spread], 1), y, w)
    curve = Curve(*isotonic(x, y, w), float(slope / spread), float(intercept - slope * mean / spread), float(mean))
    return Model(good, bad, curve, shares[1] / total)


def differences(docs: DataFrame, good: bytes, bad: bytes, keep: tuple[str, ...], name: str = "difference", curve: Curve | None = None) -> DataFrame:
    """The kept columns and the difference (NaN: an empty text), or what the curve makes of it; one map, no exchange."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches):
        sizes = Sizes(good, bad)
        for batch in batches:
            found = np.array([sizes.difference(t.as_py().encode() if t.is_valid else b"") for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(curve(found) if curve else found, pa.float64())], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidy(run), schema)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``score``, the calibrated probability of label 1; one map, no exchange."""
    if model.curve is None:
        return docs.select(*keep, F.lit(float(model.share)).alias("score"))
    return differences(docs, model.good, model.bad, keep, "score", model.curve)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if score >= 0.3)."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
