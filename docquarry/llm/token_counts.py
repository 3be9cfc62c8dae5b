"""Token counts with a sentence-piece model, no tokens kept (op 11).

Method: a map-side look-up in two tiers. No piece of the model holds a space mark behind another character, and
none holds a line feed, so a text falls apart before runs of spaces and before line feeds into pre-tokens whose
tokens do not depend on each other. The first tier is a compact table of the corpus's frequent pre-tokens and
their numbers of tokens, broadcast to all tasks; a pre-token that it lacks goes to the worker's own cache, and
what that lacks goes to the library, all of a portion in one call. Counts are exact wherever they come from.
The texts' pre-tokens never enter an exchange.

The frequent ones come from summaries with ``FREQUENT`` counters (the pre-token with the smallest counts give
way, all counters shrinking alike): one for each task over all of its texts, merged pairwise in a tree. Whatever
makes up more than 1 in ``FREQUENT`` of all pre-tokens is sure to be in. A summary, and so the broadcast table,
has at most ``FREQUENT`` pre-tokens of at most ``LONGEST`` characters: 4 MB, whatever the corpus.

Cases: null text counts as empty; an empty text has no tokens; texts of any length are cut at their pre-tokens,
long pre-tokens are counted but not remembered; repeated rows, null and repeated doc_ids give a row each; an
empty table gives an empty result; special strings inside texts are ordinary text; further columns are left out
unless asked for with ``keep``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docquarry.llm.bpe import slices, vocabulary
from docquarry.llm.common import binary_views, table, tidy

MARK = "▁"  # what the library makes of a space
FREQUENT = 1 << 14
LONGEST = 64  # characters of a pre-token that is remembered
CACHE = 200_000
LIMIT = 4096

runs = re.compile(" +[^ \n]*|\n[^ \n]*").findall


def pre_tokens(text: str) -> list[str]:
    """A text's pre-tokens. Each stands without its first space, so that the one which the library puts before
    every text takes its place; those that begin with a line feed had none."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [p if p[0] == "\n" else p[1:] for p in runs(" " + text)]
    return (text.replace("\n", " \n") if "\n" in text else text).split(" ")


class Tiers(dict):
    """The broadcast table; behind it the worker's cache and what is not remembered."""

    cache: dict[str, int]
    once: dict[str, int]

    def __missing__(self, piece: str) -> int:
        found = self.cache.get(piece)
        return self.once[piece] if found is None else found


class Pieces:
    """Numbers of tokens of pre-tokens: the broadcast tier, a cache, the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = [p for p in map(self.model.id_to_piece, range(self.model.vocab_size())) if re.search(f"[^{MARK}]{MARK}|\n", p)]
        if odd or self.model.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError(f"{path}: texts of this model cannot be cut at spaces and line feeds")
        self.use("", packed({}))

    def use(self, tag: str, form: tuple[bytes, bytes, bytes]) -> None:
        """Takes a broadcast table; the cache starts anew."""
        self.tag, self.tiers = tag, Tiers(unpacked(form))
        self.tiers.cache, self.tiers.once = {}, {}

    def lengths(self, pieces: list[str]) -> list[int]:
        """From the library: a lone space is a token of its own; before a line feed the library's space is one too many."""
        coded = self.model.encode(pieces, num_threads=1)
        return [1 if p == "" else len(ids) - (p[0] == "\n") for p, ids in zip(pieces, coded, strict=True)]

    def counts(self, pieces: list[str]) -> np.ndarray:
        tiers = self.tiers
        if len(tiers.cache) > CACHE:
            tiers.cache = {}
        cache, tiers.once = tiers.cache, {}
        missing = [p for p in set(pieces) if p not in tiers and p not in cache]
        for p, n in zip(missing, self.lengths(missing) if missing else (), strict=True):
            (cache if len(p) <= LONGEST else tiers.once)[p] = n
        return np.fromiter(map(tiers.__getitem__, pieces), np.int64, len(pieces))


@lru_cache(maxsize=2)
def counter(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def packed(lengths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The compact form: all pre-tokens end to end, their ends, their numbers of tokens."""
    raw = [p.encode("utf-8", "surrogatepass") for p in lengths]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64).astype(np.uint32)
    return b"".join(raw), ends.tobytes(), np.array(list(lengths.values()), np.uint16).tobytes()


def unpacked(form: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    text, ends, n = form[0], np.frombuffer(form[1], np.uint32).tolist(), np.frombuffer(form[2], np.uint16).tolist()
    return {text[a:b].decode("utf-8", "surrogatepass"): k for a, b, k in zip([0, *ends], ends, n)}  # noqa: B905


def shrunk(counts: Counter, most: int) -> Counter:
    """At most so many counters: the next one's count is taken from all, so that what is frequent stays."""
    if len(counts) <= most:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    less = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
    return Counter({p: n - less for p, n in counts.items() if n > less})


def frequent_pieces(docs: DataFrame, most: int = FREQUENT) -> Counter:
    """The summary of all texts: pre-tokens with lower bounds of their counts."""

    def run(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                for t in texts[a:b]:
                    total.update(pre_tokens(t))
                if len(total) > 8 * most:
                    total = shrunk(total, most)
        total = shrunk(Counter({p: n for p, n in total.items() if len(p) <= LONGEST}), most)
        if total:
            columns = [pa.array([list(total)], pa.list_(pa.string())), pa.array([list(total.values())], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["pieces", "counts"])

    def merge(a: Counter, b: Counter) -> Counter:
        return shrunk(a + b, most)

    found = docs.select("text").mapInArrow(tidy(run), "pieces array<string>, counts array<long>")
    return found.rdd.map(lambda r: Counter(dict(zip(r[0], r[1], strict=True)))).treeAggregate(Counter(), merge, merge, 3)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, most: int = FREQUENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and the kept columns; two maps over the texts, no exchange of either."""
    import pyarrow as pa

    frequent, tag = list(frequent_pieces(docs, most)), uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(packed(dict(zip(frequent, Pieces(path).lengths(frequent), strict=True))))
    fields = [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    schema = T.StructType(fields + [docs.schema[c] for c in keep])

    def run(batches):
        pieces = counter(path)
        if pieces.tag != tag:
            pieces.use(tag, shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.diff(binary_views(batch.column("text"))[1])
            for a, b in slices(texts):
                flat, ends = [], []
                for t in texts[a:b]:
                    flat += pre_tokens(t)
                    ends.append(len(flat))
                sums = np.concatenate([[0], np.cumsum(pieces.counts(flat))])
                n = np.diff(sums[np.array([0, *ends])])
                part = batch.slice(a, b - a)
                columns = [part.column("doc_id"), pa.array(sizes[a:b]), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns + [part.column(c) for c in keep], names=schema.names)

    return docs.select("doc_id", "text", *keep).mapInArrow(tidy(run), schema)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
