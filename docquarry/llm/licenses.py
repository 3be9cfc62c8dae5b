"""License scans: MinHash bands over overlapping text windows, then exact containment (op 1).

Method. Words are lower-case runs of letters and digits (bytes from 128 on are letters); shingles are five
words. Templates are put into classes by their number of shingles (up to 2, 4, 8 ...). A class of size L
is looked for in windows of 3L/2 shingles that begin every L/2, so every run of L shingles lies in a window
whole. Each window and each template has ``BANDS`` bands of one minimum. A template of more than L/2
shingles that stands whole in a window has Jaccard similarity 1/3 to it at least (0.27 with a fifth of
its shingles changed; a band agrees then with that probability, and one of 32 with 0.9999.
Windows that agree in a band are verified: the share of the template's distinct shingles in the window, and
in the window with L shingles more on either side, is counted exactly, and ``CONTAINED`` or more is a match;
so a notice that inserted words stretch to 2L is counted whole. One row is returned for each document,
license and kind (text, header, notice): the best containment and the first window that has it (one without the
margins before one with). A notice of five or six words has one or two shingles, of which all must be there.

The templates are a parameter (licenses, kinds and texts); they are sent with the tasks, and their number and size do
not depend on the documents. No exchange is needed; a text is read whole, in one portion of an Arrow batch.

Cases: null or empty texts and texts under five words match nothing (templates under five words are not
allowed); repeated rows give repeated results; ties between windows: the first; a null doc_id is returned as
it is; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.common import Prefix, mix64, portions, ragged, table, tidy, words_of
from docquarry.llm.license_texts import templates as license_templates

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32
SMALLEST = 2
U64 = np.uint64

#: Bytes as words see them: letters and digits in lower case, the rest blank.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint8)
MULTIPLIERS = mix64(np.arange(1, BANDS + 1, dtype=U64) * U64(0x632BE59BD9B4E019)) | U64(1)


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles in order: text number, hash, first byte in its text."""
    folded = FOLDED[data]
    s, e, doc = words_of(folded, bounds)
    z = np.zeros(0, np.int64)
    if len(s) < SHINGLE:
        return z, z.astype(U64), z
    word = Prefix(folded).spans(s, e)
    n = len(word) - SHINGLE + 1
    whole = np.flatnonzero(doc[:n] == doc[SHINGLE - 1 :])
    h = np.zeros(n, U64)
    for k in range(SHINGLE):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + word[k : k + n])
    return doc[whole], h[whole], (s[:n] - bounds[doc[:n]])[whole]


class Index:
    """The templates by class of size and band."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.shingles = []
        self.names: list[tuple[str, str]] = []
        self.classes: dict[int, list[int]] = {}
        for name, kind, text in templates:
            raw = np.frombuffer(text.encode(), np.uint8)
            _, h, _ = runs(raw, np.array([0, len(raw)]))
            if not len(h):
                raise ValueError(f"the template {name} ({text}) has fewer than {SHINGLE} words")
            i = len(self.names)
            self.names.append((name, kind))
            own = np.unique(h)
            size = SMALLEST
            while size < len(h):
                size *= 2
            self.shingles.append(own)
            self.classes.setdefault(size, []).append(i)
        # By class and band: sorted minima of the templates, and a bitmap over their leading bits.
        self.minima, self.order, self.maybe = {}, {}, {}
        for size, members in self.classes.items():
            low = np.array([[(self.shingles[i] * m).min() for i in members] for m in MULTIPLIERS], U64)
            bits = np.zeros((BANDS, 1 << 16), bool)
            for b in range(BANDS):
                bits[b, (low[b] >> U64(48)).astype(np.int64)] = True
            self.order[size] = np.argsort(low, axis=1, kind="stable")
            self.minima[size], self.maybe[size] = np.take_along_axis(low, self.order[size], 1), bits

    def levels(self, per: np.ndarray):
        """Blocks of 1, 2, 4 .. shingles that begin anew in every text: for each size the last block of each text,
        and the pairs of blocks that the next size joins."""
        count, step = per, 1
        while True:
            head = np.cumsum(count) - count
            pairs = -(-count // 2)
            left = ragged(head, pairs) + ragged(np.zeros(len(per), np.int64), pairs)
            last = head + count - 1
            yield 2 * step, last[count > 0], left, np.minimum(left + 1, np.repeat(last, pairs))
            if 2 * step >= max(self.classes):
                return
            count, step = pairs, 2 * step

    def matches(self, doc: np.ndarray, h: np.ndarray, at: np.ndarray, n_docs: int):
        """By text number and template: containment and first byte of the best window."""
        best: dict[tuple[int, int], tuple[float, bool, int]] = {}
        if not len(h):
            return {}
        per = np.bincount(doc, minlength=n_docs)
        start = np.cumsum(per) - per
        levels = list(self.levels(per))
        asked: set[tuple[int, int, int]] = set()
        for b in range(BANDS):
            low = h * MULTIPLIERS[b]
            for size, last, left, right in levels:
                if size in self.classes:
                    window = low
                    for _ in range(2):  # each block and the two behind it, up to the text's end
                        wider = window.copy()
                        np.minimum(window[:-1], window[1:], out=wider[:-1])
                        wider[last] = window[last]
                        window = wider
                    hit = np.flatnonzero(self.maybe[size][b][(window >> U64(48)).astype(np.int64)])
                    if len(hit):
                        minima = self.minima[size][b]
                        first, end = (np.searchsorted(minima, window[hit], side=x) for x in ("left", "right"))
                        for w, x, y in zip(hit.tolist(), first.tolist(), end.tolist(), strict=True):
                            for k in range(x, y):
                                asked.add((size, w, self.classes[size][self.order[size][b, k]]))
                low = np.minimum(low[left], low[right])
        for size, w, template in sorted(asked):
            step = size // 2
            counts = -(-per // step)
            heads = np.cumsum(counts) - counts
            d = int(np.searchsorted(heads, w, side="right")) - 1
            a = (w - int(heads[d])) * step
            b = min(int(per[d]), a + 3 * step)
            # The window, then L more on either side: words put into a notice push its ends out of every window.
            for narrow, x, y in ((True, a, b), (False, max(0, a - 2 * step), min(int(per[d]), b + 2 * step))):
                window = h[start[d] + x : start[d] + y]
                share = float(np.isin(self.shingles[template], window).mean())
                held = best.get((d, template))
                if share >= CONTAINED - 1e-12 and (held is None or (share, narrow) > held[:2]):
                    best[d, template] = (share, narrow, int(at[start[d] + x + int(np.flatnonzero(np.isin(window, self.shingles[template]))[0])]))
        return {k: (share, place) for k, (share, _, place) in best.items()}


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """doc_id, license, kind, containment, first_byte: a row for each document, license and kind that matches.

    templates: (license, kind, text); of several texts of a license and kind the one that is contained best.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    texts = templates or license_templates()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("license", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_byte", T.LongType())])

    def run(batches):
        index = Index(texts)
        for batch in batches:
            for i, j, data, bounds in portions(batch.column("text")):
                doc, h, at = runs(data, bounds)
                best: dict[tuple[int, tuple[str, str]], tuple[float, int]] = {}
                for (d, t), (share, place) in sorted(index.matches(doc, h, at, j - i).items()):
                    held = best.get((d, index.names[t]))
                    if held is None or (share, -place) > (held[0], -held[1]):
                        best[d, index.names[t]] = (share, place)
                if best:
                    found = sorted(best.items())
                    ids = batch.column("doc_id").take(pa.array([i + d for (d, _), _ in found]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([n[0] for (_, n), _ in found]), pa.array([n[1] for (_, n), _ in found]), pa.array([x[0] for _, x in found]), pa.array([x[1] for _, x in found], pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a license text, header or notice: doc_id, license, kind, containment, first_byte."""
    return scan(table(spark, sf_dir, "documents"))
