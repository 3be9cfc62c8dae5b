"""The pass of containment recall: a block of parts against all chunks, each text read once.

Terms are looked for in a slice's distinct words instead of its texts, what they weigh in each row is a table of bytes
(term by row), and a part's numbers are sums of that table's rows. A part whose terms cannot reach its last kept number
in a slice is not summed at all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.scan import ranges, runs_in

ROWS = 2048  # chunks of a slice
FIRST_ROWS = 64  # the first rows of a task set bounds that most of the others do not reach
CELLS = 1 << 19  # numbers (rows times parts) that are summed together
MANY = 1024  # parts, beyond which chunks are read latest first by a few tasks for each core
WORDS = 200_000  # words that a worker remembers
PENDING = 1 << 21  # rows that a worker holds before it drops what has been beaten
FIELDS = ("snippet", "path", "heading", "file_name")  # by rising weight: 1, 2, 3, 3
PLAIN = re.compile("[a-z0-9]+")
BITS = 40  # of modified_at in a key of number and time
FREE = np.iinfo(np.int64).max  # the key of rows that no bound holds for


class Lists:
    """Lists of numbers end to end."""

    def __init__(self, lists: list):
        self.flat = np.array([k for x in lists for k in x], np.int32)
        self.length = np.array([len(x) for x in lists], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])

    def padded(self, which: np.ndarray, place: np.ndarray, none: int) -> np.ndarray:
        """The chosen lists as rows of places, filled up with ``none``; absent ones (none) are last and cut."""
        width = int(self.length[which].max(initial=0))
        out = np.full((len(which), width), none, np.int32)
        filled = np.arange(width) < self.length[which, None]
        out[filled] = place[self.flat[ranges(self.at[which], self.length[which])]]
        if width > 8:
            out.sort(axis=1)
        return out[:, : width - int((out == none).all(axis=0)[::-1].cumprod().sum())]


@dataclass
class Request:
    """A block of parts: ids, distinct words, and the words and scopes (none: all chunks) of each part by number."""

    ids: np.ndarray
    parts: np.ndarray
    words: list[str]
    uses: Lists
    cores: Lists
    scopes: list[str]
    inside: Lists


def request_of(rows: list, scoped: bool) -> Request:
    lowered = [[sorted({t.lower() for t in r[c] if t}) for r in rows] for c in ("terms", "core")]
    words = sorted({t for lists in lowered for x in lists for t in x})
    place = {t: k for k, t in enumerate(words)}
    uses, cores = (Lists([[place[t] for t in x] for x in lists]) for lists in lowered)
    named = [r["scopes"] if scoped else None for r in rows]
    scopes = sorted({s for x in named for s in x or ()})
    number = {s: k for k, s in enumerate(scopes)}
    inside = Lists([[len(scopes)] if x is None else sorted({number[s] for s in x}) for x in named])
    return Request(np.array([r["query_id"] for r in rows], np.int64), np.array([r["part"] for r in rows], np.int32), words, uses, cores, scopes, inside)


class Finder:
    """Which words of a request lie in texts."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.n_words, self.known, self.seen = len(words), {}, {}
        self.plain, self.other = ahocorasick.Automaton(), ahocorasick.Automaton()
        for k, w in enumerate(words):
            (self.plain if PLAIN.fullmatch(w) else self.other).add_word(w, k)
        for x in (self.plain, self.other):
            x.make_automaton()

    @staticmethod
    def _in(automaton, text: str) -> set[int]:
        return {k for _, k in automaton.iter(text)} if len(automaton) else set()

    def _remembered(self, memory: dict, values: list[str], look) -> list:
        if len(memory) > WORDS:
            memory.clear()
        out = []
        for v in values:
            found = memory.get(v)
            if found is None:
                found = memory[v] = look(v)
            out.append(found)
        return out

    def snippets(self, texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and words of the request in them. A word of letters and digits lies inside a run of such."""
        import pyarrow as pa

        lowered = [t.lower() if t else "" for t in texts.to_pylist()]
        row, runs, _, _ = runs_in(pa.array(lowered, pa.string()))
        coded = runs.dictionary_encode()
        lists = Lists(self._remembered(self.known, coded.dictionary.to_pylist(), lambda v: tuple(self._in(self.plain, v))))
        index = np.array(coded.indices, np.int64)
        used = lists.length[index] > 0
        row, index = row[used], index[used]
        n = lists.length[index]
        out = [(np.repeat(row, n), lists.flat[ranges(lists.at[index], n)])]
        if len(self.other):
            more = Lists([self._in(self.other, t) for t in lowered])
            out.append((np.repeat(np.arange(len(lowered)), more.length), more.flat))
        return out

    def names(self, texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for short texts that come again and again."""
        coded = texts.fill_null("").dictionary_encode()
        look = lambda v: tuple(self._in(self.plain, v.lower()) | self._in(self.other, v.lower()))
        lists = Lists(self._remembered(self.seen, coded.dictionary.to_pylist(), look))
        index = np.array(coded.indices, np.int64)
        n = lists.length[index]
        return [(np.repeat(np.arange(len(index)), n), lists.flat[ranges(lists.at[index], n)])]

    def weights(self, part) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and bytes by place and row: a chunk's best field for each word; the last place is empty."""
        found = [(min(f + 1, 3), *x) for f, name in enumerate(FIELDS) for x in (self.names if f else self.snippets)(part.column(name))]
        there = np.zeros(self.n_words, bool)
        for _, _, word in found:
            there[word] = True
        n_there = int(there.sum())
        place = np.where(there, np.cumsum(there) - 1, n_there).astype(np.int32)
        table = np.zeros((n_there + 1, part.num_rows), np.uint8)
        for weight, row, word in found:
            table[place[word], row] = weight
        return place, table


class Kept:
    """What a task sends: of each part rows that can be among the first ``keep`` of what it has read."""

    def __init__(self, request: Request, keep: int, pending: int):
        self.request, self.keep, self.pending = request, keep, pending
        self.best = np.full((len(request.ids), keep), -1, np.int64)  # the first keys of each part so far
        self.least = np.full(len(request.ids), -1, np.int64)
        self.clear()

    def clear(self):
        self.held, self.fresh, self.chunk_ids, self.times, self.n_held, self.n_rows = [], [], [], [], 0, 0

    def raise_bounds(self, part: np.ndarray, key: np.ndarray):
        """part: in runs, one for each part."""
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        who, count = part[start], np.diff(np.append(start, len(part)))
        group = np.repeat(np.arange(len(who)), count)
        order = np.lexsort((-key, group))
        rank = np.arange(len(part)) - np.repeat(start, count)
        first = rank < self.keep
        both = np.full((len(who), 2 * self.keep), -1, np.int64)
        both[:, : self.keep] = self.best[who]
        both[group[first], self.keep + rank[first]] = key[order][first]
        both.partition(self.keep, axis=1)
        self.best[who], self.least[who] = both[:, self.keep :], both[:, self.keep]

    def add(self, part, key, row, raw, overlap, core):
        """row: of the slice that ``end_slice`` ends."""
        self.fresh.append((part.astype(np.int32), key, row, raw.astype(np.int32), overlap.astype(np.int32), core.astype(np.int32)))

    def end_slice(self, chunk_ids, times):
        """Copies what is sent of a slice's rows, so that its texts are let go."""
        import pyarrow as pa

        if self.fresh:
            part, key, row, *numbers = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
            sent, at = np.unique(row, return_inverse=True)
            self.held.append((part, key, at + self.n_rows, *numbers))
            self.chunk_ids.append(chunk_ids.take(pa.array(sent)))
            self.times.append(times.take(pa.array(sent)))
            self.n_held, self.n_rows, self.fresh = self.n_held + len(part), self.n_rows + len(sent), []

    def prune(self):
        if self.held:
            every = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            stays = every[1] >= self.least[every[0]]
            self.held = [tuple(x[stays] for x in every)]
            self.n_held = int(stays.sum())

    def out(self):
        import pyarrow as pa

        self.prune()
        if self.n_held:
            chunk_ids, times = pa.concat_arrays(self.chunk_ids), pa.concat_arrays(self.times)
            for a in range(0, self.n_held, 1 << 16):
                part, _, row, raw, overlap, core = (x[a : a + (1 << 16)] for x in self.held[0])
                at = pa.array(row)
                columns = [pa.array(self.request.ids[part]), pa.array(self.request.parts[part]), chunk_ids.take(at), times.take(at), *(pa.array(x.astype(np.int64)) for x in (raw, overlap, core))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "part", "chunk_id", "modified_at", "raw", "overlap", "core"])
        self.clear()

    def overfull(self):
        """Rows that must go because too many are held even without the beaten ones."""
        if self.n_held > self.pending:
            self.prune()
            if self.n_held > self.pending // 2:
                yield from self.out()


def summed(request: Request, kept: Kept, place: np.ndarray, table: np.ndarray, long: np.ndarray, when: np.ndarray, first_row: int, inside: np.ndarray | None):
    """The parts of a request against some rows of a slice: those that may be among the first go to ``kept``."""
    uses, cores, n = request.uses, request.cores, table.shape[1]
    bounded = 0 <= when.min() and when.max() < 1 << BITS
    most = table.max(axis=1)
    upto = np.concatenate([[0], np.cumsum(most[place[uses.flat]], dtype=np.int64)])
    reach = upto[uses.at[1:]] - upto[uses.at[:-1]]
    need = np.ones(len(reach), np.int64)
    if bounded:
        number, time = kept.least >> BITS, kept.least & (1 << BITS) - 1
        need = np.where(kept.least < 0, 1, number + (time > when.max()))
    active = np.flatnonzero(reach >= need)
    active = active[np.argsort(uses.length[active], kind="stable")]
    kind = np.uint8 if 3 * uses.length.max(initial=0) < 256 else np.uint32
    step, none = max(1, CELLS // n), len(table) - 1
    for a in range(0, len(active), step):
        who = active[a : a + step]
        terms = uses.padded(who, place, none)
        raw = table[terms[:, 0]].astype(kind)
        for k in range(1, terms.shape[1]):
            raw += table[terms[:, k]]
        if inside is not None:
            scopes = request.inside.padded(who, np.arange(len(inside)), len(inside) - 1)
            allowed = np.zeros(raw.shape, bool)
            for k in range(scopes.shape[1]):
                allowed |= inside[scopes[:, k]]
            raw *= allowed
        some = np.flatnonzero(raw.max(axis=1) >= need[who])
        if not len(some):
            continue
        raw = raw[some]
        i, j = np.divmod(np.flatnonzero(raw >= need[who[some], None].astype(kind)), n)
        number = raw[i, j].astype(np.int64)
        part = who[some[i]]
        if bounded:
            key = number << BITS | when[j]
            better = key >= kept.least[part]
            i, j, number, part, key = i[better], j[better], number[better], part[better], key[better]
            if not len(i):
                continue
            kept.raise_bounds(part, key)
            still = key >= kept.least[part]
            i, j, number, part, key = i[still], j[still], number[still], part[still], key[still]
        else:
            key = np.full(len(i), FREE)
        overlap, core = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in range(terms.shape[1]):
            term = terms[some[i], k]
            weight = table[term, j]
            overlap += np.where(weight == 3, 3, weight > 0) * long[term]
        terms = cores.padded(who, place, none)
        for k in range(terms.shape[1]):
            core += table[terms[some[i], k], j] > 0
        kept.add(part, key, first_row + j, number, overlap, core)


def contained(chunks: DataFrame, request: Request, keep: int, scoped: bool) -> DataFrame:
    """One block of a request against all chunks."""
    schema = f"query_id long, part int, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, modified_at long, raw long, overlap long, core long"
    chunks = chunks.select("chunk_id", "modified_at", *FIELDS, *(["above"] if scoped else []))
    if len(request.ids) > MANY:
        # A task sends up to ``keep`` rows for each part, so there are few; latest first, its bounds hold early.
        tasks = 2 * chunks.sparkSession.sparkContext.defaultParallelism
        chunks = chunks.coalesce(tasks).sortWithinPartitions(F.desc("modified_at"))

    rows, first, pending = ROWS, FIRST_ROWS, PENDING

    def run(batches):
        if not request.words:
            return
        finder, kept = Finder(request.words), Kept(request, keep, pending)
        long_words = np.array([len(w) >= 2 for w in request.words])
        number = {s: k for k, s in enumerate(request.scopes)}
        size = first
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                place, table = finder.weights(part)
                long = np.zeros(len(table), np.int64)
                long[place[long_words]] = 1
                long[-1] = 0
                when = np.array(part.column("modified_at").fill_null(0), np.int64)
                inside = None
                if scoped:
                    inside = np.zeros((len(number) + 2, part.num_rows), bool)
                    inside[-2] = True  # for parts without scopes; the last is for none
                    for i, above in enumerate(part.column("above").to_pylist()):
                        inside[[number[s] for s in above or () if s in number], i] = True
                x = 0
                while x < part.num_rows:
                    y = min(x + size, part.num_rows)
                    summed(request, kept, place, np.ascontiguousarray(table[:, x:y]), long, when[x:y], x, None if inside is None else inside[:, x:y])
                    x, size = y, min(2 * size, rows)
                kept.end_slice(part.column("chunk_id"), part.column("modified_at"))
                yield from kept.overfull()
        yield from kept.out()

    return chunks.mapInArrow(run, schema)
