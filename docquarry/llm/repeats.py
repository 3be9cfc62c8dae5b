"""Removal of repeated passages with suffix arrays (op 10).

Every byte is removed that a string of ``MIN`` = 100 bytes covers which also starts earlier (smaller doc_id,
or earlier in the same document); strings never cross documents and are judged on the input.

Method. Suffixes are sorted in blocks that hold all that can be equal. Of every 100-byte string the
leftmost minimal hash among its ``K``-byte strings is its anchor, so equal strings have equal anchors, and a
sorted exchange on the anchors' hashes brings their surroundings (100 bytes either way) together.
Surroundings that are equal as a whole are folded into their first occurrence; what differs is cut down to what
another surrounding of the anchor shares on either side, folded once more, and goes, as one block per anchor, through the suffix sorting by grouping in ``gsaca`` (many blocks side by side). In suffix
order the places with the same 100 bytes, compared byte by byte, stand in a row; all but the first are
covered.

A block takes ``MOST`` different surroundings. Anchors with more (the ends of passages that thousands of
documents share) are handled another way: all their 100-byte strings are exchanged by two hashes of theirs
(128 bits) and all but the first occurrence are covered. A task that sees more than ``MOST`` surroundings of an
anchor on its own says so with one row and sends the strings at once, so no key brings more than ``MOST``
rows from a task.

Two reads of the texts follow the anchors: one fetches the surroundings that blocks need, one applies the
covered ranges; both are joins on doc_id, texts never meet in groups.

Cases: null text counts as empty; texts under 100 bytes keep all; texts of any length are cut into pieces
that overlap by what an anchor needs; equal texts: the one with the smallest doc_id stays; an empty table
gives an empty result; repeated rows (same doc_id and text) are one document and get equal results; different texts
under one doc_id are parts of one document, in the order of their hashes, each with its own ranges (strings do not
cross them; an id is meant to have few of them: their sizes are added up in one task); null ids are left out of
matching and keep their text; further columns are left out unless kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import Prefix, binary_views, ragged, stored, table, tidy, width
from docquarry.llm.gsaca import suffix_arrays

MIN = 100
K = 40
SPAN = MIN - K + 1  # anchors are minimal among so many neighbours
MOST = 32
PIECE = 1 << 20
HELD = 24 << 20  # bytes of text whose anchors a task folds at once
SORTED = 1 << 20  # symbols that are sorted side by side

ANCHOR, FULL, STRING, COVER, BLOCK, FETCH = range(6)
SHIFT = "_shift"
ROWS = "kind int, h long, c long, doc long, pos long"
I64, U64 = np.int64, np.uint64


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, Prefix]:
    """Anchor places in texts laid end to end, their hashes, and the hashes of any span."""
    n = len(data)
    spans = Prefix(data)
    if n < MIN:
        return np.zeros(0, I64), np.zeros(0, U64), spans
    at = np.arange(n - K + 1)
    h = spans.spans(at, at + K)
    bits = int(n).bit_length()
    key = (h >> U64(bits) << U64(bits)) | at.astype(U64)
    done = 1
    low = key
    while done < SPAN:  # minimum over `done` places, doubled until it spans all
        step = min(done, SPAN - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    size = np.diff(bounds)
    starts = ragged(bounds[:-1], np.maximum(size - MIN + 1, 0))
    chosen = np.zeros(n, bool)
    chosen[(low[starts] & U64((1 << bits) - 1)).astype(I64)] = True
    places = np.flatnonzero(chosen)
    return places, h[places], spans


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges united per document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    shift = np.cumsum(new).astype(I64) * (1 << 42)  # documents apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift) - shift
    fresh = new.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    tails = np.concatenate([heads[1:], [len(doc)]]) - 1
    return doc[heads], start[heads], reach[tails]


def rows_of(kind, h, c, doc, pos):
    import pyarrow as pa

    n = len(doc)
    fill = lambda x, t: np.full(n, x, t) if np.isscalar(x) else np.asarray(x).view(t) if np.asarray(x).dtype.itemsize == np.dtype(t).itemsize else np.asarray(x, t)
    return pa.RecordBatch.from_arrays([pa.array(fill(kind, np.int32)), pa.array(fill(h, I64)), pa.array(fill(c, I64)), pa.array(fill(doc, I64)), pa.array(fill(pos, I64))], names=["kind", "h", "c", "doc", "pos"])


def spread(doc: np.ndarray) -> np.ndarray:
    """A key for rows that only pass through."""
    return (doc.astype(U64) * U64(0x9E3779B97F4A7C15)).view(I64)


def heads_of(*columns) -> np.ndarray:
    """Where a sorted row differs from the one before."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def once(*columns):
    """Sorted rows without repetitions: a string that holds two anchors is met twice, a repeated row's places too."""
    first = heads_of(*columns)
    return tuple(c[first] for c in columns)


def strings_at(data, bounds_of, place, doc, pos):
    """Two hashes of all 100-byte strings that hold the anchor at each place, with document and start."""
    one, two = Prefix(data), Prefix(data, 1)
    first = np.maximum(place - (MIN - K), bounds_of[0])
    last = np.minimum(place + K, bounds_of[1] - (MIN - K)) - K  # the last start so that the string ends inside
    n = np.maximum(last - first + 1, 0)
    start = ragged(first, n).astype(I64)
    return one.spans(start, start + MIN), two.spans(start, start + MIN), np.repeat(doc, n), start - np.repeat(place - pos, n)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (8 at least) at a and at b are the same, eight at a time."""
    words = np.lib.stride_tricks.as_strided(data.view("<u1"), (max(0, len(data) - 7), 8), (1, 1), writeable=False).view("<u8")[:, 0] if len(data) >= 8 else np.zeros(0, U64)
    same = np.ones(len(a), bool)
    for at in range(0, int(size.max(initial=0)), 8):
        step = np.minimum(at, size - 8)
        same &= words[a + step] == words[b + step]
    return same


class Folder:
    """Folds the anchors of one task's texts before they are sent: equal surroundings, compared byte by byte."""

    def __init__(self):
        self.held, self.pieces = 0, []

    def add(self, data: np.ndarray, bounds: np.ndarray, docs: np.ndarray, base: np.ndarray, own: tuple[int, int]) -> None:
        """Texts laid end to end; base: where each stands in its document; own: the places to take anchors from."""
        places, h, spans = anchors(data, bounds)
        mine = (places >= own[0]) & (places < own[1])
        places, h = places[mine], h[mine]
        row = np.searchsorted(bounds, places, side="right") - 1
        a, b = np.maximum(places - (MIN - K), bounds[row]), np.minimum(places + MIN, bounds[row + 1])
        c = spans.spans(a, b) ^ (places - a).astype(U64)
        self.pieces.append((h, c, docs[row], places - bounds[row] + base[row], places, len(self.pieces) + np.zeros(len(h), np.int32), data, bounds, row))
        self.held += len(data)

    def flush(self):
        """Rows for the exchange: first occurrences of anchors and strings, covered ranges."""
        if not self.pieces:
            return
        h, c, doc, pos, place, piece = (np.concatenate([p[k] for p in self.pieces]) for k in range(6))
        row = np.concatenate([p[8] for p in self.pieces])
        order = np.lexsort((pos, doc, c, h))
        h, c, doc, pos, place, piece, row = (x[order] for x in (h, c, doc, pos, place, piece, row))
        one = heads_of(h, c, doc, pos)  # a repeated row is no earlier place
        h, c, doc, pos, place, piece, row = (x[one] for x in (h, c, doc, pos, place, piece, row))
        first = heads_of(h, c)
        # Equal hashes are no proof: what differs from its group's first stays apart, under a hash of its own.
        data, shift = np.concatenate([p[6] for p in self.pieces]), np.cumsum([0] + [len(p[6]) for p in self.pieces])[piece]
        edges = [np.stack([p[7][:-1][p[8]], p[7][1:][p[8]]], 1) for p in self.pieces]
        edge = np.concatenate(edges)[order][one]
        left, right = np.maximum(place - (MIN - K), edge[:, 0]) + shift, np.minimum(place + MIN, edge[:, 1]) + shift
        head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        later = np.flatnonzero(~first)
        odd = later[~same_bytes(data, left[later], left[head[later]], (right - left)[later])]
        if len(odd):
            first[odd] = True
            c = c.copy()
            c[odd] = (doc[odd].astype(U64) * U64(0x9E3779B97F4A7C15)) ^ pos[odd].astype(U64) ^ c[odd]
        del data, edges, edge, left, right
        cover = [(doc[~first], np.maximum(pos[~first] - (MIN - K), 0), pos[~first] + MIN)]
        h, c, doc, pos, place, piece, row = (x[first] for x in (h, c, doc, pos, place, piece, row))
        group = np.cumsum(heads_of(h)) - 1
        full = (np.bincount(group) > MOST)[group] if len(group) else np.zeros(0, bool)
        if full.any():
            found = []
            for k in np.unique(piece[full]):
                mine = full & (piece == k)
                data, bounds = self.pieces[k][6:8]
                found.append(strings_at(data, (bounds[row[mine]], bounds[row[mine] + 1]), place[mine], doc[mine], pos[mine]))
            sh, sc, sd, sp = (np.concatenate([f[k] for f in found]) for k in range(4))
            order = np.lexsort((sp, sd, sc, sh))
            sh, sc, sd, sp = once(sh[order], sc[order], sd[order], sp[order])
            one = heads_of(sh, sc)
            cover.append((sd[~one], sp[~one], sp[~one] + MIN))
            yield rows_of(STRING, sh[one], sc[one], sd[one], sp[one])
            marks = np.unique(h[full])
            yield rows_of(FULL, marks, 0, np.zeros(len(marks), I64), np.zeros(len(marks), I64))
        yield rows_of(ANCHOR, h[~full], c[~full], doc[~full], pos[~full])
        d, s, e = merged(*(np.concatenate([x[k] for x in cover]) for k in range(3)))
        yield rows_of(COVER, spread(d), e, d, s)
        self.held, self.pieces = 0, []


def texts_of(batch, most: int = PIECE):
    """Texts of an Arrow batch laid end to end in portions; long ones in overlapping pieces. Skips null ids."""
    data, bounds = binary_views(batch.column("text"))
    docs, shift = np.array(batch.column("doc_id").fill_null(0)), np.array(batch.column(SHIFT))
    known = np.array(batch.column("doc_id").is_valid())
    size = np.diff(bounds)
    use = np.flatnonzero(known & (size >= MIN))
    i = 0
    while i < len(use):
        j, total = i, 0
        while j < len(use) and (j == i or total + size[use[j]] <= most):
            total += size[use[j]]
            j += 1
        if total > most:  # one long text: neighbours overlap by a string and its surroundings
            a, b = bounds[use[i]], bounds[use[i] + 1]
            at = 0
            while at < b - a:
                stop = min(b - a, at + most)
                # An anchor belongs to one piece, which holds all of its surroundings.
                own = (0 if at == 0 else MIN, stop - at if stop == b - a else stop - at - 2 * MIN)
                yield data[a + at : a + stop], np.array([0, stop - at]), docs[use[i : i + 1]], shift[use[i : i + 1]] + at, own
                if stop == b - a:
                    break
                at = stop - 3 * MIN
        else:
            rows = use[i:j]
            where = ragged(bounds[rows], size[rows])
            yield data[where], np.concatenate([[0], np.cumsum(size[rows])]), docs[rows], shift[rows], (0, len(where))
        i = j


def send(batches):
    """Map side: texts to rows of ``ROWS``."""
    folder = Folder()
    for batch in batches:
        for portion in texts_of(batch):
            folder.add(*portion)
            if folder.held >= HELD:
                yield from folder.flush()
    yield from folder.flush()


def whole_groups(batches, names):
    """Columns of a stream sorted by its first column, cut so that no key is divided."""
    held = None
    for batch in batches:
        now = [np.array(batch.column(n)) for n in names]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        key = now[0]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield held


def sift(batches):
    """Reduce side, sorted by h, c, doc, pos: what is covered, what needs a block, what is overfull."""
    for h, kind, c, doc, pos in whole_groups(batches, ["h", "kind", "c", "doc", "pos"]):
        through = kind == COVER
        if through.any():
            yield rows_of(COVER, 0, c[through], doc[through], pos[through])
        for which in (STRING, ANCHOR):
            mine = (kind == which) | (kind == FULL) if which == ANCHOR else kind == which
            if not mine.any():
                continue
            gh, gk, gc, gd, gp = h[mine], kind[mine], c[mine], doc[mine], pos[mine]
            if which == STRING:
                gh, gc, gd, gp = once(gh, gc, gd, gp)
                first = heads_of(gh, gc)
                yield rows_of(STRING, gh[first], gc[first], gd[first], gp[first])
                yield rows_of(COVER, 0, gp[~first] + MIN, gd[~first], gp[~first])
                continue
            full_keys = np.unique(gh[gk == FULL])
            real = gk == ANCHOR
            gh, gc, gd, gp = once(gh[real], gc[real], gd[real], gp[real])
            first = heads_of(gh, gc)
            yield rows_of(COVER, 0, gp[~first] + MIN, gd[~first], np.maximum(gp[~first] - (MIN - K), 0))
            gh, gd, gp = gh[first], gd[first], gp[first]
            if not len(gh):
                continue
            group = np.cumsum(heads_of(gh)) - 1
            many = np.bincount(group)[group]
            full = (many > MOST) | np.isin(gh, full_keys)
            block = ~full & (many > 1)
            yield rows_of(BLOCK, gh[block], 0, gd[block], gp[block])
            yield rows_of(FETCH, gh[full], 0, gd[full], gp[full])


def fetch(batches):
    """Surroundings (BLOCK) and strings (STRING, with their second hash in ``left``) that were asked for, from the texts."""
    import pyarrow as pa

    names = ["h", "kind", "doc", "pos", "left", "around"]
    for batch in batches:
        data, bounds = binary_views(batch.column("text"))
        docs = np.array(batch.column("doc_id"))
        asked = batch.column("asked")
        count = np.diff(np.array(asked.offsets))
        flat = asked.flatten()
        kind, h, pos = (np.array(flat.field(n)) for n in ("kind", "h", "pos"))
        row = np.repeat(np.arange(len(docs)), count)
        shift = np.array(batch.column(SHIFT))
        inside = pos - shift[row]  # another text of the same document has places of its own
        here = (inside >= 0) & (inside < np.diff(bounds)[row])
        kind, h, pos, row, inside = kind[here], h[here], pos[here], row[here], inside[here]
        place = bounds[row] + inside
        mine = kind == BLOCK
        a, b = np.maximum(place[mine] - (MIN - K), bounds[row[mine]]), np.minimum(place[mine] + MIN, bounds[row[mine] + 1])
        raw = data[ragged(a, b - a)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(b - a)]), pa.int32())
        around = pa.Array.from_buffers(pa.binary(), len(a), [None, offsets.buffers()[1], pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(h[mine]), pa.array(kind[mine]), pa.array(docs[row[mine]]), pa.array(pos[mine] - (place[mine] - a)), pa.array(place[mine] - a), around], names=names)
        full = ~mine
        for r in np.unique(row[full]):  # a text at a time keeps the spans small
            own = full & (row == r)
            text = data[bounds[r] : bounds[r + 1]]
            n = int(own.sum())
            edge = (np.zeros(n, I64), np.full(n, len(text), I64))
            sh, sc, sd, sp = strings_at(text, edge, inside[own], np.full(n, docs[r], I64), pos[own])
            yield pa.RecordBatch.from_arrays([pa.array(sh.view(I64)), pa.array(np.full(len(sh), STRING, np.int32)), pa.array(sd), pa.array(sp), pa.array(sc.view(I64)), pa.nulls(len(sh), pa.binary())], names=names)


def reach(keys: np.ndarray, around: np.ndarray, have: np.ndarray) -> np.ndarray:
    """How many first bytes of ``around`` (a row for each surrounding, ``have`` bytes of it real, the rest zero) another
    row of the block begins with at the most; -1 where a block has one row. Neighbours in sorted order tell."""
    n, wide = around.shape
    words = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    words[:, :wide] = around
    words = words.view(">u8").astype(U64)
    order = np.lexsort((have, *words.T[::-1], keys))  # a row that ends before real zeros comes first
    keys, around, have = keys[order], around[order], have[order]
    differ = around[1:] != around[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), wide)
    shared = np.minimum(shared, np.minimum(have[1:], have[:-1]))
    shared[keys[1:] != keys[:-1]] = -1
    most = np.full(n, -1, I64)
    most[1:] = shared
    most[:-1] = np.maximum(most[:-1], shared)
    out = np.empty(n, I64)
    out[order] = most
    return out


def narrowed(keys, doc, start, left, sizes, data):
    """What of the blocks has to be sorted: keys, doc, start, sizes and bytes; and the covered ranges found on the way.

    Equal strings stand alike around their anchors. So a surrounding is cut down to what another one of its block
    shares to the left and to the right of the anchor, and is left out if that is shorter than a string. What is
    equal then, compared byte by byte, is folded into its first occurrence, which may cut others down further.
    """
    at, place = np.cumsum(sizes) - sizes + left, start + left
    order = np.lexsort((place, doc, keys))
    rows = order[heads_of(keys[order], doc[order], place[order])]  # a repeated row is no earlier place
    keys, doc, place, at, left, right = keys[rows], doc[rows], place[rows], at[rows], left[rows], (sizes - left - K)[rows]
    steps = np.arange(MIN - K)
    before = np.where(steps < left[:, None], data[np.maximum(at[:, None] - 1 - steps, 0)], 0).astype(np.uint8)
    after = np.where(steps < right[:, None], data[np.minimum(at[:, None] + K + steps, len(data) - 1)], 0).astype(np.uint8)
    spans, found = Prefix(data), []
    while len(keys):
        left, right = reach(keys, before, left), reach(keys, after, right)
        use = np.flatnonzero(left + right + K >= MIN)
        whole = spans.spans(at[use] - left[use], at[use] + K + right[use])
        use = use[np.lexsort((place[use], doc[use], whole, left[use], keys[use]))]
        keys, doc, place, at, left, right, before, after = (x[use] for x in (keys, doc, place, at, left, right, before, after))
        whole = spans.spans(at - left, at + K + right)
        first = heads_of(keys, left, right, whole)
        head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        later = np.flatnonzero(~first)
        later = later[same_bytes(data, at[later] - left[later], at[head[later]] - left[later], (left + K + right)[later])]
        found.append((doc[later], (place - left)[later], (place + K + right)[later]))
        stay = np.ones(len(first), bool)
        stay[later] = False
        keys, doc, place, at, left, right, before, after = (x[stay] for x in (keys, doc, place, at, left, right, before, after))
        if len(later) * 16 <= len(first):
            break
        # What lies beyond the reach is no longer compared.
        before, after = before * (steps < left[:, None]), after * (steps < right[:, None])
    sizes = left + K + right
    ranges = merged(*(np.concatenate([f[k] for f in found]) for k in range(3))) if found else (doc, place, place)
    return (keys, doc, place - left, sizes, data[ragged(at - left, sizes)]), ranges


def covered(doc: np.ndarray, start: np.ndarray, sizes: np.ndarray, keys: np.ndarray, data: np.ndarray):
    """Ranges that a suffix sorting of the blocks finds covered.

    doc, start, sizes: a row for each surrounding; keys: its block; data: the bytes end to end.
    """
    n = len(doc)
    # A separator below all bytes after each surrounding; blocks are the strings that are sorted.
    symbols = np.zeros(len(data) + n, np.int32)
    text_at = np.cumsum(sizes + 1) - (sizes + 1)
    where = ragged(text_at, sizes)
    symbols[where] = data.astype(np.int32) + 1
    heads = np.flatnonzero(heads_of(keys))
    block_sizes = np.add.reduceat(sizes + 1, heads)
    sa = suffix_arrays(symbols, block_sizes)
    row = np.searchsorted(text_at, sa, side="right") - 1
    inside = sa - text_at[row]
    valid = inside + MIN <= sizes[row]
    sa, row, inside = sa[valid], row[valid], inside[valid]
    if not len(sa):
        return doc[:0], start[:0], start[:0]
    block = np.searchsorted(heads, row, side="right") - 1
    same = np.zeros(len(sa), bool)
    pair = np.flatnonzero(block[1:] == block[:-1]) + 1
    at = sa - row  # in the bytes: no separators there
    same[pair] = same_bytes(data, at[pair], at[pair - 1], np.full(len(pair), MIN))
    rank = np.cumsum(~same) - 1
    d, s = doc[row], start[row] + inside
    order = np.lexsort((s, d, rank))
    rank, d, s = once(rank[order], d[order], s[order])
    later = ~heads_of(rank)
    return merged(d[later], s[later], s[later] + MIN)


def settle(batches):
    """Reduce side, sorted by h, left, doc, pos: first occurrences of strings; suffix sorting of blocks."""
    waiting, ready = [], []

    def narrow():
        """Takes what waits: covered ranges at once, the rest is ready to be sorted."""
        rest, ranges = narrowed(*(np.concatenate([w[k] for w in waiting]) for k in range(6)))
        waiting.clear()
        ready.append(rest)
        return rows_of(COVER, 0, ranges[2], ranges[0], ranges[1])

    def run():
        keys, doc, start, sizes, raw = (np.concatenate([r[k] for r in ready]) for k in range(5))
        ready.clear()
        if not len(keys):
            return
        # Blocks of like size together: they take their steps side by side.
        heads = np.flatnonzero(heads_of(keys))
        rows = np.diff(np.concatenate([heads, [len(keys)]]))
        total = np.add.reduceat(sizes + 1, heads)
        at = np.cumsum(sizes) - sizes
        order = np.argsort(total, kind="stable")
        i = 0
        while i < len(order):
            j, most = i, int(total[order[i]])
            while j < len(order) and total[order[j]] <= 2 * most + 64:
                j += 1
            picked = ragged(heads[order[i:j]], rows[order[i:j]])
            yield covered(doc[picked], start[picked], sizes[picked], keys[picked], raw[ragged(at[picked], sizes[picked])])
            i = j

    for h, kind, doc, pos, left, around in whole_columns(batches):
        strings = kind == STRING
        if strings.any():
            sh, sc, sd, sp = once(h[strings], left[strings], doc[strings], pos[strings])
            later = ~heads_of(sh, sc)
            d, s, e = merged(sd[later], sp[later], sp[later] + MIN)
            yield rows_of(COVER, 0, e, d, s)
        blocks = np.flatnonzero(~strings)
        if len(blocks):
            data, bounds = around
            sizes = np.diff(bounds)[blocks]
            raw = data[ragged(bounds[:-1][blocks], sizes)]
            waiting.append((h[blocks], doc[blocks], pos[blocks], left[blocks], sizes, raw))
            if sum(len(w[5]) for w in waiting) >= SORTED:
                yield narrow()
            if sum(len(r[4]) for r in ready) >= SORTED:
                for d, s, e in run():
                    yield rows_of(COVER, 0, e, d, s)
    if waiting:
        yield narrow()
    if ready:
        for d, s, e in run():
            yield rows_of(COVER, 0, e, d, s)


def whole_columns(batches):
    """h, kind, doc, pos, left and the surroundings of a stream sorted by h, cut so that no key is divided."""
    held = None
    for batch in batches:
        now = [np.array(batch.column(n)) for n in ("h", "kind", "doc", "pos", "left")]
        data, bounds = binary_views(batch.column("around"))
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held[:5], now, strict=True)]
            data, bounds = np.concatenate([held[5], data]), np.concatenate([held[6], bounds[1:] + held[6][-1]])
        key = now[0]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield *[x[:cut] for x in now], (data[: bounds[cut]], bounds[: cut + 1])
        held = [*[x[cut:] for x in now], data[bounds[cut] :], bounds[cut:] - bounds[cut]]
    if held is not None and len(held[0]):
        yield *held[:5], (held[5], held[6])


def shifted(docs: DataFrame) -> DataFrame:
    """docs with ``SHIFT``: where each text begins in its document. 0 but for different texts under one doc_id, which
    follow one another, so far apart that the surroundings of one's places do not reach another."""
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    each = docs.filter("doc_id IS NOT NULL").select("doc_id", key.alias("_key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("_size"))
    mixed = stored(each.groupBy("doc_id").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).filter("a <> b").select("doc_id"), "mixed")
    if mixed.isEmpty():
        return docs.withColumn(SHIFT, F.lit(0).cast("long"))
    before = Window.partitionBy("doc_id").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.join(mixed, "doc_id", "left_semi").distinct().select("doc_id", "_key", F.coalesce(F.sum(F.col("_size") + 2 * MIN).over(before), F.lit(0)).alias(SHIFT))
    return docs.withColumn("_key", key).join(stored(parts, "shifts"), ["doc_id", "_key"], "left").drop("_key").withColumn(SHIFT, F.coalesce(SHIFT, F.lit(0).cast("long")))


def cover(docs: DataFrame) -> DataFrame:
    """Covered ranges of ``shifted`` documents: doc_id and ``ranges``, an array of (start, end) in bytes, unsorted."""
    spark = docs.sparkSession
    n = width(spark)
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), SHIFT)
    sent = texts.mapInArrow(tidy(send), ROWS)
    sifted = stored(sent.repartition(n, "h").sortWithinPartitions("h", "c", "doc", "pos").mapInArrow(tidy(sift), ROWS), "anchors")
    asked = sifted.filter(F.col("kind").isin(BLOCK, FETCH)).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("kind", "h", "pos")).alias("asked"))
    fetched = texts.join(asked, "doc_id").mapInArrow(tidy(fetch), "h long, kind int, doc long, pos long, left long, around binary")
    strings = sifted.filter(F.col("kind") == STRING).select("h", "kind", "doc", "pos", F.col("c").alias("left"), F.lit(None).cast("binary").alias("around"))
    settled = fetched.unionByName(strings).repartition(n, "h").sortWithinPartitions("h", "left", "doc", "pos").mapInArrow(tidy(settle), ROWS)
    found = sifted.filter(F.col("kind") == COVER).unionByName(settled)
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("pos").alias("start"), F.col("c").alias("end"))).alias("ranges"))


def cut(text: bytes, ranges, shift: int = 0) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, maximal runs removed. shift: where it begins in its document."""
    if not ranges:
        return text, 0, 0
    start = np.maximum(np.array([r["start"] for r in ranges], I64) - shift, 0)
    end = np.minimum(np.array([r["end"] for r in ranges], I64) - shift, len(text))
    own = start < end  # the others are another text's
    start, end = start[own], end[own]
    if not len(start):
        return text, 0, 0
    _, s, e = merged(np.zeros(len(start), I64), start, end)
    parts, at = [], 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts), int((e - s).sum()), len(s)


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, as text) and the kept columns."""
    import pyarrow as pa

    docs = shifted(docs.select("doc_id", "text", *keep))
    ranges = cover(docs)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField("kept", T.StringType()))
    schema = T.StructType(fields + [docs.schema[c] for c in keep])

    def run(batches):
        for batch in batches:
            out = []
            for text, found, shift in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), batch.column(SHIFT).to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, removed, runs = cut(raw, found, shift)
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            columns = [batch.column("doc_id"), *[pa.array([r[k] for r in out], pa.int64()) for k in range(3)], pa.array([r[3] for r in out], pa.string())]
            if with_text:
                columns.append(pa.array([r[4] for r in out], pa.string()))
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in keep], names=schema.names)

    return docs.join(ranges, "doc_id", "left").mapInArrow(tidy(run), schema)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(table(spark, sf_dir, "documents"))
