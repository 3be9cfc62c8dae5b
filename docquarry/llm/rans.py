"""Token ids in a binary file format: static range asymmetric numeral system (op 4).

Format. A corpus of token ids is a folder with ``table`` (one row: the shared frequency table, 2**22 in
all, every id of the vocabulary at least 1, so that any id can be written) and ``blocks`` (Parquet files
written by Spark, so a lost or repeated task leaves one copy). A block holds whole consecutive documents
of about ``BLOCK_TOKENS`` ids and is independent of all others:

    magic, version, documents, tokens, lanes, words, checkpoints        header, little endian
    document ids (int64), document lengths (uint32)
    lane states at the start (uint64), per checkpoint: word offset (uint64) and lane states (uint64)
    32-bit words of the coded stream
    crc32 of everything before

Id i of a block belongs to lane i % lanes; the lanes are coded side by side as numpy vectors with 64-bit
states. A checkpoint stands before every ``CHECKPOINT`` steps, so that a reader may decode from there on.

Order: blocks are written in ascending doc_id order (range partitions, sorted inside); a document's start
is the total of its range partition's predecessors (one number per partition reaches the driver) plus the
ids before it in its partition.

Cases: null text counts as empty; an empty text has the end id only; a long document is one larger block;
equal ids keep together; an empty table gives no blocks; further columns are left out; a null doc_id is
written as the smallest long and read back as null.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.bpe import byte_alphabet, vocabulary
from docquarry.llm.common import binary_views, discard, portions, ragged, scratch, stored, table, tidy, width

MAGIC, VERSION = b"RANS", 1
SCALE = 22
LOW = np.uint64(1 << 31)
LANES = 2048
CHECKPOINT = 128
BLOCK_TOKENS = 524_288
END_ID = 2
NO_ID = -(1 << 63)
#: Texts are encoded in portions of so many bytes; the table of pieces is bounded by their number and ids, each piece by its bytes.
ENCODE_BYTES = 1 << 22
CACHE_WORDS, CACHE_IDS, CACHE_BYTES = 1_000_000, 8_000_000, 256
#: White space beyond ASCII's own, and control signs that some count as such (fixed values).
OTHER_SPACE = "\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Classes of characters in the byte-level pre-tokenizer's pattern, which is
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
WHITE, LETTER, NUMBER, SIGN, RARE = range(5)
HEAD = struct.Struct("<4sIQQIQI")


def classes(codes: range) -> np.ndarray:
    """The class of each code point below U+0280; controls are rare, as byte 0 parts the pieces."""
    out = []
    for c in codes:
        kind = unicodedata.category(chr(c))
        out.append(WHITE if chr(c) in " \t\n\x0b\x0c\r" else RARE if c < 32 else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else SIGN)
    return np.array(out, np.uint8)


class ByteBpe:
    """Ids by the ``tokenizers`` library, its model asked once for each distinct piece.

    The byte-level pattern's pieces are found for all texts of a portion at once, by classes of characters
    up to U+027F; Arrow names each distinct piece, and only new ones reach the library's model. What stands
    between two cuts at white space and holds other characters goes to the library in one piece, and so do
    whole texts with other white space or with special tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.library, self.model):
            t.no_padding()
            t.no_truncation()
        # The same model on pieces that are cut already and written in the byte-level alphabet.
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.whole = "|".join([f"[{OTHER_SPACE}]", *map(re.escape, special)])
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.alphabet = " " + "".join(byte_alphabet())[1:]  # byte 0 parts the pieces
        self.one = np.concatenate([classes(range(128)), np.full(128, RARE, np.uint8)])
        self.two = classes(range(0x280))
        self.letters = np.zeros(self.size, np.int64)
        for token, i in self.library.get_vocab().items():
            self.letters[i] = len(token)
        self.reset()

    def reset(self) -> None:
        """A table of ids laid end to end, by piece. Not empty, so that views can be had."""
        self.words: dict[bytes, int] = {}
        self.flat, self.at = bytearray(self.kind.itemsize), array("q", [1])

    def learn(self, fresh: list[bytes], odd: dict[int, bytes]) -> None:
        """The library's ids of new pieces, asked for in one call; odd ones are texts for the whole library."""
        shown = b"\0".join(fresh).decode("latin-1").translate(self.alphabet)
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.kind)
        # Tokens are spelled in full, so their lengths tell where a piece ends.
        ends = np.cumsum(list(map(len, fresh)))
        reach = np.concatenate([[0], np.cumsum(self.letters[ids])])
        upto = np.searchsorted(reach, ends)
        if not np.array_equal(reach[upto], ends):
            raise ValueError("the vocabulary does not spell a piece in full")
        bounds = np.concatenate([[0], upto])
        if odd:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for k, found in zip(odd, self.library.encode_batch_fast([x.decode() for x in odd.values()], add_special_tokens=False), strict=True):
                parts[k] = np.array(found.ids, self.kind)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        self.at.frombytes((bounds[1:] + len(self.flat) // self.kind.itemsize).astype(np.int64).tobytes())
        self.flat += ids.tobytes()

    def cut(self, data: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts laid end to end start, and which of these are for the whole library."""
        n = len(data)
        kind = self.one[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))  # two bytes, up to U+027F
        kind[lead] = kind[lead + 1] = self.two[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
        if whole.any():
            kind[np.repeat(whole, np.diff(bounds))] = RARE
        first = np.zeros(n + 3, bool)  # a text's first byte; what lies behind all texts belongs to none
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        first[n:] = True
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last of some white characters before others is a piece of its own, or a space in front of one.
        white = kind == WHITE
        breaks = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
        start[breaks] = True
        start[breaks[data[breaks] == 32] + 1] = False
        quote = np.flatnonzero((data == 39) & start)
        if len(quote):
            end = np.concatenate([data, np.zeros(2, np.uint8)])
            x, y = end[quote + 1], end[quote + 2]
            short = quote[~first[quote + 1] & np.isin(x, np.frombuffer(b"stmd", np.uint8))]
            long = quote[~first[quote + 1] & ~first[quote + 2] & ((x == 114) & (y == 101) | (x == 118) & (y == 101) | (x == 108) & (y == 108))]  # re, ve, ll
            for some, size in ((short, 2), (long, 3)):
                start[some + 1] = False
                behind = some + size
                start[behind[behind < n]] = True
        rare = np.flatnonzero(kind == RARE)
        if not len(rare):
            return np.flatnonzero(start), rare
        places = np.union1d(np.flatnonzero(first[:n]), breaks)
        marked = np.zeros(len(places), bool)
        marked[np.searchsorted(places, rare, side="right") - 1] = True
        start[np.repeat(marked, np.diff(places, append=n))] = False
        start[places[marked]] = True
        starts = np.flatnonzero(start)
        return starts, np.searchsorted(starts, places[marked])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow string array or a list; no nulls) laid end to end, and n+1 bounds."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, bounds = binary_views(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        if len(self.at) > CACHE_WORDS or len(self.flat) > CACHE_IDS * self.kind.itemsize:
            self.reset()
        starts, apart = self.cut(data, bounds, np.array(pc.match_substring_regex(texts, self.whole)))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
        named = pieces.dictionary_encode()
        names, which = named.dictionary.to_numpy(zero_copy_only=False).tolist(), np.array(named.indices)
        found = np.fromiter(map(self.words.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(new)) + len(self.at) - 1
            fresh = [names[k] for k in new.tolist()]
            self.words.update((x, r) for x, r in zip(fresh, found[new].tolist(), strict=True) if len(x) <= CACHE_BYTES)
            strange = np.zeros(len(names), bool)
            strange[which[apart]] = True
            odd = {k: fresh[k] for k in np.flatnonzero(strange[new]).tolist()}
            self.learn([b"" if k in odd else x for k, x in enumerate(fresh)] if odd else fresh, odd)
        picked = found[which]
        at, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, self.kind)
        first = at[picked]
        lengths = at[picked + 1] - first
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return flat[ragged(first, lengths)], sums[np.searchsorted(starts, bounds)]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path)


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE, each at least 1, in proportion to the counts."""
    total, n = 1 << SCALE, len(counts)
    whole = max(1, int(counts.sum()))
    freq = 1 + (counts.astype(np.float64) * (total - n) / whole).astype(np.int64)
    freq[int(np.argmax(freq))] += total - int(freq.sum())
    return freq


class Coder:
    """Interleaved coding of one block with a shared table."""

    def __init__(self, freq: np.ndarray, decoder: bool = False):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.most = self.freq << np.uint64(63 - SCALE)
        if decoder:
            self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 65536 else np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """States at the start, words in reading order, checkpoints (word offset, states)."""
        n, steps = len(ids), -(-len(ids) // LANES)
        x = np.full(LANES, LOW, np.uint64)
        words, marks, written = [], [], 0
        ids = ids.astype(np.intp)
        f, c, top = self.freq.take(ids), self.cum.take(ids), self.most.take(ids)
        low32, s32, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
        for t in range(steps - 1, -1, -1):
            a, b = t * LANES, min(n, (t + 1) * LANES)
            y, ft = x[: b - a], f[a:b]
            full = y >= top[a:b]
            if full.any():
                out = (y[full] & low32).astype(np.uint32)
                words.append(out)
                written += len(out)
                y[full] >>= s32
            q = y // ft
            x[: b - a] = (q << scale) + (y - q * ft) + c[a:b]
            if t and t % CHECKPOINT == 0:
                marks.append((written, x.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        return x, stream, [(written - w, s) for w, s in marks[::-1]]

    def decode(self, n: int, x: np.ndarray, words: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the steps first .. last-1, from the states and the words that stand there."""
        steps = -(-n // LANES)
        last = steps if last is None else min(last, steps)
        out = np.empty(max(0, min(n, last * LANES) - first * LANES), np.uint32)
        x, at = x.copy(), 0
        mask, scale, s32 = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for t in range(first, last):
            a, b = t * LANES, min(n, (t + 1) * LANES)
            y = x[: b - a]
            slot = y & mask
            s = self.symbol.take(slot.view(np.int64)).astype(np.intp)
            y = self.freq.take(s) * (y >> scale) + slot - self.cum.take(s)
            low = np.flatnonzero(y < LOW)
            if len(low):
                y[low] = (y[low] << s32) | words[at : at + len(low)]
                at += len(low)
            x[: b - a] = y
            out[a - first * LANES : b - first * LANES] = s
        return out


def pack(coder: Coder, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    states, words, marks = coder.encode(ids)
    parts = [HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), LANES, len(words), len(marks)), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), states.astype("<u8").tobytes()]
    for offset, s in marks:
        parts += [struct.pack("<Q", offset), s.astype("<u8").tobytes()]
    body = b"".join([*parts, words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block read back: checks the checksum, then gives documents and ids (from any checkpoint on)."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum does not match")
        magic, version, docs, self.tokens, lanes, words, marks = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION or lanes != LANES:
            raise ValueError("not a block of this format")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        self.states = [np.frombuffer(data, "<u8", lanes, at)]
        self.offsets = [0]
        at += 8 * lanes
        for _ in range(marks):
            self.offsets.append(struct.unpack_from("<Q", data, at)[0])
            self.states.append(np.frombuffer(data, "<u8", lanes, at + 8))
            at += 8 + 8 * lanes
        self.words = np.frombuffer(data, "<u4", words, at)

    def part(self, coder: Coder, k: int) -> np.ndarray:
        """Ids from checkpoint k to the next; parts can be decoded side by side."""
        return coder.decode(self.tokens, self.states[k], self.words[self.offsets[k] :], k * CHECKPOINT, (k + 1) * CHECKPOINT)

    def ids(self, coder: Coder) -> np.ndarray:
        return np.concatenate([self.part(coder, k) for k in range(len(self.offsets))])


def tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian 16-bit binary where the vocabulary allows, else 32-bit), end id included.

    Every task adds one row without ids: how often it met each id (32-bit counts), so that the shared table
    needs no second read.
    """
    import pyarrow as pa

    def run(batches):
        bpe = byte_bpe(path)
        counts = np.zeros(bpe.size, np.int64)
        names = ["doc_id", "ids", "counts"]
        for batch in batches:
            texts = batch.column("text")
            for a, b, _, _ in portions(texts, ENCODE_BYTES):
                n = b - a
                ids, bounds = bpe.encode(texts.slice(a, n).fill_null(""))
                # The end id goes behind every document.
                ends = bounds[1:] + np.arange(n)
                out = np.empty(len(ids) + n, bpe.kind)
                inner = np.ones(len(out), bool)
                inner[ends] = False
                out[inner], out[ends] = ids, end_id
                counts += np.bincount(out, minlength=bpe.size)
                offsets = ((bounds + np.arange(n + 1)) * bpe.kind.itemsize).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), raw, pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            rest = counts
            while rest.any():  # counts beyond 32 bits go into further rows
                now = np.minimum(rest, 0xFFFFFFFF)
                rest = rest - now
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([now.astype("<u4").tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids binary, counts binary")


def frequencies(coded: DataFrame, size: int) -> np.ndarray:
    """The shared table over all documents; one row for each id of the vocabulary reaches the driver."""
    import pyarrow as pa

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("counts"):
                counts += np.frombuffer(raw.as_buffer(), "<u4")
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in coded.filter("counts IS NOT NULL").select("counts").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return quantize(counts)


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encodes every document and writes the corpus folder."""
    import pyarrow as pa

    spark = docs.sparkSession
    size = byte_bpe(path).size
    kind = "<u2" if size <= 65536 else "<u4"
    coded = stored(tokens(docs, path, end_id), "token-ids", "zstd")
    freq = frequencies(coded, size)
    spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()), size, end_id)], "freq binary, vocabulary long, end_id long").coalesce(1).write.parquet(f"{folder}/table")

    def run(batches):
        coder = Coder(freq)
        part = TaskContext.get().partitionId()
        seq = before = 0
        doc_ids, ids, held = [], [], 0

        def flush():
            nonlocal seq, before, held
            whole = np.concatenate(ids)
            data = pack(coder, np.array(doc_ids, np.int64), np.array([len(x) for x in ids]), whole)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([before]), pa.array([len(whole)]), pa.array([data], pa.binary())], names=["part", "seq", "before", "tokens", "payload"])
            before += len(whole)
            seq += 1
            held = 0
            doc_ids.clear()
            ids.clear()
            return row

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                found = np.frombuffer(x.as_buffer(), kind)
                doc_ids.append(NO_ID if d is None else d)
                ids.append(found)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered = coded.filter("ids IS NOT NULL").select("doc_id", "ids").repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(tidy(run), "part long, seq long, before long, tokens long, payload binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    discard(coded)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens, ids_crc32."""
    import pyarrow as pa

    freq = np.frombuffer(bytes(spark.read.parquet(f"{folder}/table").first()["freq"]), "<u4").astype(np.int64)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One number for each range partition.
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    offset, sums = {}, 0
    for p, n in totals:
        offset[p] = sums
        sums += n

    def run(batches):
        coder = Coder(freq, decoder=True)
        for batch in batches:
            for part, before, data in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("payload"), strict=True):
                block = Block(data.as_py())
                ids = block.ids(coder).astype("<u4")
                ends = np.cumsum(block.lengths.astype(np.int64))
                starts = ends - block.lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                none = block.doc_ids == NO_ID
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids.astype(np.int64), mask=none), pa.array(starts + offset[part] + before), pa.array(block.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "before", "payload").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents in the file format and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return read(spark, folder)
