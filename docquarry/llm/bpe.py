"""BPE encoding and decoding with a ready vocabulary (op 3).

Method: an Aho-Corasick automaton over the vocabulary finds, for every place of a word, the tokens that
match there. The encoder takes the longest one, keeps it if the pair-compatibility table says that BPE
leaves the two neighbours apart, else tries the next shorter prefix token or backtracks; places that led
nowhere are marked, so each is visited once and a word takes linear time. A sequence whose neighbours
are all compatible is the one that rank-ordered merging gives. Decoding copies byte ranges that an
offset table names for each id.

Cases: null text counts as empty; an empty text has no ids and decodes to an empty text; texts may be of
any length (work is per word, memory per Arrow batch); repeated rows give repeated results; further
columns of the input are left out unless asked for with ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.common import ragged, table, tidy

#: Characters with Unicode's White_Space property (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CACHE_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTable:
    """Which two tokens may stand side by side: memory of one walk per pair, filled when asked."""

    def __init__(self, left: list[int], right: list[int], merged: dict[tuple[int, int], int], n_base: int):
        self.left, self.right, self.merged, self.n_base = left, right, merged, n_base
        self.known: dict[tuple[int, int], bool] = {}

    def __call__(self, a: int, b: int) -> bool:
        pair = (a, b)
        found = self.known.get(pair)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[pair] = self.walk(a, b)
        return found

    def walk(self, a: int, b: int) -> bool:
        """Undo merges at the border, latest first; a border merge older than both sides forbids the pair.

        Token numbers are merge ranks. Of equal ranks the leftmost merge goes first: the left side was
        there before an equal border merge, the right side was not.
        """
        bound = len(self.left)
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < bound:
                return False
            if a < self.n_base and b < self.n_base:
                return True
            if a > b:
                bound, a = a, self.right[a]
            else:
                bound, b = b + 1, self.left[b]


class WordBpe:
    """A BPE vocabulary with word ends, from a ``tokenizers`` file (its path is a parameter)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.white, self.odd = re.compile(f"[{WHITE}]+"), re.compile("[\x1c-\x1f]").search
        alphabet = byte_alphabet()
        # A symbol is one character: bytes from U+0100 on, bytes that end a word from U+0300 on.
        names = alphabet + [x + suffix for x in alphabet]
        symbols = [chr(0x100 + b) for b in range(256)] + [chr(0x300 + b) for b in range(256)]
        rank = {x: i for i, x in enumerate(names)}
        left, right, text, merged = list(range(512)), list(range(512)), symbols[:], {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = a + b
            if whole in rank:
                merged.setdefault((rank[a], rank[b]), rank[whole])
                continue
            rank[whole] = len(left)
            merged[rank[a], rank[b]] = len(left)
            left.append(rank[a])
            right.append(rank[b])
            text.append(text[rank[a]] + text[rank[b]])
        self.ids = [vocab[x] for x in sorted(rank, key=rank.get)]
        self.sizes = [len(x) for x in text]
        self.pair_ok = PairTable(left, right, merged, 512)
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(text):
            self.automaton.add_word(x, i)
        self.automaton.make_automaton()
        # For each token the longest token that is a proper prefix of it, or -1.
        number = {x: i for i, x in enumerate(text)}
        self.shorter = [next((number[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in number), -1) for x in text]
        self.inner, self.last = "".join(symbols[:256]), symbols[256:]
        # Decoding: every token's text and a space, laid end to end, with offsets by id.
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        shown = [by_id.get(i, "").encode() + b" " for i in range(max(by_id) + 1)]
        self.shown, self.shown_at = self.laid(shown)
        self.digits, self.digits_at = self.laid([b"%d " % i for i in range(len(shown))])
        self.reset()

    @staticmethod
    def laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def reset(self) -> None:
        """Forgets what was learned of texts; the vocabulary's tables stay."""
        self.rows: dict[str, int] = {}
        self.words: dict[str, array] = {}
        self.pair_ok.known.clear()
        self.flat, self.at = array("i", [0]), array("q", [1])  # not empty, so that views can be had

    def word(self, word: bytes) -> list[int]:
        """Token ranks of one word by backtracking over longest matches."""
        chars = word[:-1].decode("latin-1").translate(self.inner) + self.last[word[-1]]
        ok, sizes = self.pair_ok, self.sizes
        known, out, before = ok.known, [], -1
        for _, token in self.automaton.iter_long(chars):  # the longest everywhere: often right at once
            if before >= 0:
                good = known.get((before, token))
                if not (ok(before, token) if good is None else good):
                    break
            out.append(token)
            before = token
        else:
            return out
        n = len(chars)
        longest = [0] * n
        for end, token in self.automaton.iter(chars):  # by rising end: the last one for a start is the longest
            longest[end + 1 - sizes[token]] = token
        open_at = bytearray(b"\x01" * (n + 1))
        shorter = self.shorter
        out, pos, token = [], 0, longest[0]
        while pos < n:
            while token >= 0:
                end = pos + sizes[token]
                if open_at[end]:
                    if not out:
                        break
                    pair = (out[-1], token)
                    good = known.get(pair)
                    if ok(*pair) if good is None else good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else 0
            else:  # nothing fits here: back, with a shorter token in place of the last
                open_at[pos] = 0
                token = out.pop()
                pos -= sizes[token]
                token = shorter[token]
        return out

    def __missing(self, chunk: str) -> int:
        words = self.words
        for piece in self.pieces(chunk):
            found = words.get(piece)
            if found is None:
                if len(words) > CACHE_WORDS:
                    words.clear()
                found = words[piece] = array("i", [self.ids[t] for t in self.word(piece.encode())])
            self.flat.extend(found)
        self.at.append(len(self.flat))
        row = self.rows[chunk] = len(self.rows)
        return row

    def chunks(self, text: str) -> list[str]:
        """Normalised and cut at white space: no match of the word pattern crosses that."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # by single characters, so without the final form
                text = text.replace("Σ", "σ")
        if self.odd(text):  # white space to str.split() but not by the Unicode property
            return self.white.sub(" ", text).lower().split(" ")
        return text.lower().split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and n+1 bounds."""
        if len(self.rows) > CACHE_WORDS:
            self.reset()
        rows, counts = array("i"), np.zeros(len(texts), np.int64)
        get, lookup, missing = self.rows.get, self.rows.__getitem__, self.__missing
        for k, text in enumerate(texts):
            before = len(rows)
            if self.special_split and "<|" in text and self.special_split.search(text):
                for part in self.special_split.split(text):
                    rows.extend([-1 - self.special[part]] if part in self.special else [missing(c) if (r := get(c)) is None else r for c in self.chunks(part)])
            else:
                chunks = self.chunks(text)
                try:
                    rows.extend(map(lookup, chunks))
                except KeyError:
                    del rows[before:]
                    rows.extend([missing(c) if (r := get(c)) is None else r for c in chunks])
            counts[k] = len(rows) - before
        picked = np.array(rows, np.int64)
        at, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, np.int32)
        named = np.flatnonzero(picked < 0)  # special tokens
        row = np.maximum(picked, 0) if len(named) else picked
        starts = at[row]
        lengths = at[row + 1] - starts if len(at) > 1 else np.ones(len(row), np.int64)
        if len(named):
            lengths[named], starts[named] = 1, len(flat) - 1 - picked[named]
            flat = np.concatenate([flat, np.arange(len(self.shown_at) - 1, dtype=np.int32)])
        ids = flat[ragged(starts, lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[np.concatenate([[0], np.cumsum(counts)])]

    def spelled(self, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        lengths = at[ids + 1] - at[ids]
        joined = data[ragged(at[ids], lengths)].tobytes()
        return joined, np.concatenate([[0], np.cumsum(lengths)])[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Texts of the ids, by the offset table: the tokens joined by one space."""
        joined, at = self.spelled(ids, bounds, self.shown, self.shown_at)
        return [joined[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Decimal ids joined by one space."""
        joined, at = self.spelled(ids, bounds, self.digits, self.digits_at)
        return [joined[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list[str], most: int = 120_000):
    """Runs of texts of about so many characters (one text at least)."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes and decodes every whole text: ids, counts and digests per document; one map, no exchange.

    Result: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (array of int), then the kept columns.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [docs.schema[c] for c in keep])

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                ids, bounds = bpe.encode(texts[a:b])
                sha = lambda parts: [hashlib.sha256(x).hexdigest() for x in parts]
                part = batch.slice(a, b - a)
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sha(bpe.decimals(ids, bounds))), pa.array(sha(bpe.decode(ids, bounds))), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns + [part.column(c) for c in keep], names=schema.names)
        bpe.reset()

    return docs.select("doc_id", "text", *keep).mapInArrow(tidy(run), schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("ids")
