"""Byte-level BPE encoding and decoding.

A text is cut into words by the vocabulary's pattern (added tokens are cut out first). A word
is encoded on a contiguous rank array: the ids of its parts and, beside them, the rank of each
adjacent pair. The smallest rank is looked for again and again, the boundary there is deleted,
and the two neighbouring ranks are looked up anew. All words of one length go through this
together, as rows of a matrix: each round deletes one boundary in every row that still has a
merge, so that the rows keep one length. Words beyond ``SHORT`` bytes take the same steps with
a heap in place of the scan. Words already seen come from a bounded cache.

Cases: null is empty text (no ids, decoded to the empty text). Very long texts are cut into
words piece by piece. Rows are independent of each other; repeated rows repeat their result. Of
equal ranks the leftmost pair merges first. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import blocks, prepare

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHORT = 64
CACHED_WORDS = 150_000
WORDS_AT_ONCE = 200_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the rest follow from code point 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a byte-level BPE file, with vectorised encoding of many words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        ids = content["model"]["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        self.size = max(ids.values()) + 1 + len(content["added_tokens"])
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of = {
            i: bytes(to_byte[c] for c in word) for word, i in ids.items() if word not in self.added
        } | {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.rank_of = {}  # of the long words' pairs: a plain dictionary, built when needed
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.cache: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def encode_same_length(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32 bits) of words that all have the same number of bytes."""
        length = len(words[0])
        parts = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        which, done = np.arange(len(words)), [b""] * len(words)
        for n in range(length, 0, -1):
            row = np.arange(len(which))
            at = ranks.argmin(axis=1) if n > 1 else np.zeros(len(which), int)
            best = ranks[row, at] if n > 1 else np.full(len(which), NONE)
            ended = best == NONE
            if ended.any():
                flat = parts[ended].astype("<u4").tobytes()
                for i, w in enumerate(which[ended].tolist()):
                    done[w] = flat[4 * n * i : 4 * n * (i + 1)]
                go = ~ended
                which, parts, ranks = which[go], parts[go], ranks[go]
                at, best, row = at[go], best[go], np.arange(int(go.sum()))
            if not len(which):
                break
            parts[row, at] = self.merged[best]
            parts = parts[np.arange(n) != (at + 1)[:, None]].reshape(len(which), n - 1)
            ranks = ranks[np.arange(n - 1) != at[:, None]].reshape(len(which), n - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            p = at[before]
            ranks[before, p - 1] = self.rank(parts[before, p - 1], parts[before, p])
            p = at[after]
            ranks[after, p] = self.rank(parts[after, p], parts[after, p + 1])
        return done

    def encode_long(self, word: bytes) -> bytes:
        """The same merges in the same order; a heap holds the ranks."""
        if not self.rank_of:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                rank = self.rank_of.get(ids[i] * self.size + ids[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Put words into the cache; a full one is emptied first."""
        new = {w for w in words if w not in self.cache}
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            new = set(words)
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            raw = w.encode()
            if len(raw) > SHORT:
                self.cache[w] = self.encode_long(raw)
            else:
                by_length.setdefault(len(raw), []).append((w, raw))
        for group in by_length.values():
            coded = self.encode_same_length([raw for _, raw in group])
            self.cache.update(zip((w for w, _ in group), coded, strict=True))

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at added tokens; True marks an added token."""
        at = 0
        if self.special and any(t in text for t in self.added):
            for m in self.special.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield text[at:], False

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        cut = []
        for text in texts:
            whole = len(text) <= WORDS_AT_ONCE
            cut.append(self.pattern.findall(text) if whole and not self._marked(text) else None)
        self.learn({w for words in cut if words for w in words})
        known = self.cache
        for text, words in zip(texts, cut, strict=True):
            if words is not None:
                yield b"".join(map(known.__getitem__, words))
                continue
            out = []
            for part, added in self.segments(text):
                if added:
                    out.append(np.array([self.added[part]], "<u4").tobytes())
                    continue
                found = (m[0] for m in self.pattern.finditer(part))
                while some := list(itertools.islice(found, WORDS_AT_ONCE)):
                    missing = {w for w in some if w not in self.cache}
                    if missing:
                        self.learn({*some})
                    out.append(b"".join(map(self.cache.__getitem__, some)))
            self.learn({w for words in cut if words for w in words})
            yield b"".join(out)

    def _marked(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in a Python worker."""
    return Vocabulary(path)


def _encoded(texts: pa.Array, path: str) -> Iterator[tuple[str, bytes]]:
    words = vocabulary(path)
    for first, last in blocks(texts):
        some = [t or "" for t in texts.slice(first, last - first).to_pylist()]
        yield from zip(some, words.encode(some), strict=True)


def encode(docs: DataFrame, column: str = "text", into: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with the ids of a text column as ``array<int>``."""
    prepare(docs.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for _, x in _encoded(texts, path)]
        return pa.array(ids, pa.list_(pa.int32()))

    return docs.withColumn(into, ids_of(F.col(column)))


def decode(coded: DataFrame, column: str = "ids", into: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``coded`` with the text of an ids column; null ids are the empty text."""
    prepare(coded.sparkSession)

    @F.arrow_udf(T.StringType())
    def text_of(ids: pa.Array) -> pa.Array:
        words = vocabulary(path)
        return pa.array([words.decode(x or []) for x in ids.to_pylist()], pa.string())

    return coded.withColumn(into, text_of(F.col(column)))


def digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per document the number of ids and hashes of the ids and of the decoded text."""
    prepare(docs.sparkSession)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def round_trip(texts: pa.Array) -> pa.Array:
        words, rows = vocabulary(path), []
        for _, coded in _encoded(texts, path):
            text = words.decode(np.frombuffer(coded, "<u4").tolist())
            rows.append(
                {
                    "n_tokens": len(coded) // 4,
                    "ids_sha256": hashlib.sha256(coded).hexdigest(),
                    "decoded_sha256": hashlib.sha256(text.encode()).hexdigest(),
                }
            )
        kind = pa.struct(
            [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        )
        return pa.array(rows, kind)

    found = docs.select("doc_id", round_trip(F.col("text")).alias("r"))
    return found.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
