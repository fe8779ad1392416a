"""Language-model scoring by online logistic mixing of context predictors.

A text is its lower-cased words with one space between them and an end symbol. Each symbol is
coded as a path of bits in a Huffman tree that depends on the two symbols before it, and each bit
is predicted by several models. A model hashes a context (the last 3, 4 or 6 symbols) to a slot
and holds for each inner node of the tree how often the path went left or right in the training
texts. The predictions, as log odds, are added with weights. The weights are chosen by a gate (how
deep the bit lies, whether a word begins) and learnt online: after each portion of a text they
move along the gradient of its cost. The mix is then refined by a correction for each of 25
ranges of its log odds, learnt the same way. A text starts from the same weights always and learns
from itself only as far as it has been read, so a score is a true probability and does not depend
on other texts, order or partitions.

Whole words are predicted too, from their counts overall and among texts alike, and whole passages
from their counts alone and after the passage before (``lm_passages``); all of these are mixed with
weights learnt online.

What is learnt from the corpus covers all training texts: counts of words, words by class and
passages, pairs of bytes (for the alphabet), symbol counts per context slot. Counts of words, words
by class and passages grow with the corpus and are joined; only the most frequent, ``HEAD`` of a kind
(``CLASS_ROWS`` of the words by class) at most, are broadcast too, which keeps hot keys out of the join.
A word that is looked up by the join has the weights that the words before it left, but leaves them as
what was at hand would. The tables of the bit predictors have a fixed size, whatever the corpus
(``SLOTS``; contexts share slots by hash).

Cases: null and empty texts are the end alone. A null id counts as the empty string for the split.
Bytes outside the alphabet cost an escape and 8 bits. Repeated rows get equal results. Without
training texts all predictions are even. Long texts are scored in whole. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, Words, blocks, mixed, prepare, stored
from .lm_passages import Passages, mixed_scores

ORDERS = (2, 3, 4, 6)
MIXED = (1, 2, 3)  # which of them predict bits; the trees rest on the first already
SLOTS = (1 << 12, 1 << 16, 1 << 17, 1 << 17)  # per order; the first is exact
FIRSTS = tuple(int(x) for x in np.r_[0, np.cumsum(SLOTS)][:-1])
SYMBOL_BITS = 6
SYMBOLS = 1 << SYMBOL_BITS
END, ESCAPE = 0, SYMBOLS - 1
END_BYTE = 256
HEAD = 1 << 18  # words and passages whose counts are at hand without a join
CLASS_ROWS = 1 << 18  # words by class whose counts are at hand without a join
END_WORD = 0x656E64  # stands for the end among the word hashes
# Kinds of counted keys besides the classes (0 and more) of words: pairs of bytes, the end (words overall
# where keys are looked up), passages after others, passages alone.
BYTES, ENDS, AFTER, ALONE = -1, -2, -3, -4

CHUNK = 1024  # slots in one stored portion of the models
BLOCK = 1 << 19
GROUP = 1 << 15  # symbols whose bits are worked on at once, so that they stay in the cache
PORTION = 256  # symbols of a text before the first update; doubles up to PORTION_MOST
PORTION_MOST = 4096
GATES = 8  # of a text
BINS = 25
CELLS = 32  # places of a text's bins, a power of two times its gates
SCALE = 8.0 / 127
START = np.array([0.3, 0.4, 0.4], np.float32)
RATE, PRIOR = 0.3, 20.0
PAD = max(ORDERS)  # even: symbols before are taken two by two
LN10 = float(np.log(10))
# A step of a path is 2 * node + bit; the sign turns log odds of a 1 into those against the bit. Above
# these lies how deep the bit is, at most 3, which is a part of its gate.
STEPS = 2 * SYMBOLS
NODE = np.arange(4 * STEPS) % STEPS >> 1
SIGN = np.where(np.arange(4 * STEPS) & 1, -1, 1).astype(np.float32)
DEEP = np.arange(4 * STEPS) // STEPS * 2


# --- texts as symbols -------------------------------------------------------------------


class Stream:
    """A block of texts as bytes: words with a space between them, then the end (256)."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts, lower=True)
        sizes = w.ends - w.starts
        empty = w.counts == 0
        shift = np.cumsum(empty) - empty  # ends of empty texts before this one
        word = np.arange(len(sizes))
        self.codes = np.full(int(sizes.sum()) + len(sizes) + int(empty.sum()), 32, np.int16)
        letters = w.data[~SPACE[w.data]]
        at = np.arange(len(letters)) + np.repeat(word + shift[w.rows], sizes)
        self.codes[at] = letters
        lengths = np.bincount(w.rows, sizes + 1, len(texts)).astype(np.int64) + empty
        self.first = np.r_[0, np.cumsum(lengths)]
        self.codes[self.first[1:] - 1] = END_BYTE


class Pairs:
    """Pairs of adjacent letters a to z, by word. The commonest pair is the class of a text.

    Texts of one language share it mostly, so word counts within a class say more than overall.
    """

    KINDS = 26 * 26

    def __init__(self, words: Words):
        letter = (words.data >= 97) & (words.data <= 122)
        both = letter[1:] & letter[:-1]
        cuts = words.offsets[(words.offsets > 0) & (words.offsets < len(letter))]
        both[cuts - 1] = False  # two texts meet there
        at = np.flatnonzero(both)
        self.code = (words.data[at].astype(np.int64) - 97) * 26 + words.data[at + 1] - 97
        self.first = np.r_[np.searchsorted(at, words.starts), len(at)]
        self.counts = np.zeros((len(words.counts), self.KINDS), np.int64)

    def read(self, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Count the pairs of words ``first`` up to ``last`` of the rows."""
        low = self.first[first]
        many = self.first[last] - low
        at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        keys = np.repeat(np.arange(len(row)), many) * self.KINDS + self.code[at]
        self.counts[row] += np.bincount(keys, minlength=len(row) * self.KINDS).reshape(-1, self.KINDS)

    def classes(self, row: np.ndarray) -> np.ndarray:
        """The class of what has been read; ``KINDS`` where there was no pair."""
        counts = self.counts[row]
        best = counts.argmax(axis=1)
        return np.where(counts[np.arange(len(row)), best] > 0, best, self.KINDS)


@dataclass
class Alphabet:
    """Symbols of bytes, and for each pair of symbols its share of the slots of every order."""

    symbol: np.ndarray
    base: np.ndarray  # (orders, pairs)
    size: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray) -> Alphabet:
        """From counts of byte pairs (257 x 257; the end is 256)."""
        often = pairs.sum(axis=1)
        often[32] = often.max() + 1  # the space always has a symbol
        order = np.lexsort((np.arange(256), -often[:256]))[: SYMBOLS - 2]
        symbol = np.full(257, ESCAPE, np.uint8)
        symbol[order] = np.arange(1, len(order) + 1)
        symbol[END_BYTE] = END
        folded = np.zeros((SYMBOLS, SYMBOLS))
        np.add.at(folded, (symbol[:, None].repeat(257, 1), symbol[None, :].repeat(257, 0)), pairs)
        share = (folded.ravel() + 1e-9) / (folded.sum() + 1e-9 * folded.size)
        sizes = []
        for slots in SLOTS[1:]:
            size = 1 + np.floor(share * (slots - share.size)).astype(np.int64)
            sizes.append(size)
        size = np.stack([np.ones(share.size, np.int64), *sizes])
        base = np.stack([f + np.r_[0, np.cumsum(s)][:-1] for f, s in zip(FIRSTS, size, strict=True)])
        return cls(symbol, base, size)

    def contexts(self, stream: Stream) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Symbol, pair before it, and slot in every order, of each position of a block."""
        symbols, pair, tail = self.codes(stream)
        return symbols, pair, [self.slots(order, pair, tail) for order in range(len(ORDERS))]

    def codes(self, stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, pair before it, and the symbols before that pair as one number, of each position of a block."""
        symbols = self.symbol.astype(np.int64).take(stream.codes)
        begin, lengths = stream.first[:-1], np.diff(stream.first)

        def before(values: np.ndarray, k: int) -> np.ndarray:
            """The values k places earlier; before a text there are ends, as the one of the text before."""
            out = np.zeros(len(values), np.int64)
            out[k:] = values[: max(0, len(values) - k)]
            for place in range(k):
                out[begin[lengths > place] + place] = END
            return out

        pair = before(symbols, 1) * SYMBOLS
        pair += before(symbols, 2)
        tail = np.zeros(len(symbols), np.int64)
        for read in range(2, PAD, 2):
            tail *= SYMBOLS**2
            tail += before(pair, read)
        return symbols, pair, tail

    def slots(self, order: int, pair: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The slot of each context in the order at this place of ``ORDERS``."""
        if not order:
            return self.base[0].take(pair)
        within = (tail >> (PAD - ORDERS[order]) * SYMBOL_BITS).view(np.uint64)
        within += np.uint64(1)
        within *= np.uint64(0x9E3779B97F4A7C15)
        within >>= np.uint64(32)
        within *= self.size[order].view(np.uint64).take(pair)
        within >>= np.uint64(32)
        slots = within.view(np.int64)
        slots += self.base[order].take(pair)
        return slots


# --- trees and models -------------------------------------------------------------------


def huffman(counts: list[float]) -> list[tuple[int, ...]]:
    """The path of each symbol: ``2 * node + bit`` from the root (node 0) down."""
    heap: list[tuple[float, int, int]] = [(c, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    new = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[new] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], new, new))
        new += 1
    paths: list[tuple[int, ...]] = [()] * len(counts)
    waiting, node = [(new - 1, ())], 0
    while waiting:
        at, path = waiting.pop()
        if at in children:
            for bit, child in enumerate(children[at]):
                waiting.append((child, (*path, 2 * node + bit)))
            node += 1
        else:
            paths[at] = path
    return paths


@dataclass
class Trees:
    """Paths for every pair of symbols before and every symbol, one after the other."""

    steps: np.ndarray  # 2 * node + bit, and STEPS times the depth up to 3
    first: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Trees:
        """From symbol counts by pair (pairs x symbols); symbols never seen get a small share."""
        every = (counts.sum(axis=0) + 1) / (counts.sum() + SYMBOLS)

        @functools.cache
        def unseen() -> list[tuple[int, ...]]:
            return huffman(every.tolist())

        paths = [
            p for row in counts for p in (huffman((row + every).tolist()) if row.any() else unseen())
        ]
        length = np.array([len(p) for p in paths], np.int64)
        steps = np.fromiter(
            (s + STEPS * min(d, 3) for p in paths for d, s in enumerate(p)), np.uint16, int(length.sum())
        )
        return cls(steps, np.r_[0, np.cumsum(length)][:-1], length)

    def log_odds(self, counts: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Log odds of a 1 at each node, from symbol counts by slot, as small integers."""
        out = np.zeros(counts.shape, np.int8)
        for p in np.unique(pair):
            rows = np.flatnonzero(pair == p)
            mine = slice(p * SYMBOLS, (p + 1) * SYMBOLS)
            first, length = self.first[mine], self.length[mine]
            sums = np.zeros((2 * SYMBOLS, SYMBOLS), np.float32)
            steps = self.steps[first[0] : first[-1] + length[-1]] % STEPS
            sums[steps, np.repeat(np.arange(SYMBOLS), length)] = 1
            each = counts[rows].astype(np.float32) @ sums.T
            odds = np.log((each[:, 1::2] + 0.4) / (each[:, 0::2] + 0.4))
            out[rows] = np.clip(np.rint(odds / SCALE), -127, 127)
        return out


@dataclass
class Model:
    alphabet: Alphabet
    trees: Trees
    tables: np.ndarray  # slots x nodes, flat

    def __setstate__(self, state: dict) -> None:
        """A row of the tables, 64 bytes, begins where a line of the cache does: its bits are one access."""
        self.__dict__.update(state)
        room = np.empty(self.tables.size + SYMBOLS, np.int8)
        begin = -room.ctypes.data % SYMBOLS
        aligned = room[begin : begin + self.tables.size]
        aligned[:] = self.tables
        self.tables = aligned

    def symbol_costs(self, stream: Stream) -> np.ndarray:
        """-ln of the probability of each symbol of a block, given those before it."""
        symbols, pair, tail = self.alphabet.codes(stream)
        texts = len(stream.first) - 1
        start, length = stream.first[:-1], np.diff(stream.first)
        costs = np.where(symbols == ESCAPE, np.log(256.0), 0.0)
        code = pair * SYMBOLS + symbols
        opening = np.zeros((SYMBOLS, SYMBOLS), np.int64)  # pairs after which a word begins
        opening[[END, self.alphabet.symbol[32]]] = 1
        opening = opening.ravel()
        weights = np.tile(START[:, None] * SCALE, (1, texts * GATES)).astype(np.float32)
        bends = np.zeros(texts * CELLS, np.float32)
        read, step = 0, PORTION
        while (active := np.flatnonzero(length > read)).size:
            group = np.cumsum(np.minimum(length[active] - read, step)) // GROUP
            for mine in np.split(active, np.flatnonzero(np.diff(group)) + 1):
                many = np.minimum(length[mine] - read, step)
                low = start[mine] + read
                at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
                path, pairs, tails = code.take(at), pair.take(at), tail.take(at)
                bits = self.trees.length.take(path)
                opens = np.cumsum(bits) - bits
                of = np.repeat(np.arange(len(at)), bits)  # the symbol of each bit
                place = (self.trees.first.take(path) - opens).take(of)
                place += np.arange(len(of))
                steps = self.trees.steps.take(place).astype(np.int64)
                node, sign = NODE.take(steps), SIGN.take(steps)
                gate = (opening.take(pairs) + np.repeat((mine - mine[0]) * GATES, many)).take(of)
                gate += DEEP.take(steps)
                held = weights[:, mine[0] * GATES : (mine[-1] + 1) * GATES]
                bent = bends[mine[0] * CELLS : (mine[-1] + 1) * CELLS]
                mix, inputs = np.zeros(len(of), np.float32), []
                for mixed_, order in enumerate(MIXED):
                    where = (self.alphabet.slots(order, pairs, tails) * SYMBOLS).take(of)
                    where += node
                    x = self.tables.take(where).astype(np.float32)
                    # Indices are within range; to clip them costs less than to check them.
                    part = held[mixed_].take(gate, mode="clip")
                    part *= x
                    mix += part
                    inputs.append(x)
                bin_ = np.clip(mix * 2 + BINS / 2, 0, BINS - 1).astype(np.int64)
                bin_ += (gate & -GATES) * (CELLS // GATES)
                mix += bent.take(bin_, mode="clip")
                mix *= sign
                against = np.exp(np.clip(mix, -30, 30, out=mix), out=mix)
                costs[at] += np.bincount(of, np.log(1 + against), len(at))
                # The update: gradient over curvature, from all bits of the portion.
                miss = against / (1 + against)
                error, curve = -miss * sign, miss * (1 - miss)
                for mixed_, x in enumerate(inputs):
                    up = np.bincount(gate, error * x, held.shape[1])
                    x *= x
                    x *= curve
                    down = np.bincount(gate, x, held.shape[1])
                    # inputs are counted in units of SCALE
                    held[mixed_] += (RATE * up / (down + PRIOR / SCALE**2)).astype(np.float32)
                up = np.bincount(bin_, error, len(bent))
                down = np.bincount(bin_, curve, len(bent))
                bent += (RATE * up / (down + PRIOR)).astype(np.float32)
            read, step = read + step, min(2 * step, PORTION_MOST)
        return costs

    def word_logs(self, stream: Stream, head: Head, counts: np.ndarray) -> WordLogs:
        """Natural log of the probability of each word of a block; ``counts`` of its words.

        Each word comes from its symbols, or as a whole from the counted words, overall or in
        the class of the text so far. A text begins with even shares for the three; where its
        words so far came from changes them.
        """
        costs, words = self.symbol_costs(stream), stream.words
        texts, n = len(words.counts), len(words.starts)
        empty = np.zeros(texts)
        without = np.flatnonzero(words.counts == 0)
        empty[without] = -costs[stream.first[without]]
        found = WordLogs(empty, np.zeros(n), *np.full((2, n), -np.inf, np.float32), np.zeros(n, np.int16))
        if not n:
            return found
        size = words.ends - words.starts + 1
        begin = np.cumsum(size) - size + (np.cumsum(words.counts == 0))[words.rows]
        sums = np.r_[0, np.cumsum(costs)]
        last = np.zeros(n, bool)
        last[words.first[1:][words.counts > 0] - 1] = True
        ending = np.where(last, head.log_last, head.log_not_last)
        spelt, whole = sums[begin] - sums[begin + size], head.log_share(counts) + ending
        pairs, drawn, read, step = Pairs(words), np.full((3, texts), 3.0), 0, 16
        while (active := np.flatnonzero(words.counts > read)).size:
            many = np.minimum(words.counts[active] - read, step)
            first = np.cumsum(many) - many
            low = words.first[active] + read
            at = np.arange(many.sum()) + np.repeat(low - first, many)
            kind = np.repeat(pairs.classes(active), many)
            inside = head.log_class_share(words.hashes[at], kind)
            ways = np.stack([spelt[at], whole[at], inside + ending[at]])
            shares = np.log(drawn[:, active] / drawn[:, active].sum(axis=0))
            ways += np.repeat(shares, many, axis=1)
            top = ways.max(axis=0)
            ways = np.exp(ways - top)
            both = ways.sum(axis=0)
            found.logs[at] = np.log(both) + top
            found.kinds[at] = kind
            whose = np.repeat(np.arange(len(active)), many)
            if head.words:
                rare = np.flatnonzero(counts[at] == 0)
                part = at[rare]
                found.gains[part] = shares[1, whose[rare]] + ending[part] - np.log(head.words) - found.logs[part]
            rare = np.flatnonzero((inside == -np.inf) & (head.class_rest[kind] > 0))
            part, all_words = at[rare], np.log(head.class_words[kind[rare]])
            found.class_gains[part] = shares[2, whose[rare]] + ending[part] - all_words - found.logs[part]
            drawn[:, active] += np.add.reduceat(ways / both, first, axis=1)
            pairs.read(active, low, low + many)
            read, step = read + step, 2 * step
        return found


@dataclass
class WordLogs:
    """What words of a block say: ``empty`` by text, the rest by word.

    ``gains`` is for words that the head has no count of: if the count is n, n times e to the gain is
    what it adds to the probability, as a multiple of it. ``class_gains`` is the same for counts within
    the class of the text before the word, ``kinds``.
    """

    empty: np.ndarray
    logs: np.ndarray
    gains: np.ndarray
    class_gains: np.ndarray
    kinds: np.ndarray


# --- what is gathered from the corpus ---------------------------------------------------


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by class, passages, ends of texts and pairs of bytes, each with its count."""
    pairs = np.zeros(257 * 257, np.int64)

    def rows(kinds: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [kinds.astype(np.int16), keys.view(np.int64), counts.astype(np.int64)]
        return pa.record_batch([pa.array(c) for c in columns], ["class", "key", "n"])

    def words(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        kinds, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(kinds, kind="stable")  # a radix sort, as kinds are short
        kinds, hashes = kinds[order], hashes[order]
        cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
        for kind, some in zip(kinds[cuts], np.split(hashes, cuts[1:]), strict=True):
            keys, counts = np.unique(some, return_counts=True)
            yield rows(np.full(len(keys), kind), keys, counts)

    held, size, texts = [], 0, 0
    for batch in batches:
        for first, last in blocks(batch.column(0), BLOCK):
            stream = Stream(batch.column(0).slice(first, last - first))
            codes = np.r_[END_BYTE, stream.codes.astype(np.int64)]
            pairs += np.bincount(codes[:-1] * 257 + codes[1:], minlength=pairs.size)
            found = Pairs(stream.words)
            every = np.arange(last - first)
            found.read(every, stream.words.first[:-1], stream.words.first[1:])
            held.append((found.classes(every).astype(np.int16)[stream.words.rows], stream.words.hashes))
            passages = Passages(stream.words)
            for kind, keys in ((AFTER, passages.after), (ALONE, passages.alone)):
                held.append((np.full(len(keys), kind, np.int16), keys))
            size, texts = size + len(stream.words.rows), texts + last - first
            if size > 1 << 21:
                yield from words(held)
                held, size = [], 0
    if size:
        yield from words(held)
    if texts:
        yield rows(np.array([ENDS]), np.array([END_WORD], np.uint64), np.array([texts]))
    seen = np.flatnonzero(pairs)
    yield rows(np.full(len(seen), BYTES), seen.astype(np.uint64), pairs[seen])


def _count_symbols(batches: Iterator[pa.RecordBatch], alphabet: Alphabet) -> Iterator[pa.RecordBatch]:
    """Counts by slot and symbol of a whole partition, in sparse portions."""
    counts = np.zeros(sum(SLOTS) * SYMBOLS, np.uint32)
    for batch in batches:
        for first, last in blocks(batch.column(0), BLOCK):
            symbols, pair, tail = alphabet.codes(Stream(batch.column(0).slice(first, last - first)))
            for begin in range(0, len(symbols), GROUP):
                some = slice(begin, begin + GROUP)
                for order in range(len(ORDERS)):
                    slots = alphabet.slots(order, pair[some], tail[some])
                    slots *= SYMBOLS
                    slots += symbols[some]
                    np.add.at(counts, slots, np.uint32(1))
    yield _portions(counts.reshape(-1, CHUNK * SYMBOLS), np.arange(sum(SLOTS) // CHUNK), TaskContext.get().partitionId() // 64)


def _portions(counts: np.ndarray, chunks: np.ndarray, salt: int) -> pa.RecordBatch:
    found = [(c, np.flatnonzero(row)) for c, row in zip(chunks.tolist(), counts, strict=True)]
    kept = [(i, c, at) for i, (c, at) in enumerate(found) if len(at)]
    return pa.record_batch(
        [
            pa.array([c for _, c, _ in kept], pa.int32()),
            pa.array([salt] * len(kept), pa.int32()),
            pa.array([at.astype("<u2").tobytes() for _, _, at in kept], pa.binary()),
            pa.array([counts[i][at].astype("<u8").tobytes() for i, _, at in kept], pa.binary()),
        ],
        ["chunk", "salt", "at", "n"],
    )


PORTIONS = "chunk int, salt int, at binary, n binary"


def _dense(at: bytes, n: bytes, into: np.ndarray) -> None:
    into[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u8")


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the portions of each chunk and salt; rows come sorted by both."""
    current, total = None, np.zeros(CHUNK * SYMBOLS, np.uint64)
    for batch in batches:
        for chunk, salt, at, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (chunk, salt) != current:
                if current:
                    yield _portions(total[None], np.array(current[:1]), current[1])
                current, total = (chunk, salt), np.zeros(CHUNK * SYMBOLS, np.uint64)
            _dense(at, n, total)
    if current:
        yield _portions(total[None], np.array(current[:1]), current[1])


def _summed(portions: DataFrame) -> DataFrame:
    keys = ["chunk", "salt"]
    return portions.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_add_up, PORTIONS)


def fit_model(training: DataFrame, pairs: np.ndarray) -> Model:
    """Tables of all orders from all training texts; sums are made in the cluster."""
    alphabet = Alphabet.of(pairs.copy())
    counted = training.select("text").mapInArrow(lambda b: _count_symbols(b, alphabet), PORTIONS)
    summed = stored(_summed(_summed(counted).withColumn("salt", F.lit(0))))
    exact = np.zeros((SLOTS[0] // CHUNK, CHUNK * SYMBOLS), np.uint64)
    for r in summed.where(F.col("chunk") < SLOTS[0] // CHUNK).collect():
        _dense(r.at, r.n, exact[r.chunk])
    trees = Trees.of(exact.reshape(-1, SYMBOLS).astype(np.float64))
    owner = np.zeros(sum(SLOTS), np.int64)  # the pair that a slot belongs to
    for base, size in zip(alphabet.base, alphabet.size, strict=True):
        for b, n, p in zip(base, size, range(len(base)), strict=True):
            owner[b : b + n] = p

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, tables = batch.column(0).to_pylist(), []
            for chunk, at, n in zip(chunks, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                total = np.zeros(CHUNK * SYMBOLS, np.uint64)
                _dense(at, n, total)
                mine = owner[chunk * CHUNK : (chunk + 1) * CHUNK]
                tables.append(trees.log_odds(total.reshape(CHUNK, SYMBOLS), mine).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(tables, pa.binary())], ["chunk", "odds"])

    tables = np.zeros((sum(SLOTS) // CHUNK, CHUNK * SYMBOLS), np.int8)
    # At most sum(SLOTS) * SYMBOLS bytes.
    for r in summed.mapInArrow(predict, "chunk int, odds binary").toLocalIterator():
        tables[r.chunk] = np.frombuffer(r.odds, np.int8)
    return Model(alphabet, trees, tables.ravel())


# --- scores -----------------------------------------------------------------------------


class Table:
    """Counts by hash: an array of twice the size or more, with the next free place for clashes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.bits = max(1, (2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)  # zero is no key
        small = counts.max(initial=0) < 1 << 31
        self.counts = np.zeros(1 << self.bits, np.int32 if small else np.int64)
        left, at, self.steps = np.arange(len(keys)), self._home(keys), 0
        while len(left):  # each round places one key at each free place that is wanted
            self.steps += 1
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            placed = left[self.keys[at[left]] == keys[left]]
            self.counts[at[placed]] = counts[placed]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 for one that isn't there."""
        out = np.zeros(len(hashes), np.int64)
        at, left = self._home(hashes), np.arange(len(hashes))
        for _ in range(self.steps):
            found = self.keys.take(at)
            hit = found == hashes
            out[left[hit]] = self.counts.take(at[hit])
            on = ~hit & (found != 0)
            if not on.any():
                break
            hashes, left, at = hashes[on], left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


def in_class(hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A hash of a word and a class."""
    return mixed(hashes + (np.asarray(kind, np.int64) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Head:
    """Counts of the most frequent training words, overall and within a class, and passages.

    ``words``, ``texts`` and ``passages`` are the numbers of all of them in training,
    ``class_words`` those of all words in each class, ``class_rest`` those without a count here.
    """

    counts: Table
    words: int
    texts: int
    class_counts: Table
    class_words: np.ndarray
    class_rest: np.ndarray
    passages: int
    passage_counts: Table

    def log_share(self, counts: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(counts / max(1, self.words))

    def log_class_share(self, hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        counts = self.class_counts.find(in_class(hashes, kind))
        with np.errstate(divide="ignore"):
            return np.log(counts / np.maximum(1, self.class_words[kind]))

    @property
    def log_last(self) -> float:
        """ln of the chance that a text ends after a word."""
        return float(np.log((self.texts + 0.5) / (self.words + self.texts + 1)))

    @property
    def log_not_last(self) -> float:
        return float(np.log1p(-np.exp(self.log_last)))


def _most(counted: DataFrame, limit: int) -> pa.Table:
    """All rows from the count ``n`` on at which at most ``limit`` rows remain."""
    bucket = F.floor(F.log2("n") * 16).cast("int")
    found = counted.groupBy(bucket.alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("least"))
    least, have = None, 0
    for r in sorted(found.collect(), key=lambda r: -r.b):  # at most 64 * 16 rows
        have += r.k
        if have > limit:
            break
        least = r.least
    return (counted.where(F.col("n") >= least) if least is not None else counted.limit(0)).toArrow()


def frequent(counted: DataFrame, words: DataFrame) -> Head:
    """From all counts (``class, key, n``) and those of words overall (``key, n``)."""
    by_class = counted.where("class >= 0")
    sizes = np.zeros(Pairs.KINDS + 1, np.int64)
    for r in by_class.groupBy("class").agg(F.sum("n").alias("n")).collect():
        sizes[r["class"]] = r.n
    texts = words.where(F.col("key") == END_WORD).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passages = counted.where(F.col("class") == ALONE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = _most(counted.where(F.col("class").isin(AFTER, ALONE)), HEAD)
    rows, part = _most(words.where(F.col("key") != END_WORD), HEAD), _most(by_class, CLASS_ROWS)
    hashes = rows.column("key").to_numpy().view(np.uint64)
    kinds, many = part.column("class").to_numpy(), part.column("n").to_numpy()
    inside, rest = in_class(part.column("key").to_numpy().view(np.uint64), kinds), sizes.copy()
    np.subtract.at(rest, kinds, many)
    return Head(
        Table(hashes, rows.column("n").to_numpy()),
        int(sizes.sum()),
        int(texts),
        Table(inside, many),
        sizes,
        rest,
        int(passages),
        Table(runs.column("key").to_numpy().view(np.uint64), runs.column("n").to_numpy()),
    )


SCORED = (
    "n_tokens long, head_known long, head_log double, n_bytes long, empty double, rare array<int>, "
    "gains array<float>, class_gains array<float>, logs array<double>, seen array<long>, at array<int>, "
    "kind array<short>, class array<short>, key array<long>"
)


def _lists(rows: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of ``n`` rows from values whose rows ascend."""
    offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=n))]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _scored(texts: pa.Array, model: Model, head: Head) -> pa.Array:
    """What a text's own words and the head's counts say, and the keys to look up.

    A text with r words that need a look-up and s passages has r + 2 * s counts: of these words, of
    the passages after the ones before, of the passages alone. ``at`` tells which of them each
    ``key`` of a ``kind`` stands for. A word without a count is asked once for its counts overall and in
    its ``class`` (kind ``ENDS``), one that lacks only the latter by the class as the kind.
    """
    parts: list[pa.Array] = []
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int32())]
    kinds += [pa.list_(k) for k in (pa.float32(), pa.float32(), pa.float64(), pa.int64(), pa.int32())]
    kinds += [pa.list_(k) for k in (pa.int16(), pa.int16(), pa.int64())]
    names = [c.split()[0] for c in SCORED.split(", ")]
    for first, last in blocks(texts, BLOCK):
        n = last - first
        stream = Stream(texts.slice(first, n))
        words = stream.words
        rows, hashes, counts = words.rows, words.hashes, head.counts.find(words.hashes)
        hit = counts > 0
        # The end is a token too, known if there was any training text.
        known = np.bincount(rows[hit], minlength=n) + (head.texts > 0)
        logs = np.bincount(rows[hit], np.log10(counts[hit] + 0.5), n) + np.log10(head.texts + 0.5)
        said, passages = model.word_logs(stream, head, counts), Passages(words)
        rare = np.flatnonzero((said.gains > -np.inf) | (said.class_gains > -np.inf))
        owner, many, runs = rows[rare], np.bincount(rows[rare], minlength=n), passages.counts
        first_run = np.cumsum(runs) - runs
        run = np.arange(len(passages.rows)) - first_run[passages.rows]
        seen = [head.passage_counts.find(k) for k in (passages.after, passages.alone)]
        place = np.arange(len(rare)) - (np.cumsum(many) - many)[owner]
        by_class = np.where(said.gains[rare] > -np.inf, ENDS, said.kinds[rare])
        asks = [(owner, place, by_class, said.kinds[rare], hashes[rare])]
        for way, (kind, keys) in enumerate(((AFTER, passages.after), (ALONE, passages.alone))):
            some = np.flatnonzero(seen[way] == 0)
            who = passages.rows[some]
            same = np.full(len(some), kind)
            asks.append((who, (many + way * runs)[who] + run[some], same, same, keys[some]))
        asker, where, kind, class_, keys = (np.concatenate(c) for c in zip(*asks, strict=True))
        order = np.argsort(asker, kind="stable")
        again = np.r_[passages.rows, passages.rows]
        by_run = np.argsort(again, kind="stable")
        columns = [
            words.counts + 1,
            known,
            logs,
            np.diff(stream.first),
            said.empty,
            _lists(owner, n, passages.of_word[rare] - first_run[owner], pa.int32()),
            _lists(owner, n, said.gains[rare], pa.float32()),
            _lists(owner, n, said.class_gains[rare], pa.float32()),
            _lists(passages.rows, n, passages.sums(said.logs), pa.float64()),
            _lists(again[by_run], n, np.concatenate(seen)[by_run], pa.int64()),
            *(
                _lists(asker[order], n, c[order], k)
                for c, k in (
                    (where, pa.int32()),
                    (kind, pa.int16()),
                    (class_, pa.int16()),
                    (keys.view(np.int64), pa.int64()),
                )
            ),
        ]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        parts.append(pa.StructArray.from_arrays(arrays, names))
    if not parts:
        return pa.array([], pa.struct(list(zip(names, kinds, strict=True))))
    return pa.concat_arrays(parts)


FINISHED = "more long, logs double, score double"


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values of all lists, the row of each and its place there; null is empty."""
    many = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(many)), many)
    return lists.flatten(), row, np.arange(len(row)) - (np.cumsum(many) - many)[row]


def _finished(
    empty: pa.Array,
    rare: pa.Array,
    gains: pa.Array,
    class_gains: pa.Array,
    logs: pa.Array,
    seen: pa.Array,
    found: pa.Array,
    texts: int,
    passages: int,
) -> pa.Array:
    """Scores from what ``_scored`` left and the counts found; and the sum of logs of rare words' counts.

    A word's count overall is found in parts, one for each class that it occurs in. Of the ``way`` that
    a count was found by, bit 0 says that it counts overall (or for a passage), bit 1 in the class asked.
    """
    run_of, word_row, word = _flat(rare)
    each, run_row, run = _flat(logs)
    n = len(empty)
    words, runs = np.bincount(word_row, minlength=n), np.bincount(run_row, minlength=n)
    base = np.cumsum(words + 2 * runs) - words - 2 * runs
    counts = np.zeros(int((words + 2 * runs).sum()))
    values, row, place = _flat(seen)
    counts[(base + words)[row] + place] = values.to_numpy()
    values, row, _ = _flat(found)
    way, n_found = values.field("way").to_numpy(), values.field("n").to_numpy()
    where = base[row] + (way >> 2)
    counts += np.bincount(where, n_found * (way & 1), len(counts))
    within = np.bincount(where, n_found * (way >> 1 & 1), len(counts))
    overall, after = base[word_row] + word, (base + words)[run_row] + run
    with np.errstate(divide="ignore"):
        plus = np.logaddexp(0, np.log(counts[overall]) + gains.flatten().to_numpy())
        plus = np.logaddexp(plus, np.log(within[overall]) + class_gains.flatten().to_numpy())
    run_at = (np.cumsum(runs) - runs)[word_row] + run_of.to_numpy()
    each = each.to_numpy() + np.bincount(run_at, plus, len(run_row))
    total = mixed_scores(runs, each, counts[after], counts[after + runs[run_row]], texts, passages)
    have = counts[overall] > 0
    columns = [
        np.bincount(word_row[have], minlength=n),
        np.bincount(word_row[have], np.log10(counts[overall][have] + 0.5), n).astype(float),
        np.where(runs > 0, total, empty.to_numpy()) / LN10,
    ]
    names = [c.split()[0] for c in FINISHED.split(", ")]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names)


def score(docs: DataFrame) -> DataFrame:
    """One row per document: the split, token counts, base score, model score, bits per byte."""
    spark = prepare(docs.sparkSession)
    split = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), (remainder() == 1).alias("held_out")
    )
    training = split.where("not held_out").select("text")
    counted = stored(
        training.mapInArrow(_count_words, "class short, key long, n long")
        .groupBy("class", "key")
        .agg(F.sum("n").alias("n"))
    )
    is_word = (F.col("class") >= 0) | (F.col("class") == ENDS)
    words = stored(counted.where(is_word).groupBy("key").agg(F.sum("n").alias("n")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pairs = np.zeros(257 * 257)
    for r in counted.where(F.col("class") == BYTES).collect():  # at most 257 * 257 rows
        pairs[r.key] = r.n
    model, head = fit_model(training, pairs.reshape(257, 257)), frequent(counted, words)
    shared = spark.sparkContext.broadcast((model, head))
    texts, passages = head.texts, head.passages

    @F.arrow_udf(SCORED)
    def scored(column: pa.Array) -> pa.Array:
        return _scored(column, *shared.value)

    @F.arrow_udf(FINISHED)
    def finished(
        empty: pa.Array,
        rare: pa.Array,
        gains: pa.Array,
        class_gains: pa.Array,
        logs: pa.Array,
        seen: pa.Array,
        found: pa.Array,
    ) -> pa.Array:
        return _finished(empty, rare, gains, class_gains, logs, seen, found, texts, passages)

    rows = stored(
        split.select("doc_id", "held_out", scored(F.col("text")).alias("s"))
        .select("doc_id", "held_out", "s.*")
        .withColumn("row", F.monotonically_increasing_id())
    )
    asked = rows.select("row", F.explode(F.arrays_zip("at", "kind", "class", "key")).alias("a")).select(
        "row", "a.at", "a.kind", F.col("a.class").alias("class_asked"), "a.key"
    )
    known = counted.where(F.col("class").isin(AFTER, ALONE) | (F.col("class") >= 0)).select(
        F.when(F.col("class") >= 0, ENDS).otherwise(F.col("class")).cast("short").alias("of"), "key", "class", "n"
    )
    by_class, same = F.col("kind") >= 0, F.col("class") == F.col("class_asked")
    # What is found counts overall unless it was asked by class, and in the class if that is the one asked.
    way = (F.col("at") * 4 + F.when(by_class, 0).otherwise(1) + F.when(same, 2).otherwise(0)).alias("way")
    asked = asked.withColumn("of", F.when(by_class, ENDS).otherwise(F.col("kind")).cast("short")).alias("a")
    # The key comes first: rows are sorted by it, and kinds hardly tell them apart.
    meets = (F.col("a.key") == F.col("k.key")) & (F.col("a.of") == F.col("k.of")) & (~by_class | same)
    found = asked.join(known.alias("k"), meets).groupBy("row").agg(F.collect_list(F.struct(way, "n")).alias("found"))
    unseen = F.col("n_tokens") - F.col("n_known")
    even = float(np.log10(total + 0.5 * (distinct + 1)))
    return (
        rows.drop("at", "kind", "class", "key")
        .join(found, "row", "left")
        .withColumn("f", finished("empty", "rare", "gains", "class_gains", "logs", "seen", "found"))
        .withColumn("n_known", F.col("head_known") + F.col("f.more"))
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (
                F.col("head_log")
                + F.col("f.logs")
                + (unseen - F.lit(0 if head.texts else 1)) * F.log10(F.lit(0.5))
                - F.col("n_tokens") * F.lit(even)
            ).alias("base_score"),
            F.col("f.score").alias("score"),
            (-F.col("f.score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )
