"""SimHash near-duplicates with a hierarchical index in Gray order.

Fingerprints that differ in at most ``DISTANCE`` of 64 bits are linked. The bits are cut into
six blocks; four differences leave at least two blocks alike, so fingerprints meet in one of 15
groups, those with the same bits in two blocks. Within its group a fingerprint is looked up in an
index: fingerprints are sorted by Gray rank, which puts similar ones side by side; runs of
``FANOUT`` make a node, runs of nodes a higher node. A node holds the bits that all below it
share. A search adds up the differences on the shared bits from the top down, each bit once at
the highest node that has it, and leaves a whole node out once the sum exceeds the distance.

Equal fingerprints are one node of the graph; a task reports a spanning forest of the links that
it finds, never all pairs. A group with more than ``GROUP`` different fingerprints is cut into
blocks, and every pair of its blocks meets in a task. Nothing is capped.

Cases: null and empty texts (no word) have the fingerprint zero and are linked like any other.
Repeated rows have equal fingerprints. Null ids are members of components; a component's id is
its smallest id that is not null, null if there is none. Long texts are read in whole. An empty table
gives an empty result. Extra columns are ignored or, in
``one_of_each``, passed through.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import LOWER, blocks, prepare, stored
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 6
FANOUT = 16
GROUP = 8192
PAIRS_AT_ONCE = 1 << 20

_LOWER = LOWER.tobytes()


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half the hashes of the word shingles."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends][: max(1, len(words) - shingle + 1)]
    stops = ends[min(shingle, len(words)) - 1 :]
    of = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 16):
        some = zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)], strict=True)
        hashes = np.array([of(joined[a : b - 1], SEED) for a, b in some], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(on.view("<u8")[0])


def with_fingerprint(docs: DataFrame, column: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column as a long (the same 64 bits, signed)."""
    prepare(docs.sparkSession)

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        found = [
            fingerprint(t or "")
            for first, last in blocks(texts)
            for t in texts.slice(first, last - first).to_pylist()
        ]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return docs.withColumn(into, of(F.col(column)))


def block_masks(blocks_: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of ``blocks_ - distance`` blocks."""
    cuts = np.linspace(0, 64, blocks_ + 1).round().astype(int).tolist()
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    chosen = itertools.combinations(parts, max(1, blocks_ - distance))
    masks = [sum(c) for c in chosen]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The index over groups of fingerprints; ``group`` numbers are ascending."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.codes, self.group = codes[order], group[order]
        both, either, owner = self.codes, self.codes, self.group
        self.levels = []  # from the leaves up: pattern, shared bits, first child
        while True:
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            within = np.arange(len(owner)) - np.repeat(heads, np.diff(np.r_[heads, len(owner)]))
            at = np.flatnonzero(within % FANOUT == 0)
            both, either = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at)
            owner, child = owner[at], np.r_[at, len(owner)]
            self.levels.append((both, ~(both ^ either), child))
            if len(at) == len(heads):
                break
        self.roots = owner

    def links(self, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in ``codes``) of pairs within the distance, in bounded portions."""
        root = np.searchsorted(self.roots, self.group)
        size = np.bincount(root)[root]
        asks = np.flatnonzero(size > 1)
        work = np.cumsum(size[asks])
        if not len(asks):
            return
        cuts = np.searchsorted(work, np.arange(PAIRS_AT_ONCE, work[-1], PAIRS_AT_ONCE))
        for part in np.split(asks, cuts):
            who, node = part, root[part]
            total, above = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint64)
            for pattern, shared, child in reversed(self.levels):
                fresh = shared[node] & ~above
                total = total + np.bitwise_count((self.codes[who] ^ pattern[node]) & fresh)
                near = total <= distance
                who, node, total = who[near], node[near], total[near]
                above = shared[node]
                low, many = child[node], child[node + 1] - child[node]
                at = np.repeat(np.arange(len(node)), many)
                node = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + low[at]
                who, total, above = who[at], total[at], above[at]
            fresh = ~above
            total = total + np.bitwise_count((self.codes[who] ^ self.codes[node]) & fresh)
            hit = (total <= distance) & (who < node)
            yield who[hit], node[hit]


def forest(codes: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of each group's graph: fingerprint, root fingerprint."""
    index = GrayIndex(codes, group)
    label = np.arange(len(codes))
    for a, b in index.links(distance):
        while True:
            x, y = label[a], label[b]
            low = np.minimum(x, y)
            if (x == y).all():
                break
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label != label[label]).any():
                label = label[label]
    while (label != label[label]).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return index.codes[moved], index.codes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the groups of a sorted partition; a group may go over several batches."""

    def linked(rows: pa.Table) -> pa.RecordBatch:
        frame = rows.combine_chunks()
        codes = frame["fingerprint"].to_numpy().view(np.uint64)
        keys = np.stack([frame[c].to_numpy() for c in ("mask", "key", "low", "high")])
        change = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        u, v = forest(codes, np.r_[0, np.cumsum(change)])
        return pa.record_batch([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])

    closed: list[pa.RecordBatch] = []  # whole groups
    going: list[pa.RecordBatch] = []  # ends with a group that may go on
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
        other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        if len(other):
            last = int(other[-1]) + 1
            closed += [*going, batch.slice(0, last)]
            going = [batch.slice(last)]
        else:
            going.append(batch)
        if sum(b.num_rows for b in closed) >= GROUP:
            yield linked(pa.Table.from_batches(closed))
            closed = []
    if rest := [b for b in closed + going if b.num_rows]:
        yield linked(pa.Table.from_batches(rest))


def links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``codes`` (distinct ``fingerprint`` longs) to links (u, v) that connect what is near."""
    masks = F.explode(F.array(*[F.lit(m) for m in block_masks(BLOCKS, distance)])).alias("mask")
    keyed = codes.select("fingerprint", masks).withColumn(
        "key", F.col("fingerprint").bitwiseAND(F.col("mask"))
    )
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    meeting = (
        keyed.join(sizes, ["mask", "key"])
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "mask",
            "key",
            F.least("part", "other").alias("low"),
            F.greatest("part", "other").alias("high"),
            "fingerprint",
        )
    )
    dealt = meeting.repartition("mask", "key", "low", "high").sortWithinPartitions(
        "mask", "key", "low", "high"
    )
    return dealt.mapInArrow(_forests, "u long, v long").distinct()


def with_components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints`` (stored; ``doc_id, fingerprint`` and more) with ``component_id``."""
    codes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    found = components(links(codes.select("fingerprint"), distance))
    rooted = codes.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select(
        F.col("fingerprint").alias("__f"), "component_id", F.col("root").alias("component")
    )
    return prints.join(classes, F.col("fingerprint") == F.col("__f")).drop("__f")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` in hexadecimal, ``component_id``."""
    prints = stored(with_fingerprint(docs.select("doc_id", "text")).drop("text"))
    return with_components(prints).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, nulls last.

    Of repeated rows one stays. Texts are fingerprinted once: the documents are stored with
    fingerprint and a row key, and rejoined on that key.
    """
    columns = docs.columns
    keyed = stored(
        with_fingerprint(docs, into="__print").withColumn("__row", F.monotonically_increasing_id())
    )
    prints = keyed.select(
        F.col("doc_id"), F.col("__print").alias("fingerprint"), F.col("__row").alias("row")
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    kept = with_components(prints).groupBy("component").agg(best).select(F.col("best.row").alias("__kept"))
    return keyed.join(kept, F.col("__row") == F.col("__kept"), "left_semi").select(*columns)
