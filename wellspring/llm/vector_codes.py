"""Vector code compression: product codes with equal-average search for the nearest entry.

Vectors of whole numbers are cut into ``PARTS`` equal parts; each part position has a codebook of
``ENTRIES`` entries, fitted by rounds of assigning and averaging. A part's nearest entry is found
without looking at all: by the inequality of Cauchy and Schwarz, the squared difference of two
vectors' component sums, over their length, is at most their squared distance. So the entries are
sorted by their sums, the search starts where the part's own sum belongs, and goes outward to the
nearer sum of both sides until that bound strictly exceeds the best distance. An equal bound may
still hide an entry as near with a lower index, therefore "strictly".

Each round is one pass: a task adds up its parts by entry and emits at most
``PARTS * ENTRIES * (length / PARTS + 1)`` sums, which Spark adds up and the driver divides. The
codebooks are the only thing that travels to the tasks; their size doesn't depend on the rows.
Rounds end early when no entry moves, as all later ones would repeat it. Codes are stored before
errors are summed by label, and labels with many rows get their sums without a shuffle of these.

Cases: rows whose vector is null or holds null or non-finite components are dropped, and so are
vectors of another length than most rows have (ties: the shorter; the length is a multiple of
``PARTS``, empty vectors don't count). With fewer than ``ENTRIES`` rows there are as many entries.
Rows with null ids are coded like others and are the last to start a codebook; repeated ids and
rows each count, in the order of their vectors. Equal distances go to the lower index. Errors that
a long can't hold are null; codes are exact at any size. Null labels are one label. An empty table
gives an empty result. Extra columns, whatever their names, are ignored. Texts aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, stored
from .spread import join_facts
from .vectors import SUMS, added_up, alike, as_long, digits, gathered, group_sums, sound, whole

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]`` is an array of entries by components, as Python integers."""

    entries: tuple[np.ndarray, ...]

    @property
    def length(self) -> int:
        return sum(b.shape[1] for b in self.entries)

    def sha256(self) -> str:
        flat = (str(x) for book in self.entries for entry in book.tolist() for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The whole numbers that a code of two hex digits a part stands for."""
        at = bytes.fromhex(code)
        return [x for book, i in zip(self.entries, at, strict=True) for x in book[i].tolist()]


def nearest_by_average(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of its nearest entry (ties: lower) and the squared distance."""
    rows, book = alike(rows, book)
    (n, size), k = rows.shape, len(book)
    order = np.argsort(book.sum(axis=1), kind="stable")
    sums = book.sum(axis=1)[order]
    own = rows.sum(axis=1)
    right = np.searchsorted(sums, own)  # next entry to look at on either side
    left = right - 1
    index = np.full(n, -1)
    best = np.zeros(n, rows.dtype)
    running = np.arange(n)
    while len(running):
        s, lo, hi = own[running], left[running], right[running]
        below, above = s - sums[np.maximum(lo, 0)], sums[np.minimum(hi, k - 1)] - s
        upward = ((lo < 0) | ((hi < k) & (above < below))).astype(bool)
        gap = np.where(upward, above, below)
        fresh = index[running] < 0
        open_ = (lo >= 0) | (hi < k)
        go = (open_ & (fresh | (gap * gap <= size * best[running]))).astype(bool)
        running, upward = running[go], upward[go]
        entry = order[np.where(upward, right[running], left[running])]
        off = rows[running] - book[entry]
        distance = (off * off).sum(axis=1)
        first, old = index[running] < 0, best[running]
        better = (first | (distance < old) | ((distance == old) & (entry < index[running]))).astype(bool)
        index[running[better]], best[running[better]] = entry[better], distance[better]
        right[running] += upward
        left[running] -= ~upward
    return index, best


def kept(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str | None = None) -> DataFrame:
    """``id, vec`` and ``label`` of the rows that take part."""
    named = F.col(label) if label else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("vec"), named.alias("label"))
    rows = rows.where(sound("vec")).where(f"size(vec) > 0 and size(vec) % {PARTS} = 0")
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (usual.n if usual else 0))


def _cut(vectors: pa.Array) -> list[np.ndarray]:
    return np.split(whole(vectors, SCALE), PARTS, axis=1)


def _next(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floored mean of its parts; an unused one stays."""
    size = books.length // PARTS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in gathered(batches):
            for p, part in enumerate(_cut(batch.column(0))):
                index, _ = nearest_by_average(part, books.entries[p])
                count, added = group_sums(part, index, len(books.entries[p]))
                for e in np.flatnonzero(count):
                    slot = (p * ENTRIES + int(e)) * (size + 1)
                    for i, x in enumerate([count[e], *added[e]]):
                        total[slot + i] = total.get(slot + i, 0) + int(x)
        yield digits(total.items())

    total = added_up(rows.select("vec").mapInArrow(sums, SUMS))
    moved = []
    for p, book in enumerate(books.entries):
        book = book.copy()
        for e in range(len(book)):
            slot = (p * ENTRIES + e) * (size + 1)
            if count := total.get(slot, 0):
                book[e] = [total.get(slot + 1 + i, 0) // count for i in range(size)]
        moved.append(book)
    return Codebooks(tuple(moved))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from the rows that ``kept`` returns; None without rows."""
    prepare(rows.sparkSession)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").toArrow()
    if not first.num_rows:
        return None
    books = Codebooks(tuple(p.astype(object) for p in _cut(first.column("vec").combine_chunks())))
    for _ in range(rounds):
        after = _next(rows, books)
        if all((a == b).all() for a, b in zip(after.entries, books.entries, strict=True)):
            break
        books = after
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` of the codebooks' length with ``code`` and ``error`` in place of the vector."""
    columns = [f for f in rows.schema.fields if f.name != "vec"]
    names = [f.name for f in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", code string, error long"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            index = np.zeros((batch.num_rows, PARTS), np.uint8)
            error: np.ndarray | int = 0
            for p, part in enumerate(_cut(batch.column("vec"))):
                index[:, p], distance = nearest_by_average(part, books.entries[p])
                error = error + distance.astype(object)
            code = pa.array([row.tobytes().hex() for row in index])
            yield pa.record_batch([*[batch.column(n) for n in names], code, as_long(error)], [*names, "code", "error"])

    return rows.select(*names, "vec").mapInArrow(coded, schema)


def compressed(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """Codes and errors of all vectors, errors by label, and the hash of the codebooks."""
    rows = kept(vectors, id_column, column, label)
    books = fit(rows)
    if books is None:
        codes = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        codes = stored(encode(rows, books))
    # An error that is null, being too large for a long, makes its label's sum too large as well.
    whole_sum = F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(19,0)")))
    labels = codes.groupBy("label").agg(whole_sum.alias("total"), F.count("*").alias("n"))
    return join_facts(codes, labels, "label", "n").select(
        F.col("id").alias(id_column),
        "code",
        "error",
        F.expr("try_cast(total as bigint)").alias("label_error"),
        F.lit(books.sha256() if books else "").alias("codebooks_sha256"),
    )
