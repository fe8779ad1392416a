"""Helpers for operators on vectors of whole numbers: rows that take part, exact integers and sums.

Components are scaled and floored to integers and everything after that is exact. Blocks of
ordinary numbers are int64 arrays; a block with numbers so large that squares would not fit holds
Python integers instead, and the same code runs on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Vectors that a Python task works on at once.
BLOCK_ROWS = 2048
#: Sums travel in digits of this many bits, so that Spark adds them up exactly whatever their size.
DIGIT_BITS = 32

SUMS = "slot int, digit int, value long"


def sound(column: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.expr(f"{column} is not null and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")


def gathered(batches: Iterable[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or a little more, the last one with what is left."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _floor(x: float, scale: int) -> int:
    """``floor(scale * x)`` of any finite double; from 2**52 on a double is a whole number."""
    return int(x) * scale if abs(x) >= 2.0**52 else math.floor(scale * x)


def whole(vectors: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of a column of vectors of one length; ``scale`` is a power of two."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() >= 2.0**40:
        flat = np.array([_floor(x, scale) for x in flat.tolist()], object)
    else:
        flat = np.floor(flat * scale).astype(np.int64)
    return flat.reshape(len(vectors), -1)


def alike(rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 where squared sums of their differences fit, else both as Python integers."""
    limit = 2**30 // max(rows.shape[1], 1)
    for a in (rows, others):
        if a.size and max(abs(int(a.max())), abs(int(a.min()))) > limit:
            return rows.astype(object), others.astype(object)
    return rows.astype(np.int64), others.astype(np.int64)


def as_long(numbers: Iterable) -> pa.Array:
    """Integers as a long column; null where a long can't hold one."""
    if isinstance(numbers, np.ndarray) and numbers.dtype == np.int64:
        return pa.array(numbers)
    return pa.array([int(x) if -(2**63) <= x < 2**63 else None for x in numbers], pa.int64())


def digits(slots: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    """Rows of ``SUMS`` for ``(slot, integer)`` pairs; digits have the integer's sign."""
    out: list[tuple[int, int, int]] = []
    for slot, number in slots:
        sign, left, digit = (-1 if number < 0 else 1), abs(int(number)), 0
        while left:
            out.append((slot, digit, sign * (left & ((1 << DIGIT_BITS) - 1))))
            left, digit = left >> DIGIT_BITS, digit + 1
    slot, digit, value = zip(*out) if out else ((), (), ())
    types = (pa.int32(), pa.int32(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip((slot, digit, value), types)], ["slot", "digit", "value"])


def added_up(parts: DataFrame) -> dict[int, int]:
    """Exact totals by slot, from each task's ``digits``."""
    total: dict[int, int] = {}
    for r in parts.groupBy("slot", "digit").agg(F.sum("value").alias("value")).collect():
        total[r.slot] = total.get(r.slot, 0) + (r.value << (DIGIT_BITS * r.digit))
    return total


def group_sums(rows: np.ndarray, groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of each of ``n`` groups of rows."""
    count = np.bincount(groups, minlength=n)
    sums = np.zeros((n, rows.shape[1]), rows.dtype)
    used = np.flatnonzero(count)
    starts = np.r_[0, np.cumsum(count)][used]
    sums[used] = np.add.reduceat(rows[np.argsort(groups, kind="stable")], starts, axis=0)
    return count, sums
