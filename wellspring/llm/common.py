"""Helpers of the operators in this subpackage: tables, and words of Arrow text columns.

A word is a maximal run of characters other than space and the controls 09 to 0D. These are
single bytes in UTF-8, so words are found on the bytes of a whole batch at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shipping import ship
from ..sources.tables import stored  # noqa: F401  (re-exported to the operators)

#: Rows of one Arrow batch. Texts may be long; a batch of them has to fit beside the others.
BATCH_ROWS = 1000
#: Bytes of text that a Python task works on at once (one longer text is a block by itself).
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the Python operators rely on."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each."""
    _, offsets = text_bytes(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each starts (one more entry at the end); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, ``n`` at least."""
    size = 1 << max(n, BLOCK_BYTES + 1).bit_length()
    return _powers(size)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a block of texts: byte ranges, the row of each, 64-bit hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        blank = np.ones(len(self.data) + 2, bool)
        blank[1:-1] = SPACE[self.data]
        opens = blank[:-1] & ~blank[1:]  # opens[i]: byte i begins a run
        closes = ~blank[:-1] & blank[1:]  # closes[i]: byte i - 1 ends one
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        inside = cuts[~blank[cuts] & ~blank[cuts + 1]]  # two texts meet within a run
        opens[inside] = closes[inside] = True
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes)
        self.rows = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.rows, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])


def sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive word hashes (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + hashes[i : i + n]
    return mixed(out)
