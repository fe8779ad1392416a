"""Centroid clustering: nearest centroids by the threshold algorithm, rounds of exact means.

Every dimension has the list of centroids sorted by their value in it. For a vector each list is
walked outward from the vector's own value, one entry of every list at a step. A centroid met for
the first time gets its exact distance. One not met yet is, in every dimension, at least as far as
the entry walked to last (the frontier), so its distance is at least the sum of the squared
frontier distances. The walk stops when that sum strictly exceeds the best distance; at an equal
sum a centroid as near with a smaller number could still come.

A round is one pass over the vectors: a task adds up its vectors by centroid and emits at most
``CENTROIDS * (SIZE + 1)`` sums. Only the centroids travel to the tasks. All numbers are exact:
components are integers, sums of any size are added up in digits. The sums of distances over the
clusters come from one aggregate of ``CENTROIDS`` rows; no vector is moved for them.

Cases: vectors that are null, hold null or non-finite components or have another number of
components than ``SIZE`` are dropped, with their rows. With fewer than ``CENTROIDS`` rows there are
as many centroids. Rows with null ids are clustered like others and are the last to start a
centroid; repeated rows each count, rows with one id in the order of their vectors. Equal distances
go to the smaller number. Distances and sums that a long can't hold are null. An empty table gives
an empty result. Extra columns, whatever their names, are ignored. Texts aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, stored
from .vectors import SUMS, added_up, alike, as_long, digits, gathered, group_sums, sound, whole

SCALE = 64
SIZE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = "1:"


def nearest_by_threshold(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its nearest centroid (ties: smaller) and the squared distance."""
    rows, centroids = alike(rows, centroids)
    (n, size), k = rows.shape, len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    dims = np.arange(size)
    right = np.stack([np.searchsorted(values[:, d], rows[:, d]) for d in dims], axis=1)
    left = right - 1
    far = math.inf if rows.dtype == object else np.iinfo(np.int64).max
    known = np.full((n, k), far, rows.dtype)  # exact distances of the centroids met so far
    met = np.zeros((n, k), bool)
    running = np.arange(n)
    for _ in range(k):
        v, lo, hi = rows[running], left[running], right[running]
        below, above = v - values[np.maximum(lo, 0), dims], values[np.minimum(hi, k - 1), dims] - v
        upward = ((lo < 0) | ((hi < k) & (above < below))).astype(bool)
        at = np.where(upward, hi, lo)
        frontier = np.where(upward, above, below)
        right[running], left[running] = hi + upward, lo - ~upward
        here = np.zeros((len(running), k), bool)
        here[np.arange(len(running))[:, None], order[at, dims]] = True
        r, c = np.nonzero(here & ~met[running])
        r = running[r]
        off = rows[r] - centroids[c]
        known[r, c] = (off * off).sum(axis=1)
        met[r, c] = True
        bound = (frontier * frontier).sum(axis=1)
        running = running[(bound <= known[running].min(axis=1)).astype(bool)]
        if not len(running):
            break
    cluster = known.argmin(axis=1)
    return cluster, known[np.arange(n), cluster]


def kept(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id, vec`` of the rows that take part."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("vec"))
    return rows.where(sound("vec")).where(F.size("vec") == SIZE)


def _next(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floored mean of its vectors; one without vectors stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in gathered(batches):
            vectors = whole(batch.column(0), SCALE)
            cluster, _ = nearest_by_threshold(vectors, centroids)
            count, added = group_sums(vectors, cluster, len(centroids))
            for c in np.flatnonzero(count):
                for i, x in enumerate([count[c], *added[c]]):
                    slot = int(c) * (SIZE + 1) + i
                    total[slot] = total.get(slot, 0) + int(x)
        yield digits(total.items())

    total = added_up(rows.select("vec").mapInArrow(sums, SUMS))
    moved = centroids.copy()
    for c in range(len(centroids)):
        slot = c * (SIZE + 1)
        if count := total.get(slot, 0):
            moved[c] = [total.get(slot + 1 + i, 0) // count for i in range(SIZE)]
    return moved


def fit(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids, as Python integers, from the rows that ``kept`` returns."""
    prepare(rows.sparkSession)
    draw = F.sha2(F.concat(F.lit(SEED), F.col("id").cast("string")), 256)
    first = rows.orderBy(draw.asc_nulls_last(), "vec").limit(CENTROIDS).select("vec").toArrow()
    centroids = whole(first.column("vec").combine_chunks(), SCALE).astype(object) if first.num_rows else np.zeros((0, SIZE), object)
    for _ in range(rounds if len(centroids) else 0):
        after = _next(rows, centroids)
        if (after == centroids).all():  # every later round would repeat this one
            break
        centroids = after
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every row."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            cluster, distance = nearest_by_threshold(whole(batch.column("vec"), SCALE), centroids)
            yield pa.record_batch([batch.column("id"), pa.array(cluster, pa.int32()), as_long(distance)], ["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "vec").mapInArrow(nearest, f"id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The cluster of every vector, sums of distances, and hashes of the centroids."""
    rows = kept(vectors, id_column, column)
    centroids = fit(rows)
    if not len(centroids):
        found = rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found = stored(assign(rows, centroids))
    # A distance that is null, being too large for a long, makes its sums too large as well.
    whole_sum = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(19,0)")))
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(whole_sum.alias("total")).collect()}
    inertia = None if None in sums.values() else sum(map(int, sums.values()))
    as_known = lambda x: F.lit(int(x) if x is not None and x < 2**63 else None).cast("long")
    text = [",".join(map(str, c)) for c in centroids.tolist()]
    of_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    hashes = [F.lit(hashlib.sha256(t.encode()).hexdigest()) for t in text]
    return found.select(
        F.col("id").alias(id_column),
        "cluster",
        "distance",
        of_cluster([as_known(sums.get(c, 0)) for c in range(len(text))]).cast("long").alias("cluster_inertia"),
        as_known(inertia).alias("inertia"),
        of_cluster(hashes).cast("string").alias("centroid_sha256"),
    )
