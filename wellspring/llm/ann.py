"""Approximate nearest neighbours by largest inner product, with an adaptive dimension scan.

Vectors get one more component, sqrt(largest squared norm - own squared norm), and queries a
zero there: the smallest distance is then the largest inner product. A random rotation (fixed
seed) makes every component carry an equal share of a distance on average. Vectors are put into
the list of their nearest centroid. A query probes its nearest lists. Within them the components
are read in blocks of columns; after each block a candidate is dropped if its partial distance
is too large, at the confidence ``EPSILON`` gives, for its whole distance to be among the
nearest. What is left has its full distance, and its score on the original vectors.

Centroids are fitted on the ``SAMPLE`` vectors with the smallest hashes of their ids; every
vector is in a list. How many lists to probe is measured, not assumed: for ``TRIALS`` queries the
true neighbours are found by brute force, and as many lists are probed as hold ``COVERED`` of
them; a query whose lists hold fewer than ``NEAREST`` other rows goes on to its next ones until
they do. Starting centroids are distinct vectors, and lists that end up empty are left out, so a
probe never goes to waste on one. Lists are dealt to cells of about ``CELL`` vectors; a longer list goes to several cells,
so that copies of one vector need not meet. A task holds one cell and streams the queries by.

Broadcast: centroids (at most ``LISTS``), the rotation, and the trial queries.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, neither
do rows without an id or with another number of components than most. A repeated query id is
searched once, with its smallest vector; repeated rows are candidates each. No row with the
query's id is its candidate. Equal scores go to the smaller id. An empty table gives an empty
result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import prepare, stored

NEAREST = 20
SAMPLE = 20_000
LISTS = 16_384
TRIALS = 64
COVERED = 0.97
CELL = 2048
BLOCK = 16
EPSILON = 2.1
ROUNDS = 8
FIRST = 64
SEED = 11


@dataclass(frozen=True)
class Index:
    """What every task needs: rotation, largest squared norm, centroids (rotated)."""

    rotation: np.ndarray
    largest: float
    centroids: np.ndarray

    def rotated(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        own = np.einsum("ij,ij->i", vectors, vectors)
        more = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(self.largest - own, 0))
        return np.column_stack([vectors, more]) @ self.rotation

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, up to a constant for each row."""
        return np.einsum("ij,ij->i", self.centroids, self.centroids) - 2 * rotated @ self.centroids.T


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def taking_part(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id, vec`` of the rows that can be compared."""
    fit = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec"))
    fit = fit.where("id is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    fit = fit.where("exists(vec, x -> x <> 0)")
    usual = fit.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fit.where(F.size("vec") == (usual.n if usual else 0))


def fit_index(fit: DataFrame) -> Index | None:
    """Centroids by k-means on a bounded sample, on the driver."""
    norm = F.expr("aggregate(vec, 0D, (a, x) -> a + x * x)")
    n, largest = fit.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return None
    sample = fit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    vectors = matrix(sample.column("vec").combine_chunks())
    size = vectors.shape[1] + 1
    random = np.random.default_rng(SEED)
    rotation, _ = np.linalg.qr(random.standard_normal((size, size)))
    index = Index(rotation, largest, np.zeros((0, size)))
    rows = index.rotated(vectors)
    distinct = np.unique(rows, axis=0)
    lists = min(LISTS, max(1, math.isqrt(n)), len(distinct))
    centroids = distinct[random.choice(len(distinct), lists, replace=False)]
    for _ in range(ROUNDS):
        nearest = Index(rotation, largest, centroids).distances(rows).argmin(axis=1)
        count = np.bincount(nearest, minlength=lists)
        order = np.argsort(nearest, kind="stable")
        used = np.flatnonzero(count)
        starts = np.r_[0, np.cumsum(count)][used]
        centroids[used] = np.add.reduceat(rows[order], starts) / count[used][:, None]
    return Index(rotation, largest, centroids)


def assign(fit: DataFrame, index: Index) -> DataFrame:
    """``id, vec, list``: the nearest centroid of every vector."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = index.distances(index.rotated(matrix(batch.column(1)))).argmin(axis=1)
            columns = [batch.column(0), batch.column(1), pa.array(lists.astype(np.int32))]
            yield pa.record_batch(columns, ["id", "vec", "list"])

    return fit.mapInArrow(nearest, "id long, vec array<double>, list int")


def probes_needed(assigned: DataFrame, index: Index, queries: DataFrame, nearest: int) -> int:
    """Lists to probe so that ``COVERED`` of the trial queries' true neighbours are in them."""
    trial = queries.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(TRIALS).toArrow()
    if not trial.num_rows:
        return len(index.centroids)
    ids = trial.column("id").to_numpy()
    vectors = matrix(trial.column("vec").combine_chunks())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = vectors @ matrix(batch.column(1)).T
                score[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
                k = min(nearest, batch.num_rows)
                at = np.argpartition(-score, k - 1, axis=1)[:, :k]
                who = np.repeat(np.arange(len(ids)), k)
                lists = batch.column(2).to_numpy()[at.ravel()]
                values = score[who, at.ravel()]
                yield pa.record_batch([pa.array(who), pa.array(lists), pa.array(values)], ["q", "list", "score"])

    found = assigned.mapInArrow(best, "q long, list int, score double").where("score > double('-inf')")
    # TRIALS x nearest rows.
    rows = top(found, "q", F.desc("score"), nearest).select("q", "list").collect()
    order = np.argsort(index.distances(index.rotated(vectors, queries=True)), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = sorted(int(place[r.q, r.list]) + 1 for r in rows)
    return needed[max(0, math.ceil(COVERED * len(needed)) - 1)] if needed else len(index.centroids)


def top(rows: DataFrame, key: str, *order_then_k) -> DataFrame:
    *order, k = order_then_k
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def probed(order: np.ndarray, sizes: np.ndarray, probes: int, wanted: np.ndarray) -> np.ndarray:
    """How many lists each query probes: ``probes``, or more until they hold ``wanted`` rows."""
    held = np.cumsum(sizes[order], axis=1)
    return np.clip((held < wanted[:, None]).sum(axis=1) + 1, min(probes, order.shape[1]), order.shape[1])


class Cell:
    """The vectors of one cell as blocks of columns."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, index: Index):
        self.ids, self.vectors, self.lists, self.index = ids, vectors, lists, index
        rotated = index.rotated(vectors)
        self.size = rotated.shape[1]
        self.blocks = [np.ascontiguousarray(rotated[:, i : i + BLOCK]) for i in range(0, self.size, BLOCK)]

    def scan(self, query: np.ndarray, rows: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be within ``limit`` and their squared distances."""
        partial, read = np.zeros(len(rows)), 0
        for block in self.blocks:
            width = block.shape[1]
            gap = block[rows] - query[read : read + width]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            read += width
            bar = limit * (1 + 1e-9)
            if read < self.size:
                bar = bar * read / self.size * (1 + EPSILON / math.sqrt(read)) ** 2
            near = partial <= bar
            rows, partial = rows[near], partial[near]
        return rows, partial

    def search(self, query_id: int, vector: np.ndarray, query: np.ndarray, place: np.ndarray, probes: int, nearest: int):
        """The cell's best rows among the ``probes`` nearest lists: ids and scores."""
        places = place[self.lists]
        rows = np.flatnonzero((places < probes) & (self.ids != query_id))
        if len(rows) > FIRST:
            rows = rows[np.argpartition(places[rows], FIRST)]
        limit, found, gaps = np.inf, np.zeros(0, np.int64), np.zeros(0)
        start, step = 0, FIRST
        while start < len(rows):
            some, partial = self.scan(query, rows[start : start + step], limit)
            found, gaps = np.r_[found, some], np.r_[gaps, partial]
            if len(gaps) >= nearest:
                limit = np.partition(gaps, nearest - 1)[nearest - 1]
            start, step = start + step, 8 * step
        left = found[gaps <= limit * (1 + 1e-9)]
        scores = (self.vectors[left] * vector).sum(axis=1)
        best = np.lexsort((self.ids[left], -scores))[:nearest]
        return self.ids[left][best], scores[best]


RESULT = "query_id long, vec_id long, score double"


def _search(batches: Iterator[pa.RecordBatch], index: Index, nearest: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, its vectors before the queries."""
    current, held, cell = None, [], None
    for batch in batches:
        cells, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])]) if len(cells) else []
        for a, b in zip(cuts, [*cuts[1:], len(cells)], strict=True):
            part = batch.slice(a, b - a)
            if cells[a] != current:
                current, held, cell = cells[a], [], None
            if not asks[a]:
                held.append(part)
                continue
            if cell is None:
                rows = pa.Table.from_batches(held).combine_chunks() if held else None
                if rows is not None:
                    vectors = matrix(rows["vec"].combine_chunks())
                    cell = Cell(rows["id"].to_numpy(), vectors, rows["list"].to_numpy(), index)
            if cell is None:
                continue
            vectors, ids = matrix(part.column(3)), part.column(2).to_numpy()
            rotated = index.rotated(vectors, queries=True)
            place = np.argsort(np.argsort(index.distances(rotated), axis=1, kind="stable"), axis=1)
            probes = part.column(4).to_numpy()  # queries carry it in place of a list
            out: list[tuple[np.ndarray, ...]] = []
            for i, query_id in enumerate(ids):
                found, scores = cell.search(query_id, vectors[i], rotated[i], place[i], probes[i], nearest)
                out.append((np.full(len(found), query_id), found, scores))
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.record_batch(columns, ["query_id", "vec_id", "score"])


def search(
    vectors: DataFrame,
    queries: DataFrame,
    nearest: int = NEAREST,
    id_column: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """Nearest rows of ``vectors`` for every row of ``queries`` (same columns)."""
    spark = prepare(vectors.sparkSession)
    fit = taking_part(vectors, id_column, column)
    index = fit_index(fit)
    if index is None:
        return spark.createDataFrame([], RESULT.replace("vec_id", "rank int, vec_id"))
    size = len(index.rotation) - 1
    asked = taking_part(queries, id_column, column).where(F.size("vec") == size)
    asked = asked.groupBy("id").agg(F.min("vec").alias("vec"))
    assigned = stored(assign(fit, index))
    # At most LISTS rows.
    counts = {r["list"]: r["count"] for r in assigned.groupBy("list").count().collect()}
    used = np.array(sorted(counts))
    renumbered = F.element_at(F.lit(np.searchsorted(used, np.arange(len(index.centroids))).tolist()), F.col("list") + 1)
    assigned = assigned.withColumn("list", renumbered.cast("int"))
    sizes = np.array([counts[i] for i in used])
    index = Index(index.rotation, index.largest, index.centroids[used])
    probes = probes_needed(assigned, index, asked, nearest)
    # Rows with the query's own id are no candidates: their number comes on top.
    own = assigned.groupBy("id").agg(F.count("*").alias("own"))
    asked = asked.join(own, "id", "left").select("id", "vec", F.coalesce("own", F.lit(0)).alias("own"))
    cells = max(16, math.ceil(sizes.sum() / CELL))
    parts = -(-sizes // CELL)
    firsts = np.r_[0, np.cumsum(parts)][:-1]  # numbers of the lists' parts, one after the other

    many = F.element_at(F.lit(parts.tolist()), F.col("list") + 1)
    first = F.element_at(F.lit(firsts.tolist()), F.col("list") + 1)
    placed = assigned.select(
        F.pmod(first + F.pmod(F.xxhash64("id", F.lit(SEED)), many), F.lit(cells)).cast("int").alias("cell"),
        F.lit(False).alias("ask"),
        "id",
        "vec",
        "list",
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = index.distances(index.rotated(matrix(batch.column(1)), queries=True))
            near = np.argsort(distances, axis=1, kind="stable")
            many = probed(near, sizes, probes, nearest + batch.column(2).to_numpy())
            goes = [
                np.unique(np.concatenate([np.arange(firsts[x], firsts[x] + parts[x]) for x in row[:n]]) % cells)
                for row, n in zip(near, many, strict=True)
            ]
            at = np.repeat(np.arange(len(goes)), [len(g) for g in goes])
            to = np.concatenate(goes) if goes else np.zeros(0, int)
            columns = [
                pa.array(to.astype(np.int32)),
                pa.array(np.ones(len(at), bool)),
                batch.column(0).take(pa.array(at)),
                batch.column(1).take(pa.array(at)),
                pa.array(many[at].astype(np.int32)),
            ]
            yield pa.record_batch(columns, ["cell", "ask", "id", "vec", "list"])

    sent = asked.mapInArrow(send, "cell int, ask boolean, id long, vec array<double>, list int")
    together = placed.unionByName(sent).repartition(cells, "cell").sortWithinPartitions("cell", "ask")
    found = together.mapInArrow(lambda b: _search(b, index, nearest), RESULT)
    ranked = top(found, "query_id", F.desc("score"), F.col("vec_id"), nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
