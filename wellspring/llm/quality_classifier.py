"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are fitted: one on target text (documents labelled as
good), one on raw text (all documents). The log importance weight of a document is the sum over
its n-grams of log p(target) - log p(raw). Gumbel noise is added to each weight; the documents
with the ``k`` largest sums are then a sample without replacement in proportion to the weights.

The n-grams are single words and pairs of words, and the same of word shapes (case, symbols,
length, repetition of the word before). ``k`` comes from labels that the models have not seen:
half of the labelled documents fit the target model, the other half finds the weight, without
noise, that separates good from bad best while keeping at least ``KEEP`` of the good ones; ``k``
is the number of documents whose weight without noise reaches it. The ``k``-th largest noisy
weight is found exactly, by counts of ranges that grow narrower (at most ``RANGES`` rows a round).

At most ``LABELS`` labelled documents are used, those with the smallest hashes of their ids;
they are broadcast (16 bytes each). The raw model counts every word of every document.

Cases: null and empty texts have weight 0. Equal noisy weights go by the smaller id, null last; rows
with equal weight and id share their result, so they may go beyond ``k``. A document with contradicting labels counts as bad;
labels without a document, or a null quality, are not used. Without good labels, or without any
held-out ones, every document is kept. Repeated rows get equal results. Long texts are weighed in
whole. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import Words, blocks, mixed, prepare, stored

BUCKETS = 1 << 14
LABELS = 50_000
KEEP = 0.995
RANGES = 1 << 12
LAST = 2**63 - 1
SEED = 7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = ~_LETTER
_SYMBOL[[ord(c) for c in ".,'-"]] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of a block of texts."""
    plain, words = Words(texts), Words(texts, lower=True)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = words.ends - words.starts

    def count(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of[plain.data])])
        return total[words.ends] - total[words.starts]

    upper, letters, symbols = count(_UPPER), count(_LETTER), count(_SYMBOL)
    pair = words.rows[1:] == words.rows[:-1]
    same = np.r_[False, (words.hashes[1:] == words.hashes[:-1]) & pair]
    case = np.where(upper == 0, 0, np.where((upper == 1) | (2 * upper < letters), 1, 2))
    shape = ((case * 4 + np.minimum(symbols, 3)) * 5 + np.minimum(size // 4, 4)) * 2 + same
    streams = []
    for salt, codes in ((1, words.hashes), (2, mixed(shape.astype(np.uint64) + np.uint64(1)))):
        streams.append((words.rows, codes + np.uint64(salt)))
        streams.append((words.rows[1:][pair], (codes[:-1] * np.uint64(31) + codes[1:])[pair] + np.uint64(salt)))
    rows = np.concatenate([r for r, _ in streams])
    buckets = np.concatenate([mixed(c) % np.uint64(BUCKETS) for _, c in streams])
    return rows, buckets.astype(np.int64)


def labelled(labels: DataFrame, limit: int = LABELS) -> DataFrame:
    """``__id, __good, __fit`` of at most ``limit`` labelled documents; half are for fitting."""
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("q")
    )
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return chosen.select(
        F.col("doc_id").alias("__id"),
        (F.col("q") == 1).alias("__good"),
        (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)) == 0).alias("__fit"),
    )


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by bucket, of a whole partition: raw text, target text."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = np.asarray(batch.column(1).to_pylist(), bool)
        for first, last in blocks(batch.column(0)):
            rows, buckets = features(batch.column(0).slice(first, last - first))
            counts[0] += np.bincount(buckets, minlength=BUCKETS)
            hit = target[first:last][rows]
            counts[1] += np.bincount(buckets[hit], minlength=BUCKETS)
    at = np.flatnonzero(counts[0])
    yield pa.record_batch(
        [pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"]
    )


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket: ``BUCKETS`` numbers, whatever the input."""
    prepare(docs.sparkSession)
    marked = docs.select("doc_id", "text").join(
        F.broadcast(labels.where("__good and __fit")), F.col("doc_id") == F.col("__id"), "left"
    )
    counted = (
        marked.select("text", F.col("__id").isNotNull().alias("target"))
        .mapInArrow(_tally, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    counts = np.zeros((2, BUCKETS))
    for r in counted.collect():
        counts[:, r.bucket] = r.raw, r.target
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    share = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def gumbel(*keys: Column) -> Column:
    """Standard Gumbel noise that depends on the keys only."""
    u = (F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return -F.log(-F.log(u))


def with_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with ``log_weight`` and ``noisy_weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf(T.DoubleType())
    def weigh(texts: pa.Array) -> pa.Array:
        sums = [np.zeros(0)]
        for first, last in blocks(texts):
            rows, buckets = features(texts.slice(first, last - first))
            sums.append(np.bincount(rows, shared.value[buckets], last - first))
        return pa.array(np.concatenate(sums))

    weighed = docs.withColumn("log_weight", weigh(F.col("text")))
    return weighed.withColumn("noisy_weight", F.col("log_weight") + gumbel(F.col("doc_id")))


def cutoff(weights: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """A weight with the best balanced accuracy among those that keep enough good ones.

    It lies halfway between the best that goes and the worst that stays.
    """
    if not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.r_[0, np.cumsum(g)] / g.sum()  # good ones below position i
    gone = np.r_[0, np.cumsum(~g)] / max(1, (~g).sum())
    first = np.r_[True, w[1:] != w[:-1], True]  # a cut never splits ties
    value = np.where(first & (1 - lost >= keep), gone - lost, -1.0)
    i = int(value.argmax())
    return float((w[i - 1] + w[i]) / 2) if 0 < i < len(w) else -np.inf


def kth(rows: DataFrame, column: str, k: int, largest: bool) -> float | int | None:
    """The ``k``-th largest or smallest value of a column of doubles or longs without nulls."""
    whole = isinstance(rows.schema[column].dataType, T.LongType)
    low, high, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    if not 0 < k <= n:
        return None
    while low < high:
        if whole:  # a product with RANGES is beyond a long
            share = f"cast(({column} - {low}BD) * {RANGES} div {high - low}BD as int)"
        else:
            share = f"cast(floor(({column} - {low!r}D) / ({high!r}D - {low!r}D) * {RANGES}) as int)"
        of = rows.where(F.col(column).between(low, high)).groupBy(F.expr(share).alias("range"))
        # At most RANGES + 1 rows.
        seen = of.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n")).collect()
        for r in sorted(seen, key=lambda r: r["range"], reverse=largest):
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def top_k(weighed: DataFrame, k: int) -> Column:
    """Member of the ``k`` largest ``(noisy_weight, -doc_id)`` of ``weighed``."""
    bar = kth(weighed, "noisy_weight", k, largest=True)
    if bar is None:
        return F.lit(k > 0)
    above, level = weighed.agg(
        F.count_if(F.col("noisy_weight") > bar), F.count_if(F.col("noisy_weight") == bar)
    ).first()
    member = F.col("noisy_weight") >= bar
    if above + level > k:
        ids = weighed.where(F.col("noisy_weight") == bar).select(_id().alias("id"))
        member &= (F.col("noisy_weight") > bar) | (_id() <= kth(ids, "id", k - above, largest=False))
    return member


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame, Column]:
    """The models' ratio, a stored table of ids and weights, and who is in the sample."""
    marks = stored(labelled(labels))
    ratio = fit(docs, marks)
    chosen = docs.select("doc_id", "text").join(
        F.broadcast(marks.where("not __fit")), F.col("doc_id") == F.col("__id")
    )
    held = with_weights(chosen, ratio)
    # One row per held-out label: bounded by LABELS.
    seen = held.groupBy("__id").agg(F.min("log_weight").alias("w"), F.first("__good").alias("g")).collect()
    threshold = cutoff(np.array([r.w for r in seen]), np.array([r.g for r in seen], bool))
    weighed = stored(with_weights(docs.select("doc_id", "text"), ratio).drop("text"))
    k = weighed.where(F.col("log_weight") >= F.lit(threshold)).count()
    return ratio, weighed, top_k(weighed, k)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, log_weight, noisy_weight, kept`` of every row."""
    _, weighed, kept = sampled(docs, labels)
    return weighed.withColumn("kept", kept)


def only_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns. Clashing names are set aside.

    Their weights are computed once more, which is cheaper than to store the texts beside them.
    """
    own = docs.columns
    ratio, _, kept = sampled(docs, labels)
    apart = docs.select("doc_id", "text", F.struct(*own).alias("__own"))
    return with_weights(apart, ratio).where(kept).select("__own.*")
