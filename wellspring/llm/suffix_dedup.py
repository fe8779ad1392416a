"""Repeated passages across documents, by sparse suffix arrays.

A passage is a window of ``MIN_WORDS`` words. Of its ``GRAM``-word sequences the one with the smallest
hash, the first of equal ones, is its minimiser. It is chosen by the words of the window alone,
so equal windows hold equal minimisers at equal places, and every window belongs to just one: its
minimiser. Suffixes are kept at minimisers only. Consecutive windows with one minimiser make an
anchor: the words that they cover, their number, and the minimiser's place.

Anchors with equal words (copies of documents, the inside of long passages) hold equal windows:
they are settled by a grouped minimum, and one of each kind goes on. Where a minimiser has
several kinds in several documents, their suffixes (at most ``MIN_WORDS`` words) are sorted over all
tasks, and each is compared with its neighbours of other documents, before and after: no suffix of
another document has more leading words in common with it than these. That is how far a match
reaches right of the minimiser. From there matches are extended left: a window counts only if
its right part is within that reach, and its whole content, left part included, is compared by a
64-bit hash beside the minimiser's; the smallest document of each window is again a grouped
minimum. (The neighbour alone may have other words on the left while a farther suffix has the
right ones; a window's minimum sees both.) The repeated windows of an anchor overlap, so they are
one stretch of words.

The first document (smallest id, null last) keeps a passage, later ones lose it. Repetition
within a document is left alone.

How it stays bounded: anchors are narrow rows, about one for 20 words. The sort's key ends with
the words on the left, so a passage with many openings is cut over many tasks. A task goes
through its suffixes batch by batch. Those at a task's border, whose neighbour may be in another task,
are taken as matching throughout, which costs windows but loses none. Groups are only counted or
reduced to minima, which Spark does before the shuffle; what a group says goes back to its rows by
a join of two stored tables, so that AQE can split the rows of a frequent line over many tasks.
No task holds a group.

Cases: null, empty and short texts have no passage. Rows with one id are one document; rows that
repeat both id and text share their result. Where words come back in short turns (one word, a
pair of words, over and over) equal anchors of a document that overlap are one row. Long texts are
read in whole. An empty table gives an empty result. Extra columns
pass through ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import Words, blocks, mixed, powers, prepare, sequences, stored

MIN_WORDS = 50
GRAM = 11
LAST = 2**63 - 1

#: ``pos`` and ``until`` are the first and last place of the minimiser, ``l`` the words before it.
ANCHOR = "doc long, rid long, h long, ctx long, pos int, until int, l int, n int"
#: ``words`` are the suffix's words within the anchor as 32-bit hashes, ``windows`` hashes of its windows.
SUFFIX = "h long, ctx long, doc long, l int, words binary, windows array<bigint>"
WINDOW = "h long, ctx long, doc long, w long, i int"


def minimisers(words: Words, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Minimisers: positions (among all words of the block), hashes, first windows, numbers of windows."""
    window = min_words - gram + 1
    grams = sequences(words.hashes, gram)
    if len(grams) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The position in the low bits makes the first of equal sequences the smallest. Half of the
    # bits are always the hash, so that the choice is the same in every block.
    low = np.uint64(2**32 - 1)
    least, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * span <= window:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    n = len(grams) - window + 1
    least = np.minimum(least[:n], least[window - span :][:n])
    whole = np.flatnonzero(words.rows[:n] == words.rows[min_words - 1 :][:n])
    picked, at, count = np.unique((least[whole] & low).astype(np.int64), return_index=True, return_counts=True)
    return picked, grams[picked], whole[at], count


def _sums(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Running sums for hashes of word ranges, and what shifts a range to the beginning."""
    up, down = powers(len(words.hashes) + 1)
    sums = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(words.hashes * up[: len(words.hashes)], out=sums[1:])
    return sums, down


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ANCHOR.split(", ")]
    for batch in batches:
        docs, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, last in blocks(batch.column(2)):
            words = Words(batch.column(2).slice(first, last - first))
            at, hashes, start, n = minimisers(words)
            if not len(at):
                continue
            sums, down = _sums(words)
            around = mixed((sums[start + n - 1 + MIN_WORDS] - sums[start]) * down[start])
            around = mixed(around + ((at - start) * 64 + n).astype(np.uint64))
            # Equal anchors of a row that follow within a window cover all words from the first to
            # the last of them.
            order = np.lexsort((at, around, hashes, words.rows[at]))
            keys = np.stack([words.rows[at].astype(np.uint64), hashes, around])[:, order]
            new = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (np.diff(at[order]) > MIN_WORDS)]
            one = order[new]
            until = at[order[np.r_[np.flatnonzero(new)[1:], len(order)] - 1]]
            row = words.rows[at[one]]
            yield pa.record_batch(
                [
                    pa.array(docs[first:last][row]),
                    pa.array(rids[first:last][row]),
                    pa.array(hashes[one].view(np.int64)),
                    pa.array(around[one].view(np.int64)),
                    pa.array((at[one] - words.first[row]).astype(np.int32)),
                    pa.array((until - words.first[row]).astype(np.int32)),
                    pa.array((at[one] - start[one]).astype(np.int32)),
                    pa.array(n[one].astype(np.int32)),
                ],
                names,
            )


def _identified(docs: DataFrame) -> DataFrame:
    """``doc`` (id, null last), ``rid`` (hash of the text), ``text``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text).alias("rid"),
        text.alias("text"),
    )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes at the wanted anchors' minimisers, and a hash of each of the anchors' windows."""
    names = [c.split()[0] for c in SUFFIX.split(", ")]
    for batch in batches:
        for first, last in blocks(batch.column(2)):
            doc, _, text, wanted = (c.slice(first, last - first) for c in batch.columns)
            words = Words(text)
            sums, down = _sums(words)
            row = np.repeat(np.arange(last - first), pc.list_value_length(wanted).to_numpy())
            flat = wanted.flatten()
            h, ctx, pos, before, n = (pc.struct_field(flat, f).to_numpy() for f in ("h", "ctx", "pos", "l", "n"))
            place = words.first[row] + pos
            inner, outer = _ranges(place, n + MIN_WORDS - 1 - before)
            short = (words.hashes[inner] >> np.uint64(32)).astype(">u4").tobytes()
            suffixes = pa.Array.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer((4 * outer).astype(np.int32)), pa.py_buffer(short)]
            )
            at, ends = _ranges(place - before, n)
            hashes = mixed((sums[at + MIN_WORDS] - sums[at]) * down[at]).view(np.int64)
            windows = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes))
            columns = [pa.array(c) for c in (h, ctx, doc.to_numpy()[row], before.astype(np.int32))]
            yield pa.record_batch([*columns, suffixes, windows], names)


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``start[i], .. start[i] + n[i] - 1`` for all i, and where each i's begin."""
    ends = np.r_[0, np.cumsum(n)]
    return np.arange(ends[-1]) + np.repeat(start - ends[:-1], n), ends


def _common(h: np.ndarray, docs: np.ndarray, suffixes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Leading words in common with the nearest row of another document: before, after.

    Rows are in order. Those that see only rows of their own document on a side have
    ``MIN_WORDS`` there.
    """
    size = len(h)
    length = pc.binary_length(suffixes).to_numpy() // 4
    words = np.zeros((size, MIN_WORDS), np.uint32)
    inside = np.arange(MIN_WORDS) < length[:, None]
    words[inside] = np.frombuffer(b"".join(suffixes.to_pylist()), ">u4")
    unlike = (words[1:] != words[:-1]) | ~(inside[1:] & inside[:-1])
    near = np.where(unlike.any(axis=1), unlike.argmax(axis=1), MIN_WORDS)
    near[h[1:] != h[:-1]] = 0
    before, after = np.r_[MIN_WORDS, near], np.r_[near, MIN_WORDS]
    cuts = np.r_[0, np.flatnonzero(docs[1:] != docs[:-1]) + 1, size]
    for run in np.flatnonzero(np.diff(cuts) > 1):  # rows of one document that follow each other
        a, b = cuts[run], cuts[run + 1]
        before[a:b] = np.minimum.accumulate(near[a - 1 : b - 1]) if a else MIN_WORDS
        after[a:b] = np.minimum.accumulate(near[a:b][::-1])[::-1] if b < size else MIN_WORDS
    return before, after


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose right parts a neighbouring suffix shares. Rows come in order."""
    names = [c.split()[0] for c in WINDOW.split(", ")]
    held: pa.RecordBatch | None = None  # the last row of another document, and the rows after it
    seen = 0  # how many rows of ``held`` were given out already
    for batch in _with_end(batches):
        if batch is not None and not batch.num_rows:
            continue
        parts = [b for b in (held, batch) if b is not None]
        if not parts:
            return
        rows = pa.concat_batches(parts)
        docs = rows.column(2).to_numpy()
        before, after = _common(rows.column(0).to_numpy(), docs, rows.column(4))
        # The last document's rows wait for the batch that follows.
        other = np.flatnonzero(docs != docs[-1])
        until = rows.num_rows if batch is None else (other[-1] + 1 if len(other) else 0)
        some = rows.slice(seen, until - seen)
        reach = np.maximum(before, after)[seen:until]
        left = some.column(3).to_numpy()
        values = some.column(5)
        n = pc.list_value_length(values).to_numpy()
        # Window i has left - i words before the minimiser and the rest from it on.
        count = np.clip(reach - MIN_WORDS + left + 1, 0, n)
        starts = np.r_[0, np.cumsum(n)][:-1]
        at, _ = _ranges(starts, count)
        row = np.repeat(np.arange(len(n)), count)
        h, ctx, doc = (some.column(c).to_numpy()[row] for c in range(3))
        hashes = values.flatten().to_numpy()[at]
        yield pa.record_batch(
            [pa.array(c) for c in (h, ctx, doc, hashes, (at - starts[row]).astype(np.int32))], names
        )
        first = max(0, until - 1)
        held, seen = rows.slice(first), until - first


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document with repeats: ``doc, rid, spans`` (word ranges ``start, end, source``)."""
    prepare(docs.sparkSession)
    named = _identified(docs)
    anchors = stored(named.mapInArrow(_anchors, ANCHOR))
    place = F.struct("doc", "rid", "pos", "l", "n")
    classes = stored(anchors.groupBy("h", "ctx").agg(F.min(place).alias("first"), F.max("doc").alias("last")))
    # One anchor of each kind, where a minimiser has several kinds in several documents.
    several = classes.groupBy("h").agg(F.min("first.doc").alias("a"), F.max("first.doc").alias("b")).where("a < b")
    wanted = classes.join(stored(several.select("h")), "h").select("h", "ctx", "first.*")
    by_doc = wanted.groupBy("doc", "rid").agg(
        F.collect_list(F.struct("h", "ctx", "pos", "l", "n")).alias("wanted")
    )
    suffixes = stored(
        named.join(by_doc, ["doc", "rid"]).select("doc", "rid", "text", "wanted").mapInArrow(_suffixes, SUFFIX)
    )
    order = ["h", "words", "ctx", "doc"]
    windows = stored(
        suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, WINDOW)
    )
    least = windows.groupBy("h", "w").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    earlier = stored(least.where("least < most").select("h", "w", "least"))
    marks = (
        windows.join(earlier, ["h", "w"])
        .where("least < doc")
        .groupBy("h", "ctx")
        .agg(F.min("i").alias("low"), F.max("i").alias("high"), F.min("least").alias("least"))
    )
    repeated = stored(
        classes.join(marks, ["h", "ctx"], "left")
        .where("last > first.doc or least is not null")
        .select("h", "ctx", F.col("first.doc").alias("owner"), "low", "high", "least")
    )
    # Documents after the first with these words lose all of them, the first its repeated windows.
    later = F.col("doc") > F.col("owner")
    start = F.col("pos") - F.col("l") + F.when(later, 0).otherwise(F.col("low"))
    end = F.col("until") - F.col("l") + F.when(later, F.col("n") - 1).otherwise(F.col("high")) + MIN_WORDS
    span = F.struct(start.alias("start"), end.alias("end"), F.least("owner", "least").alias("source"))
    spans = (
        anchors.join(repeated, ["h", "ctx"])
        .where(later | F.col("least").isNotNull())
        .select("doc", "rid", span.alias("s"))
    )
    merged = """aggregate(sort_array(all), cast(array() as array<struct<start:int,end:int,source:bigint>>),
        (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).end,
          concat(slice(acc, 1, size(acc) - 1), array(named_struct(
            'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end),
            'source', least(element_at(acc, -1).source, x.source)))),
          concat(acc, array(x))))"""
    return (
        spans.groupBy("doc", "rid")
        .agg(F.collect_set("s").alias("all"))
        .select("doc", "rid", F.expr(merged).alias("spans"))
    )


def repeats(docs: DataFrame) -> DataFrame:
    """A row for each repeated passage: its document, word range, and the first document."""
    one = repeated_spans(docs).select("doc", F.explode("spans").alias("s"))

    def shown(c: str) -> Column:
        return F.when(F.col(c) < LAST, F.col(c))

    return one.select(
        shown("doc").alias("doc_id"),
        F.col("s.start").cast("long").alias("start_word"),
        F.col("s.end").cast("long").alias("end_word"),
        (F.col("s.end") - F.col("s.start")).cast("long").alias("n_words"),
        shown("s.source").alias("first_doc_id"),
    )


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans; white space after a cut word goes with it."""
    out = []
    for text, ranges in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if ranges:
            raw = text.encode()
            words = Words(pa.array([text]))
            ends = np.r_[words.starts, len(raw)]
            kept, at = [], 0
            for r in ranges:
                kept.append(raw[at : ends[r["start"]]])
                at = int(ends[r["end"]])
            text = b"".join([*kept, raw[at:]]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of later documents, ``n_chars`` counted anew.

    Documents of which no word is left go; those that had none before stay.
    """
    own = docs.columns
    spans = repeated_spans(docs).select(F.col("doc").alias("__doc"), F.col("rid").alias("__rid"), "spans")
    apart = docs.select(
        F.struct(*own).alias("own"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__rid"),
    )
    cut = apart.join(spans, ["__doc", "__rid"], "left").withColumn(
        "__new", F.when(F.col("spans").isNotNull(), _cut(F.col("own.text"), F.col("spans")))
    )

    def column(c: str) -> Column:
        old = F.col("own")[c]
        if c not in ("text", "n_chars"):
            return old.alias(c)
        new = F.col("__new") if c == "text" else F.char_length("__new").cast(docs.schema[c].dataType)
        return F.when(F.col("spans").isNull(), old).otherwise(new).alias(c)

    left = F.col("spans").isNull() | F.col("__new").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(left).select(*map(column, own))
