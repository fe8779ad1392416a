"""Mixing sources to target weights by pivotal dependent rounding; built-ins only.

Every source gets a target number of words, a share of all words by weight that stops at ``MOST``
times its own. A document then stands for ``target / source_size`` copies. The whole copies are
taken; the fractions are rounded dependently, so that a source's words stay what they are: two
documents meet, a random direction moves words from one to the other until one of them has none or
all of its fraction, with odds that keep each document's expected copies. That one is settled; the
other meets the next.

The meetings form a tree. Documents are dealt by hash into chunks of about ``CHUNK``, each chunk
of a source is folded in its row and leaves one unsettled document, the residuals of ``CHUNK``
neighbouring chunks are folded next, and so on until each source has one chunk. A source of any
size is spread over all chunks, and a level has a ``CHUNK``-th of the rows of the one before. The
last unsettled document of a source keeps its fraction: of it only that part of the words is taken
(``partial`` is true), so that a source's words differ from its target by less than one word (and
2 ** -16 words a document).

Words are counted in units of 2 ** -16, and all of the rounding is integer arithmetic. Draws come
from digits of md5 over the two documents that meet, so reruns and retries agree.

Targets: with weight ``w`` and limit ``m`` of each source, the shares are ``min(m, level * w)`` for
the one level at which they add up to all words. The level rises from "no source stopped" by rounds
over the table of sources until no other source stops; the driver holds three numbers.

Rows: only ``(source, id, size)`` is shuffled, with equal rows counted in one; the tree sees each
such row once, and the copies of equal rows are dealt among them by count.

Cases: null texts and texts without words have size 0 and take nothing. A null source is a source,
the last one. Repeated rows and ids each count. Sources of no words have the target 0; an empty
table gives an empty result. Extra columns, whatever their names, are ignored. Texts are counted
in whole, however long.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored
from .spread import join_facts

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: No source gets more than this many times its words.
MOST = 3
UNIT = 1 << 16
CHUNK = 64
#: Equal rows are dealt out in blocks of this many.
DEALT = 10_000
WORD = r"[^\x20\x09-\x0D]+"

_KEY = ["source", "doc_id", "size"]
#: What all documents of a source share, and what a document brings into the meetings.
_SOURCE = ["source", "source_size", "target", "whole"]
_DOC = ["draw", "doc_id", "size", "alike", "more", "full", "held"]


def sizes(docs: DataFrame, column: str = "text") -> DataFrame:
    """``source, doc_id, size, copies_of``: equal rows in one, with their number."""
    count = F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("source", "doc_id", count.alias("size")).groupBy(*_KEY).agg(F.count("*").alias("alike"))


def ranked_sources(units: DataFrame) -> DataFrame:
    """``source, source_size, docs, weight`` with weights in the order of the sources.

    Sources are sorted in ranges; a source's place is its place in the range and the sizes of the
    ranges before. Ranges are stored, since sampling may cut them elsewhere when run anew.
    """
    spark = units.sparkSession
    per_source = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.count("*").alias("docs")
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_ranges = stored(
        per_source.repartitionByRange(ranges, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = in_ranges.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return (
        in_ranges.withColumn("place", place)
        .join(starts, "part")
        .withColumn("weight", F.get(weights, F.pmod(F.col("start") + F.col("place"), F.lit(len(WEIGHTS))).cast("int")).cast("long"))
        .select("source", "source_size", "docs", "weight")
    )


def with_targets(sources: DataFrame) -> DataFrame:
    """``sources`` with ``target``: the words each is to give."""
    limit = MOST * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, weight, stopped = total, 0, -1
    while True:
        # A source stops at its limit where its share of what is left would exceed it.
        stops = (
            F.col("weight").cast("decimal(38,0)") * left > limit.cast("decimal(38,0)") * weight
            if stopped >= 0
            else F.lit(False)
        )
        row = sources.agg(
            F.sum(F.when(stops, limit)).alias("given"),
            F.sum(F.when(~stops, F.col("weight"))).alias("weight"),
            F.count_if(stops).alias("stopped"),
        ).first()
        if row.stopped == stopped or not row.weight:
            break
        left, weight, stopped = total - (row.given or 0), row.weight, row.stopped
    share = F.col("weight").cast("double") * float(left) / float(weight or 1)
    return sources.withColumn("target", F.when(stops, limit.cast("double")).otherwise(share))


def with_fractions(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Each unit's whole copies, and ``held``: the fraction of one more, in units of words.

    Equal rows share out their fractions first: ``more`` of them have one more copy, one has the
    rest as its fraction, the others have none.
    """
    copies = F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(float(MOST)))
    fraction = F.floor((F.col("copies") - F.col("whole")) * F.col("size") * float(UNIT))
    return (
        join_facts(units, sources.drop("weight"), "source", "docs")
        .withColumn("copies", F.coalesce(copies, F.lit(0.0)))
        .withColumn("whole", F.floor("copies"))
        .withColumn("full", F.col("size") * UNIT)
        .withColumn("share", fraction * F.col("alike"))
        .withColumn("more", F.when(F.col("full") > 0, F.expr("share div full")).otherwise(0))
        .withColumn("held", F.when(F.col("full") > 0, F.expr("share % full")).otherwise(0))
        .drop("share", "copies")
    )


def _meet(a: Column, x: Column) -> Column:
    """The open document and the next one move words until one of them is settled."""
    open_ = a["open"]
    up = F.least(open_["full"] - open_["held"], x["held"])  # words that the open one may get
    down = F.least(open_["held"], x["full"] - x["held"])  # words that it may give
    moved = F.when(x["odds"] * (up + down) < down, up).otherwise(-down)
    its, other = open_["held"] + moved, x["held"] - moved
    settled = (its == 0) | (its == open_["full"])
    first, second = open_.withField("held", its), x.withField("held", other)
    return F.struct(
        F.when(settled, second).otherwise(first).alias("open"),
        F.concat(a["settled"], F.array(F.when(settled, first).otherwise(second))).alias("settled"),
    )


def _folded(level: DataFrame, number: int) -> DataFrame:
    """Every chunk's documents in one row: the settled ones, and the open one."""
    odds = F.conv(F.substring(F.md5(F.concat(F.lit(f"{number}|"), "draw")), 1, 13), 16, 10).cast("double") / 2.0**52
    doc = F.struct(*_DOC, odds.alias("odds"))
    chunks = level.groupBy(*_SOURCE, "bucket").agg(F.array_sort(F.collect_list(doc)).alias("chunk"))
    none = F.slice("chunk", 1, 0)
    start = F.struct(F.get("chunk", F.lit(0)).alias("open"), none.alias("settled"))
    met = F.aggregate(F.slice("chunk", F.lit(2), F.size("chunk")), start, _meet)
    return chunks.select(*_SOURCE, "bucket", met.alias("met"))


def settled(fractions: DataFrame) -> DataFrame:
    """The rows of ``with_fractions`` with every fraction none or all, but for one of each source."""
    is_open = (F.col("held") > 0) & (F.col("held") < F.col("full"))
    named = F.coalesce("source", F.lit("\x00")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    draw = F.md5(F.concat(named[0], F.lit("|"), named[1], F.lit("|"), F.col("size").cast("string")))
    rows = fractions.where(is_open).withColumn("draw", draw)
    chunks = max(1, math.ceil(rows.count() / CHUNK))
    bucket = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % chunks
    level, number = rows.withColumn("bucket", bucket), 0
    columns = [*_SOURCE, *[c for c in _DOC if c != "draw"]]
    out = [fractions.where(~is_open).select(*columns)]
    while True:
        folded = stored(_folded(level, number))
        out.append(folded.select(*_SOURCE, F.inline("met.settled")).select(*columns))
        level = folded.select(*_SOURCE, F.expr(f"bucket div {CHUNK}").alias("bucket"), "met.open.*").drop("odds")
        if chunks == 1:
            out.append(level.select(*columns))
            return functools.reduce(DataFrame.unionByName, out)
        chunks, number = math.ceil(chunks / CHUNK), number + 1


def mixed(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken of it.

    ``copies`` counts the whole copies; where ``partial``, ``taken`` has words of one more.
    """
    units = stored(sizes(docs, column))
    sources = stored(with_targets(ranked_sources(units)))
    rows = settled(stored(with_fractions(units, sources)))
    # Equal rows become rows again: the first have one more copy, the next one its fraction.
    block = F.explode(F.sequence(F.lit(0), F.expr(f"(alike - 1) div {DEALT}")))
    first = F.col("block") * DEALT
    row = F.explode(F.sequence(first, F.least(first + DEALT, F.col("alike")) - 1))
    rows = rows.withColumn("block", block).withColumn("row", row)
    held = F.when(F.col("row") < F.col("more"), F.col("full")).when(F.col("row") == F.col("more"), F.col("held")).otherwise(0)
    rows = rows.withColumn("held", held)
    part = F.expr(f"(held + {UNIT // 2}) div {UNIT}")
    one_more = ((F.col("full") > 0) & (F.col("held") == F.col("full"))).cast("long")
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + part).alias("taken"),
        (F.col("whole") + one_more).alias("copies"),
        ((F.col("held") > 0) & (F.col("held") < F.col("full"))).alias("partial"),
    )
