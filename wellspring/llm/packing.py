"""Packing documents into sequences of a fixed length by minimum bin slack.

A document's ids (and its end id) are cut into full sequences and a rest. The rests are packed
without further cuts: the longest rest opens a sequence, and a subset-sum over a bitset finds
which multiset of the remaining lengths fills the window closest to capacity. Only the bitset
before each length is kept; walking back over them gives the counts of each length. Rests are
dealt into groups of about ``GROUP``; a group ends with one sequence or two that are not full.

Ids are cut once. What is stored and shuffled is a few numbers for each piece, never the ids.

Cases: null and empty texts are the end id alone. Repeated rows and null ids are packed like
any others, since pieces are told apart by a key of their own. Long documents are cut over as many
sequences as they need. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import blocks, prepare, stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 2048
END_ID = 1
GROUP = 4096

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, key long"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding | None:
    """A faster encoder with the same ids, or None where merges don't follow the ids' order."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    vocab = content["model"]["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in content["model"]["merges"]]
    if merged != sorted(merged):
        return None
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(map(to_byte.__getitem__, w)): i for w, i in vocab.items() if w not in added}
    return tiktoken.Encoding(
        "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
    )


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(text: str, path: str = VOCABULARY) -> np.ndarray:
    fast = encoder(path)
    if fast is not None:
        ids = fast.encode(text, allowed_special="all")
    else:
        ids = tokenizer(path).encode(text, add_special_tokens=False).ids
    return np.array([*ids, END_ID], "<u4")


def cut(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY) -> DataFrame:
    """A row for each full sequence of a document and for its rest (``PIECE``)."""
    prepare(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last in blocks(batch.column(1)):
                columns: list[list[int | None]] = [[] for _ in range(6)]
                part = batch.slice(first, last - first)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = ids_of(text or "", path)
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), key)
                        key += 1
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "key"]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECE)


def fill(counts: dict[int, int], order: list[int], capacity: int) -> dict[int, int]:
    """How many of each length come closest to ``capacity``; ``order`` is tried in turn."""
    reach, full = 1, (1 << (capacity + 1)) - 1
    before: list[tuple[int, int]] = []
    for length in order:
        if length > capacity or not counts[length]:
            continue
        before.append((length, reach))
        for _ in range(min(counts[length], capacity // length)):
            more = (reach | reach << length) & full
            if more == reach:
                break
            reach = more
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, earlier in reversed(before):
        while not earlier >> total & 1:
            total -= length
            taken[length] = taken.get(length, 0) + 1
    return taken


def pack_lengths(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """Sequence number and offset of each length."""
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        waiting.setdefault(n, []).append(i)
    counts = {n: len(rows) for n, rows in waiting.items()}
    order = sorted(counts, reverse=True)
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    sequence = 0
    while order:
        longest = order[0]
        counts[longest] -= 1
        chosen = fill(counts, order, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        offset = 0
        for n, times in sorted(chosen.items(), reverse=True):
            counts[n] -= times
            for _ in range(times):
                placed[waiting[n].pop()] = (sequence, offset)
                offset += n
        order = [n for n in order if counts[n]]
        sequence += 1
    return placed


def pack(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset`` in that sequence."""
    pieces = stored(cut(docs, length, path))
    rests = pieces.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // GROUP))
    out = [c for c in pieces.columns if c != "key"]

    def packed(group: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        placed = np.array(pack_lengths(rows["length"].tolist(), length), np.int64)
        rows["sequence_id"] = 2 * ((np.int64(group[0]) << 32) + placed[:, 0])
        rows["offset"] = placed[:, 1]
        return rows[[*out, "sequence_id", "offset"]]

    schema = PIECE.replace(", key long", ", sequence_id long, offset long")
    # Full sequences get odd numbers from their own key, packed ones even numbers.
    whole = pieces.where(F.col("length") == length).select(
        *out, (2 * F.col("key") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    grouped = rests.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return whole.unionByName(grouped.groupBy("group").applyInPandas(packed, schema))
