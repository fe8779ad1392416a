"""Repeated passages in awkward texts, against all windows."""

import collections
import random

import pyarrow as pa
import pytest

from wellspring.llm import suffix_dedup
from wellspring.llm.common import Words


def prose(rnd, n, words=5000):
    return [f"w{rnd.randint(0, words)}" for _ in range(n)]


def cut(spark, texts):
    """Per document the words to cut: what is found, what all windows say."""
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeats(table.repartition(5)).collect():
        got[r.doc_id] |= {*range(r.start_word, r.end_word)}
        assert r.first_doc_id < r.doc_id
    first, want = {}, {}
    for i, w in enumerate(texts):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
        want[i] = {p for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for p in range(j, j + 50)}
    return {i: got[i] for i in want}, want


def test_turns_out_of_phase_and_phrases_said_twice(spark):
    rnd = random.Random(11)
    texts = []
    for turn in range(2, 40):
        said = prose(rnd, turn)
        for phase in (0, turn // 2, rnd.randrange(turn)):
            body = (said * (200 // turn + 2))[phase : phase + 150 + rnd.randrange(30)]
            texts.append([*prose(rnd, rnd.randrange(60)), *body, *prose(rnd, rnd.randrange(60))])
    for _ in range(60):
        phrase, passage = prose(rnd, rnd.randint(11, 20)), prose(rnd, rnd.randint(20, 40))
        texts.append([*prose(rnd, 30), *phrase, *prose(rnd, rnd.randint(1, 25)), *phrase, *passage, *prose(rnd, 30)])
        texts.append([*prose(rnd, 40), *phrase, *passage, *prose(rnd, 40)])
    rnd.shuffle(texts)
    got, want = cut(spark, texts)
    assert got == want and sum(map(len, want.values())) > 5000


def test_anchors_of_short_turns_are_few():
    for turn in range(1, 40):
        words = [f"w{i % turn}" for i in range(4000)]
        table = pa.record_batch([pa.array([1]), pa.array([1]), pa.array([" ".join(words)])], ["doc", "rid", "text"])
        assert sum(b.num_rows for b in suffix_dedup._anchors(iter([table]))) <= 60
    at, *_ = suffix_dedup.minimisers(Words(pa.array(["a b " * 200, "b a " * 200])))
    assert len(at)


def test_a_passage_of_many_openings_is_no_group_of_a_task(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def refuse(*_, **__):
        raise AssertionError("all rows of a key in one task")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", refuse)
    rnd = random.Random(12)
    passage = prose(rnd, 80)
    texts = [[*prose(rnd, 45), *passage, *prose(rnd, 20)] for _ in range(400)]
    got, want = cut(spark, texts)
    assert got == want and all(len(x) >= 80 for i, x in want.items() if i)


@pytest.mark.parametrize("seed", range(3))
def test_decoys_with_more_words_on_one_side(spark, seed):
    """An earlier document shares more words after, another one the passage itself."""
    rnd = random.Random(20 + seed)
    texts = []
    for _ in range(60):
        x, p, s = prose(rnd, 15), prose(rnd, 40), prose(rnd, rnd.randint(3, 30))
        three = [x + p, p + s, x + p + s]
        texts += [[*prose(rnd, 60), *t, *prose(rnd, 60)] for t in three]
    for _ in range(10):
        long = prose(rnd, 110)
        for _ in range(8):
            a = rnd.randrange(50)
            texts.append([*prose(rnd, 20), *long[a : a + rnd.randint(45, 100)], *prose(rnd, 20)])
    got, want = cut(spark, texts)
    assert got == want and sum(map(len, want.values())) > 60 * 55


def plain_windows(rows):
    """Windows that ``_neighbours`` must give: those whose right part another document has."""
    want = set()
    for h, ctx, doc, left, words, windows in rows:
        reach = 0
        for h2, _, doc2, _, words2, _ in rows:
            if h2 == h and doc2 != doc:
                same = 0
                while same < min(len(words), len(words2)) and words[same] == words2[same]:
                    same += 1
                reach = max(reach, same)
        want |= {(h, ctx, i) for i in range(len(windows)) if 50 - (left - i) <= reach}
    return want


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("n_docs", [2, 40])
def test_neighbours_reach_as_far_as_any_other_suffix(size, n_docs):
    rnd = random.Random(size + n_docs)
    rows = []
    for ctx in range(300):
        left = rnd.randint(0, 39)
        n = rnd.randint(1, left + 1)
        words = [7] * 11 + [rnd.choice([1, 1, 1, 1, 1, 2]) for _ in range(39)]
        length = 50 - left + n - 1
        rows.append((rnd.randint(-2, 2), ctx, rnd.randrange(n_docs), left, tuple(words[:length]), [ctx * 50 + i for i in range(n)]))
    rows.sort(key=lambda r: (r[0], r[4], r[1]))
    batches = []
    for a in range(0, len(rows), size):
        h, ctx, doc, left, words, windows = zip(*rows[a : a + size])
        raw = [b"".join(w.to_bytes(4, "big") for w in x) for x in words]
        columns = [pa.array(h), pa.array(ctx), pa.array(doc), pa.array(left, pa.int32())]
        columns += [pa.array(raw, pa.binary()), pa.array(windows, pa.list_(pa.int64()))]
        batches.append(pa.record_batch(columns, ["h", "ctx", "doc", "l", "words", "windows"]))
    out = [r for b in suffix_dedup._neighbours(iter(batches)) for r in b.to_pylist()]
    got = {(r["h"], r["ctx"], r["i"]) for r in out}
    want = plain_windows(rows)
    assert len(got) == len(out) and all(r["w"] == r["ctx"] * 50 + r["i"] for r in out)
    border = set()  # rows at the ends whose neighbours are all of their own document
    for ends in (rows, rows[::-1]):
        for r in ends:
            if r[2] != ends[0][2]:
                break
            border |= {(r[0], r[1], i) for i in range(len(r[5]))}
    assert want <= got <= want | border and len(want) > 100


def test_many_tasks_give_the_same(spark):
    rnd = random.Random(31)
    line = prose(rnd, 30)
    texts = [[*prose(rnd, rnd.randint(0, 40)), *line, *prose(rnd, rnd.randint(20, 40), 2)] for _ in range(150)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got, want = cut(spark, texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == want
