"""Importance resampling against a plain version: weights word by word, then a sorted list."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from wellspring.llm import quality_classifier as qc

MASK = 2**64 - 1
BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 29
    x = x * 0xA0761D6478BD642F & MASK
    return x ^ (x >> 32)


def word_hash(word):
    return mixed(sum((b + 1) * pow(BASE, i, 2**64) for i, b in enumerate(word.lower().encode())) & MASK)


def buckets(text):
    words = text.split(" ") if text else []
    words = [w for w in words if w]
    plain = [word_hash(w) for w in words]
    shapes = []
    for i, w in enumerate(words):
        raw = w.encode()
        upper = sum(65 <= b <= 90 for b in raw)
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
        symbols = sum(not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or chr(b) in ".,'-") for b in raw)
        case = 0 if upper == 0 else 1 if upper == 1 or 2 * upper < letters else 2
        same = i > 0 and plain[i] == plain[i - 1]
        shapes.append(mixed(((case * 4 + min(symbols, 3)) * 5 + min(len(raw) // 4, 4)) * 2 + same + 1))
    for salt, codes in ((1, plain), (2, shapes)):
        for c in codes:
            yield mixed((c + salt) & MASK) % qc.BUCKETS
        for a, b in zip(codes, codes[1:]):
            yield mixed((a * 31 + b + salt) & MASK) % qc.BUCKETS


def some_text(rnd, good):
    words = [rnd.choice(["Alpha", "beta", "gamma", "x1", "delta's", "EPS"]) for _ in range(rnd.randint(0, 60))]
    return " ".join(w if good or rnd.random() < 0.5 else "#" + w for w in words)


def test_whole_operator_against_plain_version(spark):
    rnd = random.Random(8)
    texts = {i: some_text(rnd, i % 3) for i in range(240)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in qc.classified(docs.repartition(5), labels).collect()}
    marks = {r["__id"]: r for r in qc.labelled(labels).collect()}
    noise = dict(docs.select("doc_id", qc.gumbel(F.col("doc_id"))).collect())

    raw, target = collections.Counter(), collections.Counter()
    for i, text in texts.items():
        found = list(buckets(text))
        raw.update(found)
        if i in marks and marks[i]["__good"] and marks[i]["__fit"]:
            target.update(found)
    all_raw, all_target = (sum(c.values()) + qc.BUCKETS for c in (raw, target))

    def weight(text):
        return sum(
            math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw) for b in buckets(text)
        )

    weights = {i: weight(t) for i, t in texts.items()}
    assert all(abs(got[i].log_weight - w) < 1e-6 for i, w in weights.items())
    held = [(got[i].log_weight, m["__good"]) for i, m in marks.items() if not m["__fit"]]
    bar = qc.cutoff(np.array([w for w, _ in held]), np.array([g for _, g in held]))
    k = sum(r.log_weight >= bar for r in got.values())
    order = sorted(texts, key=lambda i: (-(got[i].log_weight + noise[i]), i))
    assert {i for i, r in got.items() if r.kept} == set(order[:k]) and 0 < k < 240


@pytest.mark.parametrize("kind", [T.DoubleType(), T.LongType()])
def test_kth_value(spark, kind, monkeypatch):
    monkeypatch.setattr(qc, "RANGES", 8)
    rnd = random.Random(9)
    if isinstance(kind, T.LongType):
        values = [rnd.choice([-(2**63), 2**63 - 1, 2**53, 2**53 + 1, 5, -7, rnd.randrange(2**62)]) for _ in range(300)]
    else:
        values = [rnd.choice([0.0, -1e-9, 1e300, 0.1, 0.1 + 2**-54, -3.5, rnd.gauss(0, 5)]) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", kind)]))
    for k in (1, 2, 77, 150, 299, 300):
        assert qc.kth(rows, "v", k, True) == sorted(values)[-k]
        assert qc.kth(rows, "v", k, False) == sorted(values)[k - 1]
    assert qc.kth(rows, "v", 0, True) is None and qc.kth(rows, "v", 301, True) is None


def test_ties_of_the_last_place_go_by_id(spark):
    rows = [(i, float(v)) for i, v in enumerate([5, 3, 3, 3, 3, 1])] + [(2, 3.0), (None, 3.0)]
    weighed = spark.createDataFrame(rows, "doc_id long, noisy_weight double")

    def kept(k):
        return sorted(r.doc_id for r in weighed.where(qc.top_k(weighed, k)).collect() if r.doc_id is not None)

    assert [kept(k) for k in (0, 1, 2)] == [[], [0], [0, 1]]
    assert kept(3) == kept(4) == [0, 1, 2, 2]  # a repeated row stays with its copy
    assert kept(5) == [0, 1, 2, 2, 3] and len(kept(8)) == 7


def test_words_and_plain_words_agree():
    rows, found = qc.features(pa.array(["Alpha #beta beta", "", "EPS"]))
    assert sorted(found[rows == 0].tolist()) == sorted(buckets("Alpha #beta beta"))
