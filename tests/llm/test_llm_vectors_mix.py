"""Vector codes, source mixing and centroids against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import centroids, mixing, vector_codes
from wellspring.llm.spread import join_facts

NAN, INF = float("nan"), float("inf")
CLASH = ("id", "vec", "code", "error", "n", "total", "distance", "cluster", "slot", "digit", "held", "draw", "hot_key", "part")


def floors(vector, scale):
    return [math.floor(scale * x) if abs(x) < 2.0**52 else int(x) * scale for x in vector]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(part, book):
    return min((squared(part, entry), i) for i, entry in enumerate(book))


def as_long(x):
    return x if x < 2**63 else None


def moved(parts, book):
    groups = {}
    for p in parts:
        groups.setdefault(nearest(p, book)[1], []).append(p)
    return [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(book)]


def plain_codes(rows):
    """Rows (vec_id, vector, label) by the definition, one entry after the other."""
    size = len(rows[0][1]) // 8
    ints = [floors(v, 4096) for _, v, _ in rows]
    parts = [[v[p * size : (p + 1) * size] for p in range(8)] for v in ints]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][1]))
    books = [[parts[i][p] for i in order[:16]] for p in range(8)]
    for _ in range(6):
        books = [moved([v[p] for v in parts], books[p]) for p in range(8)]
    found = [[nearest(v[p], books[p]) for p in range(8)] for v in parts]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (r[0], "".join(f"{i:02x}" for _, i in f), as_long(e), as_long(labels[r[2]]), sha)
        for r, f, e in zip(rows, found, errors, strict=True)
    ]


def plain_clusters(rows):
    """Rows (vec_id, vector) by the definition."""
    ints = [floors(v, 64) for _, v in rows]
    draw = lambda i: hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, draw(i), rows[i][1]))
    book = [ints[i] for i in order[:16]]
    for _ in range(3):
        book = moved(ints, book)
    found = [nearest(v, book) for v in ints]
    sums = {}
    for d, c in found:
        sums[c] = sums.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    total = as_long(sum(sums.values()))
    return [(r[0], c, as_long(d), as_long(sums[c]), total, sha[c]) for r, (d, c) in zip(rows, found, strict=True)]


def vectors(kind, n, size):
    rnd = np.random.default_rng(7)
    if kind == "ties":  # few values, so that distances and sums are often equal
        made = rnd.integers(-2, 3, (n, size)) / 64
    elif kind == "copies":  # a third of the rows alike, some clusters
        made = rnd.standard_normal((20, size))[rnd.integers(0, 20, n)] + rnd.standard_normal((n, size)) * 0.1
        made[: n // 3] = made[0]
    else:  # far beyond what squares of longs can hold
        made = rnd.standard_normal((n, size)) * 10.0 ** rnd.integers(0, 300 if kind == "huge" else 12, (n, 1))
    return made.tolist()


def shuffled(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def odd(size):
    return [None, [], [NAN] * size, [INF] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [1.0] * (size + 1)]


@pytest.mark.parametrize("kind", ["ties", "copies", "large", "huge"])
def test_codes_are_those_of_a_full_search(spark, kind):
    rows = [(i // 2 if i % 50 < 4 else i, v, i % 3 or None) for i, v in enumerate(vectors(kind, 300, 24))]
    rows += [(None, rows[5][1], 1), (rows[9][0], rows[9][1], 2)]
    table = spark.createDataFrame(rows + [(900, v, 1) for v in odd(24)], "vec_id long, embedding array<double>, label int")
    table = table.withColumns({c: F.lit("x") for c in CLASH}).repartition(5)
    names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert shuffled(map(tuple, vector_codes.compressed(table).select(*names).collect())) == shuffled(plain_codes(rows))


@pytest.mark.parametrize("kind", ["ties", "copies", "large", "huge"])
def test_clusters_are_those_of_a_full_search(spark, kind):
    rows = [(i // 2 if i % 50 < 4 else i, v) for i, v in enumerate(vectors(kind, 300, 64))]
    rows += [(None, rows[5][1]), rows[9]]
    table = spark.createDataFrame(rows + [(900, v) for v in odd(64)], "vec_id long, embedding array<double>")
    table = table.withColumns({c: F.lit("x") for c in CLASH}).repartition(5)
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert shuffled(map(tuple, centroids.clustered(table).select(*names).collect())) == shuffled(plain_clusters(rows))


def test_few_vectors_and_labels_without_rows(spark):
    rows = [(i, [i / 8] * 64, None) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert {(r.code, r.error, r.label_error) for r in vector_codes.compressed(table).collect()} == {
        (f"{i:02x}" * 8, 0, 0) for i in range(3)
    }
    assert {(r.distance, r.inertia) for r in centroids.clustered(table).collect()} == {(0, 0)}


def test_searches_leave_entries_out():
    """Far apart entries are not looked at, and yet the nearest are found."""
    rnd = np.random.default_rng(3)
    book = np.arange(16)[:, None] * 1000 + rnd.integers(0, 5, (16, 8))
    rows = book[rnd.integers(0, 16, 400)] + rnd.integers(-3, 4, (400, 8))
    index, distance = vector_codes.nearest_by_average(rows, book.astype(object))
    full = ((rows[:, None] - book) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    cluster, distance = centroids.nearest_by_threshold(rows, book.astype(object))
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_codes_can_be_read_back(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors("copies", 100, 16))]
    kept = vector_codes.kept(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    books = vector_codes.fit(kept)
    for r in vector_codes.encode(kept, books).collect():
        assert squared(books.decoded(r.code), floors(rows[r.id][1], 4096)) == r.error


def plain_targets(sizes):
    """Targets by sharing the excess anew until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        rest = [s for s in names if s not in fixed]
        share = {s: weight[s] * left / sum(weight[t] for t in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


@pytest.fixture(scope="module")
def sources():
    """A hot source, tiny ones, one of no words, one null; a very long text, copies, odd texts."""
    rnd = random.Random(9)
    name = lambda: rnd.choice(["hot"] * 5 + ["a", "b", "ü", "\U0001f600", "￿", None])
    rows = [(i, " ".join(["w"] * rnd.randint(1, 60)), name()) for i in range(900)]
    rows += [(1000 + i, t, "odd") for i, t in enumerate(["", None, " \t\n", "one", "x\x0by"])]
    rows += [(2000, "long " * 200_000, "hot"), (2001, "tiny", "tiny"), (2002, None, "empty"), (None, "a b c", "a")]
    rows += [(3000, "the same row", "a")] * 40 + [(3001, "one id", "a"), (3001, "one id, other words", "b")] * 20
    return rows


def test_mix_meets_its_targets(spark, sources):
    frame = spark.createDataFrame(sources, "doc_id long, text string, source string")
    frame = frame.withColumns({c: F.lit("x") for c in CLASH + ("size", "taken", "alike", "odds", "bucket")})
    got = mixing.mixed(frame.repartition(6)).collect()
    again = mixing.mixed(frame.repartition(2)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    words = lambda t: len((t or "").split())
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, words(t)) for d, t, _ in sources)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
        assert r.partial or r.taken == r.copies * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
    assert want["tiny"] == 3 and want["empty"] == 0
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    partial = [r.source for r in got if r.partial]
    assert len(partial) == len(set(partial))


def test_copies_are_fair(spark):
    """Over many draws each document is taken as often as its share says, long or short."""
    rows = [(n * 100 + i, "w " * (1 + i), f"s{n:03d}") for n in range(300) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(frame).where("target < source_size").collect()
    per_place = {}
    for r in got:
        per_place.setdefault(r.size, []).append(r.taken / r.size - r.target / r.source_size)
    assert all(abs(np.mean(v)) < 4 * np.std(v) / math.sqrt(len(v)) + 1e-9 for v in per_place.values())


def test_more_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    rows = [(i, "w " * (1 + i % 17), "ab"[i % 5 == 0]) for i in range(500)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len({r.doc_id for r in got}) == 500
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1 and sum(r.partial for r in own) <= 1


def test_facts_of_hot_and_rare_keys(spark):
    rows = [(i, None if i % 3 else i) for i in range(9000)]
    frame = spark.createDataFrame(rows, "a int, k int")
    facts = frame.groupBy("k").agg(F.count("*").alias("n"), F.sum("a").alias("s"))
    got = {(r.a, r.k, r.s) for r in join_facts(frame, facts, "k", "n").collect()}
    null = sum(a for a, k in rows if k is None)
    assert got == {(a, k, null if k is None else a) for a, k in rows}
