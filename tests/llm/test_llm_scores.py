"""The language model's passages and look-ups against plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from wellspring.llm import lm_passages, lm_score
from wellspring.llm.common import Words


def prose(rnd, n, names=400):
    return " ".join(f"w{int(rnd.random() ** 3 * names)}" for _ in range(n))


def cut(texts):
    """Passages of each text as lists of words, by the operator's places."""
    passages = lm_passages.Passages(Words(pa.array(texts), lower=True))
    words = [w for t in texts for w in t.split()]
    stops = [*passages.starts.tolist()[1:], len(words)]
    out = [[] for _ in texts]
    for row, a, b in zip(passages.rows.tolist(), passages.starts.tolist(), stops, strict=True):
        out[row].append(words[a:b])
    return passages, out


def test_passages_end_by_their_own_words():
    rnd = random.Random(1)
    shared = prose(rnd, 300)
    texts = [f"{prose(rnd, 40)} {shared} {prose(rnd, 40)}" for _ in range(4)] + ["", "one", "same " * 500]
    passages, found = cut(texts)
    assert [len(p) for p in found] == passages.counts.tolist() and found[4] == [] and found[5] == [["one"]]
    assert [sum(p, []) for p in found] == [t.split() for t in texts]
    inner = [{tuple(p) for p in f} for f in found[:4]]
    assert sum(map(len, set.intersection(*inner))) > 150
    mean = np.mean([len(p) for f in found[:4] for p in f])
    assert 16 < mean < 64


def test_keys_tell_passages_apart():
    rnd = random.Random(2)
    shared = prose(rnd, 200)
    texts = [prose(rnd, 60, 3) + " " + shared for _ in range(20)] + [shared, shared, shared + " more"]
    passages, found = cut(texts)
    alone, after, at = {}, {}, 0
    for f in found:
        earlier = None
        for i, p in enumerate(f):
            mine = (*p, None) if i == len(f) - 1 else tuple(p)
            assert alone.setdefault(mine, passages.alone[at]) == passages.alone[at]
            assert after.setdefault((earlier, mine), passages.after[at]) == passages.after[at]
            earlier, at = mine, at + 1
    assert len({*alone.values()}) == len(alone) and len({*after.values()}) == len(after)
    assert not {*alone.values()} & {*after.values()}


def test_mix_is_a_plain_loop():
    rnd = np.random.default_rng(3)
    many = np.array([0, 1, 7, 200, 0, 33])
    n, texts, passages = int(many.sum()), 50, 4000
    logs = -rnd.exponential(60, n)
    alone = rnd.integers(0, 5, n) * rnd.integers(0, 2, n)
    seen, at = np.zeros(n), 0
    for m in many:
        seen[at : at + m] = np.r_[texts, alone[at : at + m - 1]][:m]
        at += m
    after = np.minimum(np.minimum(alone, seen), rnd.integers(0, 3, n))
    expected, at = [], 0
    for m in many:
        total, read, step = 0.0, 0, 1
        drawn = [list(lm_passages.START[:, g]) for g in range(lm_passages.GATES)]
        while read < m:
            fresh = [list(d) for d in drawn]
            for i in range(at + read, at + min(m, read + step)):
                g = int(min(seen[i], 3))
                shares = [d / sum(drawn[g]) for d in drawn[g]]
                # Scaled by the words' own probability, which may be too small for a double.
                ways = [1.0, after[i] / (seen[i] + 0.5) * math.exp(-logs[i]), alone[i] / (passages + 1) * math.exp(-logs[i])]
                parts = [s * w for s, w in zip(shares, ways, strict=True)]
                total += math.log(sum(parts)) + logs[i]
                fresh[g] = [d + p / sum(parts) for d, p in zip(fresh[g], parts, strict=True)]
            drawn, read, step = fresh, read + step, min(2 * step, lm_passages.STEP_MOST)
        expected.append(total)
        at += m
    found = lm_passages.mixed_scores(many, logs, after.astype(float), alone.astype(float), texts, passages)
    assert found == pytest.approx(expected, rel=1e-9)


def test_shares_of_passages_add_up_to_one_at_most():
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.randint(1, 120), 6) for _ in range(200)]
    _, found = cut(texts)
    after, alone = collections.Counter(), collections.Counter()
    for f in found:
        marked = [(*p, None) if i == len(f) - 1 else tuple(p) for i, p in enumerate(f)]
        alone.update(marked)
        after.update(zip([None, *marked[:-1]], marked, strict=True))
    sums = collections.Counter()
    for (earlier, _), n in after.items():
        sums[earlier] += n
    for earlier, n in sums.items():
        assert n == (len(texts) if earlier is None else alone[earlier])


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(5)
    train = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = {i: prose(rnd, rnd.randint(40, 120)) for i in range(900)}
    copies = dict(zip(held[:30], train[:30], strict=True))
    rows |= {a: rows[b] for a, b in copies.items()}
    rows |= {held[31]: "w7", held[32]: "w399", held[33]: "unheard", train[31]: "", held[34]: "w3 " * 20000}
    docs = spark.createDataFrame([*rows.items()], "doc_id long, text string")

    def of():
        return {r.doc_id: r for r in lm_score.score(docs).collect()}

    patch = pytest.MonkeyPatch()
    whole = of()
    patch.setattr(lm_score, "HEAD", 8)
    few = of()
    patch.undo()
    return rows, held, copies, whole, few


def test_counts_come_from_the_head_or_the_join(scores):
    rows, held, _, whole, few = scores
    assert whole.keys() == few.keys() == rows.keys()
    for i in rows:
        a, b = whole[i], few[i]
        assert (a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens)
        assert a.base_score == pytest.approx(b.base_score, rel=1e-12)
        # Only the words' weights may differ.
        assert b.score == pytest.approx(a.score, rel=0.1) and math.isfinite(b.score)
    for i in held[31:34]:  # a single word: weights have not moved
        assert few[i].score == pytest.approx(whole[i].score, rel=1e-5)


def test_copies_of_training_texts_score_apart(scores):
    _, held, copies, whole, few = scores
    for found in (whole, few):
        each = {i: found[i].score / found[i].n_tokens for i in held if found[i].n_tokens > 30 and i != held[34]}
        others = [s for i, s in each.items() if i not in copies]
        assert min(each[i] for i in copies) > max(others)


def test_words_by_class_come_from_the_head_or_the_join(spark):
    """Texts of up to 48 words: their weights have not yet moved by what words in a class say."""
    rnd = random.Random(11)
    kinds = [[f"{pair}{i}{pair}" for i in range(120)] for pair in ("ab", "cd", "ef")]
    texts = [" ".join(rnd.choices(kinds[i % 3], k=rnd.randint(20, 48))) for i in range(300)]
    texts += [" ".join(rnd.choices(kinds[i % 3], k=20) + rnd.choices(kinds[(i + 1) % 3], k=20)) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")

    def of(**sizes):
        with pytest.MonkeyPatch.context() as patch:
            for name, size in sizes.items():
                patch.setattr(lm_score, name, size)
            return {r.doc_id: r for r in lm_score.score(docs).collect()}

    # With and without counts of words overall at hand: the look-up is for both counts or for one.
    for head in (lm_score.HEAD, 8):
        whole, few = of(HEAD=head), of(HEAD=head, CLASS_ROWS=8)
        for i in whole:
            assert (whole[i].n_known, whole[i].base_score) == (few[i].n_known, pytest.approx(few[i].base_score, rel=1e-12))
            assert few[i].score == pytest.approx(whole[i].score, rel=1e-5)


def small_model(seed):
    """A model of few texts whose tables are random, and texts to score."""
    rnd = random.Random(seed)
    texts = [prose(rnd, n, 60) for n in (3, 900, 1, 120, 400)] + ["", "\u00e9t\u00e9 " * 70]
    pairs = np.zeros(257 * 257)
    codes = np.r_[256, lm_score.Stream(pa.array(texts)).codes.astype(np.int64)]
    np.add.at(pairs, codes[:-1] * 257 + codes[1:], 1)
    alphabet = lm_score.Alphabet.of(pairs.reshape(257, 257))
    symbols, pair, _ = alphabet.contexts(lm_score.Stream(pa.array(texts)))
    counts = np.zeros((lm_score.SLOTS[0], lm_score.SYMBOLS))
    np.add.at(counts, (pair, symbols), 1)
    tables = np.random.default_rng(seed).integers(-60, 60, sum(lm_score.SLOTS) * lm_score.SYMBOLS).astype(np.int8)
    return lm_score.Model(alphabet, lm_score.Trees.of(counts), tables), texts


def test_costs_of_a_text_do_not_depend_on_the_texts_beside_it():
    model, texts = small_model(12)
    stream = lm_score.Stream(pa.array(texts))
    together = np.split(model.symbol_costs(stream), stream.first[1:-1])
    for text, costs in zip(texts, together, strict=True):
        assert model.symbol_costs(lm_score.Stream(pa.array([text]))) == pytest.approx(costs, rel=1e-6)


def test_weights_are_learnt_from_every_bit():
    """A plain loop over the bits of one text."""
    model, texts = small_model(13)
    stream = lm_score.Stream(pa.array([texts[1]]))
    symbols, pair, slots = model.alphabet.contexts(stream)
    begins = (0, int(model.alphabet.symbol[32]))
    weights = np.tile(lm_score.START * lm_score.SCALE, (lm_score.GATES, 1))
    bends, expected, read, step = np.zeros(lm_score.BINS), np.zeros(len(symbols)), 0, lm_score.PORTION
    while read < len(symbols):
        up, down = np.zeros_like(weights), np.zeros_like(weights)
        bent_up, bent_down = np.zeros_like(bends), np.zeros_like(bends)
        for i in range(read, min(read + step, len(symbols))):
            code = pair[i] * lm_score.SYMBOLS + symbols[i]
            first = model.trees.first[code]
            expected[i] = math.log(256) if symbols[i] == lm_score.ESCAPE else 0
            for depth, at in enumerate(model.trees.steps[first : first + model.trees.length[code]] % lm_score.STEPS):
                sign = -1 if at & 1 else 1
                x = np.array([model.tables[slots[o][i] * lm_score.SYMBOLS + (at >> 1)] for o in lm_score.MIXED], float)
                gate = min(depth, 3) * 2 + (pair[i] // lm_score.SYMBOLS in begins)
                mix = (weights[gate] * x).sum()
                bin_ = int(min(max(mix * 2 + lm_score.BINS / 2, 0), lm_score.BINS - 1))
                against = math.exp(min(max((mix + bends[bin_]) * sign, -30), 30))
                expected[i] += math.log(1 + against)
                miss = against / (1 + against)
                up[gate] -= miss * sign * x
                down[gate] += miss * (1 - miss) * x * x
                bent_up[bin_] -= miss * sign
                bent_down[bin_] += miss * (1 - miss)
        weights += lm_score.RATE * up / (down + lm_score.PRIOR / lm_score.SCALE**2)
        bends += lm_score.RATE * bent_up / (bent_down + lm_score.PRIOR)
        read, step = read + step, min(2 * step, lm_score.PORTION_MOST)
    found = model.symbol_costs(stream)
    assert found.sum() == pytest.approx(expected.sum(), rel=1e-4)
    assert np.abs(found - expected).max() < 0.05
