"""Passages as predictors of a language model: counts that grow with the corpus.

A text is cut into passages of about ``2 ** TURN`` words. A passage ends behind a word where a hash
of it and of the word before has ``TURN`` low zeros, or with the text. Where it ends shows in its
own words, so no passage begins another one and shares of passages are probabilities. Two keys
stand for a passage: ``after``, itself and the passage before it, and ``alone``, itself only. Both are
counted over all training texts and looked up by a join; nothing about them is sampled or capped.

``mixed_scores`` joins three predictions of each passage: its words one by one, how often it came
after the passage before it, how often it came at all. They are added with weights, chosen by a
gate (how often the passage before it was seen: never, once, twice, more) and changed online as
the text is read.

Cases: a text without words has no passage. Copies of texts or passages count as often as they
occur. A text of one repeated word may be a single passage. Long texts are taken in whole.
"""

from __future__ import annotations

import numpy as np

from .common import Words, mixed

TURN = 5
GATES = 4
#: Weights that a text starts with, by gate: words, after, alone.
START = np.array([[4, 0, 0.2], [2, 1, 0.2], [2, 2, 0.2], [2, 4, 0.2]], float).T
STEP_MOST = 64

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ALONE, _AFTER = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Passages:
    """The passages of a block of texts: the row of each, its first word, its keys."""

    def __init__(self, words: Words):
        h, n, some = words.hashes, len(words.starts), words.counts > 0
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[words.first[:-1][some]] = True
        last[words.first[1:][some] - 1] = True
        before = np.r_[np.zeros(min(n, 1), np.uint64), h[:-1]]
        before[first] = 0
        cut = last | (mixed(h + before * np.uint64(3)) & np.uint64((1 << TURN) - 1) == 0)
        begins = np.r_[np.ones(min(n, 1), bool), cut[:-1]]
        self.starts = np.flatnonzero(begins)
        self.of_word = np.cumsum(begins) - 1
        self.rows = words.rows[self.starts]
        self.counts = np.bincount(self.rows, minlength=len(words.counts))
        place = (np.arange(n) - self.starts[self.of_word]).astype(np.uint64)
        codes = self.sums(mixed(h + place * _GOLD))
        codes = mixed(codes + last[np.flatnonzero(cut)].astype(np.uint64))
        earlier = np.r_[np.zeros(min(len(codes), 1), np.uint64), codes[:-1]]
        earlier[first[self.starts]] = 1
        self.alone = mixed(codes + _ALONE)
        self.after = mixed(codes + mixed(earlier + _AFTER))

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Sum over the words of each passage."""
        return np.add.reduceat(each, self.starts) if len(self.starts) else each[:0]


def mixed_scores(
    many: np.ndarray, logs: np.ndarray, after: np.ndarray, alone: np.ndarray, texts: int, passages: int
) -> np.ndarray:
    """Natural log of the probability of each of ``len(many)`` texts with ``many`` passages each.

    ``logs`` is that of each passage from its words, ``after`` and ``alone`` how often its keys occur
    among all training ``texts`` and ``passages``.
    """
    begin = np.cumsum(many) - many
    seen = np.r_[np.zeros(min(len(alone), 1)), alone[:-1]]  # the passage before
    seen[begin[many > 0]] = texts
    with np.errstate(divide="ignore"):
        ways = np.stack([logs, np.log(after) - np.log(seen + 0.5), np.log(alone) - np.log(passages + 1)])
    gate = np.minimum(seen, GATES - 1).astype(np.int64)
    total, drawn = np.zeros(len(many)), np.tile(START, (1, len(many)))
    read, step = 0, 1
    while (active := np.flatnonzero(many > read)).size:
        now = np.minimum(many[active] - read, step)
        opens = np.cumsum(now) - now
        at = np.arange(now.sum()) + np.repeat(begin[active] + read - opens, now)
        cell = np.repeat(active * GATES, now) + gate[at]
        held = drawn[:, cell]
        with np.errstate(divide="ignore"):
            each = ways[:, at] + np.log(held / held.sum(axis=0))
        top = each.max(axis=0)
        each = np.exp(each - top)
        both = each.sum(axis=0)
        total[active] += np.add.reduceat(np.log(both) + top, opens)
        for way, share in enumerate(each / both):
            drawn[way] += np.bincount(cell, share, drawn.shape[1])
        read, step = read + step, min(2 * step, STEP_MOST)
    return total
