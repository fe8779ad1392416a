"""Folds over long arrays, as SQL text."""

from __future__ import annotations


def scan(array: str, start: str, step: str, emit: str, kind: str) -> str:
    """SQL: what ``emit``, an array, gives for every element in turn, joined to ``array<kind>``.

    ``step`` makes the next state ``n`` from the state before, ``acc.s``, and the element ``x``;
    ``emit`` sees all three. ``array`` is a column, read in stretches of about the root of its
    length: results are appended to that many short arrays and then to one of arrays, never to a
    long one, so the time grows with ``n * sqrt(n)`` moved references at most.
    """
    long = f"greatest(1, cast(sqrt(size({array})) as int))"
    stretches = f"transform(sequence(0, greatest(size({array}) - 1, 0) div {long}), i -> slice({array}, i * {long} + 1, {long}))"
    stretch = f"""aggregate(c, named_struct('s', o.s, 'out', cast(array() as array<{kind}>)),
      (acc, x) -> transform(array({step}), n -> named_struct('s', n, 'out', concat(acc.out, {emit})))[0])"""
    return f"""aggregate({stretches}, named_struct('s', {start}, 'out', cast(array() as array<array<{kind}>>)),
      (o, c) -> transform(array({stretch}), r -> named_struct('s', r.s, 'out', concat(o.out, array(r.out))))[0],
      o -> flatten(o.out))"""
