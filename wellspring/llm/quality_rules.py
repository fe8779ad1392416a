"""Quality rules with risk-controlled cutoffs.

A rule rejects a document whose measured value lies beyond a cutoff. The cutoffs are not chosen
by hand: labelled good documents of each stratum (language) are the holdout. For a cutoff that
rejects ``k`` of ``n`` good ones, the exact binomial tail P(X <= k | n, risk) is the p-value of
"this cutoff falsely rejects more than ``risk`` of the good documents". Cutoffs are tested from
lenient to strict and testing stops at the first that isn't significant (fixed sequence), so a
rule costs one test; the level is shared over all strata and rules (Bonferroni). The total risk
is shared over the rules. With probability 1 - ``LEVEL`` no stratum loses more than ``RISK`` of
its good documents to the rules. A stratum with too few labels for that gets no cutoff.

Everything is built-in functions: measures within the row, one grouped count for the holdout.

Cases: null and empty texts have no words and fail the base test. A null language is a stratum
of its own. A document with contradicting labels counts as bad. Repeated rows each get a result. Long texts are
measured in whole; a value equal to a cutoff passes. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

RISK = 0.02
LEVEL = 0.05


@dataclass(frozen=True)
class Rule:
    """Reject where ``value`` (SQL over the measures) is above a cutoff; lenient ones first."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


_SHARES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.02, 0.01)
_RATES = (3.0, 2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005)
_LENGTHS = (20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.25, 6.0)

RULES = (
    Rule("symbols", "n_symbols / nullif(n_words, 0)", _RATES),
    Rule("shouting", "n_shouts / nullif(n_words, 0)", _RATES),
    Rule("capitals", "n_capitals / nullif(word_chars, 0)", _SHARES),
    Rule("repeat_words", "n_repeat_words / nullif(n_words, 0)", _SHARES),
    Rule("dup_lines", "n_dup_lines / nullif(n_lines, 0)", _SHARES),
    Rule("long_words", "word_chars / nullif(n_words, 0)", _LENGTHS),
    Rule("short_words", "-word_chars / nullif(n_words, 0)", (-1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0, -4.25)),
)

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_shouts",
    "n_capitals",
)

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(text: str, characters: str) -> str:
    return f"(char_length({text}) - char_length(translate({text}, '{characters}', '')))"


def measure(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the measures of ``MEASURES`` added as longs.

    Repeated 3-word windows: windows become hashes with their position in the low bits; sorting
    the longs brings equal hashes together. Only windows whose hash repeats are then compared as
    words, so that the result is exact.
    """
    same = "shiftright({}, __bits) = shiftright({}, __bits)"
    steps = {
        "__text": f"coalesce({column}, '')",
        "__words": r"array_remove(split(__text, '[\\x20\\x09-\\x0D]+'), '')",
        "__n": "size(__words)",
        "__bits": "length(bin(__n))",
        "__keys": """sort_array(if(__n < 4, cast(array() as array<bigint>), transform(
            sequence(0, __n - 3), i -> shiftleft(shiftright(xxhash64(
              __words[i], __words[i + 1], __words[i + 2]), __bits), __bits) | cast(i as bigint))))""",
        "__maybe": f"""transform(filter(__keys, (x, i) ->
            coalesce({same.format("x", "get(__keys, i - 1)")}, false)
            or coalesce({same.format("x", "get(__keys, i + 1)")}, false)),
            x -> cast(x & (shiftleft(1L, __bits) - 1) as int))""",
        "__windows": """sort_array(transform(__maybe, i -> struct(concat_ws(
            ' ', __words[i], __words[i + 1], __words[i + 2]) as w, i as i)))""",
        "__at": """sort_array(transform(filter(__windows, (x, i) ->
            coalesce(x.w = get(__windows, i - 1).w, false)
            or coalesce(x.w = get(__windows, i + 1).w, false)), x -> x.i))""",
        "__lines": r"filter(split(__text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')",
    }
    measured = {
        "n_words": "__n",
        "word_chars": r"char_length(translate(__text, ' \t\n\u000B\u000C\r', ''))",
        "n_symbols": _count("__text", "#*$%&|<>"),
        "n_dup_lines": "size(__lines) - size(array_distinct(__lines))",
        "n_repeat_words": """aggregate(transform(__at, (x, i) ->
            least(3, coalesce(get(__at, i + 1) - x, 3))), 0, (a, x) -> a + x)""",
        "n_lines": "size(__lines)",
        "n_shouts": _count("__text", "!"),
        "n_capitals": _count("__text", _CAPITALS),
    }
    for name, sql in steps.items():
        docs = docs.withColumn(name, F.expr(sql))
    docs = docs.withColumns({c: F.expr(f"cast({s} as bigint)") for c, s in measured.items()})
    return docs.drop(*steps)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: str) -> str:
    """SQL: ln of the gamma function for x >= 1, by Stirling's series at x + 8."""
    z = f"({x} + 8)"
    product = " * ".join(f"({x} + {i})" for i in range(8))
    series = f"1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - 1 / (1680 * pow({z}, 7))"
    return f"(({z} - 0.5) * ln({z}) - {z} + 0.91893853320467274178 + {series} - ln({product}))"


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), where k < n p; 1 elsewhere.

    Terms are summed from ``k`` downward. They fall at least geometrically there, so that the
    rest after ``steps`` terms is below double precision.
    """
    k, n = f"cast({k} as double)", f"cast({n} as double)"
    top = f"""exp({_log_gamma(f"({n} + 1)")} - {_log_gamma(f"({k} + 1)")}
        - {_log_gamma(f"({n} - {k} + 1)")} + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D))"""
    steps = f"cast(least({k}, 12 * sqrt({n} * {p}D) + 60) as int)"
    total = f"""aggregate(sequence(0, {steps}), named_struct('term', {top}, 'sum', 0D),
        (a, i) -> named_struct(
          'term', a.term * ({k} - i) * (1 - {p}D) / (({n} - {k} + i + 1) * {p}D),
          'sum', a.sum + a.term),
        a -> a.sum)"""
    return F.expr(f"if({k} < {n} * {p}D, {total}, 1D)")


def select_cutoffs(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL
) -> DataFrame:
    """Strictest safe cutoff per stratum and rule: ``stratum, rule, cutoff, n, k, p_value``.

    ``measured`` has ``doc_id``, ``lang`` and the measures, ``labels`` has ``doc_id, quality``.
    The holdout is every good document that passes the base test. Rules without a safe cutoff
    have no row.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    held = measured.where(~base_failed()).join(good.select("doc_id"), "doc_id")
    bins = [
        F.expr(
            f"struct('{r.name}' as rule, size(filter(array({', '.join(f'{c}D' for c in r.cutoffs)}), "
            f"c -> {r.value} > c)) as above)"
        )
        for r in RULES
    ]
    # A handful of rows from here on: strata x rules x cutoffs.
    counted = stored(
        held.select(F.col("lang").alias("stratum"), F.explode(F.array(*bins)).alias("b"))
        .groupBy("stratum", "b.rule", "b.above")
        .agg(F.count("*").alias("c"))
    )
    tests = counted.select("stratum").distinct().count() * len(RULES)
    wide = counted.groupBy("stratum", "rule").agg(
        F.map_from_entries(F.collect_list(F.struct("above", "c"))).alias("by"),
        F.sum("c").alias("n"),
    )
    grid = F.create_map(
        *[
            x
            for r in RULES
            for x in (F.lit(r.name), F.array(*[F.lit(c) for c in r.cutoffs]))
        ]
    )
    tested = (
        wide.withColumn("cutoffs", grid[F.col("rule")])
        .select("*", F.posexplode("cutoffs").alias("i", "cutoff"))
        .withColumn(
            "k",
            F.expr(
                "aggregate(map_entries(by), 0L, (a, e) -> a + if(e.key > i, e.value, 0L))"
            ),
        )
        .withColumn("p_value", binomial_tail("k", "n", risk / len(RULES)))
        .withColumn("bar", F.lit(level / max(1, tests)))
    )
    return (
        tested.groupBy("stratum", "rule")
        .agg(
            F.min(F.when(F.col("p_value") > F.col("bar"), F.col("i"))).alias("stop"),
            F.collect_list(F.struct("i", "cutoff", "k", "p_value")).alias("all"),
            F.first("n").alias("n"),
        )
        .withColumn("passed", F.expr("array_max(filter(all, x -> stop is null or x.i < stop))"))
        .where("passed is not null")
        .select("stratum", "rule", "passed.cutoff", "n", "passed.k", "passed.p_value")
    )


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``, ``kept`` and ``failed_rules``.

    The cutoffs of a stratum come together as one row; strata are few, so Spark finds the side
    small when it runs and no stratum's documents have to meet in one task.
    """
    per = cutoffs.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut")
    )
    failed = ", ".join(
        f"if({r.value} > __cut['{r.name}'], '{r.name}', null)" for r in RULES
    )
    return (
        measured.join(per, measured["lang"].eqNullSafe(per["stratum"]), "left")
        .withColumn("base_failed", base_failed())
        .withColumn(
            "failed_rules",
            F.expr(f"if(base_failed, cast(array() as array<string>), array_compact(array({failed})))"),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("__cut", "stratum")
    )


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, lang``, the measures, ``base_failed, kept, failed_rules``."""
    measured = stored(measure(docs.select("doc_id", "lang", "text")).drop("text"))
    return judge(measured, select_cutoffs(measured, labels))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_rules(docs, labels).select(
        "doc_id",
        *MEASURES[:5],
        "base_failed",
        "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )
