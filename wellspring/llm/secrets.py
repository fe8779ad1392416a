"""Secret scans: credentials whose parts lie apart, linked within scopes.

A credential often has several parts: an access identifier, a secret, an endpoint. Strong parts
(the base kinds) are always reported. Weak candidates - a login name, a short pass phrase, a
random-looking string, an address - mean little alone; they are reported only when a
complementary part lies within ``REACH`` code points in the same scope. A scope is a block of
text without a blank line.

The join of parts with the intervals around complementary parts is a sweep over the sorted
parts of one text: going forward each part meets the last end of every other role before it,
going backward the next start. That finds the same partners as a join on overlapping intervals
but makes no pairs. All of it is column expressions on the row itself: no shuffle, and no group
larger than a text.

Cases: null and empty texts have no spans. Long texts are read in whole; the time grows with the
number of their parts and a little faster, as ``scan`` says. Ties of places go by the order of kinds.
An empty table gives an empty result. Repeated rows each get their own result. Columns
other than the text are passed through; the result column takes the name that is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

REACH = 256

IDENTIFIER, SECRET, ENDPOINT, BREAK = "identifier", "secret", "endpoint", "break"


@dataclass(frozen=True)
class Kind:
    """A pattern for parts. ``keep`` is SQL over the match ``{m}`` and the value ``{v}`` (a group)."""

    name: str
    role: str
    pattern: str
    keep: str
    group: int = 0
    strong: bool = False


_SET = r"""["']?\x20*[:=]\x20*["']?"""

KINDS = (
    Kind(
        "assign",
        SECRET,
        rf"((?i:password|passwd|secret|token|api_?key)){_SET}([A-Za-z0-9+/_.=-]+)",
        "length({v}) >= 8",
        group=2,
        strong=True,
    ),
    Kind("access", IDENTIFIER, r"AKIA[A-Z0-9]+", "length({m}) >= 16", strong=True),
    Kind("hex", SECRET, r"[0-9a-f]+", "length({m}) >= 32", strong=True),
    Kind(
        "login",
        IDENTIFIER,
        rf"((?i:user_?name|user_?id|login|client_?id|access_?key_?id)){_SET}([A-Za-z0-9+/_.@-]+)",
        "length({v}) >= 3",
        group=2,
    ),
    Kind(
        "phrase",
        SECRET,
        rf"((?i:pwd|passphrase|credential|private_?key|signature)){_SET}([A-Za-z0-9+/_.=-]+)",
        "length({v}) >= 4",
        group=2,
    ),
    Kind(
        "random",
        SECRET,
        r"[A-Za-z0-9+/_-]{24,}",
        "{m} rlike '[0-9]' and {m} rlike '[a-z]' and {m} rlike '[A-Z]'",
    ),
    Kind(
        "endpoint",
        ENDPOINT,
        r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/?#&=%+-]+"
        r"|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]+)?",
        "true",
    ),
    Kind("break", BREAK, r"\n[\x20\x09\x0B-\x0D]*\n", "true"),
)
BASE = tuple(k.name for k in KINDS if k.strong)

#: A text without a match of this has no span: weak identifiers and endpoints need a secret.
ANY_SECRET = "|".join(
    [
        r"AKIA[A-Z0-9]{12}",
        r"[0-9a-f]{32}",
        rf"(?i:password|passwd|secret|token|api_?key|pwd|passphrase|credential|private_?key|signature){_SET}[A-Za-z0-9+/_.=-]",
        r"[A-Za-z0-9+/_-]{24}",
    ]
)

_PART = "struct<start:int,rank:int,end:int,kind:string,role:string,strong:boolean,text:string>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(array: str, start: str, step: str, emit: str, kind: str) -> str:
    """SQL: what ``emit``, an array, gives for every element in turn, joined to ``array<kind>``.

    ``step`` makes the next state; both see the state before as ``acc.s`` and the element as
    ``x``. The array is a column, read in stretches of about the root of its length: results are
    appended to that many short arrays and then to one of arrays, never to a long one, so a
    hundred times the elements take a thousand times as long at most, not ten thousand.
    """
    long = f"greatest(1, cast(sqrt(size({array})) as int))"
    stretches = f"""transform(sequence(0, greatest(size({array}) - 1, 0) div {long}), i -> slice({array}, i * {long} + 1, {long}))"""
    stretch = f"""aggregate(c, named_struct('s', o.s, 'out', cast(array() as array<{kind}>)),
      (acc, x) -> named_struct('s', {step}, 'out', concat(acc.out, {emit})))"""
    return f"""aggregate({stretches}, named_struct('s', {start}, 'out', cast(array() as array<array<{kind}>>)),
      (o, c) -> transform(array({stretch}), r -> named_struct('s', r.s, 'out', concat(o.out, array(r.out))))[0],
      o -> flatten(o.out))"""


def matches_of(kind: Kind, text: str) -> str:
    """SQL: for each match the piece of text before it, the match and its value; the rest last."""
    pattern = _quoted(kind.pattern)
    return f"""arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0),
      regexp_extract_all({text}, {pattern}, {kind.group}))"""


def parts_of(kind: Kind, rank: int, matches: str) -> str:
    """SQL: the parts of one kind, in order, with code point positions, from its matches.

    The pieces between matches and the matches alternate, so running lengths give positions.
    """
    p, m, v = "x.`0`", "x.`1`", "x.`2`"
    keep = kind.keep.format(m=m, v=v)
    here = (
        f"acc.s + length({p}) as start, {rank} as rank, acc.s + length({p}) + length({m}) as end, "
        f"'{kind.name}' as kind, '{kind.role}' as role, {str(kind.strong).lower()} as strong, {m} as text"
    )
    step = f"acc.s + length({p}) + coalesce(length({m}), 0)"
    emit = f"if({m} is not null and ({keep}), array(struct({here})), cast(array() as array<{_PART}>))"
    return scan(matches, "0", step, emit, _PART)


_ROLES = (IDENTIFIER, SECRET, ENDPOINT)


def _sweep(parts: str, forward: bool) -> str:
    """SQL: for each part whether a complementary part lies on one side within reach.

    The state holds for each role the nearest position so far; a break forgets them.
    """
    seen = "end" if forward else "start"
    best = "greatest" if forward else "least"
    distance = "x.start - acc.s.{r}" if forward else "acc.s.{r} - x.end"
    near = {r: f"coalesce({distance.format(r=r)} <= {REACH}, false)" for r in _ROLES}
    partner = (
        f"case x.role when '{IDENTIFIER}' then {near[SECRET]} when '{ENDPOINT}' then {near[SECRET]} "
        f"when '{SECRET}' then {near[IDENTIFIER]} or {near[ENDPOINT]} else false end"
    )
    state = ", ".join(
        f"'{r}', case when x.role = '{BREAK}' then null "
        f"when x.role = '{r}' then {best}(acc.s.{r}, x.{seen}) else acc.s.{r} end"
        for r in _ROLES
    )
    empty = ", ".join(f"'{r}', cast(null as int)" for r in _ROLES)
    return scan(parts, f"named_struct({empty})", f"named_struct({state})", f"array({partner})", "boolean")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` doesn't have."""
    return [next(n for n in ("_" * k + name for k in range(len(docs.columns) + 1)) if n not in docs.columns) for name in names]


def find_credentials(docs: DataFrame, column: str = "text", into: str = "credentials") -> DataFrame:
    """``docs`` with an array of spans: start, rank, end, kind, role, strong, text, linked.

    ``linked`` says that a complementary part is within reach. Weak spans are always linked.

    Each step is a column that the next one reads more than once, which keeps Spark from putting
    the one into the other; the sweeps are arguments of one zip, not repeated for its elements.
    """
    t, parts, back, ahead, behind = fresh(docs, "text_", "parts_", "back_", "ahead_", "behind_")
    found = fresh(docs, *[f"matches_{k.name}_" for k in KINDS])
    none = "cast(array() as array<struct<`0`:string,`1`:string,`2`:string>>)"
    gate = f"{t} rlike {_quoted(ANY_SECRET)}"
    every = ",\n".join(parts_of(k, i, f"`{m}`") for i, (k, m) in enumerate(zip(KINDS, found, strict=True)))
    zipped = f"arrays_zip({parts}, {ahead}, {behind})"
    return (
        docs.withColumn(t, F.coalesce(F.col(column), F.lit("")))
        .withColumns({m: F.expr(f"if({gate}, {matches_of(k, t)}, {none})") for k, m in zip(KINDS, found, strict=True)})
        .withColumn(parts, F.expr(f"sort_array(concat({every}))"))
        .withColumn(back, F.expr(f"reverse({parts})"))
        .withColumn(ahead, F.expr(_sweep(parts, forward=True)))
        .withColumn(behind, F.expr(f"reverse({_sweep(back, forward=False)})"))
        .withColumn(
            into,
            F.expr(
                f"""transform(filter({zipped}, x -> x.{parts}.role <> '{BREAK}' and (x.{parts}.strong or x.{ahead} or x.{behind})),
                  x -> struct(x.{parts}.start, x.{parts}.rank, x.{parts}.end, x.{parts}.kind, x.{parts}.role,
                    x.{parts}.strong, x.{parts}.text, x.{ahead} or x.{behind} as linked))"""
            ),
        )
        .drop(t, parts, back, ahead, behind, *found)
    )


def span_list(spans: str) -> str:
    """SQL: ``kind:start:end`` of spans, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts, the hash of the base spans and the list of all spans."""
    found = find_credentials(docs.select("doc_id", "text"), into="found").drop("text")
    counts = [
        F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
        for k in BASE
    ]
    return found.select(
        "doc_id",
        *counts,
        F.expr(f"sha2({span_list('filter(found, x -> x.strong)')}, 256)").alias("base_sha256"),
        F.expr(span_list("found")).alias("spans"),
        F.expr("cast(size(filter(found, x -> not x.strong)) as bigint)").alias("n_weak"),
        F.expr("cast(size(filter(found, x -> x.linked)) as bigint)").alias("n_linked"),
    )


def redacted(found: str, text: str) -> Column:
    """The text with every span, overlapping ones merged, replaced by ``[kind]``.

    The text is joined from the pieces between the spans; the kind is that of the first span.
    """
    piece = f"substring({text}, acc.s + 1, x.start - acc.s)"
    emit = f"if(x.start >= acc.s, array({piece}, '[', x.kind, ']'), cast(array() as array<string>))"
    pieces = scan(found, "0", "greatest(acc.s, x.end)", emit, "string")
    return F.expr(f"concat(array_join({pieces}, ''), substring({text}, array_max(transform({found}, x -> x.end)) + 1))")


def without_credentials(docs: DataFrame) -> DataFrame:
    """``docs`` with credentials cut out of ``text`` and ``n_chars`` (if there) counted anew.

    Texts without a span stay as they are, null too. No document goes.
    """
    spans, new = fresh(docs, "spans_", "redacted_")
    found = find_credentials(docs, into=spans)
    some = F.size(spans) > 0
    out = found.withColumn(new, F.when(some, redacted(spans, "text")).otherwise(F.col("text")))
    changes = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changes["n_chars"] = F.when(some, F.char_length(new).cast(kind)).otherwise(F.col("n_chars"))
    return out.withColumns(changes).drop(spans, new)
