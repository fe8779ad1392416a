"""The queries of this subpackage that SQL can express, for DuckDB.

Written from the definitions: positions are running sums over unnested matches, partners are
found by windows, thresholds by summing binomial terms.
"""

from __future__ import annotations

from . import centroids, mixing, quality_rules, secrets, vector_codes


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_scan() -> str:
    raw = " union all ".join(
        f"""select rid, {i} as rank, '{k.name}' as kind, '{k.role}' as role, {k.strong} as strong,
          regexp_split_to_array(t, {_text(k.pattern)}) as p,
          regexp_extract_all(t, {_text(k.pattern)}, 0) as m,
          regexp_extract_all(t, {_text(k.pattern)}, {k.group}) as v
        from docs where regexp_matches(t, {_text(k.pattern)})"""
        for i, k in enumerate(secrets.KINDS)
    )
    tests = {
        "random": "regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')"
    }
    keep = " ".join(
        f"when '{k.name}' then {tests.get(k.name) or k.keep.format(m='m', v='v')}" for k in secrets.KINDS
    )
    roles = (secrets.IDENTIFIER, secrets.SECRET, secrets.ENDPOINT)
    sides = ", ".join(
        f"""coalesce(s - max(case when role = '{r}' then e end) over (w rows between unbounded preceding
            and 1 preceding) <= {secrets.REACH}, false) or
        coalesce(min(case when role = '{r}' then s end) over (w rows between 1 following
            and unbounded following) - e <= {secrets.REACH}, false) as near_{r}"""
        for r in roles
    )
    counts = ", ".join(
        f"count(*) filter (where kind = '{k}') as n_{k}" for k in secrets.BASE
    )
    joined = "string_agg(kind || ':' || s || ':' || e, ',' order by s, rank)"
    return f"""
    with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
    raw as ({raw}),
    matches as (
      select rid, rank, kind, role, strong, unnest(p[1:len(m)]) as p, unnest(m) as m, unnest(v) as v,
        generate_subscripts(m, 1) as i
      from raw),
    placed as (
      select *, cast(sum(length(p) + length(m)) over (partition by rid, rank order by i) as bigint) as e
      from matches),
    parts as (select *, e - length(m) as s from placed where case kind {keep} end),
    scoped as (
      select *, sum(cast(role = '{secrets.BREAK}' as int)) over (
        partition by rid order by s, rank rows unbounded preceding) as scope
      from parts),
    near as (
      select *, {sides} from scoped window w as (partition by rid, scope order by s, rank)),
    judged as (
      select *, case role when '{secrets.SECRET}' then near_identifier or near_endpoint
        else near_secret end as linked
      from near where role <> '{secrets.BREAK}'),
    spans as (select * from judged where strong or linked),
    found as (
      select rid, {counts}, {joined} filter (where strong) as base, {joined} as spans,
        count(*) filter (where not strong) as n_weak, count(*) filter (where linked) as n_linked
      from spans group by rid)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
      coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
      coalesce(spans, '') as spans, coalesce(n_weak, 0) as n_weak, coalesce(n_linked, 0) as n_linked
    from docs left join found using (rid)"""


def quality() -> str:
    rules = quality_rules.RULES
    risk = quality_rules.RISK / len(rules)
    grid = ", ".join(
        f"('{r.name}', {i}, {float(c)!r})" for r in rules for i, c in enumerate(r.cutoffs)
    )
    values = " union all ".join(
        f"select rid, lang, '{r.name}' as rule, {r.value} as value from sound" for r in rules
    )
    measures = ", ".join(quality_rules.MEASURES[:5])
    order = ", ".join(f"when '{r.name}' then {i}" for i, r in enumerate(rules)).replace(",", "")
    return rf"""
    with docs as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
    split as (
      select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
      from docs),
    windows as (
      select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as c
      from (select rid, w, unnest(range(1, len(w) - 1)) as i from split)),
    covered as (
      select rid, count(distinct place) as n_repeat_words
      from (select rid, unnest([i, i + 1, i + 2]) as place from windows where c > 1) group by rid),
    measured as (
      select rid, doc_id, lang, len(w) as n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(l) - len(list_distinct(l)) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines,
        length(t) - length(replace(t, '!', '')) as n_shouts,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals
      from split left join covered using (rid)),
    base as (
      select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured),
    sound as (select * from base where not base_failed),
    vals as ({values}),
    good as (select doc_id from labels group by doc_id having min(quality) = 1),
    held as (select v.* from vals v join base using (rid) join good using (doc_id)),
    grid(rule, i, cutoff) as (values {grid}),
    counted as (
      select lang, rule, i, cutoff, count(*) as n, count(*) filter (where value > cutoff) as k
      from held join grid using (rule) group by lang, rule, i, cutoff),
    tested as (
      select *, case when k < n * {risk!r} then list_sum(list_transform(range(0, k + 1), lambda x:
          exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({risk!r}) + (n - x) * ln(1 - {risk!r}))))
        else 1 end as p,
        {quality_rules.LEVEL!r} / ((select count(*) from (select distinct lang from counted)) * {len(rules)}) as bar
      from counted),
    passed as (
      select lang, rule, i, cutoff from tested t where not exists (
        select 1 from tested o where o.lang is not distinct from t.lang and o.rule = t.rule
          and o.i <= t.i and o.p > o.bar)),
    cutoffs as (select lang, rule, arg_max(cutoff, i) as cutoff from passed group by lang, rule),
    failed as (
      select rid, string_agg(v.rule, ',' order by case v.rule {order} end) as failed_rules
      from vals v join cutoffs c on v.rule = c.rule and v.lang is not distinct from c.lang
      where v.value > c.cutoff group by rid)
    select doc_id, {measures}, base_failed, not base_failed and failed_rules is null as kept,
      coalesce(failed_rules, '') as failed_rules
    from base left join failed using (rid)"""


_SOUND = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
# Quotient rounded down, for sums of any sign.
_MEAN = "cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint)"


def vector_codes_sql() -> str:
    """Long tables of components, an unpruned search, one set of CTEs a round."""
    v = vector_codes
    rounds = "".join(
        f""",
    near{r} as (
      select rid, p, min(d * {v.ENTRIES} + e) as m from (
        select rid, p, e, sum((x - y) * (x - y)) as d from comps join book{r} using (p, i) group by all)
      group by rid, p),
    mean{r} as (
      select p, m % {v.ENTRIES} as e, i, {_MEAN} as y from near{r} join comps using (rid, p) group by all),
    book{r + 1} as (
      select p, e, i, coalesce(n.y, o.y) as y from book{r} o left join mean{r} n using (p, e, i))"""
        for r in range(v.ROUNDS)
    )
    last = f"book{v.ROUNDS}"
    return f"""
    with sound as (select row_number() over () as rid, vec_id, label, embedding as v from embeddings
      where {_SOUND} and len(embedding) > 0 and len(embedding) % {v.PARTS} = 0),
    kept as (select * from sound where len(v) = (
      select len(v) from sound group by 1 order by count(*) desc, 1 limit 1)),
    comps as (
      select rid, (k - 1) * {v.PARTS} // len(v) as p, (k - 1) % (len(v) // {v.PARTS}) as i,
        cast(floor({v.SCALE}::double * v[k]) as bigint) as x
      from (select rid, v, unnest(range(1, len(v) + 1)) as k from kept)),
    first as (select rid, row_number() over (order by vec_id nulls last, v) - 1 as e from kept),
    book0 as (select p, e, i, x as y from first join comps using (rid) where e < {v.ENTRIES}){rounds},
    final as (
      select rid, p, min(d * {v.ENTRIES} + e) as m from (
        select rid, p, e, sum((x - y) * (x - y)) as d from comps join {last} using (p, i) group by all)
      group by rid, p),
    coded as (
      select rid, string_agg(printf('%02x', cast(m % {v.ENTRIES} as int)), '' order by p) as code,
        cast(sum(m // {v.ENTRIES}) as bigint) as error
      from final group by rid)
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
      (select sha256(string_agg(y, ',' order by p, e, i)) from {last}) as codebooks_sha256
    from kept join coded using (rid)"""


def centroids_sql() -> str:
    """The distance to every centroid, one set of CTEs a round."""
    c = centroids
    near = lambda r: f"""
    near{r} as (
      select rid, min(d * {c.CENTROIDS} + c) as m from (
        select rid, c, sum((x - y) * (x - y)) as d from comps join cent{r} using (i) group by all)
      group by rid)"""
    rounds = "".join(
        f""",{near(r)},
    mean{r} as (select m % {c.CENTROIDS} as c, i, {_MEAN} as y from near{r} join comps using (rid) group by all),
    cent{r + 1} as (select c, i, coalesce(n.y, o.y) as y from cent{r} o left join mean{r} n using (c, i))"""
        for r in range(c.ROUNDS)
    )
    last = c.ROUNDS
    return f"""
    with kept as (select row_number() over () as rid, vec_id, embedding as v from embeddings
      where {_SOUND} and len(embedding) = {c.SIZE}),
    comps as (
      select rid, k as i, cast(floor({c.SCALE}::double * v[k]) as bigint) as x
      from (select rid, v, unnest(range(1, {c.SIZE} + 1)) as k from kept)),
    first as (select rid, row_number() over (order by sha256('{c.SEED}' || vec_id) nulls last, v) - 1 as c from kept),
    cent0 as (select c, i, x as y from first join comps using (rid) where c < {c.CENTROIDS}){rounds},{near(last)},
    hashes as (select c, sha256(string_agg(y, ',' order by i)) as centroid_sha256 from cent{last} group by c),
    found as (
      select rid, cast(m % {c.CENTROIDS} as int) as cluster, cast(m // {c.CENTROIDS} as bigint) as distance from near{last})
    select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
      cast(sum(distance) over () as bigint) as inertia, centroid_sha256
    from kept join found using (rid) join hashes on c = cluster"""


#: Levels of the tree of chunks that the SQL spells out: as many as CHUNK ** LEVELS units need.
LEVELS = 4


def mixing_sql() -> str:
    """Targets from sorted limits and running sums; meetings by recursion along each chunk."""
    m = mixing
    hexa = lambda text, n: f"cast('0x' || substr({text}, 1, {n}) as bigint)"
    docs = 'doc_id, size, alike, more, "full", draw'
    chunk = "source_size, target, whole, sid, bucket"
    levels = ""
    for k in range(LEVELS):
        levels += f""",
    row{k} as (
      select *, {hexa(f"md5('{k}|' || draw)", 13)}::double / {2.0**52!r}::double as odds,
        row_number() over (partition by sid, bucket order by draw) as pos
      from open{k}),
    met{k} as (
      select {chunk}, pos, {docs}, held, false as goes, null::bigint as x_held, odds from row{k} where pos = 1
      union all
      select {", ".join(f"x.{c.strip()}" for c in chunk.split(","))}, x.pos,
        {", ".join(f"case when goes_ then x.{c.strip()} else a.{c.strip()} end" for c in docs.split(","))},
        case when goes_ then x.held - moved else a.held + moved end, goes_,
        case when goes_ then a.held + moved else x.held - moved end, x.odds
      from (
        select *, (a.held + moved = 0 or a.held + moved = a."full") as goes_ from (
          select a, x, case when x.odds * (up + down) < down then up else -down end as moved from (
            select a, x, least(a."full" - a.held, x.held) as up, least(a.held, x."full" - x.held) as down
            from met{k} a join row{k} x on x.sid = a.sid and x.bucket = a.bucket and x.pos = a.pos + 1)))),
    open{k + 1} as (
      select {chunk.replace("bucket", f"bucket // {m.CHUNK} as bucket")}, {docs}, held from (
        select *, row_number() over (partition by sid, bucket order by pos desc) as z from met{k}) where z = 1),
    gone{k} as (
      select {", ".join(f"a.{c.strip()}" for c in chunk.split(","))},
        {", ".join(f"case when b.goes then a.{c.strip()} else x.{c.strip()} end as {c.strip()}" for c in docs.split(","))}, b.x_held as held
      from met{k} b join met{k} a on a.sid = b.sid and a.bucket = b.bucket and b.pos = a.pos + 1
        join row{k} x on x.sid = b.sid and x.bucket = b.bucket and x.pos = b.pos)"""
    columns = 'sid, source_size, target, whole, doc_id, size, alike, more, "full", held'
    united = " union all ".join(
        [f"select {columns} from shares where not opens"]
        + [f"select {columns} from gone{k}" for k in range(LEVELS)]
        + [f"select {columns} from open{LEVELS}"]
    )
    weights = "[" + ", ".join(map(str, m.WEIGHTS)) + "]"
    return rf"""
    with recursive units as (
      select source, doc_id, len(regexp_extract_all(coalesce(text, ''), '{m.WORD}')) as size, count(*) as alike
      from documents group by all),
    ranked as (
      select source, cast(sum(size * alike) as bigint) as source_size,
        row_number() over (order by source nulls last) as sid
      from units group by source),
    weighed as (
      select *, {weights}[(sid - 1) % {len(m.WEIGHTS)} + 1] as weight, {m.MOST} * source_size as most from ranked),
    sorted as (
      select *, sum(source_size) over () - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(weight) over (o rows between current row and unbounded following) as weights,
        row_number() over o as place
      from weighed window o as (order by most::double / weight, sid)),
    bar as (select rest, weights, place from sorted where weight * rest <= most * weights order by place limit 1),
    sources as (
      select sid, source, source_size, case when s.place < b.place then most::double
        else weight::double * b.rest::double / b.weights::double end as target
      from sorted s cross join bar b),
    copied as (
      select s.*, doc_id, size, alike, coalesce(least(target / nullif(source_size, 0), {float(m.MOST)!r}::double), 0) as copies,
        size * {m.UNIT} as "full"
      from units u join sources s on u.source is not distinct from s.source),
    shared as (
      select *, cast(floor(copies) as bigint) as whole,
        cast(floor((copies - floor(copies)) * size * {float(m.UNIT)!r}::double) as bigint) * alike as share
      from copied),
    shares as (
      select *, case when "full" > 0 then share // "full" else 0 end as more,
        case when "full" > 0 then share % "full" else 0 end as held,
        "full" > 0 and share % "full" > 0 as opens,
        md5(coalesce(source, chr(0)) || '|' || coalesce(cast(doc_id as varchar), '-') || '|' || size) as draw
      from shared),
    open0 as (
      select {chunk.replace("bucket", f"{hexa('draw', 8)} % greatest(1, (select cast(ceil(count(*) / {m.CHUNK}) as bigint) from shares where opens)) as bucket")},
        {docs}, held
      from shares where opens){levels},
    united as ({united}),
    dealt as (
      select *, case when r < more then "full" when r = more then held else 0 end as h
      from (select *, unnest(range(alike)) as r from united))
    select doc_id, s.source, size, d.source_size, d.target,
      size * whole + (h + {m.UNIT // 2}) // {m.UNIT} as taken,
      whole + cast("full" > 0 and h = "full" as int) as copies, h > 0 and h < "full" as partial
    from dealt d join sources s using (sid)"""
