"""One SQL statement per registered query, for DuckDB on the same tables.

Written from the definitions, not from the engine's plans: islands are found by numbering,
recursive fills by recursion over hours, power cuts by recursion over forecast hours.
"""

from __future__ import annotations

ORDER = "partition by station_id order by timestamp, event_id"
HOURLY = "partition by station_id order by timestamp"
CALENDAR = "partition by station_id order by day, month, hour, year, timestamp, event_id"
MEASURES = ["input_flow_rate", "reservoir_level_percentage", "output_flow_rate", "pressure"]
STATS = [f"{m}_{s}" for m in MEASURES for s in ("first", "last", "mean")]
PUMP_SECONDS = ["pump_1_duration_sum", "pump_2_duration_sum"]
WEATHER = ["air_temp_c", "total_precip_mm", "relative_humidity_percentage"]
DIFFS = {
    "input_flow_rate_diff": "input_flow_rate",
    "output_flow_rate_diff": "output_flow_rate",
    "reservoir_level_change": "reservoir_level_percentage",
    "pressure_change": "pressure",
}
ACTIVE = ["pump_1_active", "pump_2_active"]
CHANGE = "change_from_last_hour_output_flow_rate_mean"
DATE_PARTS = ["year", "month", "day", "day_of_week", "week_of_year", "hour"]
CANDIDATES = [0, 16777215, 5592405, 4095, 16773120, 63, 12345678, 9876543]


def r2(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"


def d(*names: str) -> str:
    """Doubles, rounded like the engine's output."""
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


def each(template: str, names) -> str:
    return ", ".join(template.format(c=c) for c in names)


def profile(source: str) -> str:
    where = {
        "pump_1_avg": "pump_1 = 1 and pump_2 = 0",
        "pump_2_avg": "pump_1 = 0 and pump_2 = 1",
        "both_pumps_avg": "pump_1 = 1 and pump_2 = 1",
    }
    means = ", ".join(
        f"avg(input_flow_rate) filter (where {w} and input_flow_rate > 0) as {n}"
        for n, w in where.items()
    )
    return f"""
    select c.station_id, c.day, c.hour, {", ".join(f"coalesce(c.{n}, s.{n}) as {n}" for n in where)}
    from (select station_id, day, hour, {means} from {source} group by all) c
    join (select station_id, {means} from {source} group by all) s using (station_id)"""


def calendar(ts: str) -> str:
    return f"""cast(year({ts}) as int) as year, cast(month({ts}) as int) as month,
    cast(day({ts}) as int) as day, cast(isodow({ts}) - 1 as int) as day_of_week,
    cast(week({ts}) as int) as week_of_year, cast(hour({ts}) as int) as hour"""


CTES: dict[str, str] = {}

CTES["readings"] = f"""
    with raw as (
      select cast(floor(user_id / 15.0) as int) as station_id, event_id, ts as timestamp,
        case when event_id % 11 = 0 then 0.0e0 else value end as input_flow_rate,
        case when json_extract_string(props, '$.k') = '0' or (day(ts) * 24 + hour(ts)) % 37 = 0
          then 0.0e0 else 40.0e0 + cast(json_extract_string(props, '$.k') as double) / 10.0e0
          end as reservoir_level_percentage,
        cast((event_id % 7) * 1.5e0 as double) as pressure,
        cast(event_type in ('click', 'purchase') as int) as pump_1,
        cast(event_type in ('purchase', 'view') as int) as pump_2
      from events)
    select *, {calendar("timestamp")}, cast(minute(timestamp) as int) as minute from raw"""

CTES["profile_1"] = profile("readings")
CTES["distances"] = """
    select r.*, pump_1 = 0 and pump_2 = 0 and input_flow_rate > 0 as odd,
      abs(input_flow_rate - pump_1_avg) as d1, abs(input_flow_rate - pump_2_avg) as d2,
      abs(input_flow_rate - both_pumps_avg) as d3,
      case when d1 is not null and d2 is not null and d3 is not null then least(d1, d2, d3) end as dm
    from readings r left join profile_1 using (station_id, day, hour)"""
CTES["pumps"] = """
    select * exclude (odd, d1, d2, d3, dm) replace (
        case when odd then case when dm = d1 or dm = d3 then 1 else 0 end else pump_1 end as pump_1,
        case when odd then case when dm = d2 or dm = d3 then 1 else 0 end else pump_2 end as pump_2),
      case when odd then 1 else 0 end as inputed_pump_status
    from distances"""
CTES["profile_2"] = profile("pumps")
CTES["flows"] = f"""
    select p.* replace (
        case when not ((pump_1 = 1 or pump_2 = 1) and input_flow_rate = 0) then input_flow_rate
          when pump_1 = 1 and pump_2 = 0 then {r2("pump_1_avg")}
          when pump_1 = 0 and pump_2 = 1 then {r2("pump_2_avg")}
          else {r2("both_pumps_avg")} end as input_flow_rate),
      case when (pump_1 = 1 or pump_2 = 1) and input_flow_rate = 0 then 1 else 0 end
        as inputed_input_flow_rate
    from pumps p left join profile_2 using (station_id, day, hour)"""

CTES["numbered"] = f"""
    select *, row_number() over ({ORDER}) as rn,
      sum(case when reservoir_level_percentage = 0 then 0 else 1 end) over ({ORDER}
        rows between unbounded preceding and current row) as grp
    from flows"""
CTES["islands"] = """
    select station_id, grp, min(rn) as rs, max(rn) as re, count(*) as n,
      min(timestamp) as island_start, max(timestamp) as island_end
    from numbered where reservoir_level_percentage = 0 group by station_id, grp"""
CTES["levels"] = f"""
    select m.* exclude (rn, grp) replace (
        case when not fills.station_id is null and fills.n = 1 then (a + b) / 2
          when not fills.station_id is null then {r2("a + (b - a) / (n + 1) * (rn - rs + 1)")}
          else reservoir_level_percentage end as reservoir_level_percentage),
      case when fills.station_id is null then 0 else 1 end as inputed_reservoir_level,
      m.rn - 1 as row_idx
    from numbered m left join (
      select i.*, l.reservoir_level_percentage as a, r.reservoir_level_percentage as b
      from islands i
      join numbered l on l.station_id = i.station_id and l.rn = i.rs - 1
      join numbered r on r.station_id = i.station_id and r.rn = i.re + 1
      where i.n <= 3 and l.reservoir_level_percentage > 0 and r.reservoir_level_percentage > 0
    ) fills on m.station_id = fills.station_id and m.rn between fills.rs and fills.re"""
CTES["trailing_means"] = f"""
    select *, coalesce(nullif(pressure, 0), avg(nullif(pressure, 0)) over ({ORDER}
      rows between 9 preceding and current row)) as p8 from levels"""
CTES["pressures"] = f"""
    select * exclude (p8) replace (
      {r2("coalesce(p8, avg(p8) over (partition by station_id))")} as pressure) from trailing_means"""


def balance(source: str) -> str:
    return f"""
    with steps as (
      select *, reservoir_level_percentage * 1000000 / 100 as reservoir_level_liters,
        (epoch_us(timestamp) - epoch_us(lag(timestamp) over ({ORDER}))) / 1e6 as time_passed_seconds,
        input_flow_rate * time_passed_seconds as total_liters_entered,
        reservoir_level_liters - lag(reservoir_level_percentage * 1000000 / 100) over ({ORDER})
          as gained
      from {source})
    select * exclude (gained), greatest(gained, 0.0) as effective_liters_entered,
      total_liters_entered - gained as total_liters_out,
      (total_liters_entered - gained) / nullif(time_passed_seconds, 0) as output_flow_rate
    from steps
    where gained is not null and total_liters_entered >= greatest(gained, 0.0)
      and (total_liters_entered - gained) / nullif(time_passed_seconds, 0) <= 150
      and input_flow_rate <= 85"""


CTES["repaired"] = balance("pressures")
CTES["raw_balance"] = balance("readings")

CTES["hour_weather"] = """
    select h, s,
      case when s % 13 <> 0 then 15.0e0 + (s * 7 % 200) / 10.0e0 end as air_temp_c,
      case when s % 17 <> 0 then (s * 3 % 25) / 10.0e0 end as total_precip_mm,
      case when s % 19 <> 0 then 40.0e0 + s * 11 % 60 end as relative_humidity_percentage
    from (select date_trunc('hour', ts) as h, cast(sum(event_id) as bigint) as s from events
          group by 1)"""
KEYED = """cast(hour(h) as int) as hour, cast(day(h) as int) as day,
    cast(month(h) as int) as month, cast(year(h) as int) as year, relative_humidity_percentage,
    air_temp_c + 1.0e0 as max_temp_last_hour_c, air_temp_c - 1.0e0 as min_temp_last_hour_c,
    air_temp_c, total_precip_mm"""
CTES["weather"] = f"select {KEYED} from hour_weather"
CTES["overlay"] = f"""
    select {KEYED} from (select h, {each("case when s % 5 <> 0 then {c} + 0.5e0 end as {c}", WEATHER)}
      from hour_weather where h >= timestamp '2024-01-21 00:00:00')"""


def weathered(source: str) -> str:
    return f"""
    select r.*, {each("coalesce(o.{c}, w.{c}) as {c}", WEATHER)}
    from {source} r left join weather w using (hour, day, month, year)
    left join overlay o using (hour, day, month, year)"""


def filled(source: str) -> str:
    """Trailing mean, then forward, then backward fill, one after the other."""
    mean = f"coalesce({{c}}, avg({{c}}) over ({CALENDAR} rows between 9 preceding and current row))"
    fwd = f"last_value({{c}} ignore nulls) over ({CALENDAR} rows between unbounded preceding and current row)"
    bwd = f"first_value({{c}} ignore nulls) over ({CALENDAR} rows between current row and unbounded following)"
    step = lambda e, inner: f"select * replace ({each(e + ' as {c}', WEATHER)}) from ({inner})"
    return step(bwd, step(fwd, step(mean, f"select * from {source}")))


CTES["raw_weathered"] = weathered("readings")
CTES["raw_filled"] = filled("raw_weathered")
CTES["weathered_readings"] = weathered("repaired")
CTES["filled_readings"] = filled("weathered_readings")
CTES["combined"] = f"""
    select *, (epoch_us(timestamp) - epoch_us(lag(timestamp) over ({ORDER}))) / 1e6 as time_diff,
      pump_1 * time_diff as pump_1_duration, pump_2 * time_diff as pump_2_duration
    from filled_readings"""

CTES["hours"] = f"""
    select station_id, date_trunc('hour', timestamp) as timestamp,
      {each('''first({c} order by timestamp, event_id) filter (where {c} is not null) as {c}_first,
        last({c} order by timestamp, event_id) filter (where {c} is not null) as {c}_last,
        avg({c}) as {c}_mean''', MEASURES)},
      coalesce(sum(time_diff), 0) as duration_seconds_sum,
      coalesce(sum(pump_1_duration), 0) as pump_1_duration_sum,
      coalesce(sum(pump_2_duration), 0) as pump_2_duration_sum,
      {each("first({c} order by timestamp, event_id) filter (where {c} is not null) as {c}", WEATHER)}
    from combined group by all"""
CTES["calendar_hours"] = """
    select station_id, unnest(generate_series(min(timestamp), max(timestamp), interval 1 hour))
      as timestamp from hours group by station_id"""
CTES["dense"] = f"""
    select g.station_id, g.timestamp, {", ".join(f"h.{c}" for c in STATS)},
      coalesce(duration_seconds_sum, 0) as duration_seconds_sum,
      coalesce(pump_1_duration_sum, 0) / nullif(coalesce(duration_seconds_sum, 0), 0) * 3600
        as pump_1_duration_sum,
      coalesce(pump_2_duration_sum, 0) / nullif(coalesce(duration_seconds_sum, 0), 0) * 3600
        as pump_2_duration_sum,
      {", ".join(f"h.{c}" for c in WEATHER)},
      {", ".join(f"{m}_last - {m}_first as {n}" for n, m in DIFFS.items())},
      coalesce(h.pump_1_duration_sum, 0) > 0 as pump_1_active,
      coalesce(h.pump_2_duration_sum, 0) > 0 as pump_2_active
    from calendar_hours g left join hours h using (station_id, timestamp)"""
CTES["grid"] = f"""
    select *, {" or ".join(f"{c} is null" for c in [*STATS, *PUMP_SECONDS, *WEATHER, *DIFFS])}
      as inputed_row from dense"""
_keep = [*[f"{m}_last" for m in MEASURES], *PUMP_SECONDS, *ACTIVE]
CTES["carried"] = f"""
    select *, {each(f"last_value(case when not inputed_row then {{c}} end ignore nulls) over ({HOURLY} rows between unbounded preceding and current row) as k_{{c}}", _keep)},
      {each(f"lead(case when not inputed_row then {{c}}_first end) over ({HOURLY}) as nx_{{c}}", MEASURES)}
    from grid"""
_pick = "case when inputed_row then {new} else {c} end as {c}"
_new = {}
for _m in MEASURES:
    _first = f"k_{_m}_last"
    _last = f"case when k_{_m}_last is not null then coalesce(nx_{_m}, k_{_m}_last) end"
    _new[f"{_m}_first"] = _first
    _new[f"{_m}_last"] = _last
    _new[f"{_m}_mean"] = f"({_first} + {_last}) / 2"
for _n, _m in DIFFS.items():
    _new[_n] = "null" if _n == "pressure_change" else f"{_new[_m + '_last']} - {_new[_m + '_first']}"
_new |= {c: f"k_{c}" for c in [*PUMP_SECONDS, *ACTIVE]}
_new |= {c: "null" for c in WEATHER}
GRID_COLUMNS = [*STATS, "duration_seconds_sum", *PUMP_SECONDS, *WEATHER, *DIFFS, *ACTIVE]
CTES["filled_grid"] = f"""
    select station_id, timestamp,
      {", ".join(_pick.format(new=_new[c], c=c) if c in _new else c for c in GRID_COLUMNS)},
      inputed_row, row_number() over ({HOURLY}) - 1 as idx
    from carried"""
_fold = [*WEATHER, "pressure_change"]


def _step(c: str) -> str:
    if c == "pressure_change":
        value = (
            "case when g.idx >= 11 then list_avg(list_transform(range(1, 10), "
            "lambda k: r.l_pressure_change[k + 1] - r.l_pressure_change[k])) end"
        )
    else:
        value = f"case when g.idx >= 4 then {r2(f'list_avg(r.l_{c}[-4:-2])')} end"
    return f"case when g.inputed_row then {value} else g.{c} end"


CTES["folded"] = f"""
    select station_id, idx, {each("{c}", _fold)}, {each("[{c}] as l_{c}", _fold)}
    from filled_grid where idx = 0
    union all
    select g.station_id, g.idx, {", ".join(f"{_step(c)} as v_{c}" for c in _fold)},
      {", ".join(f"list_append(r.l_{c}, {_step(c)})[-11:] as l_{c}" for c in _fold)}
    from folded r join filled_grid g on g.station_id = r.station_id and g.idx = r.idx + 1"""
CTES["silver"] = f"""
    with joined as (
      select g.* replace ({", ".join(f"f.{c} as {c}" for c in _fold)}),
        output_flow_rate_mean - lag(output_flow_rate_mean) over (partition by g.station_id
          order by g.timestamp) as {CHANGE}
      from filled_grid g join folded f using (station_id, idx))
    select * exclude (idx, duration_seconds_sum), {calendar("timestamp")} from joined where idx > 0"""

LAGS = [1, 2, 3, 6, 12, 24, 26, 48, 72]
ROLLS = [2, 3, 6, 12, 24, 36, 48, 72]
SPOKEN = dict(zip(WEATHER, ["temperature", "precipitation", "humidity"]))
AGOT = ["input_flow_rate_last", *PUMP_SECONDS]
LAGGED = {
    f"{k}_hours_{'agot' if c in AGOT else 'ago'}_{SPOKEN.get(c, c)}": f"lag({c}, {k}) over ({HOURLY})"
    for k in LAGS
    for c in [*STATS, *PUMP_SECONDS, *WEATHER]
}
ROLLED = {}
for _k in ROLLS:
    _w = f"over ({HOURLY} rows between {_k - 1} preceding and current row)"
    for _c in [*DIFFS, CHANGE]:
        ROLLED[f"{_k}_hours_rolling_{_c}"] = (
            f"case when count({_c}) {_w} = {_k} then {_c} - first_value({_c}) {_w} end"
        )
    for _c in WEATHER:
        ROLLED[f"{_k}_hours_rolling_{SPOKEN[_c]}"] = (
            f"case when count({_c}) {_w} = {_k} then cast(sum(cast(floor({_c} * 1e9 + 0.5) as bigint)) "
            f"{_w} as double) / {_k * 1_000_000_000}.0e0 end"
        )
TARGETS = {f"target_{h}": f"lead({CHANGE}, {h}) over ({HOURLY})" for h in range(1, 25)}


def as_columns(expressions: dict[str, str]) -> str:
    return ", ".join(f'{e} as "{n}"' for n, e in expressions.items())


def quoted(names) -> str:
    """Rolling weather means come from whole numbers and are not rounded."""
    exact = {f"{k}_hours_rolling_{c}" for k in ROLLS for c in SPOKEN.values()}
    return ", ".join(f'"{n}"' if n in exact else f'round("{n}", 6) + 0.0 as "{n}"' for n in names)


CTES["wide"] = f"select *, {as_columns({**LAGGED, **ROLLED, **TARGETS})} from silver"

# Forecast: changes of one and two days before, as long rows.
_back = lambda days: ", ".join(
    f"lag({CHANGE}, {24 * days - h}) over ({HOURLY})" for h in range(1, 25)
)
CTES["steps"] = f"""
    select station_id, timestamp as anchor, output_flow_rate_mean as base,
      reservoir_level_percentage_last as level0, unnest(range(1, 25)) as h,
      unnest([{_back(1)}]) as c1, unnest([{_back(2)}]) as c2
    from silver"""
CTES["whole_steps"] = """
    select * from steps
    qualify count(c1) over (partition by station_id, anchor) = 24
      and count(c2) over (partition by station_id, anchor) = 24"""
CTES["paths"] = """
    with plain as (
      select *, base + sum(c1) over w as no_weather, base + sum(c2) over w as own
      from whole_steps window w as (partition by station_id, anchor order by h))
    select *, coalesce(lag(no_weather) over (partition by station_id, anchor order by h), base) + c2
      as weather from plain"""
CTES["history"] = """
    select a.station_id, a.timestamp as anchor, s.timestamp, s.output_flow_rate_mean as flow,
      s.reservoir_level_percentage_last as level
    from silver a join silver s on s.station_id = a.station_id
      and s.timestamp > a.timestamp - interval 72 hour and s.timestamp <= a.timestamp"""
CTES["run_down"] = """
    select station_id, anchor, 0 as t, level0 as l1, level0 as l2, 0.0e0 as f1, 0.0e0 as f2,
      0 as elapsed, cast(null as int) as crossing
    from paths where h = 1 and level0 is not null
    union all
    select r.station_id, r.anchor, r.t + 1, l1 - no_weather * 0.36e0, l2 - weather * 0.36e0,
      no_weather, weather,
      elapsed + case when l1 - no_weather * 0.36e0 > 0 or l2 - weather * 0.36e0 > 0 then 1 else 0 end,
      coalesce(crossing, case when l1 - no_weather * 0.36e0 < 0 then r.t + 1 end)
    from run_down r join paths p on p.station_id = r.station_id
      and p.anchor = r.anchor + (r.t - r.t % 24) * interval 1 hour and p.h = r.t % 24 + 1
    where not (r.t > 0 and r.t % 24 = 0 and (l1 < 0 or l2 < 0))"""
CTES["emptied"] = """
    select station_id, anchor, elapsed, crossing from run_down
    where t > 0 and t % 24 = 0 and (l1 < 0 or l2 < 0) and crossing is not null"""

STATE_COLUMNS = [*STATS, *PUMP_SECONDS, *DIFFS]
FORECASTS = [f"forecast_output_flow_rate_{h}h" for h in range(1, 25)]
CTES["states"] = f"""
    with wide_paths as (
      select station_id, anchor,
        {", ".join(f"max(no_weather) filter (where h = {h}) as {n}" for h, n in enumerate(FORECASTS, 1))}
      from paths group by all)
    select s.station_id, s.timestamp, hour, day_of_week, week_of_year, {each("s.{c}", STATE_COLUMNS)},
      pump_1_active, pump_2_active, {each("coalesce({c}, 0.0e0) as {c}", FORECASTS)},
      cast(coalesce(elapsed, 5) as int) as time_to_depletion
    from silver s left join wide_paths p on p.station_id = s.station_id and p.anchor = s.timestamp
    left join emptied e on e.station_id = s.station_id and e.anchor = s.timestamp"""
CTES["searchable"] = f"""
    select *, cast(pump_1_active or pump_2_active as int) as pump_active from states
    qualify row_number() over ({HOURLY}) > 72"""


def random_rewards() -> str:
    """Flat rewards of 100 schedules for every state, five drawn from each md5."""
    key = "'42-' || station_id || '-' || (epoch_us(timestamp) // 3600000000) || '-' || (candidate_id // 5)"
    drawn = f"""(select *, cast('0x' || substr(md5({key}), candidate_id % 5 * 6 + 1, 6) as bigint) as schedule
        from searchable, range(0, 100) t(candidate_id)) drawn"""
    cases = ", ".join(f"({i}, {c})" for i, c in enumerate(CANDIDATES))
    return rewards("flat").replace(f"searchable, (values {cases}) c(candidate_id, schedule)", drawn)


def rewards(reward: str) -> str:
    graded = """case when level <= 800000 then level / 800000 * 50
        else (950000 - level) / 150000 * 50 end"""
    inside = graded if reward.startswith("graded") else "50.0e0"
    scale = 1 if reward == "raw_outflow" else 3600
    out = f"flow * {scale}"
    move = f"inflow * bit - {out}" if reward == "graded_inflow" else f"inflow - {out} * bit"
    pump = "when hod between 18 and 21 then -20 when hod between 0 and 5 then 20"
    if reward == "graded_inflow":
        pump += " when hod between 6 and 17 then 10"
        few = "when ttd = 2 then -20 when ttd = 1 then -50 when ttd = 0 then -100"
    else:
        few = "when ttd < 2 then -20"
    cases = ", ".join(f"({i}, {c})" for i, c in enumerate(CANDIDATES))
    return f"""
    with hours24 as (
      select station_id, timestamp, candidate_id, schedule, h, (schedule >> h) & 1 as bit,
        input_flow_rate_mean * 3600 as inflow, reservoir_level_percentage_mean * 10000 as start,
        (hour + h) % 24 as hod, time_to_depletion as ttd,
        [{", ".join(FORECASTS)}][h + 1] as flow
      from searchable, (values {cases}) c(candidate_id, schedule), range(0, 24) r(h)),
    levels24 as (
      select *, start + sum({move}) over (partition by station_id, timestamp, candidate_id
        order by h rows between unbounded preceding and current row) as level
      from hours24)
    select station_id, timestamp, cast(candidate_id as int) as candidate_id, schedule,
      sum(case when level < 200000 or level > 950000 then -50.0e0 else {inside} end
        + case when bit = 0 then 0 {pump} else 0 end
        + case {few} when ttd > 10 then 100 when ttd > 6 then 50 when ttd > 4 then 20 else 0 end)
        as reward
    from levels24 group by all"""


CTES["flat_rewards"] = rewards("flat")

CTES["repair_plan"] = """
    select station_id, start_row, start_row + len as end_row, direction, low, high, seq, set_flow,
      set_pump_1, set_pump_2
    from (select station_id, unnest(range(0, cast(floor(count(*) / 100) as bigint) + 1)) as j
          from readings group by station_id) n,
      lateral (values (j * 100 + 10, 19, -1, 0.005e0, 0.008e0, j * 3, null, null, null),
        (j * 100 + 25, 14, 1, 0.003e0, 0.006e0, j * 3 + 1, 61.03e0, null, null),
        (j * 100 + 40, 2, 0, 0.0e0, 0.0e0, j * 3 + 2, null, 1, 0))
      s(start_row, len, direction, low, high, seq, set_flow, set_pump_1, set_pump_2)"""
CTES["raw_numbered"] = CTES["numbered"].replace("from flows", "from readings")
CTES["raw_islands"] = CTES["islands"].replace("from numbered", "from raw_numbered")
CTES["raw_levels"] = (
    CTES["levels"].replace("from numbered m", "from raw_numbered m")
    .replace("join numbered", "join raw_numbered").replace("from islands", "from raw_islands")
)


def walked(source: str, draw: str) -> str:
    """Levels of ``source`` with the repair plan applied; ``draw`` is in [0, 1)."""
    return f"""
    with covered as (
      select l.*, s.direction, s.set_flow, s.set_pump_1, s.set_pump_2, s.seq,
        1 + s.direction * (s.low + (s.high - s.low) * ({draw})) as factor
      from {source} l left join repair_plan s
        on s.station_id = l.station_id and l.row_idx between s.start_row and s.end_row
      qualify row_number() over (partition by l.station_id, row_idx order by s.seq desc) = 1),
    chains as (
      select *, sum(case when factor is null then 1 else 0 end) over (partition by station_id
        order by row_idx) as chain from covered)
    select * exclude (direction, set_flow, set_pump_1, set_pump_2, seq, factor, chain) replace (
      case when factor is null then reservoir_level_percentage else
        first_value(reservoir_level_percentage) over c * product(coalesce(factor, 1)) over c end
        as reservoir_level_percentage,
      coalesce(set_flow, input_flow_rate) as input_flow_rate,
      coalesce(set_pump_1, pump_1) as pump_1, coalesce(set_pump_2, pump_2) as pump_2,
      case when direction <> 0 then 1 else inputed_reservoir_level end as inputed_reservoir_level)
    from chains window c as (partition by station_id, chain order by row_idx
      rows between unbounded preceding and current row)"""


DRAW = "('0x' || substr(md5('42-' || l.station_id || '-' || row_idx), 1, 13))::bigint / 4503599627370496.0e0"
CTES["walks"] = walked("raw_levels", "(row_idx * 37 % 100) / 100.0e0")
CTES["hashed_walks"] = walked("raw_levels", DRAW)
CTES["walked_levels"] = walked("levels", DRAW)
CTES["walked_trailing"] = CTES["trailing_means"].replace("from levels", "from walked_levels")
CTES["walked_pressures"] = CTES["pressures"].replace("from trailing_means", "from walked_trailing")
CTES["walked_repaired"] = balance("walked_pressures")


def sql(select: str) -> str:
    """The statement with the definitions it needs in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and _mentions(text, name) and body is not text:
                needed.append(name)
                visit(body)

    visit(select)
    chain = [n for n in CTES if n in needed]
    return "with recursive " + ",\n".join(f"{n} as ({CTES[n]})" for n in chain) + "\n" + select


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(from|join|,)\s+{name}\b", text) is not None


KEY = "station_id, event_id, timestamp"
_grid_out = f"""station_id, timestamp, {d(*STATS, "duration_seconds_sum", *PUMP_SECONDS, *WEATHER, *DIFFS)},
    pump_1_active, pump_2_active, inputed_row"""
_silver_out = f"""station_id, timestamp, {", ".join(DATE_PARTS)}, {d(*STATS, *PUMP_SECONDS, *WEATHER, *DIFFS)},
    pump_1_active, pump_2_active, {d(CHANGE)}, inputed_row"""
_hours_out = f"""station_id, timestamp, {d(*STATS, "duration_seconds_sum", *PUMP_SECONDS, *WEATHER)}"""
_weather_out = f"hour, day, month, year, {d('relative_humidity_percentage', 'max_temp_last_hour_c', 'min_temp_last_hour_c', 'air_temp_c', 'total_precip_mm')}"


def _forecast(weather: str) -> str:
    return f"""select station_id, anchor, anchor + h * interval 1 hour as timestamp,
      round(no_weather, 6) + 0.0 as output_flow_rate_mean_no_weather,
      round({weather}, 6) + 0.0 as output_flow_rate_mean_weather, true as forecasted from paths"""


def _minutes(column: str) -> str:
    whole = f"cast(trunc(coalesce({column}, 0)) as int)"
    return f"({whole} // 60) || ' hours and ' || ({whole} % 60) || ' minutes'"


_usage = f"""
    with daily as (
      select station_id, cast(timestamp as date) as day_, hour between 18 and 21 as peak,
        coalesce(sum(pump_1_duration_sum), 0) as pump_1,
        coalesce(sum(pump_2_duration_sum), 0) as pump_2
      from silver where not inputed_row group by all),
    means as (
      select station_id, {", ".join(f"avg({p}) filter (where {k}) / 60 as {p}_{n}" for p in ("pump_1", "pump_2") for n, k in (("peak", "peak"), ("off", "not peak")))}
      from daily group by station_id)
    {" union all ".join(f"select station_id, '{p}' as pump, {p}_peak as pk, {p}_off as op from means" for p in ("pump_1", "pump_2"))}"""
CTES["usage"] = _usage


BINS = 32
FEATURES = ["hour", "day_of_week", "week_of_year", "year", *LAGGED, *ROLLED, "inputed_row"]
WEATHER_WORDS = ("temperature", "precipitation", "humidity")
_MILLIONTHS = 'round_even("{c}"::double * 1e6, 0) / 1e6'


def _grown(complete: str) -> str:
    """Rows, bins at equal ranks and sums of gradients up to each bin, before the first split."""
    units = lambda c: f"cast(floor({_MILLIONTHS.format(c=c)} * 65536 + 0.5) as bigint)"
    return f"""
      with rows_ as (
        select row_number() over () as rid, * from ({complete}) where timestamp < timestamp '2024-01-21 00:00:00'),
      long_ as (
        select rid, unnest([{", ".join(f"'{n}'" for n in FEATURES)}]) as feature,
          unnest(range({len(FEATURES)})) as position,
          unnest([{", ".join(_MILLIONTHS.format(c=n) for n in FEATURES)}]) as x
        from rows_),
      borders as (
        select feature, quantile_disc(x, [{", ".join(f"{k} / {BINS}.0" for k in range(1, BINS))}]) as b
        from long_ group by feature),
      bins as (
        select rid, feature, position, len(list_filter(b, lambda e: e < x)) as bin from long_ join borders using (feature)),
      goals as (
        select rid, unnest(range(1, {len(TARGETS) + 1})) as horizon, unnest([{", ".join(units(t) for t in TARGETS)}]) as t
        from rows_),
      base as (
        select horizon, count(*) as n, cast((sum(t) - ((sum(t) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as base
        from goals group by horizon),
      gradients as (select rid, horizon, t - base as g, n from goals join base using (horizon)),
      cells as (
        select horizon, feature, position, bin, count(*) as c, sum(g) as g, any_value(n) as n
        from bins join gradients using (rid) group by horizon, feature, position, bin),
      grid as (
        select distinct horizon, feature, position, n, bar from cells, (select unnest(range({BINS})) as bar)),
      lefts as (
        select horizon, feature, position, n, bar,
          cast(sum(coalesce(c, 0)) over w as bigint) as left_rows, cast(sum(coalesce(g, 0)) over w as bigint) as left_gradient,
          cast(sum(coalesce(g, 0)) over (partition by horizon, feature) as bigint) as gradient
        from (select grid.*, c, g from grid left join cells
          on cells.horizon = grid.horizon and cells.feature = grid.feature and bin = bar)
        window w as (partition by horizon, feature order by bar))"""


def build() -> dict[str, str]:
    out = {}
    out["recode_calendar"] = f"""select station_id, event_id, timestamp, {d("input_flow_rate", "reservoir_level_percentage", "pressure")},
      pump_1, pump_2, {", ".join(DATE_PARTS)}, minute from readings"""
    out["pump_profile"] = f"""select station_id, day, hour, {d("pump_1_avg", "pump_2_avg", "both_pumps_avg")}
      from profile_1"""
    out["fix_pumps_off"] = f"select {KEY}, pump_1, pump_2, inputed_pump_status from pumps"
    out["fix_flow_zero"] = f"select {KEY}, {d('input_flow_rate')}, inputed_input_flow_rate from flows"
    out["zero_islands"] = """select station_id, island_start, island_end, n as island_length
      from raw_islands"""
    out["fill_short_islands"] = f"""select {KEY}, {d("reservoir_level_percentage")},
      inputed_reservoir_level from raw_levels"""
    out["fill_short_islands_sliced"] = out["fill_short_islands"]
    out["fill_pressure"] = f"select {KEY}, {d('pressure')} from pressures"
    out["mass_balance"] = f"""select {KEY}, {d("reservoir_level_liters", "time_passed_seconds", "total_liters_entered", "effective_liters_entered", "total_liters_out", "output_flow_rate")}
      from raw_balance"""
    out["fix_readings"] = f"""select {KEY}, {d("input_flow_rate", "reservoir_level_percentage", "pressure")},
      pump_1, pump_2, {d("output_flow_rate")} from repaired"""
    for name, walk in (("segment_walk", "walks"), ("segment_walk_hashed", "hashed_walks")):
        out[name] = f"""select {KEY}, row_idx, {d("reservoir_level_percentage", "input_flow_rate")},
          inputed_reservoir_level from {walk}"""
    out["fix_readings_with_segments"] = out["fix_readings"].replace("repaired", "walked_repaired")
    out["weather_clean"] = f"""
      select {_weather_out}, case when make_date(year, month, day) < date '2024-01-16' then 0 else 1 end as file
      from weather
      union all select {_weather_out}, 2 from overlay"""
    out["weather_union"] = f"select {_weather_out} from weather"
    moved = "make_timestamp(year, month, day, hour, 0, 0) - interval 3 hour"
    out["weather_local_hours"] = f"""select {_weather_out} from (
      select hour({moved}) as hour, day({moved}) as day, month({moved}) as month, year({moved}) as year,
        * exclude (hour, day, month, year) from weather)"""
    out["weather_duplicate_hours"] = """select hour, day, month, year, count(*) as n from (
      select hour, day, month, year from weather union all select hour, day, month, year from overlay)
      group by all having count(*) > 1"""
    out["weather_overlay"] = f"select {KEY}, {d(*WEATHER)} from raw_weathered"
    out["null_profile"] = f"""select {each("count(*) filter (where {c} is null) as {c}", ["input_flow_rate", "pressure", *WEATHER])}
      from raw_weathered"""
    out["moving_average_fill"] = f"select {KEY}, {d(*WEATHER)} from raw_filled"
    out["combined_readings"] = f"""select {KEY}, minute, hour, day_of_week, week_of_year, year,
      {d("input_flow_rate", "reservoir_level_percentage", "pressure", "output_flow_rate")}, pump_1, pump_2,
      {d(*WEATHER, "time_diff", "pump_1_duration", "pump_2_duration")} from combined"""
    out["hourly_agg"] = out["hourly_one_pass"] = f"select {_hours_out} from hours"
    out["hourly_grid"] = f"select {_grid_out} from grid"
    out["hourly_fill"] = f"select {_grid_out} from filled_grid"
    out["silver"] = f"select {_silver_out} from silver"
    out["silver_sliced"] = out["silver"]
    profile_ = """select station_id, hour,
      round(avg(output_flow_rate_mean) filter (where day_of_week < 5), 6) + 0.0 as avg_weekday_output_flow,
      round(avg(output_flow_rate_mean) filter (where day_of_week >= 5), 6) + 0.0 as avg_weekend_output_flow
      from silver {where} group by all"""
    out["hour_profile"] = profile_.format(where="")
    out["hour_profile_real"] = profile_.format(where="where not inputed_row")
    out["pump_peak_usage"] = f"""select station_id, pump, {_minutes("pk")} as average_time_used_peak_hours,
      {_minutes("op")} as average_time_used_offpeak_hours from usage"""
    out["pump_peak_share"] = """select station_id, pump, p as peak_minutes, o as offpeak_minutes,
      round(p / 240, 6) + 0.0 as proportion_peak_hours,
      round(o / 1200, 6) + 0.0 as proportion_offpeak_hours,
      printf('%.2f%%', p / 240 * 100) as peak_label, printf('%.2f%%', o / 1200 * 100) as offpeak_label
      from (select *, cast(trunc(coalesce(pk, 0)) as int) as p, cast(trunc(coalesce(op, 0)) as int) as o
            from usage)"""
    out["weather_corr"] = f"""select station_id,
      {each("round(corr(output_flow_rate_mean, {c}), 6) + 0.0 as corr_{c}", WEATHER)}
      from silver group by station_id"""
    out["lag_features"] = f"select station_id, timestamp, {quoted(LAGGED)} from wide"
    out["rolling_features"] = f"select station_id, timestamp, {quoted(ROLLED)} from wide"
    out["targets"] = f"select station_id, timestamp, {quoted(TARGETS)} from wide"
    everything = [*LAGGED, *ROLLED, *TARGETS, *STATS, *PUMP_SECONDS, *WEATHER, *DIFFS, CHANGE]
    out["training_set"] = f"""select station_id, timestamp, hour, day_of_week, week_of_year, year,
      {quoted([*LAGGED, *ROLLED])}, inputed_row, {quoted(TARGETS)} from wide
      where {" and ".join(f'"{n}" is not null' for n in everything)}"""
    complete = f"""select * from wide where {" and ".join(f'"{n}" is not null' for n in everything)}"""
    out["evaluation_targets"] = f"""
      select station_id, cast(row_number() over ({HOURLY}) - 1 as int) as position, timestamp,
        round(target_1, 6) + 0.0 as target_1
      from ({complete}) where timestamp >= timestamp '2024-01-21 00:00:00' and not inputed_row"""
    out["time_split"] = f"""
      select station_id, count(*) as hours, min(timestamp) as first, max(timestamp) as last,
        case when timestamp < timestamp '2024-01-21 00:00:00' then 'train' else 'test' end as part
      from ({complete}) group by station_id, part"""
    grown = _grown(complete)
    out["binned_sums"] = f"""select * from ({grown} select horizon, feature, bar, left_rows, left_gradient from lefts
      where bar < {BINS - 1})"""
    without = ", ".join(f"'{n}'" for n in FEATURES if n.endswith(WEATHER_WORDS))
    square = lambda g, n: f"{g}::double * {g}::double / ({n} + 1.0::double)"
    out["root_splits"] = f"""select * from ({grown},
      gains as (
        select *, {square("left_gradient", "left_rows")} + {square("(gradient - left_gradient)", "(n - left_rows)")}
          - {square("gradient", "n")} as gain
        from lefts where bar < {BINS - 1} and left_rows > 0 and left_rows < n)
      select variant, horizon, feature, bar, left_rows, left_gradient, gradient
      from (select unnest(['no_weather', 'weather']) as variant) join gains
        on variant = 'weather' or feature not in ({without})
      qualify row_number() over (partition by variant, horizon order by gain desc, position, bar) = 1)"""
    out["regression_metrics"] = f"""
      select station_id, {r2("a")} as mae, {r2("m")} as mse, {r2(f"sqrt({r2('m')})")} as rmse,
        {r2("1 - m / s")} as r2
      from (select station_id, avg(abs(y - p)) as a, avg((y - p) * (y - p)) as m, var_pop(y) as s
        from (select station_id, {CHANGE} as y, lag({CHANGE}, 24) over ({HOURLY}) as p from silver)
        where y is not null and p is not null group by station_id)"""
    out["raw_errors"] = f"""
      select station_id, round(avg((y - p) * (y - p)), 6) + 0.0 as mse
      from (select station_id, {CHANGE} as y, lag({CHANGE}, 24) over ({HOURLY}) as p from silver)
      where y is not null and p is not null group by station_id"""
    out["time_folds"] = f"""
      select station_id, timestamp, cast(case when i < n - 3 * (n // 4) then 0
        else 1 + (i - (n - 3 * (n // 4))) // (n // 4) end as int) as fold_block
      from (select station_id, timestamp, row_number() over ({HOURLY}) - 1 as i,
        count(*) over (partition by station_id) as n from silver)"""
    out["history_72h"] = """select station_id, anchor, timestamp,
      round(flow, 6) + 0.0 as output_flow_rate_mean_no_weather,
      round(flow, 6) + 0.0 as output_flow_rate_mean_weather from history"""
    out["forecast_path"] = _forecast("weather")
    out["forecast_requests"] = f"""{_forecast("weather")}"""
    out["unmatched_requests"] = """
      select station_id, timestamp as anchor from silver
        where (station_id, timestamp) not in (select (station_id, anchor) from paths)
      union all select station_id, timestamp + interval 6 year from silver"""
    out["first_forecast_rows"] = f"""select * from ({_forecast("weather")})
      where timestamp <= anchor + interval 5 hour"""
    out["forecast_path_own"] = _forecast("own")
    out["real_vs_forecast_split"] = f"""{_forecast("weather")}
      union all
      select station_id, anchor, timestamp, round(flow, 6) + 0.0, round(flow, 6) + 0.0, false
      from history
      where (station_id, anchor) in (select (station_id, anchor) from paths)
        and timestamp > anchor - interval 5 hour"""
    shown = lambda a, b, p, q: f"""round({a}, 6) + 0.0 as output_flow_rate_mean_no_weather,
      round({b}, 6) + 0.0 as output_flow_rate_mean_weather,
      round({p}, 6) + 0.0 as reservoir_level_percentage_last_no_weather,
      round({q}, 6) + 0.0 as reservoir_level_percentage_last_weather"""
    out["depletion_path"] = f"""
      select r.station_id, r.anchor, r.anchor + t * interval 1 hour as timestamp,
        {shown("f1", "f2", "l1", "l2")}, true as forecasted
      from emptied e join run_down r using (station_id, anchor)
      where t between greatest(1, e.crossing - 23) and e.crossing
      union all
      select e.station_id, e.anchor, h.timestamp, {shown("flow", "flow", "level", "level")}, false
      from emptied e join history h on h.station_id = e.station_id and h.anchor = e.anchor
      where h.timestamp > e.anchor - (24 - e.crossing) * interval 1 hour"""
    out["time_to_empty"] = """select station_id, anchor, cast(elapsed as int) as time_elapsed,
      cast(crossing as int) as empty_after from emptied"""
    out["states_table"] = f"""select station_id, timestamp, hour, day_of_week, week_of_year, {d(*STATE_COLUMNS)},
      pump_1_active, pump_2_active, {d(*FORECASTS)}, time_to_depletion from states"""
    out["state_lookup"] = f"""
      select q.station_id, q.timestamp, s.timestamp as state_timestamp,
        {d("reservoir_level_percentage_mean").replace("round(", "round(s.")}, s.pump_active,
        s.time_to_depletion, {d(FORECASTS[0])}
      from silver q join (select * from searchable qualify row_number() over (partition by
        station_id, hour, day_of_week, week_of_year order by timestamp) = 1) s
      using (station_id, hour, day_of_week, week_of_year)"""
    for reward in ("flat", "raw_outflow", "graded_inflow", "graded"):
        out[f"schedule_reward_{reward}"] = f"""select station_id, timestamp, candidate_id, schedule,
          {d("reward")} from ({rewards(reward)})"""
    out["best_random_schedule"] = f"""
      select station_id, timestamp, candidate_id, schedule, {d("reward")} from ({random_rewards()})
      qualify row_number() over (partition by station_id, timestamp
        order by reward desc, candidate_id) = 1"""
    out["best_schedule"] = f"""select station_id, timestamp, candidate_id, schedule, {d("reward")}
      from flat_rewards qualify row_number() over (partition by station_id, timestamp
        order by reward desc, candidate_id) = 1"""
    return {name: sql(text) for name, text in out.items()}
