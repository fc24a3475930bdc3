"""Registration, and the checking side's own definition of the flight tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The flight tables in SQL, independent of the DataFrame definitions in
# tarmac.plans.workload: plain windows, and every as-of match by brute force.
_WEATHER_MATCH = """
    select flight_id, obs_id, valid_time, temp, dewPt, rh, vis, wc, wspd, feels_like, uv_index, pressure
    from (select f.flight_id, o.*, row_number() over (partition by f.flight_id
            order by abs(epoch_us(o.valid_time) - epoch_us(f.{at})), o.valid_time, o.obs_id) as nr
          from f_landed f join f_obs o on o.fs = f.{station}) ranked
    where nr = 1"""
# The forecast of the hour, from the answer last fetched when the flight's day begins.
_FORECAST_MATCH = """
    select f.flight_id, c.*
    from f_landed f join f_runs r on r.fs = f.{station} and r.scored_at = date_trunc('day', f.sched)
    join f_hour_forecast c on c.fs = f.{station} and c.fetched_at = r.run and hour(c.fcst_valid) = hour(f.{at})"""
VIEWS = {
    "f_airports": """
    select concat('A', lpad(cast(n_nationkey as varchar), 2, '0')) as fs, n_name as name, r_name as country,
      case when n_nationkey % 3 = 0 then null else concat('S', cast(n_nationkey as varchar)) end as state,
      cast(25 + (n_nationkey * 7) % 25 as double) as latitude,
      cast(-125 + (n_nationkey * 11) % 58 as double) as longitude,
      cast(-4 - n_nationkey % 5 as int) as utc_offset_hours,
      case n_nationkey % 5 when 0 then 'America/New_York' when 1 then 'America/Chicago'
        when 2 then 'America/Denver' when 3 then 'America/Los_Angeles' else 'America/Anchorage' end as zone
    from nation join region on n_regionkey = r_regionkey""",
    "f_flights": """
    select flight_id, event_type, concat('A', lpad(cast(user_id % 25 as varchar), 2, '0')) as dep,
      concat('A', lpad(cast((user_id * 7 + flight_id) % 25 as varchar), 2, '0')) as arr,
      upper(substring(event_type, 1, 2)) as carrier, cast(flight_id as varchar) as flight_number,
      case when event_type = 'error' then 'C' else 'L' end as status, sched, act_dep, act_arr, user_id, value
    from (select event_id as flight_id, event_type, user_id, value, ts as sched,
      lead(ts, 1) over (partition by user_id order by ts, event_id) as act_dep,
      lead(ts, 2) over (partition by user_id order by ts, event_id) as act_arr from events) e
    where event_type in ('purchase', 'signup', 'error')""",
    "f_landed": """
    select *, cast(case when status = 'C' then 0 when delta < 15 then 1 when delta < 120 then 2
      when delta < 240 then 3 else 4 end as int) as classification
    from (select *, cast(date_sub('minute', sched, act_dep) as bigint) as delta from f_flights
      where act_dep is not null and act_arr is not null) f""",
    "f_obs": """
    select obs_id, concat('A', lpad(cast((user_id * 3 + obs_id) % 25 as varchar), 2, '0')) as fs, valid_time,
      value as temp, value - (100 - k) / cast(5 as double) as dewPt, k as rh, value / cast(10 as double) as vis,
      value - k / cast(10 as double) as wc, k % 40 as wspd, value - 5 as feels_like, k % 12 as uv_index,
      case when k % 10 = 0 then null else 1000 + k / cast(4 as double) end as pressure
    from (select event_id as obs_id, user_id, ts as valid_time, value,
      cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events where event_type in ('view', 'click')) e""",
    "f_forecast": """
    select obs_id as forecast_id, fs, cast(date_trunc('hour', valid_time) as timestamp) as fcst_valid,
      date_trunc('day', valid_time) - to_days(cast(obs_id % 2 as int)) as fetched_at, temp, dewPt as dewpoint, rh, vis, wc, wspd, feels_like, uv_index,
      cast(obs_id % 60 as int) as icon_code
    from f_obs""",
    "f_history": """
    select concat('A', lpad(cast(s_nationkey as varchar), 2, '0')) as dep,
      concat('A', lpad(cast(c_nationkey as varchar), 2, '0')) as arr,
      l_returnflag as carrier, l_linenumber as flight_number, o_orderdate as departure, l_orderkey
    from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey""",
    "f_pred": """
    select flight_id, 'm1' as model, 1 as model_pos, classification as label,
      cast(case when value < 50 then 1 when value < 120 then 2 else 4 end as int) as prediction from f_landed
    union all select flight_id, 'm2', 2, classification, cast(user_id % 5 as int) from f_landed
    union all select flight_id, 'm3', 3, classification, cast(flight_id % 5 as int) from f_landed
    union all select flight_id, 'm4', 4, classification,
      cast(case when flight_id % 3 = 0 then classification else 1 end as int) from f_landed""",
    "f_status": """
    select carrier, flight_number, dep, cast(sched as date) as day, pos,
      case when pos = 0 then status else 'X' end as status, sched as gate_departure, act_dep, act_arr
    from f_flights cross join (select cast(0 as int) as pos union all select cast(1 as int)) p
    where flight_id % 50 <> 0""",
    "f_legs": """
    select flight_id, carrier, cast(flight_id % 40 as int) as number, cast(sched as date) as day, sched, dep
    from f_flights""",
    "f_requests": """
    select carrier, number, day, cast(case when number % 4 = 0 then 99 else max(hour(sched)) end as int) as want_hour,
      count(*) as legs
    from f_legs group by carrier, number, day""",
    "f_airlines": "select 'PU' as fs, 'Purchase Air' as name union all select 'SI', 'Signup Air'",
    "f_sets": """
    select fs as airport, case when fs <= 'A14' then 'training' when fs <= 'A19' then 'test' else 'blind' end as data_set
    from f_airports""",
    "f_dep_weather": _WEATHER_MATCH.format(at="sched", station="dep"),
    "f_arr_weather": _WEATHER_MATCH.format(at="act_arr", station="arr"),
    "f_hour_forecast": """
    select * from (select *, row_number() over (partition by fs, fetched_at, hour(fcst_valid)
      order by fcst_valid desc, forecast_id desc) as nr from f_forecast) ranked where nr = 1""",
    "f_runs": """
    select distinct a.fs, a.scored_at, (select max(c.fetched_at) from f_forecast c where c.fs = a.fs and c.fetched_at <= a.scored_at) as run
    from (select dep as fs, date_trunc('day', sched) as scored_at from f_landed union select arr, date_trunc('day', sched) from f_landed) a""",
    "f_dep_forecast": _FORECAST_MATCH.format(at="sched", station="dep"),
    "f_arr_forecast": _FORECAST_MATCH.format(at="act_arr", station="arr"),
    "f_told_obs": """
    select distinct fs, date_trunc('second', valid_time) as valid_time from f_obs
    where date_trunc('second', valid_time) >= date_trunc('day', valid_time) + interval 1 hour""",
    "f_far": """
    select *, concat('A', lpad(cast(user_id % 27 as varchar), 2, '0')) as far_dep,
      concat('A', lpad(cast((user_id * 7 + flight_id) % 27 as varchar), 2, '0')) as far_arr from f_flights""",
    "f_links": "select dep as src, arr as dst, count(*) as n from f_history group by dep, arr",
    "f_votes": """
    select flight_id, prediction, count(*) as votes, min(model_pos) as first from f_pred group by flight_id, prediction""",
    "f_ranked_votes": """
    select *, row_number() over (partition by flight_id order by votes desc, first) as nr from f_votes""",
    "f_overall": """
    select a.flight_id, case when b.votes = a.votes then concat('Undecided: ', {a}, '/', {b}) else {a} end as overall
    from f_ranked_votes a left join f_ranked_votes b on b.flight_id = a.flight_id and b.nr = 2
    where a.nr = 1""",
    "f_histogram": """
    select bucket, low + bucket * width as bucket_low,
      case when bucket = 49 then high else low + (bucket + 1) * width end as bucket_high, width,
      cast(coalesce(n, 0) as bigint) as n
    from (select cast(min(delta) as double) as low, cast(max(delta) as double) as high,
            cast(max(delta) - min(delta) as double) / 50 as width from f_landed where delta > 12 and delta < 50) bounds
    cross join (select cast(range as int) as bucket from range(50)) buckets
    left join (select least(cast(floor((delta - lo) / ((hi - lo) / 50)) as int), 49) as place, count(*) as n
      from (select cast(delta as double) as delta, cast(min(delta) over () as double) as lo, cast(max(delta) over () as double) as hi
            from f_landed where delta > 12 and delta < 50) kept group by 1) counted on place = bucket""",
}


def label_case(column: str, classes: int = 5) -> str:
    """Class text in SQL."""
    texts = {
        5: ["Canceled", "On Time", "Delayed less than 2 hours", "Delayed between 2 and 4 hours", "Delayed more than 4 hours"],
        3: ["Delayed less than 13 minutes", "Delayed between 13 and 41 minutes", "Delayed more than 41 minutes"],
    }[classes]
    whens = " ".join(f"when {i} then '{t}'" for i, t in enumerate(texts))
    return f"case {column} {whens} else cast({column} as varchar) end"


VIEWS["f_overall"] = VIEWS["f_overall"].format(a=label_case("a.prediction"), b=label_case("b.prediction"))


def with_views(text: str) -> str:
    """The SQL with the flight tables it uses, directly or not, put before it."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in sorted(set(re.findall(r"\bf_[a-z_]+\b", sql)) & set(VIEWS)):
            if name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(text)
    if not needed:
        return text
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed) + "\n" + text


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL for its result where SQL can say it."""

    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)

        key = name or function.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return run

    return register


def rounded(*columns: str) -> list[Column]:
    """Doubles to 6 places, the precision at which results are compared."""
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]


def day_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
