from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.base import day_text, query, rounded
from tarmac.operators import asof, joins, ordering
from tarmac.plans import workload as w


@query("""select f.flight_id, f.dep, f.sched, m.obs_id, m.valid_time, round(m.temp, 6) as temp
    from f_landed f left join f_dep_weather m on m.flight_id = f.flight_id""")
def asof_departure_weather(spark, folder):
    found = asof.nearest_observation(
        w.landed_table(spark, folder), w.observations(spark, folder), "dep", "sched", "weather"
    )
    return found.select("flight_id", "dep", "sched", "weather.obs_id", "weather.valid_time", "weather.temp").select(
        "flight_id", "dep", "sched", "obs_id", "valid_time", *rounded("temp")
    )


@query("""select f.flight_id, f.arr, f.act_arr, m.obs_id, m.valid_time, round(m.temp, 6) as temp
    from f_landed f left join f_arr_weather m on m.flight_id = f.flight_id""")
def asof_arrival_weather(spark, folder):
    found = asof.nearest_observation(
        w.landed_table(spark, folder), w.observations(spark, folder), "arr", "act_arr", "weather"
    )
    return found.select("flight_id", "arr", "act_arr", "weather.*").select(
        "flight_id", "arr", "act_arr", "obs_id", "valid_time", *rounded("temp")
    )


@query("""select flight_id, dep, sched, obs_id, valid_time
    from (select f.flight_id, f.dep, f.sched, o.obs_id, o.valid_time, row_number() over (partition by f.flight_id
            order by abs(date_sub('minute', o.valid_time, f.sched)), o.valid_time, o.obs_id) as nr
          from f_landed f left join f_obs o on o.fs = f.dep) ranked where nr = 1""")
def asof_departure_weather_minute(spark, folder):
    found = asof.nearest_observation(
        w.landed_table(spark, folder), w.observations(spark, folder), "dep", "sched", "weather", granularity="minute"
    )
    return found.select("flight_id", "dep", "sched", "weather.obs_id", "weather.valid_time")


@query("""select f.flight_id, f.dep, f.arr, d.name as dep_name, a.name as arr_name
    from (select flight_id, far_dep as dep, far_arr as arr from f_far) f join f_airports d on d.fs = f.dep join f_airports a on a.fs = f.arr""")
def join_airports(spark, folder):
    return joins.join_airports(w.far_flights(spark, folder), w.airports(spark, folder)).select(
        "flight_id", "dep", "arr", F.col("departureAirport.name").alias("dep_name"), F.col("arrivalAirport.name").alias("arr_name")
    )


@query("""select flight_id, far_dep as dep, far_arr as arr, concat('no airport record: ', case when d.fs is null then far_dep else far_arr end) as reject_reason
    from f_far f left join f_airports d on d.fs = far_dep left join f_airports a on a.fs = far_arr where d.fs is null or a.fs is null""")
def join_airports_rejects(spark, folder):
    return joins.airport_rejects(w.far_flights(spark, folder), w.airports(spark, folder)).select("flight_id", "dep", "arr", "reject_reason")


@query("""select f.flight_id, s.status, s.gate_departure, s.act_dep, s.act_arr
    from f_flights f join f_status s on s.carrier = f.carrier and s.flight_number = f.flight_number
      and s.dep = f.dep and s.day = cast(f.sched as date) and s.pos = 0""")
def join_status(spark, folder):
    schedules = w.flights(spark, folder).select(
        "flight_id", "carrier", "flight_number", "dep", F.to_date("sched").alias("day")
    )
    return joins.join_status(schedules, w.statuses(spark, folder), ["carrier", "flight_number", "dep", "day"]).select(
        "flight_id", "status", "gate_departure", "act_dep", "act_arr"
    )


@query("""select f.flight_id, s.status, s.gate_departure from f_flights f
    join f_status s on s.carrier = f.carrier and s.flight_number = f.flight_number and s.pos = 0""")
def join_nested_status(spark, folder):
    """Answers that hold their entries as an array; every 50th has none."""
    flights = w.flights(spark, folder)
    entry = [F.struct(F.lit(s).alias("status"), F.col("sched").alias("gate_departure")) for s in ("L", "C", "X")]
    entries = F.array(F.when(F.col("status") == "C", entry[1]).otherwise(entry[0]), entry[2])
    none = F.filter(entries, lambda e: F.lit(False))
    answers = flights.select("carrier", "flight_number", F.when(F.col("flight_id") % 50 != 0, entries).otherwise(none).alias("flightStatuses"))
    schedules = flights.select("flight_id", "carrier", "flight_number")
    return joins.join_nested_status(schedules, answers, ["carrier", "flight_number"]).select("flight_id", "status", "gate_departure")


@query("""select f.flight_id, c.forecast_id, c.fcst_valid, c.icon_code, round(c.temp, 6) as temp
    from f_landed f left join f_dep_forecast c on c.flight_id = f.flight_id""")
def join_forecast_hour(spark, folder):
    flights = w.scored_by_day(w.landed(spark, folder))
    found = joins.join_forecast_hour(flights, w.forecasts(spark, folder), "dep", "sched", "forecast", "scored_at")
    return found.select("flight_id", "forecast.*").select(
        "flight_id", "forecast_id", "fcst_valid", "icon_code", *rounded("temp")
    )


@query("""select f.flight_id, l.name as airline_name, d.name as dep_name, p.p_name as equipment_name
    from f_far f left join f_airlines l on l.fs = f.carrier
    left join f_airports d on d.fs = f.far_dep
    left join part p on p.p_partkey = f.user_id""")
def join_appendix(spark, folder):
    """Every airport is listed twice, as in the appendices of several answers."""
    found = joins.join_appendix(w.far_flights(spark, folder), w.airlines(spark, folder), "carrier", "fs", "airline", empty=True)
    twice = w.airports(spark, folder).unionByName(w.airports(spark, folder))
    found = joins.join_appendix(found, twice, "dep", "fs", "airport")
    parts = w.table(spark, folder, "part").select("p_partkey", "p_name")
    found = joins.join_appendix(found, parts, "user_id", "p_partkey", "equipment", empty=True)
    return found.select(
        "flight_id",
        F.col("airline.name").alias("airline_name"),
        F.col("airport.name").alias("dep_name"),
        F.col("equipment.p_name").alias("equipment_name"),
    )


@query("""select r.carrier, r.number, strftime(r.day, '%Y-%m-%d') as day, r.want_hour, r.legs as candidates,
      case when r.legs = 1 then lone.flight_id else hit.flight_id end as flight_id,
      case when r.legs > 1 and hit.flight_id is null then 'no departure at the requested hour' end as reject_reason
    from f_requests r
    left join (select carrier, number, day, min(flight_id) as flight_id from f_legs group by carrier, number, day) lone
      on lone.carrier = r.carrier and lone.number = r.number and lone.day = r.day
    left join (select carrier, number, day, hour(sched) as h, arg_min(flight_id, (sched, flight_id)) as flight_id
               from f_legs group by carrier, number, day, hour(sched)) hit
      on hit.carrier = r.carrier and hit.number = r.number and hit.day = r.day and hit.h = r.want_hour""")
def disambiguate_leg(spark, folder):
    asked = w.requests(spark, folder).drop("legs")
    found = joins.disambiguate_leg(asked, w.legs(spark, folder), ["carrier", "number", "day"])
    return found.select(
        "carrier", "number", day_text("day").alias("day"), "want_hour", "candidates", "leg.flight_id", "reject_reason"
    )


@query("""select flight_id, dep, sched from f_flights f where exists (select 1 from f_obs o
      where o.fs = f.dep and date_trunc('hour', o.valid_time) = date_trunc('hour', f.sched))""")
def semi_join_observed_hours(spark, folder):
    hours = joins.observed_hours(w.observations(spark, folder))
    return joins.in_observed_hours(w.flights(spark, folder), hours).select("flight_id", "dep", "sched")


@query("""select a.flight_id as first_flight, a.dep as origin, a.arr as via,
      strftime(cast(a.sched as date), '%Y-%m-%d') as second_date, count(*) as options,
      arg_min(b.flight_id, (b.sched, b.flight_id)) as earliest_second,
      arg_max(b.flight_id, (b.sched, b.flight_id)) as latest_second
    from f_flights a join f_flights b on b.dep = a.arr and cast(b.sched as date) = cast(a.sched as date)
    group by a.flight_id, a.dep, a.arr, cast(a.sched as date)""")
def two_leg_itinerary(spark, folder):
    flights = w.flights(spark, folder)
    return joins.two_leg_itinerary(flights, flights).withColumn("second_date", day_text("second_date"))


@query("""select flight_id, dep, cast(row_number() over (partition by dep order by sched, flight_id) as bigint) as turn
    from f_flights""")
def fair_interleave(spark, folder):
    flights = w.flights(spark, folder).select("flight_id", "dep", "sched")
    return ordering.fair_interleave(flights).select("flight_id", "dep", "turn")


@query("""select flight_id, dep, turn from (select flight_id, dep,
      cast(row_number() over (partition by dep order by sched, flight_id) as bigint) as turn from f_flights) t
    order by turn, dep limit 60""")
def fair_quota(spark, folder):
    flights = w.flights(spark, folder).select("flight_id", "dep", "sched")
    return ordering.fair_quota(flights, 60).select("flight_id", "dep", "turn")


@query("""select carrier, flight_number, dep, strftime(day, '%Y-%m-%d') as day, status, pos
    from (select *, row_number() over (partition by carrier, flight_number, dep, day order by pos) as nr from f_status) s
    where nr = 1""")
def first_per_key(spark, folder):
    first = joins.first_per_key(w.statuses(spark, folder), ["carrier", "flight_number", "dep", "day"], ["pos"])
    return first.select("carrier", "flight_number", "dep", day_text("day").alias("day"), "status", "pos")


@query("""select flight_id, dep, delta from f_landed order by delta desc, flight_id limit 5""")
def top_n(spark, folder):
    landed = w.landed(spark, folder).select("flight_id", "dep", "delta")
    return ordering.top_n(landed, [F.col("delta").desc(), F.col("flight_id")])
