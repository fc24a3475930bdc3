from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.base import day_text, query, rounded
from tarmac.operators.routes import route_counts as count_routes
from tarmac.operators.routes import route_links
from tarmac.plans import from_landed
from tarmac.plans import workload as w
from tarmac.session import shared_dir, written
from tarmac.sources import accumulate, datasets, history, landed, metadata
from tarmac.sources.schemas import AIRPORT


@query("""select flight_id, dep, arr, carrier, flight_number, status, delta, cast(classification as bigint) as classification
    from f_landed""")
def load_dataset(spark, folder):
    path = shared_dir(spark, "dataset")
    datasets.write_documents(w.landed(spark, folder), path)
    return datasets.load_dataset(spark, path, "training", cache=False).select(
        "flight_id", "dep", "arr", "carrier", "flight_number", "status", "delta", "classification"
    )


@query("select dep, arr, carrier, flight_number, departure, l_orderkey from f_history")
def load_history(spark, folder):
    path = shared_dir(spark, "history")
    rows = w.history(spark, folder)
    history.save_history(rows.withColumn("departureMonth", F.trunc("departure", "month")), path)
    return history.load_history(spark, path).select(rows.columns)


@query("""select strftime(departure, '%Y-%m') as month, dep, count(*) as stored from f_history group by 1, 2""")
def append_history(spark, folder):
    """Two runs by the default layout; the second one is repeated, which stores nothing more."""
    path = shared_dir(spark, "history")
    rows = w.history(spark, folder).withColumn("departureMonth", F.trunc("departure", "month"))
    for run in ("returned", "kept", "kept"):
        history.save_history(rows.where((F.col("carrier") == "R") == (run == "returned")), path, run=run)
    stored = history.load_history(spark, path)
    return stored.groupBy(F.date_format("departureMonth", "yyyy-MM").alias("month"), "dep").agg(F.count(F.lit(1)).alias("stored"))


@query("""select 'all' as run, strftime(departure, '%Y-%m') as month, count(*) as stored from f_history where carrier = 'R' and month(departure) <= 6 group by 1, 2
    union all select null, strftime(departure, '%Y-%m'), count(*) from f_history where carrier = 'N' group by 1, 2
    union all select 'unparted', strftime(departure, '%Y-%m'), count(*) from f_history where carrier = 'A' group by 1, 2""")
def replace_history_run(spark, folder):
    """A run that is repeated with fewer months leaves none of the others; plain, keyed and unpartitioned runs share the table."""
    path = shared_dir(spark, "history")
    rows = w.history(spark, folder).withColumn("departureMonth", F.trunc("departure", "month"))
    history.save_history(rows, path, run="all")
    history.save_history(rows.where("carrier = 'N'"), path)
    history.save_history(rows.where("carrier = 'A'"), path, partition=None, run="unparted")
    history.save_history(rows.where("carrier = 'R' and month(departure) <= 6"), path, run="all")
    stored = history.load_history(spark, path)
    return stored.groupBy("run", F.date_format("departureMonth", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("stored"))


def _one_answer_each(df, name, *columns):
    """Each row as the text of an answer whose list `name` holds it alone."""
    return df.select(F.to_json(F.struct(F.array(F.struct(*columns)).alias(name))).alias("body"))


def _raw_airlines(spark, folder):
    return _one_answer_each(w.airlines(spark, folder), "airlines", "fs", "name")


def _raw_airports(spark, folder):
    return _one_answer_each(
        w.airports(spark, folder),
        "airports",
        "fs",
        "name",
        F.col("state").alias("stateCode"),
        F.col("country").alias("countryCode"),
        "latitude",
        "longitude",
    )


def _metadata(spark, folder):
    return metadata.metadata_union(
        metadata.load_airlines(_raw_airlines(spark, folder)), metadata.load_airports(_raw_airports(spark, folder))
    )


@query("select fs, name, 'airlines' as metadata_type from f_airlines")
def load_airlines(spark, folder):
    return metadata.load_airlines(_raw_airlines(spark, folder)).select("fs", "name", "metadata_type")


@query("""select fs, name, state as stateCode, country as countryCode, latitude, longitude, 'airports' as metadata_type
    from f_airports""")
def load_airports(spark, folder):
    return metadata.load_airports(_raw_airports(spark, folder)).select(
        "fs", "name", "stateCode", "countryCode", "latitude", "longitude", "metadata_type"
    )


@query("""select fs, name, cast(null as varchar) as countryCode, 'airlines' as metadata_type from f_airlines
    union all select fs, name, country, 'airports' from f_airports""")
def metadata_union(spark, folder):
    return _metadata(spark, folder).select("fs", "name", "countryCode", "metadata_type")


@query("select fs, name from f_airports")
def view_airports(spark, folder):
    return metadata.airports_view(_metadata(spark, folder))


@query("select fs from f_airlines")
def view_airlines(spark, folder):
    return metadata.airlines_view(_metadata(spark, folder))


@query("select fs, name from f_airports where country = 'ASIA'")
def view_country_airports(spark, folder):
    return metadata.country_airports_view(_metadata(spark, folder), "ASIA")


def _raw_observations(spark, folder):
    """An answer per observation, fetched at the end of its day; odd ones hold a lone record.

    Lists hold bad entries next to the good one, and every seventh observation comes with an
    answer whose lone record is none.
    """
    observed = w.observations(spark, folder)
    record = F.struct(
        F.unix_seconds(F.col("valid_time").cast("timestamp")).alias("valid_time_gmt"),
        *[c for c in observed.columns if c not in ("obs_id", "fs", "valid_time")],
    )
    lone = F.to_json(F.struct(record.alias("observation")))
    bad = ',5,"text",{"valid_time_gmt":"soon","temp":1},null,[]]}'
    listed = F.concat(F.lit('{"observations":['), F.to_json(record), F.lit(bad))
    answer = F.when(F.col("obs_id") % 2 == 1, lone).otherwise(listed)
    answers = F.when(F.col("obs_id") % 7 == 0, F.array(answer, F.lit('{"observation":"none"}'))).otherwise(F.array(answer))
    return observed.select(
        "fs", F.date_add(F.to_date("valid_time"), 1).cast("timestamp_ntz").alias("fetched_at"), F.explode(answers).alias("body")
    )


@query("""select reject_reason, position, count(*) as entries from (
      select unnest(['not a record', 'not a record', 'no readable valid_time_gmt', 'not a record', 'not a record']) as reject_reason,
        unnest([1, 2, 3, 4, 5]) as position from f_obs where obs_id % 2 = 0
      union all select 'not a record', 0 from f_obs where obs_id % 7 = 0) t group by reject_reason, position""")
def ingest_observations_rejects(spark, folder):
    bad = landed.observation_rejects(_raw_observations(spark, folder))
    return bad.groupBy("reject_reason", "position").agg(F.count(F.lit(1)).alias("entries"))


_OBSERVED = """select fs, date_trunc('second', valid_time) as valid_time, round(temp, 6) as temp, round(dewPt, 6) as dewPt,
      cast(rh as double) as rh, pressure
    from f_obs where date_trunc('second', valid_time) >= date_trunc('day', valid_time) + interval 1 hour"""


@query(_OBSERVED)
def split_observations(spark, folder):
    """The rows side of an ingest that writes rows and rejects from one parse."""
    parsed = landed.split_observations(_raw_observations(spark, folder))
    return parsed.rows.select("fs", "valid_time", *rounded("temp", "dewPt"), "rh", "pressure")


@query(_OBSERVED)
def ingest_observations(spark, folder):
    rows = landed.ingest_observations(_raw_observations(spark, folder))
    return rows.select("fs", "valid_time", *rounded("temp", "dewPt"), "rh", "pressure")


@query("""select fs, valid_time, min(obs_id) as obs_id, count(*) > 0 as kept from f_obs group by fs, valid_time""")
def dedupe_observations(spark, folder):
    fetched_twice = w.observations(spark, folder).withColumn("_run", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_run")
    return landed.dedupe_observations(fetched_twice, tie="obs_id").select(
        "fs", "valid_time", "obs_id", F.lit(True).alias("kept")
    )


def _raw_forecasts(spark, folder):
    """An answer per forecast, fetched when the forecast says, and one three days earlier that is out of reach.

    Its list holds a number and a record without a time as well.
    """
    issued = w.forecasts(spark, folder)
    record = F.struct(
        F.unix_seconds(F.col("fcst_valid").cast("timestamp")).alias("fcst_valid"),
        F.col("dewpoint").alias("dewpt"),
        *["temp", "rh", "vis", "wc", "wspd", "feels_like", "uv_index", "icon_code"],
    )
    days = F.explode(F.array(F.lit(0), F.lit(3)))
    return issued.withColumn("_back", days).select(
        "fs",
        F.date_sub(F.to_date("fetched_at"), F.col("_back")).cast("timestamp_ntz").alias("fetched_at"),
        F.concat(F.lit('{"forecasts":[7,'), F.to_json(record), F.lit(',{"temp":1}]}')).alias("body"),
    )


@query("""select reject_reason, position, 2 * count(*) as entries from f_forecast
    cross join (select 'not a record' as reject_reason, 0 as position union all select 'no readable fcst_valid', 2) b group by 1, 2""")
def ingest_forecasts_rejects(spark, folder):
    bad = landed.forecast_rejects(_raw_forecasts(spark, folder))
    return bad.groupBy("reject_reason", "position").agg(F.count(F.lit(1)).alias("entries"))


@query("""select fs, fetched_at, fcst_valid, round(dewpoint, 6) as dewpt, round(temp, 6) as temp,
      cast(rh as double) as rh, icon_code from f_forecast""")
def ingest_forecasts(spark, folder):
    rows = landed.ingest_forecasts(_raw_forecasts(spark, folder))
    return rows.select("fs", "fetched_at", "fcst_valid", *rounded("dewpt", "temp"), "rh", "icon_code")


@query("select distinct fs, name from f_airports join f_flights on arr = fs")
def ingest_appendix(spark, folder):
    """Every schedule answer repeats its destination in the appendix."""
    places = w.airports(spark, folder).select(F.col("fs").alias("arr"), F.struct("fs", "name").alias("place"))
    answers = w.flights(spark, folder).join(places, "arr").select(
        F.to_json(F.struct(F.struct(F.array("place").alias("airports")).alias("appendix"))).alias("body")
    )
    return landed.ingest_appendix(answers, "airports", AIRPORT, "fs").select("fs", "name")


def _raw_schedules(spark, folder, flights=None):
    """Three answers per flight: its schedule, an hour without flights, and an error."""
    flights = w.flights(spark, folder) if flights is None else flights
    flight = F.struct(
        F.col("carrier").alias("carrierFsCode"),
        F.col("flight_number").alias("flightNumber"),
        F.col("dep").alias("departureAirportFsCode"),
        F.col("arr").alias("arrivalAirportFsCode"),
        F.date_format("sched", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("departureTime"),
    )
    bodies = F.array(
        F.concat(F.lit('{"scheduledFlights":['), F.to_json(flight), F.lit(',7,{"departureTime":"late"}]}')),
        F.lit('{"scheduledFlights":[]}'),
        F.lit('{"error":{"errorMessage":"quota"}}'),
    )
    return flights.select(
        F.year("sched").alias("year"),
        F.month("sched").alias("month"),
        F.day("sched").alias("day"),
        F.hour("sched").alias("hour"),
        F.explode(bodies).alias("body"),
    )


@query("""select carrier, flight_number, dep, arr, sched, cast(year(sched) as int) as year, cast(month(sched) as int) as month,
      cast(day(sched) as int) as day, cast(hour(sched) as int) as hour from f_flights""")
def ingest_schedules(spark, folder):
    rows = landed.ingest_schedules(_raw_schedules(spark, folder))
    return rows.select(
        F.col("carrierFsCode").alias("carrier"),
        F.col("flightNumber").alias("flight_number"),
        F.col("departureAirportFsCode").alias("dep"),
        F.col("arrivalAirportFsCode").alias("arr"),
        F.col("departureTime").alias("sched"),
        "date.*",
    )


@query("""select reject_reason, position, count(*) as answers from f_flights
    cross join (select 'error answer' as reject_reason, null::int as position
      union all select 'not a record', 1 union all select 'no readable departureTime', 2) b group by 1, 2""")
def ingest_schedules_rejects(spark, folder):
    bad = landed.schedule_rejects(_raw_schedules(spark, folder))
    return bad.groupBy("reject_reason", "position").agg(F.count(F.lit(1)).alias("answers"))


def _raw_statuses(spark, folder, flights=None):
    """A status answer per flight with two entries; for every 30th flight the first one is none."""

    def instant(column):
        return F.struct(F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("dateUtc"))

    times = F.struct(
        instant("sched").alias("scheduledGateDeparture"),
        instant("act_dep").alias("actualRunwayDeparture"),
        F.when(F.col("act_arr").isNotNull(), instant("act_arr")).alias("actualRunwayArrival"),
    )
    first = F.to_json(F.struct("status", times.alias("operationalTimes")))
    entry = F.when(F.col("flight_id") % 30 == 0, F.lit("3")).otherwise(first)
    flights = (w.flights(spark, folder) if flights is None else flights).where(F.col("act_dep").isNotNull())
    return flights.select("flight_id", F.concat(F.lit('{"flightStatuses":['), entry, F.lit(',{"status":"X"}]}')).alias("body"))


_STATUSES = """select flight_id, status, sched as scheduledGateDeparture, act_dep as actualRunwayDeparture, act_arr as actualRunwayArrival
    from f_flights where act_dep is not null and flight_id % 30 <> 0"""


@query(_STATUSES)
def ingest_statuses(spark, folder):
    return landed.ingest_statuses(_raw_statuses(spark, folder), ["flight_id"])


@query(_STATUSES)
def split_statuses(spark, folder):
    """The rows side of the statuses' one parse."""
    return landed.split_statuses(_raw_statuses(spark, folder), ["flight_id"]).rows


@query("""select 'not a record' as reject_reason, cast(0 as int) as position, count(*) as entries, min(flight_id) as first_flight
    from f_flights where act_dep is not null and flight_id % 30 = 0""")
def ingest_statuses_rejects(spark, folder):
    bad = landed.status_rejects(_raw_statuses(spark, folder))
    return bad.groupBy("reject_reason", "position").agg(F.count(F.lit(1)).alias("entries"), F.min("flight_id").alias("first_flight"))


@query("""select f.flight_id, f.dep, a.state, f.classification from f_landed f join f_airports a on a.fs = f.dep""")
def accumulate_append(spark, folder):
    """The key holds the airport's state, which some do not have."""
    path = shared_dir(spark, "accumulated")
    states = w.airports(spark, folder).select(F.col("fs").alias("dep"), "state")
    flights = w.landed(spark, folder).join(states, "dep").select("flight_id", "dep", "state", "classification")
    for run in (flights.where(F.col("classification") > 0), flights):
        accumulate.append_new(run, path, ["flight_id", "state"])
    return spark.read.parquet(path)


@query("""select concat('{"src":"', src, '","dst":"', dst, '","count":', cast(n as varchar), '}') as json from f_links""")
def rows_to_json(spark, folder):
    return datasets.rows_to_json(count_routes(route_links(w.history(spark, folder))))


_PROFILED = ["flight_id", "dep", "arr", "carrier", "act_dep", "value", "delta", "classification"]


@query(" union all ".join(
    f"select cast({i} as int) as position, '{c}' as column_name, count(*) as rows, count({c}) as non_null from f_landed"
    for i, c in enumerate(_PROFILED)
))
def dataset_profile(spark, folder):
    return datasets.dataset_profile(w.landed(spark, folder).select(*_PROFILED)).drop("column_type")


def _told(at: str, station: str) -> str:
    return f"""(select f.flight_id, o.valid_time, row_number() over (partition by f.flight_id
      order by abs(epoch_us(o.valid_time) - epoch_us(f.{at})), o.valid_time) as nr from f_landed f join f_told_obs o on o.fs = f.{station})"""


def _landed_answers(spark, folder):
    """Answers of four services, bad entries among them. The flights that three tables are made of are derived once."""
    flights = written(w.flights(spark, folder), "flights")
    keys = flights.select("flight_id", "carrier", "flight_number", "dep", F.to_date("sched").alias("day"))
    statuses = _raw_statuses(spark, folder, flights).join(keys, "flight_id").drop("flight_id")
    return _raw_schedules(spark, folder, flights), statuses, _raw_airports(spark, folder), _raw_observations(spark, folder)


_BUILT = f"""select f.flight_number, f.dep, f.arr, cast(f.classification as bigint) as classification,
      d.valid_time as dep_valid, a.valid_time as arr_valid
    from f_landed f left join {_told('sched', 'dep')} d on d.flight_id = f.flight_id and d.nr = 1
    left join {_told('act_arr', 'arr')} a on a.flight_id = f.flight_id and a.nr = 1 where f.flight_id % 30 <> 0"""


def _built_columns(built):
    return built.select(
        "flight_number",
        "dep",
        "arr",
        F.col("classification").cast("bigint").alias("classification"),
        F.col("departureWeather.valid_time").alias("dep_valid"),
        F.col("arrivalWeather.valid_time").alias("arr_valid"),
    )


@query(_BUILT)
def build_from_landed(spark, folder):
    """Labelled flights from the answers of four services, bad entries among them."""
    return _built_columns(from_landed.build_from_landed(*_landed_answers(spark, folder)))


@query(_BUILT)
def build_with_rejects(spark, folder):
    """The same flights from answers that are parsed once for rows and rejects."""
    return _built_columns(from_landed.build_with_rejects(*_landed_answers(spark, folder)).flights)


@query("""select 'schedules' as service, reject_reason, position, count(*) as entries from f_flights
      cross join (select 'error answer' as reject_reason, null::int as position
        union all select 'not a record', 1 union all select 'no readable departureTime', 2) b group by all
    union all select 'statuses', 'not a record', 0, count(*) from f_flights where act_dep is not null and flight_id % 30 = 0
    union all select 'observations', reject_reason, position, count(*) from (
      select unnest(['not a record', 'not a record', 'no readable valid_time_gmt', 'not a record', 'not a record']) as reject_reason,
        unnest([1, 2, 3, 4, 5]) as position from f_obs where obs_id % 2 = 0
      union all select 'not a record', 0 from f_obs where obs_id % 7 = 0) t group by all""")
def build_rejects(spark, folder):
    """What building the labelled flights leaves out, by service."""
    lost = from_landed.build_with_rejects(*_landed_answers(spark, folder)).rejects
    return lost.groupBy("service", "reject_reason", "position").agg(F.count(F.lit(1)).alias("entries"))
