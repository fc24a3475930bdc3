from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.base import query, rounded
from tarmac.functions import numeric, text, timecols
from tarmac.plans import workload as w


@query("""select flight_id, delta, date_sub('minute', act_arr, sched) as back, date_sub('minute', act_dep, act_arr) as airborne
    from f_landed""")
def delta_minutes(spark, folder):
    return w.landed(spark, folder).select(
        "flight_id",
        "delta",
        timecols.whole_minutes(F.col("act_arr"), F.col("sched")).alias("back"),
        timecols.whole_minutes(F.col("act_dep"), F.col("act_arr")).alias("airborne"),
    )


@query("""select obs_id, cast(year(valid_time) as int) as year, cast(month(valid_time) as int) as month,
      cast(day(valid_time) as int) as day, cast(hour(valid_time) as int) as hour from f_obs""")
def epoch_parts(spark, folder):
    observed = w.observations(spark, folder).select(
        "obs_id", F.unix_seconds(F.col("valid_time").cast("timestamp")).alias("valid_time_gmt")
    )
    return observed.select("obs_id", *timecols.epoch_parts(F.col("valid_time_gmt")))


def _with_zone(spark, folder):
    zones = w.airports(spark, folder).select(F.col("fs").alias("dep"), "zone")
    return w.flights(spark, folder).join(zones, "dep")


@query("""select flight_id, zone, timezone('UTC', timezone(zone, sched)) as utc
    from f_flights join f_airports on fs = dep""")
def local_to_utc(spark, folder):
    return _with_zone(spark, folder).select(
        "flight_id", "zone", timecols.local_to_utc(F.col("sched"), F.col("zone")).alias("utc")
    )


@query("""select flight_id, cast(hour(sched) as int) as utc_hour, cast(year(local) as int) as year, cast(month(local) as int) as month,
      cast(day(local) as int) as day, cast(hour(local) as int) as hour
    from (select flight_id, sched, timezone(zone, timezone('UTC', sched)) as local
          from f_flights join f_airports on fs = dep) t""")
def epoch_ms_parts(spark, folder):
    millis = F.unix_millis(F.col("sched").cast("timestamp"))
    return (
        _with_zone(spark, folder)
        .withColumn("epoch_ms", millis)
        .select(
            "flight_id",
            F.hour(timecols.epoch_ms_to_local(F.col("epoch_ms"))).alias("utc_hour"),
            *timecols.epoch_ms_parts(F.col("epoch_ms"), F.col("zone")),
        )
    )


@query("""select flight_id, case when good then split_part(d, '-', 1) end as search_year,
      case when good then split_part(d, '-', 2) end as search_month,
      case when good then split_part(d, '-', 3) end as search_day, case when good then substring(h, 1, 2) end as search_hour,
      case when not good then concat('no such date: ', d) end as reject_reason
    from (select flight_id, d, h, len(string_split(d, '-')) = 3 as good
          from (select flight_id, case when status = 'C' then strftime(sched, '%Y-%m') else strftime(sched, '%Y-%m-%d') end as d,
                  strftime(sched, '%H:%M') as h from f_flights) t) u""")
def parse_search_key(spark, folder):
    """Cancelled flights are searched with a date that lacks its day."""
    texts = w.flights(spark, folder).select(
        "flight_id",
        F.when(F.col("status") == "C", F.date_format("sched", "yyyy-MM"))
        .otherwise(F.date_format("sched", "yyyy-MM-dd"))
        .alias("date_text"),
        F.date_format("sched", "HH:mm").alias("hour_text"),
    )
    parts = timecols.search_key(F.col("date_text"), F.col("hour_text"))
    return texts.select("flight_id", *[c.alias(name) for name, c in parts.items()])


@query("""select flight_id, strftime(sched, '%B %d %Y') as departure_date, strftime(sched, '%I:%M %p') as departure_time
    from f_flights""")
def format_departure(spark, folder):
    return w.flights(spark, folder).select(
        "flight_id",
        timecols.long_date(F.col("sched")).alias("departure_date"),
        timecols.clock_time(F.col("sched")).alias("departure_time"),
    )


@query("select flight_id, " + ", ".join(
    f"cast(isodow(sched) - 1 = {d} as int)::double as weekday_{d}" for d in range(7)
) + " from f_flights")
def weekday_onehot(spark, folder):
    return w.flights(spark, folder).select("flight_id", *timecols.weekday_onehot(F.col("sched")))


@query("select flight_id, carrier, flight_number from f_flights")
def split_flight_code(spark, folder):
    coded = w.flights(spark, folder).select("flight_id", text.flight_code(F.col("carrier"), F.col("flight_number")).alias("code"))
    return coded.select(
        "flight_id", text.carrier_of(F.col("code")).alias("carrier"), text.number_of(F.col("code")).alias("flight_number")
    )


@query("select flight_id, concat(carrier, ' ', flight_number) as code from f_flights")
def build_flight_code(spark, folder):
    return w.flights(spark, folder).select(
        "flight_id", text.flight_code(F.col("carrier"), F.col("flight_number")).alias("code")
    )


@query("""select flight_id, case when state is not null then concat(name, ', ', state) else country end as destination
    from f_flights join f_airports on fs = arr""")
def destination_label(spark, folder):
    places = w.airports(spark, folder).select(F.col("fs").alias("arr"), "name", "state", "country")
    return w.flights(spark, folder).join(places, "arr").select(
        "flight_id", text.place_label(F.col("name"), F.col("state"), F.col("country")).alias("destination")
    )


@query(r"""select doc_id, md5(ascii) as ascii_md5, length(ascii) as ascii_chars
    from (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') as ascii from documents) t""")
def ascii_only(spark, folder):
    cleaned = w.table(spark, folder, "documents").select("doc_id", text.ascii_only(F.col("text")).alias("ascii"))
    return cleaned.select("doc_id", F.md5("ascii").alias("ascii_md5"), F.length("ascii").cast("bigint").alias("ascii_chars"))


@query("select flight_id, concat(dep, ' > ', arr) as route from f_flights")
def route_label(spark, folder):
    return w.flights(spark, folder).select("flight_id", text.route_label(F.col("dep"), F.col("arr")).alias("route"))


@query("""select c_custkey, round(c_acctbal / 7, 2) as lat, round(c_acctbal / 3, 2) as long from customer""")
def round_coords(spark, folder):
    balance = F.col("c_acctbal")
    return w.table(spark, folder, "customer").select(
        "c_custkey",
        numeric.coordinate(balance / 7).alias("lat"),
        numeric.coordinate(balance / 3).alias("long"),
    )


@query("select obs_id, cast(floor((temp - 30) * cast(1.8 as double) + 32 + cast(0.5 as double)) as bigint) as fahrenheit from f_obs")
def to_fahrenheit(spark, folder):
    return w.observations(spark, folder).select("obs_id", numeric.to_fahrenheit(F.col("temp") - 30).alias("fahrenheit"))


@query("""select flight_id, coalesce(a.latitude, 0.0) as latitude, coalesce(a.longitude, 0.0) as longitude
    from f_far f left join f_airports a on a.fs = f.far_arr""")
def coalesce_coords(spark, folder):
    known = w.airports(spark, folder).select(F.col("fs").alias("arr"), "latitude", "longitude")
    return w.far_flights(spark, folder).join(known, "arr", "left").select(
        "flight_id",
        numeric.known_coordinate(F.col("latitude")).alias("latitude"),
        numeric.known_coordinate(F.col("longitude")).alias("longitude"),
    )
