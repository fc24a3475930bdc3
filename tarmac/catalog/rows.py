from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.catalog.base import day_text, label_case, query, rounded
from tarmac.functions import classify
from tarmac.functions.timecols import local_to_utc
from tarmac.operators import projections, routes
from tarmac.operators.histogram import DELAY_RANGE
from tarmac.plans import workload as w
from tarmac.sources import history


@query("""select f.flight_id, round(d.temp, 6) as dep_temp, d.pressure as dep_pressure, cast(a.wspd as int) as arr_wspd
    from f_landed f join f_dep_weather d on d.flight_id = f.flight_id join f_arr_weather a on a.flight_id = f.flight_id""")
def nested_path(spark, folder):
    return w.labelled(spark, folder).select(
        "flight_id",
        projections.resolve_path("departureWeather.temp").alias("dep_temp"),
        projections.resolve_path("departureWeather.pressure").alias("dep_pressure"),
        projections.resolve_path("arrivalWeather.wspd").alias("arr_wspd"),
    ).select("flight_id", *rounded("dep_temp"), "dep_pressure", "arr_wspd")


@query("""select forecast_id, fs, fcst_valid, round(dewpoint, 6) as dewPt, rh, wspd, uv_index, icon_code from f_forecast""")
def rename_attributes(spark, folder):
    renamed = projections.rename_forecast(w.forecasts(spark, folder), {"dewPt": "dewpoint"})
    return renamed.select("forecast_id", "fs", "fcst_valid", *rounded("dewPt"), "rh", "wspd", "uv_index", "icon_code")


@query("""select flight_id, sched, act_dep, act_arr from f_flights
    where sched is not null and act_dep is not null and act_arr is not null""")
def landed_filter(spark, folder):
    return projections.landed_only(w.flights(spark, folder), "sched", "act_dep", "act_arr").select(
        "flight_id", "sched", "act_dep", "act_arr"
    )


@query("select flight_id, dep, data_set from f_landed join f_sets on airport = dep")
def dataset_split(spark, folder):
    return projections.tag_data_sets(w.landed(spark, folder), "dep", w.DATA_SETS).select("flight_id", "dep", "data_set")


@query("select flight_id, delta from f_landed where delta > 12 and delta < 50")
def delta_range_filter(spark, folder):
    return projections.between_open(w.landed(spark, folder), "delta", *DELAY_RANGE).select("flight_id", "delta")


@query("""select carrier, flight_number, departure, l_orderkey from f_history where dep = 'A01' and arr = 'A02'""")
def route_filter(spark, folder):
    return projections.on_route(w.history(spark, folder), "dep", "arr", "A01", "A02").drop("dep", "arr")


_ENDS = """f_landed f join f_airports d on d.fs = f.dep join f_airports a on a.fs = f.arr
    join f_overall o on o.flight_id = f.flight_id"""


@query(f"""select d.fs as depAirportFSCode, d.name as depAirportName, d.longitude as depAirportLong, d.latitude as depAirportLat,
      a.fs as arrAirportFSCode, a.name as arrAirportName, a.longitude as arrAirportLong, a.latitude as arrAirportLat,
      o.overall as overall, f.carrier as carrierFsCode, f.flight_number as flightNumber,
      strftime(f.sched, '%Y-%m-01') as departureMonth, strftime(f.sched, '%B %d %Y') as departureDate, strftime(f.sched, '%I:%M %p') as departureTime
    from {_ENDS}""")
def flatten_payload(spark, folder):
    rows = history.flatten_payload(w.payloads(spark, folder))
    return rows.withColumns({"overall": F.col("prediction.overall"), "departureMonth": day_text("departureMonth")}).drop("prediction")


def _airport_json(alias: str, weather: str) -> str:
    return f"""concat('{{"airportInfo":{{"fs":"', {alias}.fs, '","name":"', {alias}.name, '","utc_offset_hours":',
      cast({alias}.utc_offset_hours as varchar), '}},"weatherForecast":{{"icon_code":',
      coalesce(cast({weather}.icon_code as varchar), 'null'), ',"rh":', coalesce(cast({weather}.rh as varchar), 'null'), '}}}}')"""


def _model_json(alias: str) -> str:
    return f"""concat('{{"model":"{alias}","prediction":"', {label_case(alias + '.prediction')}, '"}}')"""


@query(f"""select f.flight_id, concat('{{"flightInfo":{{"carrierFsCode":"', f.carrier, '","flightNumber":"', f.flight_number,
      '"}},"departureAirportInfo":', {_airport_json('d', 'dc')}, ',"arrivalAirportInfo":', {_airport_json('a', 'ac')},
      ',"prediction":{{"overall":"', o.overall, '","models":[', {_model_json('m1')}, ',', {_model_json('m2')}, ',',
      {_model_json('m3')}, ',', {_model_json('m4')}, ']}}}}') as payload
    from {_ENDS}
    left join f_dep_forecast dc on dc.flight_id = f.flight_id
    left join f_arr_forecast ac on ac.flight_id = f.flight_id
    join f_pred m1 on m1.flight_id = f.flight_id and m1.model = 'm1'
    join f_pred m2 on m2.flight_id = f.flight_id and m2.model = 'm2'
    join f_pred m3 on m3.flight_id = f.flight_id and m3.model = 'm3'
    join f_pred m4 on m4.flight_id = f.flight_id and m4.model = 'm4'""")
def assemble_payload(spark, folder):
    payload = w.payloads(spark, folder)

    def end(name):
        airport, weather = F.col(f"{name}.airportInfo"), F.col(f"{name}.weatherForecast")
        return F.struct(
            F.struct(*[airport[c].alias(c) for c in ("fs", "name", "utc_offset_hours")]).alias("airportInfo"),
            F.struct(*[weather[c].alias(c) for c in ("icon_code", "rh")]).alias("weatherForecast"),
        ).alias(name)

    shown = F.struct(
        F.struct("flightInfo.carrierFsCode", "flightInfo.flightNumber").alias("flightInfo"),
        end("departureAirportInfo"),
        end("arrivalAirportInfo"),
        "prediction",
    )
    return payload.select("flight_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("payload"))


@query("""select concat(f.carrier, ' ', f.flight_number) as flightnumber, f.sched as time,
      timezone('UTC', timezone(d.zone, f.sched)) as time_utc, f.arr as dest_airport_code,
      case when a.state is not null then concat(a.name, ', ', a.state) else a.country end as destination
    from f_flights f join f_airports d on d.fs = f.dep left join f_airports a on a.fs = f.arr""")
def flight_search(spark, folder):
    airports = w.airports(spark, folder)
    zones = airports.select(F.col("fs").alias("dep"), "zone")
    schedules = w.flights(spark, folder).join(zones, "dep").select(
        "carrier",
        "flight_number",
        "arr",
        F.col("sched").alias("local_time"),
        local_to_utc(F.col("sched"), F.col("zone")).alias("utc_time"),
    )
    return projections.flight_search(schedules, airports)


@query("""select flight_id, cast(hour(sched) as int) as hour from f_flights where dep = 'A03' and cast(sched as date) = date '2024-01-05'""")
def search_departures(spark, folder):
    """Every hour of one day at one airport."""
    flights = w.flights(spark, folder).select("flight_id", "dep", F.col("sched").alias("local_time"))
    hours = [projections.search_departures(flights, "A03", "2024-01-05", h).withColumn("hour", F.lit(h)) for h in range(24)]
    return reduce(DataFrame.unionByName, hours).select("flight_id", "hour")


@query("select arr as dst, dep as src from f_history")
def route_rename(spark, folder):
    return routes.route_links(w.history(spark, folder))


@query("select dep as airport, l_orderkey from f_history union all select arr, l_orderkey from f_history")
def explode_endpoints(spark, folder):
    return projections.endpoints(
        w.history(spark, folder),
        {"airport": "dep", "l_orderkey": "l_orderkey"},
        {"airport": "arr", "l_orderkey": "l_orderkey"},
    )


@query("select flight_id, delta, classification from f_landed")
def classify5(spark, folder):
    return w.landed(spark, folder).select("flight_id", "delta", "classification")


@query("""select flight_id, delta, cast(case when status = 'C' then 0 when delta < 15 then 1 when delta < 120 then 2
      else 4 end as int) as classification from f_landed""")
def classify5_compat(spark, folder):
    return w.label_landed(w.flights(spark, folder), compat=True).select("flight_id", "delta", "classification")


@query("""select flight_id, delta, cast(case when delta < 13 then 0 when delta < 41 then 1 else 2 end as int) as classification
    from f_landed""")
def classify3(spark, folder):
    return w.landed(spark, folder).select("flight_id", "delta", classify.classify3(F.col("delta")).alias("classification"))


@query(f"select flight_id, {label_case('classification')} as label_text from f_landed")
def class_label5(spark, folder):
    return w.landed(spark, folder).select("flight_id", classify.class_label5(F.col("classification")).alias("label_text"))


@query(f"""select flight_id, {label_case('c', 3)} as label_text
    from (select flight_id, case when delta < 13 then 0 when delta < 41 then 1 else 2 end as c from f_landed) t""")
def class_label3(spark, folder):
    three = classify.classify3(F.col("delta"))
    return w.landed(spark, folder).select("flight_id", classify.class_label3(three).alias("label_text"))


@query("""select flight_id, case classification when 0 then 'Canceled' when 1 then 'On Time' when 2 then 'Delay less 2 hours'
      when 3 then 'Delay between 2 and 4 hours' else 'Delay more than 4 hours' end as message from f_landed""")
def class_message(spark, folder):
    return w.landed(spark, folder).select("flight_id", classify.class_message(F.col("classification")).alias("message"))


@query("select flight_id, overall = 'On Time' as on_time from f_overall")
def on_time_flag(spark, folder):
    rules = list(w.rule_models().values())
    text = w.vote_in_row(rules, classify.class_label5)
    return w.landed(spark, folder).select("flight_id", classify.is_on_time(text).alias("on_time"))
