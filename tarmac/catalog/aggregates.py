from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.base import label_case, query, rounded
from tarmac.functions.classify import class_label5
from tarmac.functions.timecols import clock_time, long_date
from tarmac.operators import handlers, histogram, joins, metrics, routes, voting
from tarmac.plans import workload as w


@query("""select model, cast(sum(rows) as bigint) as rows, round(sum(p * support) / sum(support), 6) as weighted_precision,
      round(sum(r * support) / sum(support), 6) as weighted_recall,
      round(sum(case when p + r > 0 then 2 * p * r / (p + r) else 0 end * support) / sum(support), 6) as weighted_f1,
      round(sum(hits) / sum(support), 6) as accuracy
    from (select s.model, s.support, s.support as rows, coalesce(h.hits, 0) as hits,
            coalesce(h.hits, 0) / cast(s.support as double) as r,
            coalesce(h.hits / cast(q.predicted as double), 0) as p
          from (select model, label, count(*) as support from f_pred group by model, label) s
          left join (select model, label, count(*) as hits from f_pred where label = prediction group by model, label) h
            on h.model = s.model and h.label = s.label
          left join (select model, prediction, count(*) as predicted from f_pred group by model, prediction) q
            on q.model = s.model and q.prediction = s.label) c
    group by model""")
def weighted_metrics(spark, folder):
    scores = metrics.weighted_metrics(metrics.confusion_counts(w.predictions(spark, folder)))
    return scores.select("model", "rows", *rounded("weighted_precision", "weighted_recall", "weighted_f1", "accuracy"))


@query("select model, label, " + ", ".join(
    f"count(*) filter (where prediction = {c}) as predicted_{c}" for c in range(5)
) + " from f_pred group by model, label")
def confusion_matrix(spark, folder):
    counts = metrics.confusion_counts(w.predictions(spark, folder))
    return metrics.confusion_matrix(counts, handlers.DefaultHandler().classes())


@query(f"select distinct classification as label, {label_case('classification')} as label_text from f_landed")
def distinct_class_labels(spark, folder):
    return metrics.distinct_class_labels(w.landed(spark, folder), handlers.DefaultHandler(), "classification")


@query("""select f.flight_id, classification as class, round(d.temp, 6) as x, round(a.temp, 6) as y from f_landed f
    join f_dep_weather d on d.flight_id = f.flight_id join f_arr_weather a on a.flight_id = f.flight_id""")
def scatter_pairs(spark, folder):
    pairs = metrics.scatter_pairs(
        w.labelled(spark, folder), handlers.DefaultHandler(), "departureWeather.temp", "arrivalWeather.temp", ["flight_id"]
    )
    return pairs.select("flight_id", "class", *rounded("x", "y"))


@query("select bucket, round(bucket_low, 6) as bucket_low, round(bucket_high, 6) as bucket_high, n from f_histogram")
def delta_histogram(spark, folder):
    buckets = histogram.delta_histogram(w.landed(spark, folder), "delta")
    return buckets.select("bucket", *rounded("bucket_low", "bucket_high"), "n")


@query("""select bucket, round(low + bucket * width, 6) as bucket_low, round(case when bucket = 49 then high else low + (bucket + 1) * width end, 6) as bucket_high,
      cast(coalesce(n, 0) as bigint) as n
    from (select min(value) as low, max(value) as high, (max(value) - min(value)) / 50 as width from f_landed where value > 12 and value < 50) bounds
    cross join (select cast(range as int) as bucket from range(50)) buckets
    left join (select least(cast(floor((value - lo) / ((hi - lo) / 50)) as int), 49) as place, count(*) as n
      from (select value, min(value) over () as lo, max(value) over () as hi from f_landed where value > 12 and value < 50) kept group by 1) counted on place = bucket""")
def value_histogram(spark, folder):
    """A continuous column: as many values as rows."""
    buckets = histogram.delta_histogram(w.landed(spark, folder), "value")
    return buckets.select("bucket", *rounded("bucket_low", "bucket_high"), "n")


@query("select count(*) as n from f_landed where delta > 12 and delta < 50")
def delta_range_count(spark, folder):
    return histogram.count_between(w.landed(spark, folder), "delta", *histogram.DELAY_RANGE)


@query("""select bucket, round(coalesce(sum(width) over (order by bucket rows between unbounded preceding and 1 preceding), 0), 6)
      as position, round(width, 6) as width, n from f_histogram""")
def histogram_positions(spark, folder):
    bars = histogram.histogram_positions(histogram.delta_histogram(w.landed(spark, folder), "delta"))
    return bars.select("bucket", *rounded("position", "width"), "n")


def _links(spark, folder):
    return routes.route_links(w.history(spark, folder))


@query("select src, dst, n as count from f_links")
def route_counts(spark, folder):
    return routes.route_counts(_links(spark, folder))


def _stored_history(spark, folder):
    """The history under its stored names, with both airports."""
    airports = w.airports(spark, folder)
    named = w.history(spark, folder)
    for prefix, code in (("dep", "dep"), ("arr", "arr")):
        named = named.join(
            airports.select(
                F.col("fs").alias(code),
                F.col("name").alias(f"{prefix}AirportName"),
                F.col("latitude").alias(f"{prefix}AirportLat"),
                F.col("longitude").alias(f"{prefix}AirportLong"),
            ),
            code,
        )
    return named.select(
        F.col("dep").alias("depAirportFSCode"),
        F.col("arr").alias("arrAirportFSCode"),
        F.col("carrier").alias("carrierFsCode"),
        F.col("flight_number").cast("string").alias("flightNumber"),
        long_date(F.col("departure")).alias("departureDate"),
        clock_time(F.col("departure")).alias("departureTime"),
        "depAirportName",
        "arrAirportName",
        "depAirportLat",
        "depAirportLong",
        "arrAirportLat",
        "arrAirportLong",
    )


_BADGE = """select {ends} h.carrier as carrierFsCode, cast(h.flight_number as varchar) as flightNumber,
      strftime(h.departure, '%B %d %Y') as departureDate, strftime(h.departure, '%I:%M %p') as departureTime,
      d.name as depAirportName, a.name as arrAirportName, count(*) as passengers
    from f_history h join f_airports d on d.fs = h.dep join f_airports a on a.fs = h.arr {where} group by all"""


@query(_BADGE.format(ends="", where="where h.dep = 'A01' and h.arr = 'A02'"))
def route_badge(spark, folder):
    return routes.route_badge(_stored_history(spark, folder), "A01", "A02")


@query(_BADGE.format(ends="h.dep as depAirportFSCode, h.arr as arrAirportFSCode,", where=""))
def route_badge_all(spark, folder):
    return routes.route_badge(_stored_history(spark, folder))


def _nodes(spark, folder):
    ends = [
        {"code": f"{p}AirportFSCode", "name": f"{p}AirportName", "latitude": f"{p}AirportLat", "longitude": f"{p}AirportLong"}
        for p in ("dep", "arr")
    ]
    return routes.airport_nodes(_stored_history(spark, folder), *ends)


@query("""select distinct fs as code, name, latitude, longitude from f_airports
    where fs in (select dep from f_history) or fs in (select arr from f_history)""")
def airport_nodes(spark, folder):
    return _nodes(spark, folder)


@query("""select distinct fs as id, concat('{"id":"', fs, '","name":"', name, '","latitude":', latitude, ',"longitude":', longitude, '}') as node
    from f_airports where fs in (select dep from f_history) or fs in (select arr from f_history)""")
def node_json(spark, folder):
    return routes.node_json(_nodes(spark, folder))


_DEGREES = """(select airport, count(*) as degree from (select src as airport from f_links union all select dst from f_links) e
    group by airport)"""


@query(f"select airport, degree from {_DEGREES} d")
def airport_degree(spark, folder):
    return routes.airport_degree(_links(spark, folder))


@query("select src, string_agg(dst, ',' order by dst) as destinations, count(*) as links from f_links group by src")
def adjacency_list(spark, folder):
    return routes.adjacency_list(_links(spark, folder))


@query("select fs as code, fs in (select src from f_links) as is_origin from f_airports")
def origin_flag(spark, folder):
    nodes = w.airports(spark, folder).select(F.col("fs").alias("code"))
    return routes.origin_flag(nodes, _links(spark, folder))


@query(f"""select airport, degree, cast(row_number() over (order by degree desc, airport) as int) as rank from {_DEGREES} d""")
def rank_airports(spark, folder):
    return routes.rank_airports(routes.airport_degree(_links(spark, folder)))


@query("select flight_id, overall from f_overall")
def ensemble_vote(spark, folder):
    return voting.ensemble_vote(w.predictions(spark, folder), class_label5)


@query("select flight_id, overall from f_overall")
def ensemble_vote_in_row(spark, folder):
    return w.landed(spark, folder).select(
        "flight_id", voting.vote_in_row(list(w.rule_models().values()), class_label5).alias("overall")
    )


@query("select distinct fs, cast(date_trunc('hour', valid_time) as timestamp) as obs_hour from f_obs")
def distinct_obs_hours(spark, folder):
    return joins.observed_hours(w.observations(spark, folder))


@query("select classification, count(*) as flights from f_landed group by classification")
def class_balance(spark, folder):
    return metrics.class_balance(w.landed(spark, folder))
