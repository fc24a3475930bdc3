"""Trained models. What they predict depends on the training, which SQL cannot follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.base import query
from tarmac.operators import explained, models
from tarmac.operators.features import ATTRIBUTES, labelled_set
from tarmac.operators.handlers import DefaultHandler, ThreeClassHandler
from tarmac.operators.projections import in_data_set
from tarmac.plans import from_landed, scoring, training
from tarmac.plans import workload as w
from tarmac.session import shared_dir, written
from tarmac.sources import history

_HANDLER = DefaultHandler()


def _labelled(spark, folder):
    """The training records as a table: training and scoring both read them."""
    return written(w.labelled(spark, folder), "labelled")


def _set(labelled, name):
    return in_data_set(labelled, "dep", name, w.DATA_SETS)


def _registry(labelled, names=tuple(models.MODELS)):
    return models.train_all(labelled_set(_set(labelled, "training"), _HANDLER), _HANDLER, names)


def _trained(spark, folder, name):
    """Predictions of one model on the flights it was not trained on."""
    labelled = _labelled(spark, folder)
    registry = _registry(labelled, (name,))
    scored = training.score_labelled(_set(labelled, "test"), registry, _HANDLER, ["flight_id"])
    return scored.select(
        "flight_id", F.col("label").cast("int").alias("label"), F.col(models.prediction_column(name)).cast("int").alias("prediction")
    )


def _naive_bayes(keep: str, where: str) -> str:
    """The whole of naive Bayes in SQL: counts of the training flights, log-probabilities, and the best class of each flight."""
    names = [(a, end) for end in ("d", "a") for a in ATTRIBUTES]
    values = ", ".join(f"floor(greatest(coalesce(cast({end}.{a} as double), 0), 0)) as x{i}" for i, (a, end) in enumerate(names))
    n = range(len(names))
    return f"""select {keep} from (
      select x.*, t.class, row_number() over (partition by flight_id order by
        (ln(t.flights + 1.0::double) - ln(cast(t.every + t.classes as double))) + {" + ".join(f"x{i} * (ln(t.s{i} + 1) - ln(t.total + {len(names)}))" for i in n)} desc, t.class) as nr
      from (select f.flight_id, f.classification as label, data_set, {values} from f_landed f join f_sets on airport = f.dep
        join f_dep_weather d on d.flight_id = f.flight_id join f_arr_weather a on a.flight_id = f.flight_id) x
      cross join (select *, {" + ".join(f"s{i}" for i in n)} as total, sum(flights) over () as every, count(*) over () as classes
        from (select f.classification as class, count(*) as flights, {", ".join(f"sum(x{i}) as s{i}" for i in n)}
          from (select f.classification, {values} from f_landed f join f_sets on airport = f.dep
            join f_dep_weather d on d.flight_id = f.flight_id join f_arr_weather a on a.flight_id = f.flight_id where data_set = 'training') f group by 1) c) t) s
    where nr = 1 and {where}"""


@query()
def train_logreg(spark, folder):
    return _trained(spark, folder, "logistic_regression")


@query(_naive_bayes("flight_id, label, class as prediction", "data_set = 'test'"))
def train_naive_bayes(spark, folder):
    return _trained(spark, folder, "naive_bayes")


@query()
def train_decision_tree(spark, folder):
    return _trained(spark, folder, "decision_tree")


@query()
def train_random_forest(spark, folder):
    return _trained(spark, folder, "random_forest")


@query()
def score_batch(spark, folder):
    labelled = _labelled(spark, folder)
    return training.score_labelled(labelled, _registry(labelled), _HANDLER, ["flight_id"]).drop("features")


@query()
def score_with_label(spark, folder):
    """Label and prediction pairs, the input of all metrics."""
    labelled = _labelled(spark, folder)
    registry = _registry(labelled, ("decision_tree", "naive_bayes"))
    scored = training.score_labelled(_set(labelled, "test"), registry, _HANDLER, ["flight_id"])
    return models.long_predictions(scored, registry, ["flight_id", F.col("label").cast("int").alias("label")])


@query(_naive_bayes("flight_id, 'naive_bayes' as model, 1 as model_pos, label, class as prediction", "data_set = 'test'"))
def score_with_label_naive_bayes(spark, folder):
    """Label and prediction pairs of the model that SQL can follow."""
    labelled = _labelled(spark, folder)
    registry = _registry(labelled, ("naive_bayes",))
    scored = training.score_labelled(_set(labelled, "test"), registry, _HANDLER, ["flight_id"])
    return models.long_predictions(scored, registry, ["flight_id", F.col("label").cast("int").alias("label")])


@query(_naive_bayes("flight_id, cast(label as double) as label, cast(class as double) as prediction_naive_bayes", "true"))
def score_batch_naive_bayes(spark, folder):
    """All flights scored by the model that SQL can follow."""
    labelled = _labelled(spark, folder)
    return training.score_labelled(labelled, _registry(labelled, ("naive_bayes",)), _HANDLER, ["flight_id"]).drop("features")


@query("""select model, count(*) as flights, cast(0 as bigint) as different from f_landed
    cross join (select unnest(['decision_tree', 'random_forest']) as model) m group by model""")
def recomputed_trees(spark, folder):
    """Flights for which a tree or forest, written out as conditions, gives another class than the model: none."""
    labelled = _labelled(spark, folder)
    names = ("decision_tree", "random_forest")
    registry = _registry(labelled, names)
    scored = training.score_labelled(labelled, registry, _HANDLER, ["flight_id"])
    parts = []
    for name in names:
        again = explained.recomputed(scored, registry.models[name], "again")
        parts.append(again.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("flights"), F.count_if(F.col("again") != F.col(models.prediction_column(name))).alias("different")))
    return parts[0].unionByName(parts[1])


@query("""select count(*) as flights, true as near_zero from f_landed join f_sets on airport = dep where data_set = 'training'""")
def logreg_gradient(spark, folder):
    """At the fitted coefficients the gradient of the loss is under a hundredth of what it is at zero."""
    flights = labelled_set(_set(_labelled(spark, folder), "training"), _HANDLER)
    fitted, start = explained.loss_gradient(flights, models.train(flights, "logistic_regression", _HANDLER))
    return flights.agg(F.count(F.lit(1)).alias("flights"), F.lit(fitted < start / 100).alias("near_zero"))


def upcoming_inputs(spark, folder):
    """Requests, schedules and airports in the shape of the scoring run.

    Flights leave at `sched` and arrive at `act_arr`, both local; a request names
    the flight and its departure as an instant.
    """
    airports = w.airports(spark, folder).withColumnRenamed("zone", "timeZoneRegionName")
    flights = w.landed(spark, folder)
    schedules = flights.select(
        F.col("carrier").alias("carrierFsCode"),
        F.col("flight_number").alias("flightNumber"),
        F.col("dep").alias("departureAirportFsCode"),
        F.col("arr").alias("arrivalAirportFsCode"),
        F.col("sched").alias("departureTime"),
        F.col("act_arr").alias("arrivalTime"),
        (F.col("user_id") % 50).cast("string").alias("flightEquipmentIataCode"),
    )
    zones = airports.select(F.col("fs").alias("dep"), "timeZoneRegionName")
    requests = flights.join(zones, "dep").select(
        F.col("flight_id").alias("request_id"),
        F.concat_ws(" ", "carrier", "flight_number").alias("flight"),
        F.unix_millis(F.to_utc_timestamp(F.col("sched").cast("timestamp"), F.col("timeZoneRegionName"))).alias("epoch_ms"),
        F.col("dep").alias("departure_airport"),
    )
    equipment = w.table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("iata"), F.col("p_name").alias("name"))
    return requests, schedules, airports, equipment


@query("""select f.flight_id as request_id, f.carrier as carrierFsCode, f.flight_number as flightNumber,
      cast(hour(timezone('UTC', timezone(d.zone, f.sched))) as int) as want_hour, cast(1 as bigint) as candidates,
      f.dep as departureAirportFsCode, f.arr as arrivalAirportFsCode,
      timezone('UTC', timezone(d.zone, f.sched)) as departureTimeUTC,
      timezone('UTC', timezone(a.zone, f.act_arr)) as arrivalTimeUTC
    from f_landed f join f_airports d on d.fs = f.dep join f_airports a on a.fs = f.arr""")
def resolve_requests(spark, folder):
    requests, schedules, airports, _equipment = upcoming_inputs(spark, folder)
    return scoring.resolve_requests(requests, schedules, airports).select(
        "request_id",
        "carrierFsCode",
        "flightNumber",
        "want_hour",
        "candidates",
        *[F.col(f"leg.{c}").alias(c) for c in ("departureAirportFsCode", "arrivalAirportFsCode", "departureTimeUTC", "arrivalTimeUTC")],
    )


@query()
def score_upcoming(spark, folder):
    requests, schedules, airports, equipment = upcoming_inputs(spark, folder)
    payload, _rejects = scoring.score_upcoming(
        requests,
        schedules,
        airports,
        w.airlines(spark, folder),
        equipment,
        w.forecasts(spark, folder),
        _registry(_labelled(spark, folder), ("naive_bayes", "decision_tree")),
        _HANDLER,
        {"dewPt": "dewpoint"},
    )
    return payload.select("request_id", F.to_json("flightInfo").alias("flight"), F.to_json("prediction").alias("prediction"))


@query("""select m.model, m.model_pos, count(*) as flights, cast(0 as bigint) as different
    from f_landed join f_sets on airport = dep
    cross join (select 'naive_bayes' as model, 1 as model_pos union all select 'decision_tree', 2) m
    where data_set = 'test' group by m.model, m.model_pos""")
def registry_roundtrip(spark, folder):
    """Flights whose predictions differ after saving and loading the models, by model: none may."""
    labelled = _labelled(spark, folder)
    registry = _registry(labelled, ("naive_bayes", "decision_tree"))
    path = shared_dir(spark, "models")
    registry.save(spark, path)
    loaded = models.ModelRegistry.load(spark, path)
    test = _set(labelled, "test")
    keep = ["flight_id"]
    before = training.score_labelled(test, registry, _HANDLER, keep)
    after = training.score_labelled(test, loaded, _HANDLER, keep)
    pairs = models.long_predictions(before, registry, keep).join(
        models.long_predictions(after, loaded, keep).withColumnRenamed("prediction", "reloaded"),
        ["flight_id", "model", "model_pos"],
    )
    return pairs.groupBy("model", "model_pos").agg(
        F.count(F.lit(1)).alias("flights"), F.count_if(F.col("prediction") != F.col("reloaded")).alias("different")
    )


@query()
def compare_handlers(spark, folder):
    return training.compare_handlers(
        w.labelled(spark, folder), [DefaultHandler(), ThreeClassHandler()], "dep", w.DATA_SETS, names=("naive_bayes", "decision_tree")
    )


@query("""select dep, arr, carrier, count(*) as stored from f_landed group by dep, arr, carrier""")
def score_and_store(spark, folder):
    """Requests scored and stored; the run is repeated, which stores nothing more."""
    requests, schedules, airports, equipment = upcoming_inputs(spark, folder)
    registry = _registry(_labelled(spark, folder), ("naive_bayes",))
    path = shared_dir(spark, "history")
    inputs = (requests, schedules, airports, w.airlines(spark, folder), equipment, w.forecasts(spark, folder), registry)
    for _ in range(2):
        from_landed.score_and_store(path, "today", *inputs, handler=_HANDLER, forecast_names={"dewPt": "dewpoint"})
    stored = history.load_history(spark, path)
    return stored.groupBy(
        F.col("depAirportFSCode").alias("dep"), F.col("arrAirportFSCode").alias("arr"), F.col("carrierFsCode").alias("carrier")
    ).agg(F.count(F.lit(1)).alias("stored"))


# What the queries above give that does not depend on the training.
_LAST_RUN = """(select fs, max(fetched_at) as run from f_forecast group by fs)"""


def _last_forecast(end: str) -> str:
    return f"""left join {_LAST_RUN} r{end} on r{end}.fs = f.{end}
    left join f_hour_forecast c{end} on c{end}.fs = f.{end} and c{end}.fetched_at = r{end}.run and hour(c{end}.fcst_valid) = hour(f.{end}_utc)"""


@query(f"""select f.flight_id as request_id, f.carrier, f.dep, f.arr, cdep.forecast_id as dep_forecast, carr.forecast_id as arr_forecast,
      2 as models
    from (select l.flight_id, l.carrier, l.dep, l.arr, timezone('UTC', timezone(d.zone, l.sched)) as dep_utc,
        timezone('UTC', timezone(a.zone, l.act_arr)) as arr_utc
      from f_landed l join f_airports d on d.fs = l.dep join f_airports a on a.fs = l.arr) f
    {_last_forecast('dep')} {_last_forecast('arr')}""")
def score_upcoming_inputs(spark, folder):
    """Flights, forecasts and number of models of all scored requests; the last answers count."""
    requests, schedules, airports, equipment = upcoming_inputs(spark, folder)
    registry = _registry(_labelled(spark, folder), ("naive_bayes", "decision_tree"))
    inputs = (requests, schedules, airports, w.airlines(spark, folder), equipment, w.forecasts(spark, folder), registry)
    payload, _rejects = scoring.score_upcoming(*inputs, _HANDLER, {"dewPt": "dewpoint"})
    return payload.select(
        "request_id",
        F.col("flightInfo.carrierFsCode").alias("carrier"),
        F.col("flightInfo.departureAirportFsCode").alias("dep"),
        F.col("flightInfo.arrivalAirportFsCode").alias("arr"),
        F.col("departureAirportInfo.weatherForecast.forecast_id").alias("dep_forecast"),
        F.col("arrivalAirportInfo.weatherForecast.forecast_id").alias("arr_forecast"),
        F.size("prediction.models").alias("models"),
    )


@query("""select m.model, classification as label, count(*) as flights, cast(0 as bigint) as outside
    from f_landed join f_sets on airport = dep
    cross join (select unnest(['logistic_regression', 'naive_bayes', 'decision_tree', 'random_forest']) as model) m
    where data_set = 'test' group by m.model, classification""")
def train_support(spark, folder):
    """Scored flights of each model and label, and predictions outside the classes: there are none."""
    labelled = _labelled(spark, folder)
    registry = _registry(labelled)
    scored = training.score_labelled(_set(labelled, "test"), registry, _HANDLER)
    rows = models.long_predictions(scored, registry, [F.col("label").cast("int").alias("label")])
    return rows.groupBy("model", "label").agg(
        F.count(F.lit(1)).alias("flights"), F.count_if(~F.col("prediction").between(0, 4) | F.col("prediction").isNull()).alias("outside")
    )


@query(f"""select h.handler, m.model, count(*) as rows, true as recall_is_accuracy
    from f_landed join f_sets on airport = dep
    cross join (select unnest(['{DefaultHandler.name}', '{ThreeClassHandler.name}']) as handler) h
    cross join (select unnest(['naive_bayes', 'decision_tree']) as model) m
    where data_set = 'test' group by h.handler, m.model""")
def compare_handlers_support(spark, folder):
    """Flights behind each row of the comparison; recall weighted by class size is plain accuracy."""
    scores = compare_handlers(spark, folder)
    same = F.abs(F.col("weighted_recall") - F.col("accuracy")) < 1e-9
    return scores.select("handler", "model", "rows", same.alias("recall_is_accuracy"))
