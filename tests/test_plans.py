import json

import pytest
from instants import at
from pyspark.sql import functions as F

from tarmac.functions.classify import class_label5
from tarmac.operators import features, handlers, metrics, models, projections
from tarmac.operators.handlers import DefaultHandler, ThreeClassHandler, WeekdayHandler
from tarmac.plans import scoring, training
from tarmac.plans.labelled import build_labelled_flights, label_flights
from tarmac.session import shared_dir
from tarmac.sources import history
from tarmac.sources.schemas import HISTORY

WEATHER = "struct<dewPt double, rh double, vis double, wc double, wspd double, feels_like double, uv_index double, temp double>"
LABELLED = f"flight_id int, dep string, departureTime timestamp_ntz, deltaDeparture bigint, classification int, departureWeather {WEATHER}, arrivalWeather {WEATHER}"


def weather(x):
    return None if x is None else (x, 50.0, 10.0, None, float("nan"), -x, 3.9, x)


@pytest.fixture(scope="module")
def flights(spark):
    data = []
    for i in range(160):
        label = (1, 2, 4)[i % 3]
        data.append((i, "TRN" if i % 2 else "TST", at(f"2024-01-{i % 7 + 1:02d} 10:00"), label * 12, label, weather(label * 10.0 + i % 5), weather(2.0)))
    return spark.createDataFrame(data, LABELLED)


SETS = {"training": ["TRN"], "test": ["TST"]}


def test_build(rows):
    schedules = rows(
        [(1, "NK", "1", "BOS", "LAS", "d"), (2, "NK", "2", "BOS", "XXX", "d"), (3, "NK", "3", "BOS", "LAS", "d"), (4, "NK", "4", "BOS", "LAS", "d"), (5, "NK", "5", "BOS", "LAS", "d")],
        "flight_id int, carrier string, flight_number string, dep string, arr string, day string",
    )
    gate, off, on = at("2024-01-01 10:00"), at("2024-01-01 10:20"), at("2024-01-01 12:00")
    statuses = rows(
        [
            ("NK", "1", "BOS", "d", 0, "L", gate, off, on),
            ("NK", "1", "BOS", "d", 1, "X", gate, gate, gate),
            ("NK", "2", "BOS", "d", 0, "L", gate, off, on),
            ("NK", "3", "BOS", "d", 0, "C", gate, None, None),
            ("NK", "4", "BOS", "d", 0, "C", gate, off, on),
        ],
        "carrier string, flight_number string, dep string, day string, pos int, status string, "
        "gate_departure timestamp_ntz, act_dep timestamp_ntz, act_arr timestamp_ntz",
    )
    airports = rows([("BOS",), ("LAS",)], "fs string")
    observations = rows(
        [(1, "BOS", at("2024-01-01 10:15"), 1.0), (2, "BOS", at("2024-01-01 09:50"), 2.0), (3, "LAS", at("2024-01-01 12:30"), 3.0)],
        "obs_id int, fs string, valid_time timestamp_ntz, temp double",
    )

    def build(**options):
        built = build_labelled_flights(schedules, statuses, airports, observations, **options)
        return {r.flight_id: r for r in built.collect()}

    got = build()
    assert set(got) == {1, 4}
    assert (got[1].deltaDeparture, got[1].classification, got[1].classificationMsg) == (20, 2, "Delay less 2 hours")
    assert got[4].classification == 0
    assert (got[1].departureWeather.obs_id, got[1].arrivalWeather.obs_id) == (2, 3)
    assert set(build(materialise=False)) == {1, 4}
    kept = build(keep_cancelled=True)
    assert set(kept) == {1, 3, 4}
    assert kept[3].classification == 0 and kept[3].deltaDeparture is None and kept[3].arrivalWeather is None


def test_compat_labels(rows):
    flights = rows(
        [("L", at("2024-01-01 10:00"), at("2024-01-01 13:00"), at("2024-01-01 15:00"))],
        "status string, gate_departure timestamp_ntz, act_dep timestamp_ntz, act_arr timestamp_ntz",
    )
    assert label_flights(flights).first().classification == 3
    assert label_flights(flights, compat=True).first().classification == 4


def test_feature_order_and_handler_features(flights):
    plain = features.labelled_set(flights, keep=["flight_id"]).where("flight_id = 0").first()
    assert plain.label == 1.0 and len(plain.features) == 14
    assert plain.features[0] == 10.0 and plain.features[3] is None and plain.features[5] == -10.0 and plain.features[7] == 2.0
    custom = features.labelled_set(flights, ThreeClassHandler(), ["flight_id"]).where("flight_id = 0").first()
    assert custom.label == 0.0 and list(custom.features[14:]) == [1, 0, 0, 0, 0, 0, 0]
    cleaned = features.labelled_set(flights).select(
        features.impute_zero(F.col("features")).alias("zero"), features.clamp_nonneg_int(F.col("features")).alias("whole")
    ).first()
    assert list(cleaned.zero[3:7]) == [0.0, 0.0, -10.0, 3.9] and list(cleaned.whole[3:7]) == [0.0, 0.0, 0.0, 3.0]


def test_forecast_names_differ_in_case_only(spark, rows):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        forecast = rows([(1.0, 2.0)], "dewpt double, rh double")
        renamed = projections.rename_forecast(forecast)
        assert renamed.columns == ["dewPt", "rh"] and renamed.select("dewPt").first()[0] == 1.0
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_training_and_scoring_build_the_same_array(spark, flights):
    observed = features.feature_projection(flights, keep=["flight_id"]).select("flight_id", features.features().alias("f"))
    rename = lambda name: F.struct(*[F.col(f"{name}.{a}").alias(features.FORECAST_NAMES.get(a, a)) for a in features.ATTRIBUTES])
    forecasts = flights.select("flight_id", rename("departureWeather").alias("d"), rename("arrivalWeather").alias("a"))
    scored = forecasts.select("flight_id", features.forecast_features("d", "a").alias("f"))
    assert sorted(map(str, observed.collect())) == sorted(map(str, scored.collect()))


def test_data_sets(rows):
    airports = rows([("SEA",), ("BOS",), ("XXX",)], "dep string")
    tagged = {(r.dep, r.data_set) for r in projections.tag_data_sets(airports, "dep").collect()}
    assert tagged == {("SEA", "mega_set"), ("SEA", "blind_set"), ("BOS", "mega_subset"), ("BOS", "training_set")}
    assert [len(v) for v in projections.NAMED_SETS.values()] == [20, 10, 5, 1, 1]


def test_custom_handler_and_python_function(flights):
    class LateOnly(DefaultHandler):
        name = "late"
        labels = {0: "fine", 1: "late"}

        def classification(self):
            return (F.col("deltaDeparture") > 20).cast("int")

    got = handlers.apply_handler(flights, LateOnly()).groupBy("label_text").count().collect()
    assert {r.label_text for r in got} == {"fine", "late"} and LateOnly().num_classes() == 2
    twice = handlers.row_function(lambda rows: rows["deltaDeparture"] * 2, "bigint")
    assert flights.where(twice("deltaDeparture") != F.col("deltaDeparture") * 2).count() == 0


def test_all_models_learn_and_survive_saving(spark, flights, tmp_path):
    handler = DefaultHandler()
    train, test = (projections.in_data_set(flights, "dep", n, SETS) for n in SETS)
    registry = models.train_all(
        features.labelled_set(train, handler), handler, logistic_regression={"iterations": 100, "intercept": True}, random_forest={"trees": 10}
    )
    assert list(registry.models) == list(models.MODELS)
    scores = {r.model: r for r in training.evaluate(test, registry, handler).collect()}
    assert set(scores) == set(models.MODELS) and all(r.rows == 80 for r in scores.values())
    # The three classes lie apart along one feature; classes 0 and 3 never occur.
    accuracy = {m: r.accuracy for m, r in scores.items()}
    assert accuracy["decision_tree"] == accuracy["random_forest"] == accuracy["logistic_regression"] == 1.0, accuracy
    assert accuracy["naive_bayes"] > 0.5, accuracy
    counts = training.prediction_counts(test, registry, handler)
    matrix = metrics.confusion_matrix(counts, handler.classes()).where("model = 'decision_tree'").collect()
    assert {r.label: r[f"predicted_{r.label}"] for r in matrix} == {1: 27, 2: 26, 4: 27}
    registry.save(spark, str(tmp_path / "models"))
    loaded = models.ModelRegistry.load(spark, str(tmp_path / "models"))
    assert list(loaded.models) == list(registry.models)
    before = training.score_labelled(test, registry, handler, ["flight_id"])
    after = training.score_labelled(test, loaded, handler, ["flight_id"])
    assert before.columns == ["flight_id", "label", "features", *[f"prediction_{m}" for m in models.MODELS]]
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_classes_come_from_the_handler(flights):
    model = models.train(features.labelled_set(flights), "decision_tree")
    assert model.stages[2].numClasses == 5


def test_handlers_compared(flights):
    result = training.compare_handlers(
        flights, [DefaultHandler(), ThreeClassHandler()], "dep", SETS, names=("decision_tree",)
    ).collect()
    assert {(r.handler, r.model) for r in result} == {("default", "decision_tree"), ("three_class", "decision_tree")}


def test_scoring_needs_models():
    with pytest.raises(ValueError):
        models.ModelRegistry().require()


def test_score_upcoming(spark, rows, flights):
    handler = WeekdayHandler()
    registry = models.train_all(features.labelled_set(flights, handler), handler, ("decision_tree", "naive_bayes"))
    airports = rows(
        [("BOS", "Logan", "America/New_York", 42.4, -71.0), ("LAS", "McCarran", "America/Los_Angeles", 36.1, -115.1)],
        "fs string, name string, timeZoneRegionName string, latitude double, longitude double",
    )
    schedules = rows(
        [
            ("NK", "641", "BOS", "LAS", at("2016-10-12 16:40"), at("2016-10-12 19:34"), "32S"),
            ("NK", "641", "LAS", "BOS", at("2016-10-12 21:00"), at("2016-10-13 05:00"), "32S"),
            ("XX", "7", "LAS", "BOS", at("2016-10-12 21:00"), at("2016-10-13 05:00"), "ZZZ"),
        ],
        "carrierFsCode string, flightNumber string, departureAirportFsCode string, arrivalAirportFsCode string, "
        "departureTime timestamp_ntz, arrivalTime timestamp_ntz, flightEquipmentIataCode string",
    )
    leaves = 1476304800000  # 2016-10-12 20:40 UTC
    requests = rows(
        [("a", "NK 641", leaves, "BOS"), ("b", "NK 641", leaves + 3 * 3600000, "BOS"), ("c", "XX 7", leaves, None), ("d", "NK 1", leaves, "BOS")],
        "request_id string, flight string, epoch_ms bigint, departure_airport string",
    )
    fetched = at("2016-10-12 00:00")
    forecasts = rows(
        [(1, "BOS", fetched, at("2016-10-12 20:00"), 10.0, 50.0, 10.0, 1.0, 2.0, -10.0, 3.9)],
        "forecast_id int, fs string, fetched_at timestamp_ntz, fcst_valid timestamp_ntz, dewpt double, rh double, vis double, wc double, "
        "wspd double, feels_like double, uv_index double",
    )
    airlines = rows([("NK", "Spirit")], "fs string, name string")
    equipment = rows([("32S", "A320")], "iata string, name string")
    payload, rejects = scoring.score_upcoming(requests, schedules, airports, airlines, equipment, forecasts, registry, handler)
    got = {r.request_id: r for r in payload.collect()}
    assert set(got) == {"a", "c"}
    assert {r.request_id: r.reject_reason for r in rejects.collect()} == {
        "b": "no departure at the requested hour",
        "d": "no scheduled departure",
    }
    a, c = got["a"], got["c"]
    assert a.flightInfo.departureTimeUTC == at("2016-10-12 20:40") and a.flightInfo.arrivalTimeUTC == at("2016-10-13 02:34")
    assert a.departureAirportInfo.airportInfo.name == "Logan" and a.departureAirportInfo.weatherForecast.forecast_id == 1
    assert a.arrivalAirportInfo.weatherForecast is None
    assert a.flightInfo.airlineInfo.name == "Spirit" and a.flightInfo.equipmentInfo.name == "A320"
    assert c.flightInfo.airlineInfo.name is None and c.flightInfo.departureAirportFsCode == "LAS"
    assert [m.model for m in a.prediction.models] == ["decision_tree", "naive_bayes"]
    stored = {r.depAirportFSCode: r for r in history.flatten_payload(payload).collect()}
    assert (stored["BOS"].departureDate, stored["BOS"].departureTime) == ("October 12 2016", "04:40 PM")
    assert stored["BOS"].prediction.overall == a.prediction.overall
    path = shared_dir(spark, "history")
    history.save_history(history.flatten_payload(payload), path)
    loaded = history.load_history(spark, path, HISTORY)
    assert {r.depAirportFSCode: r.prediction for r in loaded.collect()} == {k: r.prediction for k, r in stored.items()}
    assert {str(r.departureMonth) for r in loaded.collect()} == {"2016-10-01"}
    for _ in range(2):
        history.save_history(history.flatten_payload(payload), path + "-runs", run="first")
    history.save_history(history.flatten_payload(payload), path + "-runs", run="second")
    assert history.load_history(spark, path + "-runs").groupBy("run").count().orderBy("run").collect() == [("first", 2), ("second", 2)]
    assert json.loads(payload.select(F.to_json("prediction").alias("j")).first().j)["overall"]


def test_search(rows):
    schedules = rows(
        [("NK", "1", "LAS", "BOS", at("2016-10-12 16:00")), ("NK", "2", "LAS", "ORY", at("2016-10-12 16:59")), ("NK", "3", "LAS", "BOS", at("2016-10-12 17:00"))],
        "carrier string, flight_number string, dep string, arr string, local_time timestamp_ntz",
    ).withColumn("utc_time", F.col("local_time"))
    airports = rows([("BOS", "Logan", "MA", "US"), ("ORY", "Orly", None, "France")], "fs string, name string, state string, country string")
    hour = projections.search_departures(schedules, "LAS", "2016-10-12", 16)
    got = {r.flightnumber: r.destination for r in projections.flight_search(hour, airports).collect()}
    assert got == {"NK 1": "Logan, MA", "NK 2": "France"}


def test_wide_vectors_train_every_model(spark, folder):
    """The documents' embeddings as 64 features and their 10 labels."""
    from pyspark.ml.feature import SQLTransformer

    wide = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("label").cast("double"), F.transform("embedding", lambda x: x.cast("double")).alias("features")
    )
    for name in ("naive_bayes", "decision_tree"):
        model = models.MODELS[name](64).fit(wide)
        assert isinstance(model.stages[0], SQLTransformer)
        assert model.transform(wide).select(models.prediction_column(name)).distinct().count() >= 1


def test_unknown_class_passes_through(rows):
    assert rows([(7,)], "v int").select(class_label5(F.col("v"))).first()[0] == "7"


def test_a_leg_of_an_unknown_airport_is_a_leg(rows):
    schedules = rows(
        [
            ("WN", "1", "LAS", "SFO", at("2016-10-12 08:00"), at("2016-10-12 09:30")),
            ("WN", "1", "SFO", "XXX", at("2016-10-12 14:00"), at("2016-10-12 16:00")),
            ("WN", "2", "LAS", "XXX", at("2016-10-12 08:00"), at("2016-10-12 09:30")),
            ("WN", "3", "YYY", "LAS", at("2016-10-12 08:00"), at("2016-10-12 09:30")),
        ],
        "carrierFsCode string, flightNumber string, departureAirportFsCode string, arrivalAirportFsCode string, "
        "departureTime timestamp_ntz, arrivalTime timestamp_ntz",
    )
    zone = "America/Los_Angeles"
    airports = rows([("LAS", zone), ("SFO", zone), ("SFO", zone)], "fs string, timeZoneRegionName string")
    asked = [("a", "WN 1", 1476306000000, "SFO"), ("b", "WN 1", 1476284400000, "LAS"), ("c", "WN 2", 1476284400000, "LAS"), ("d", "WN 3", 1476284400000, "LAS")]
    requests = rows(asked, "request_id string, flight string, epoch_ms bigint, departure_airport string")
    got = {r.request_id: (r.candidates, r.leg and r.leg.arrivalAirportFsCode, r.reject_reason) for r in scoring.resolve_requests(requests, schedules, airports).collect()}
    assert got == {
        "a": (2, None, "no airport record: XXX"),
        "b": (2, "SFO", None),
        "c": (1, None, "no airport record: XXX"),
        "d": (1, None, "no airport record: YYY"),
    }


def test_training_records_write_only_the_columns_they_need(spark, folder, monkeypatch):
    from tarmac.plans import workload

    seen = []
    monkeypatch.setattr(workload, "written", lambda df, purpose: seen.append(df.columns) or df)
    labelled = workload.labelled(spark, folder)
    assert seen == [["flight_id", "dep", "arr", "sched", "act_arr", "delta", "classification"]]
    assert "value" in workload.landed_table(spark, folder).columns
    assert labelled.columns == ["flight_id", "dep", "arr", "departureTime", "deltaDeparture", "classification", "departureWeather", "arrivalWeather"]
