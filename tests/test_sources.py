import json

import pytest
from instants import at

from tarmac.session import shared_dir
from tarmac.sources import accumulate, datasets, history, landed, metadata
from tarmac.sources.schemas import EQUIPMENT
from tarmac.streaming.accumulate import accumulate_landed


def test_observation_answers(rows):
    fetched = at("2024-01-02 00:00")
    record = {"valid_time_gmt": 1704150000, "dewPt": 1.5, "rh": 80, "temp": None}
    old = {"valid_time_gmt": 1704067200 + 3599}
    raw = rows(
        [
            ("LONE", fetched, json.dumps({"observation": record})),
            ("LIST", fetched, json.dumps({"observations": [record, old]})),
            ("FIRST", fetched, json.dumps({"observation": [record], "observations": [record, record]})),
            ("NONE", fetched, json.dumps({"observations": []})),
            ("ERR", fetched, json.dumps({"errors": [{"code": "x"}]})),
            ("BAD", fetched, "<html>"),
        ],
        "fs string, fetched_at timestamp_ntz, body string",
    )
    got = landed.ingest_observations(raw)
    assert sorted(r.fs for r in got.collect()) == ["FIRST", "LIST", "LONE"]
    one = got.where("fs = 'LONE'").first()
    assert (one.valid_time, one.dewPt, one.rh, one.temp) == (at("2024-01-01 23:00"), 1.5, 80.0, None)
    rejects = landed.answer_rejects(raw, ["observation", "observations"], lone_allowed=True)
    assert {r.fs: r.reject_reason for r in rejects.collect()} == {"ERR": "error answer", "BAD": "no list in the answer"}


def test_a_bad_entry_costs_only_itself(rows):
    fetched = at("2024-01-02 00:00")
    good = {"valid_time_gmt": 1704150000, "temp": 1}
    raw = rows(
        [
            ("MIXED", fetched, json.dumps({"observations": [good, 5, good, "text", None, {"valid_time_gmt": "soon"}, [good]]})),
            ("TEXT", fetched, json.dumps({"observation": "nothing"})),
            ("BROKEN", fetched, json.dumps({"observations": "[1,"})),
            ("HTML", fetched, "<html>"),
        ],
        "fs string, fetched_at timestamp_ntz, body string",
    )
    assert [r.fs for r in landed.ingest_observations(raw).collect()] == ["MIXED"] * 2
    bad = {(r.fs, r.position, r.reject_reason) for r in landed.observation_rejects(raw).collect()}
    assert bad == {
        *(("MIXED", p, "not a record") for p in (1, 3, 4, 6)),
        ("MIXED", 5, "no readable valid_time_gmt"),
        ("TEXT", 0, "not a record"),
        ("BROKEN", None, "unreadable list"),
        ("HTML", None, "no list in the answer"),
    }
    entries = {r.position: r.entry for r in landed.observation_rejects(raw).where("fs = 'MIXED'").collect()}
    assert entries[1] == "5" and json.loads(entries[5]) == {"valid_time_gmt": "soon"}
    flights = rows([(json.dumps({"scheduledFlights": [{"flightNumber": "1", "departureTime": "2024-01-01T08:00:00"}, 7]}),)], "body string")
    parts = flights.selectExpr("1 as year", "1 as month", "1 as day", "1 as hour", "body")
    assert landed.ingest_schedules(parts).count() == 1 and landed.schedule_rejects(parts).count() == 1
    statuses = rows([("1", json.dumps({"flightStatuses": [5, {"status": "L"}]})), ("2", json.dumps({"flightStatuses": [{"status": "L"}, 5]}))], "flight_number string, body string")
    assert [(r.flight_number, r.status) for r in landed.ingest_statuses(statuses, ["flight_number"]).collect()] == [("2", "L")]
    assert {(r.flight_number, r.position) for r in landed.status_rejects(statuses).collect()} == {("1", 0), ("2", 1)}


def test_null_keys_append_once(spark, rows):
    path = shared_dir(spark, "nulls")
    batch = rows([(1, "a", 5), (None, "b", 6), (None, "b", 4)], "k int, p string, v int")
    for _ in range(2):
        accumulate.append_new(batch, path, ["k", "p"], "p")
    assert sorted((str(r.k), r.p, r.v) for r in spark.read.parquet(path).collect()) == [("1", "a", 5), ("None", "b", 4)]


def test_schedule_answers(rows):
    flight = {
        "flightNumber": "1024",
        "carrierFsCode": "WN",
        "departureAirportFsCode": "BOS",
        "arrivalAirportFsCode": "BWI",
        "departureTime": "2015-12-29T12:30:00.000",
        "serviceClasses": ["R", "Y"],
    }
    raw = rows(
        [
            (2015, 12, 29, 12, json.dumps({"scheduledFlights": [flight, flight]})),
            (2015, 12, 29, 13, json.dumps({"scheduledFlights": []})),
            (2015, 12, 29, 14, json.dumps({"scheduledFlights": flight})),
            (2015, 12, 29, 15, json.dumps({"error": {"errorMessage": "no"}})),
        ],
        "year int, month int, day int, hour int, body string",
    )
    got = landed.ingest_schedules(raw).collect()
    assert len(got) == 2 and got[0].departureTime == at("2015-12-29 12:30") and got[0].date.hour == 12
    assert got[0].serviceClasses == ["R", "Y"]
    rejects = {r.hour: r.reject_reason for r in landed.answer_rejects(raw, ["scheduledFlights"]).collect()}
    assert rejects == {14: "not a list", 15: "error answer"}


def test_status_answers(rows):
    def entry(status, arrived=True):
        times = {"scheduledGateDeparture": {"dateUtc": "2015-12-29T17:30:00.000Z"}, "actualRunwayDeparture": {"dateUtc": "2015-12-29T17:50:00.000Z"}}
        if arrived:
            times["actualRunwayArrival"] = {"dateUtc": "2015-12-29T19:00:00.000Z"}
        return {"status": status, "operationalTimes": times}

    raw = rows(
        [
            ("1", json.dumps({"flightStatuses": [entry("L"), entry("X")]})),
            ("2", json.dumps({"flightStatuses": []})),
            ("3", json.dumps({"flightStatuses": [entry("A", arrived=False)]})),
        ],
        "flight_number string, body string",
    )
    got = {r.flight_number: r for r in landed.ingest_statuses(raw, ["flight_number"]).collect()}
    assert set(got) == {"1", "3"}
    assert got["1"].status == "L" and got["1"].actualRunwayArrival == at("2015-12-29 19:00")
    assert got["3"].actualRunwayArrival is None


def test_forecast_and_appendix_answers(rows):
    fetched = at("2016-10-12 00:00")
    near, far = 1476230400 + 3600, 1476230400 + 49 * 3600
    body = {
        "forecasts": [{"fcst_valid": near, "dewpt": 1.5, "gust": None, "phrase_12char": "Fair"}, {"fcst_valid": far}],
        "appendix": {"equipments": [{"iata": "32S", "name": "A320", "jet": True}, {"name": "no code"}]},
    }
    raw = rows([("BOS", fetched, json.dumps(body))] * 2, "fs string, fetched_at timestamp_ntz, body string")
    got = landed.ingest_forecasts(raw).collect()
    assert [(r.fs, r.fcst_valid, r.dewpt, r.gust, r.phrase_12char) for r in got] == [("BOS", at("2016-10-12 01:00"), 1.5, None, "Fair")] * 2
    assert got[0].fetched_at == fetched
    equipment = landed.ingest_appendix(raw, "equipments", EQUIPMENT, "iata").collect()
    assert [(r.iata, r.name, r.jet, r.widebody) for r in equipment] == [("32S", "A320", True, None)]


def test_dedupe(rows):
    copies = rows([("A", 1, 5), ("A", 1, 4), ("B", 1, 7)], "fs string, valid_time int, obs_id int")
    assert {(r.fs, r.obs_id) for r in landed.dedupe_observations(copies, tie="obs_id").collect()} == {("A", 4), ("B", 7)}
    assert landed.dedupe_observations(copies).count() == 2


def test_metadata_views(rows):
    airports = rows(
        [(json.dumps({"airports": [{"fs": "BOS", "name": "Logan", "countryCode": "US"}, {"name": "No code", "countryCode": "US"}]}),),
         (json.dumps({"airports": [{"fs": "ORY", "name": "Orly", "countryCode": "FR"}]}),)],
        "body string",
    )
    airlines = rows([(json.dumps({"airlines": [{"fs": "NK", "name": "Spirit"}]}),)], "body string")
    both = metadata.metadata_union(metadata.load_airlines(airlines), metadata.load_airports(airports))
    assert both.count() == 4
    assert sorted(r.fs for r in metadata.airports_view(both).collect()) == ["BOS", "ORY"]
    assert [r.fs for r in metadata.airlines_view(both).collect()] == ["NK"]
    assert [r.fs for r in metadata.country_airports_view(both).collect()] == ["BOS"]


def test_load_dataset(spark, rows):
    path = shared_dir(spark, "set")
    datasets.write_documents(rows([(1, "a"), (2, None)], "id int, name string"), path)
    loaded = datasets.load_dataset(spark, path, "training")
    assert loaded.is_cached and spark.table("training").count() == 2
    loaded.unpersist()
    declared = datasets.load_dataset(spark, path, "training", schema="id int, late string", cache=False)
    assert declared.columns == ["id", "late"]
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "", "training")
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, path, "")


def test_profile_and_json(rows):
    df = rows([(1, None), (2, 'say "é"')], "id int, name string")
    assert [tuple(r) for r in datasets.dataset_profile(df).collect()] == [(0, "id", "int", 2, 2), (1, "name", "string", 2, 1)]
    assert [r.json for r in datasets.rows_to_json(df).collect()] == ['{"id":1}', '{"id":2,"name":"say \\"é\\""}']


@pytest.mark.parametrize("partition", [None, "day"])
def test_appending_twice_appends_once(spark, rows, partition):
    path = shared_dir(spark, "acc")
    schema = "flight string, day string, n int"
    first = rows([("a", "d1", 1), ("a", "d1", 1), ("b", "d2", 1)], schema)
    second = rows([("b", "d2", 9), ("c", "d3", 1)], schema)
    for run in (first, first, second, second):
        accumulate.append_new(run, path, ["flight", "day"], partition)
    stored = {(r.flight, r.n) for r in spark.read.schema(schema).parquet(path).collect()}
    assert stored == {("a", 1), ("b", 1), ("c", 1)}
    assert spark.read.parquet(path).count() == 3


def test_partition_must_be_part_of_the_key(spark, rows):
    path = shared_dir(spark, "acc")
    df = rows([("a", "d1")], "flight string, day string")
    accumulate.append_new(df, path, ["flight"])
    with pytest.raises(ValueError):
        accumulate.append_new(df, path, ["flight"], "day")


def test_stream_takes_what_landed_since(spark, rows, tmp_path):
    landing, target, marks = (str(tmp_path / n) for n in ("landing", "target", "marks"))
    schema = "flight string, n int"

    def run():
        accumulate_landed(spark, landing, schema, target, marks, ["flight"]).awaitTermination()
        return {r.flight for r in spark.read.parquet(target).collect()}, spark.read.parquet(target).count()

    rows([("a", 1), ("b", 1)], schema).write.mode("append").json(landing)
    assert run() == ({"a", "b"}, 2)
    rows([("b", 2), ("c", 1)], schema).write.mode("append").json(landing)
    assert run() == ({"a", "b", "c"}, 3)
    assert run() == ({"a", "b", "c"}, 3)


def test_history_grows_and_is_partitioned(spark, rows):
    path = shared_dir(spark, "history")
    data = rows([("BOS", "October 12 2016"), ("LAS", "October 13 2016")], "depAirportFSCode string, departureDate string")
    history.save_history(data, path, "departureDate")
    history.save_history(data, path, "departureDate")
    assert history.load_history(spark, path).count() == 4
    assert history.load_history(spark, path).where("departureDate = 'October 12 2016'").count() == 2


def test_shared_folder_follows_the_session(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(before + "/tarmac/x-")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
