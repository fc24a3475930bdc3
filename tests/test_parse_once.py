"""Rows and rejects of landed answers from one parse."""

import json

from instants import at

from tarmac.plans import from_landed
from tarmac.sources import landed

FETCHED = at("2016-10-12 00:00")
NEAR = 1476230400 - 3600


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.select(left.columns).collect()))


def observations(rows):
    bodies = [
        json.dumps({"observations": [{"valid_time_gmt": NEAR, "temp": 1.5}, 5, {"temp": 2}, {"valid_time_gmt": NEAR - 60}]}),
        json.dumps({"observation": {"valid_time_gmt": NEAR - 10**6}}),
        json.dumps({"error": {"code": 1}}),
        "no json",
        None,
    ]
    return rows([("BOS", FETCHED, b) for b in bodies], "fs string, fetched_at timestamp_ntz, body string")


def test_both_sides_equal_the_two_parses(rows):
    raw = observations(rows)
    parsed = landed.split_observations(raw)
    assert same(landed.ingest_observations(raw), parsed.rows) and parsed.rows.count() == 2
    assert same(landed.observation_rejects(raw), parsed.rejects)
    # The old observation is sound, but not of the last hours.
    assert parsed.counts == {"rows": 3, "rejects": 5}
    assert parsed.rows.columns == landed.ingest_observations(raw).columns


def test_the_answers_are_read_once(rows):
    parsed = landed.split_observations(observations(rows))
    for side in (parsed.rows, parsed.rejects):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "from_json" not in plan and "Scan ExistingRDD" not in plan


def test_schedules_with_unreadable_times(rows):
    flights = [
        {"carrierFsCode": "NK", "departureTime": "2016-10-12T08:00:00.000", "arrivalTime": "2016-10-12T10:00:00.000"},
        {"carrierFsCode": "XX", "departureTime": "2016-10-12T08:00:00.000"},
        {"carrierFsCode": "YY", "departureTime": "2016-10-12T08:00:00.000", "arrivalTime": "soon"},
        {"carrierFsCode": "ZZ", "departureTime": "2016-10-12T08:00:00.000", "arrivalTime": None},
        {"carrierFsCode": "QQ", "departureTime": "late", "arrivalTime": "2016-10-12T10:00:00.000"},
    ]
    raw = rows([(2016, 10, 12, 8, json.dumps({"scheduledFlights": flights}))], "year int, month int, day int, hour int, body string")
    parsed = landed.split_schedules(raw)
    assert {r.carrierFsCode for r in parsed.rows.collect()} == {"NK", "XX", "ZZ"}
    assert {(r.position, r.reject_reason) for r in parsed.rejects.collect()} == {(2, "no readable arrivalTime"), (4, "no readable departureTime")}
    assert same(landed.ingest_schedules(raw), parsed.rows) and same(landed.schedule_rejects(raw), parsed.rejects)


def status(code):
    return {"status": code, "operationalTimes": {"scheduledGateDeparture": {"dateUtc": "2016-10-12T08:00:00Z"}}}


def test_statuses_take_the_first_entry_and_reject_any(rows):
    answers = [[status("L"), 3], [3, status("X")], [status("C"), status("L")], []]
    raw = rows([(i, json.dumps({"flightStatuses": a})) for i, a in enumerate(answers)], "flight int, body string")
    parsed = landed.split_statuses(raw, ["flight"])
    assert {(r.flight, r.status) for r in parsed.rows.collect()} == {(0, "L"), (2, "C")}
    assert same(landed.ingest_statuses(raw, ["flight"]), parsed.rows)
    assert {(r.flight, r.position) for r in parsed.rejects.collect()} == {(0, 1), (1, 0)}
    assert parsed.counts == {"rows": 2, "rejects": 2}


def test_forecasts_and_tables_without_rows(rows):
    body = json.dumps({"forecasts": [{"fcst_valid": 1476230400 + 3600, "temp": 1}, 7]})
    raw = rows([("BOS", FETCHED, body)], "fs string, fetched_at timestamp_ntz, body string")
    parsed = landed.split_forecasts(raw)
    assert same(landed.ingest_forecasts(raw), parsed.rows) and same(landed.forecast_rejects(raw), parsed.rejects)
    empty = landed.split_forecasts(raw.limit(0))
    assert empty.rows.count() == empty.rejects.count() == 0 and empty.counts == {"rows": 0, "rejects": 0}


def test_built_with_rejects(rows):
    flights = [
        {"carrierFsCode": "NK", "flightNumber": "1", "departureAirportFsCode": "BOS", "arrivalAirportFsCode": arr, "departureTime": "2016-10-12T08:00:00.000"}
        for arr in ("LAS", "XXX")
    ]
    schedules = rows([(2016, 10, 12, 8, json.dumps({"scheduledFlights": [*flights, 9]}))], "year int, month int, day int, hour int, body string")
    times = {"scheduledGateDeparture": "08:00", "actualRunwayDeparture": "08:30", "actualRunwayArrival": "11:00"}
    entry = {"status": "L", "operationalTimes": {k: {"dateUtc": f"2016-10-12T{t}:00Z"} for k, t in times.items()}}
    statuses = rows(
        [("NK", "1", "BOS", at("2016-10-12").date(), json.dumps({"flightStatuses": [entry, "x"]}))], "carrier string, flight_number string, dep string, day date, body string"
    )
    airports = rows([(json.dumps({"airports": [{"fs": "BOS"}, {"fs": "LAS"}]}),)], "body string")
    built = from_landed.build_with_rejects(schedules, statuses, airports, observations(rows))
    assert [(r.flight_number, r.arr, r.classification) for r in built.flights.collect()] == [("1", "LAS", 2)]
    lost = {(r.service, r.reject_reason, r.entry) for r in built.rejects.where("service <> 'observations'").collect()}
    assert lost == {("schedules", "not a record", "9"), ("statuses", "not a record", "x"), ("airports", "no airport record: XXX", "BOS-XXX")}
    assert built.counts == {"schedules": {"rows": 2, "rejects": 1}, "statuses": {"rows": 1, "rejects": 1}, "observations": {"rows": 3, "rejects": 5}}


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_each_text_is_parsed_once_a_row(rows):
    """The answer, its list and the entry: three parses, whatever filters and columns ask of them."""
    raw = observations(rows)
    assert parses(landed.ingest_observations(raw)) == 3
    assert parses(landed.observation_rejects(raw)) == 3
    assert parses(landed.answer_rejects(raw, ["observation", "observations"], lone_allowed=True)) == 2
    answers = rows([("1", json.dumps({"flightStatuses": [{"status": "L"}]}))], "flight string, body string")
    assert parses(landed.ingest_statuses(answers, ["flight"])) == 3
    assert landed.ingest_statuses(answers, ["flight"]).first().status == "L"


def test_an_escaped_name_is_a_name(rows):
    entry = '{"departureTime":"2016-10-12T01:00:00.000","arrival\\u0054ime":"late"}'
    plain = '{"departureTime":"2016-10-12T01:00:00.000","flightNumber":"\\u0041"}'
    raw = rows([(2016, 10, 12, 1, '{"scheduledFlights":[' + entry + "," + plain + "]}")], "year int, month int, day int, hour int, body string")
    assert [(r.reject_reason, r.position) for r in landed.schedule_rejects(raw).collect()] == [("no readable arrivalTime", 0)]
    assert [r.flightNumber for r in landed.ingest_schedules(raw).collect()] == ["A"]


def test_statuses_and_observations_are_parsed_into_tables(rows):
    schedule = {"carrierFsCode": "XX", "flightNumber": "1", "departureAirportFsCode": "BOS", "arrivalAirportFsCode": "BOS", "departureTime": "2016-10-11T23:00:00.000"}
    schedules = rows([(2016, 10, 11, 23, json.dumps({"scheduledFlights": [schedule]}))], "year int, month int, day int, hour int, body string")
    times = {n: {"dateUtc": "2016-10-11T23:0%d:00.000Z" % i} for i, n in enumerate(("scheduledGateDeparture", "actualRunwayDeparture", "actualRunwayArrival"))}
    answer = json.dumps({"flightStatuses": [{"status": "L", "operationalTimes": times}]})
    statuses = rows([("XX", "1", "BOS", answer)] * 2, "carrier string, flight_number string, dep string, body string").selectExpr("*", "date'2016-10-11' as day")
    airports = rows([(json.dumps({"airports": [{"fs": "BOS", "name": "Boston"}]}),)], "body string")
    built = from_landed.build_from_landed(schedules, statuses, airports, observations(rows))
    assert parses(built) == 0
    lazy = from_landed.build_from_landed(schedules, statuses, airports, observations(rows), materialise=False)
    assert same(lazy, built) and built.count() == 1
