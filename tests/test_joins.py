import pytest
from instants import at

from pyspark.sql import functions as F

from tarmac.operators import joins

AIRPORTS = [("BOS", "Logan"), ("LAS", "McCarran")]


@pytest.fixture
def airports(rows):
    return rows(AIRPORTS, "fs string, name string")


@pytest.fixture
def flights(rows):
    return rows(
        [(1, "BOS", "LAS"), (2, "BOS", "XXX"), (3, "YYY", "LAS"), (4, None, "LAS")], "flight_id int, dep string, arr string"
    )


def test_unknown_airport_rejects_that_flight_only(flights, airports):
    assert [r.flight_id for r in joins.join_airports(flights, airports).collect()] == [1]
    rejects = {r.flight_id: r.reject_reason for r in joins.airport_rejects(flights, airports).collect()}
    assert rejects == {
        2: "no airport record: XXX",
        3: "no airport record: YYY",
        4: "no airport record: ",
    }


def test_appendix_null_or_empty(flights, airports):
    found = {r.flight_id: r.airport for r in joins.join_appendix(flights, airports, "arr", "fs", "airport").collect()}
    assert found[1].name == "McCarran" and found[2] is None
    empty = {r.flight_id: r.airport for r in joins.join_appendix(flights, airports, "arr", "fs", "airport", empty=True).collect()}
    assert empty[2] is not None and empty[2].name is None


def test_first_status_counts_and_flights_without_answer_go(rows):
    flights = rows([("NK", "1"), ("NK", "2")], "carrier string, flight_number string")
    statuses = rows([("NK", "1", 1, "X"), ("NK", "1", 0, "L")], "carrier string, flight_number string, pos int, status string")
    result = joins.join_status(flights, statuses, ["carrier", "flight_number"]).collect()
    assert [(r.flight_number, r.status) for r in result] == [("1", "L")]
    nested = rows([("NK", "1", [("L",), ("X",)]), ("NK", "2", [])], "carrier string, flight_number string, flightStatuses array<struct<status string>>")
    result = joins.join_nested_status(flights, nested, ["carrier", "flight_number"]).collect()
    assert [(r.flight_number, r.status) for r in result] == [("1", "L")]


def test_last_forecast_of_the_hour_wins(rows):
    flights = rows(
        [(1, "BOS", at("2024-01-01 10:59")), (2, "BOS", at("2024-01-01 11:00")), (3, "BOS", at("2024-01-02 10:00"))],
        "flight_id int, dep string, sched timestamp_ntz",
    )
    fetched = at("2024-01-01 00:00")
    forecasts = rows(
        [
            (1, "BOS", fetched, at("2024-01-01 10:00")),
            (2, "BOS", fetched, at("2024-01-02 10:00")),
            (3, "LAS", fetched, at("2024-01-01 11:00")),
        ],
        "forecast_id int, fs string, fetched_at timestamp_ntz, fcst_valid timestamp_ntz",
    )
    for table in (forecasts, forecasts.drop("forecast_id").withColumn("forecast_id2", F.col("fcst_valid"))):
        found = joins.join_forecast_hour(flights, table, "dep", "sched", "forecast")
        got = {r.flight_id: r.forecast and r.forecast.fcst_valid for r in found.collect()}
        assert got == {1: at("2024-01-02 10:00"), 2: None, 3: at("2024-01-02 10:00")}


def test_forecast_of_the_run_before_the_scoring(rows):
    """One answer serves flights over midnight and of the next day, until the next one is fetched."""
    hours = [at(f"2024-01-0{d} {h:02d}:00") for d in (1, 2) for h in range(24)]
    runs = [("BOS", at("2024-01-01 00:00"), 1), ("BOS", at("2024-01-02 12:00"), 2), ("LAS", at("2024-01-01 00:00"), 3)]
    forecasts = rows([(n, fs, run, h) for fs, run, n in runs for h in hours], "forecast_id int, fs string, fetched_at timestamp_ntz, fcst_valid timestamp_ntz")
    flights = rows(
        [
            (1, "BOS", at("2024-01-01 22:00"), "LAS", at("2024-01-02 01:00"), at("2024-01-01 20:00")),
            (2, "BOS", at("2024-01-03 09:00"), "LAS", at("2024-01-03 13:00"), at("2024-01-02 11:59")),
            (3, "BOS", at("2024-01-03 09:00"), "XXX", at("2024-01-03 13:00"), at("2024-01-02 12:00")),
            (4, "BOS", at("2024-01-01 09:00"), "LAS", at("2024-01-01 13:00"), at("2023-12-31 23:59")),
            (5, "BOS", at("2024-01-01 09:00"), "LAS", at("2024-01-01 13:00"), None),
        ],
        "flight_id int, dep string, sched timestamp_ntz, arr string, lands timestamp_ntz, scored_at timestamp_ntz",
    )
    found = joins.join_forecast_hour(flights, forecasts, "dep", "sched", "d", "scored_at")
    found = joins.join_forecast_hour(found, forecasts, "arr", "lands", "a", "scored_at")
    got = {r.flight_id: (r.d and r.d.forecast_id, r.a and r.a.forecast_id) for r in found.collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (2, None), 4: (None, None), 5: (None, None)}
    assert found.columns == [*flights.columns, "d", "a"]


def test_repeated_codes_multiply_nothing(rows):
    flights = rows([(1, "BOS", "LAS")], "flight_id int, dep string, arr string")
    airports = rows([("BOS", "b"), ("BOS", "a"), ("LAS", "c"), (None, "d")], "fs string, name string")
    assert [(r.departureAirport.name, r.arrivalAirport.name) for r in joins.join_airports(flights, airports).collect()] == [("a", "c")]
    assert [r.x.name for r in joins.join_appendix(flights, airports, "dep", "fs", "x").collect()] == ["a"]


def test_first_row_with_a_null_place(rows):
    statuses = rows([(1, 3, "X"), (1, None, "L"), (2, None, "C")], "k int, pos int, status string")
    assert {(r.k, r.status) for r in joins.first_per_key(statuses, ["k"], ["pos"]).collect()} == {(1, "L"), (2, "C")}


def test_which_leg(rows):
    legs = rows(
        [
            ("NK", 1, 10, at("2024-01-01 08:30")),
            ("NK", 1, 11, at("2024-01-01 08:10")),
            ("NK", 1, 12, at("2024-01-01 20:00")),
            ("NK", 2, 13, at("2024-01-01 05:00")),
        ],
        "carrier string, number int, flight_id int, sched timestamp_ntz",
    )
    requests = rows(
        [("a", "NK", 1, 8), ("b", "NK", 1, 9), ("c", "NK", 2, 23), ("d", "NK", 3, 8)],
        "request string, carrier string, number int, want_hour int",
    )
    found = joins.disambiguate_leg(requests, legs, ["carrier", "number"]).collect()
    got = {r.request: (r.leg and r.leg.flight_id, r.candidates, r.reject_reason) for r in found}
    assert got == {
        "a": (11, 3, None),
        "b": (None, 3, "no departure at the requested hour"),
        "c": (13, 1, None),
        "d": (None, 0, "no scheduled departure"),
    }


def test_observed_hours(rows):
    flights = rows([(1, "BOS", at("2024-01-01 10:59")), (2, "BOS", at("2024-01-01 11:00"))], "flight_id int, dep string, sched timestamp_ntz")
    observations = rows([("BOS", at("2024-01-01 10:01")), ("BOS", at("2024-01-01 10:20"))], "fs string, valid_time timestamp_ntz")
    hours = joins.observed_hours(observations)
    assert hours.count() == 1
    assert [r.flight_id for r in joins.in_observed_hours(flights, hours).collect()] == [1]


def test_two_legs(rows):
    flights = rows(
        [
            (1, "BOS", "LAS", at("2024-01-01 08:00")),
            (2, "LAS", "SEA", at("2024-01-01 06:00")),
            (3, "LAS", "SFO", at("2024-01-01 12:00")),
            (4, "LAS", "SFO", at("2024-01-02 12:00")),
        ],
        "flight_id int, dep string, arr string, sched timestamp_ntz",
    )
    same_day = joins.two_leg_itinerary(flights, flights).collect()
    assert [(r.first_flight, r.options, r.earliest_second, r.latest_second) for r in same_day] == [(1, 2, 2, 3)]
    next_day = joins.two_leg_itinerary(flights, flights, days_after=1).collect()
    assert [(r.first_flight, r.options, r.earliest_second) for r in next_day] == [(1, 1, 4)]
    with pytest.raises(ValueError):
        joins.two_leg_itinerary(flights, flights, days_after=-1)
