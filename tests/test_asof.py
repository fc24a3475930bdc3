import random
from datetime import datetime, timedelta

import pytest
from instants import at
from pyspark.sql import functions as F

from tarmac.operators import asof
from tarmac.operators.slices import HOUR

FLIGHTS = "flight_id int, dep string, sched timestamp_ntz, arr string, act_arr timestamp_ntz"
OBSERVATIONS = "obs_id int, fs string, valid_time timestamp_ntz, temp double"
BASE = datetime(2024, 1, 1)


def chosen(df, name="weather"):
    return {r.flight_id: r.obs_id for r in df.select("flight_id", f"{name}.obs_id").collect()}


def find(rows, flights, observations, **options):
    made = rows([(i, s, t, s, t) for i, s, t in flights], FLIGHTS)
    return chosen(asof.nearest_observation(made, rows(observations, OBSERVATIONS), "dep", "sched", "weather", **options))


def test_exact_tie_takes_the_earlier_observation(rows):
    observations = [(1, "BOS", at("2024-01-01 11:00"), 1.0), (2, "BOS", at("2024-01-01 13:00"), 2.0)]
    assert find(rows, [(7, "BOS", at("2024-01-01 12:00"))], observations) == {7: 1}


def test_same_instant_takes_the_smaller_id(rows):
    observations = [(5, "BOS", at("2024-01-01 11:00"), 1.0), (2, "BOS", at("2024-01-01 11:00"), 2.0)]
    assert find(rows, [(7, "BOS", at("2024-01-01 11:00"))], observations) == {7: 2}


def test_minute_granularity_takes_the_first_listed(rows):
    flights = [(7, "BOS", at("2024-01-01 12:00:00"))]
    observations = [
        (1, "BOS", at("2024-01-01 11:49:10"), 1.0),
        (2, "BOS", at("2024-01-01 11:49:40"), 1.0),
        (3, "BOS", at("2024-01-01 12:10:05"), 1.0),
    ]
    assert find(rows, flights, observations) == {7: 3}
    assert find(rows, flights, observations, granularity="minute") == {7: 1}


def test_unknown_granularity(rows):
    with pytest.raises(ValueError):
        find(rows, [(7, "BOS", BASE)], [(1, "BOS", BASE, 1.0)], granularity="day")


def test_no_maximum_gap_and_station_without_observations(rows):
    flights = [(1, "BOS", at("2024-06-01 00:00")), (2, "SEA", at("2024-06-01 00:00")), (3, "BOS", None), (4, None, BASE)]
    observations = [(9, "BOS", at("2020-01-01 00:00"), 1.0), (8, "LAX", at("2024-06-01 00:00"), 1.0), (7, None, BASE, 1.0)]
    assert find(rows, flights, observations) == {1: 9, 2: None, 3: None, 4: None}


def test_before_epoch_and_null_attributes(rows):
    flights = [(1, "BOS", at("1969-12-31 23:50"))]
    observations = [(1, "BOS", at("1969-12-31 23:00"), None), (2, "BOS", at("1970-01-01 00:05"), 3.0)]
    assert find(rows, flights, observations) == {1: 2}


def brute(flights, observations, granularity):
    answer = {}
    for flight, station, moment in flights:
        def distance(o):
            gap = abs(o[2] - moment)
            return gap if granularity == "exact" else gap // timedelta(minutes=1)

        here = [o for o in observations if o[1] == station]
        answer[flight] = min(here, key=lambda o: (distance(o), o[2], o[0]))[0] if here else None
    return answer


@pytest.mark.parametrize("granularity", ["exact", "minute"])
@pytest.mark.parametrize("seconds", [HOUR, 24 * HOUR, 400 * 24 * HOUR])
def test_equals_brute_force_with_a_hot_station(rows, granularity, seconds):
    rng = random.Random(seconds)
    stations = ["HUB"] * 6 + ["A", "B", "C"]

    def moment():
        return BASE + timedelta(seconds=rng.choice([0, 30, 3600, 7200]) + rng.randrange(6 * 86400), microseconds=rng.choice([0, 1, 999999]))

    observations = [(i, rng.choice(stations), moment(), float(i)) for i in range(250)]
    observations += [(1000 + i, o[1], o[2], o[3]) for i, o in enumerate(observations[:40])]
    flights = [(i, rng.choice(stations + ["NONE"]), moment()) for i in range(300)]
    flights += [(1000 + i, "HUB", observations[0][2]) for i in range(50)]
    assert find(rows, flights, observations, granularity=granularity, seconds=seconds) == brute(flights, observations, granularity)


def test_both_ends_in_one_search_equal_two_searches(rows):
    rng = random.Random(3)
    flights = rows(
        [
            (i, rng.choice("AB"), BASE + timedelta(minutes=rng.randrange(5000)), rng.choice("ABC"), BASE + timedelta(minutes=rng.randrange(5000)))
            for i in range(120)
        ],
        FLIGHTS,
    )
    observations = rows(
        [(i, rng.choice("AB"), BASE + timedelta(minutes=rng.randrange(5000)), 1.0) for i in range(60)], OBSERVATIONS
    )
    both = asof.weather_at_both_ends(flights, observations)
    for station, moment, name in (("dep", "sched", "departureWeather"), ("arr", "act_arr", "arrivalWeather")):
        alone = asof.nearest_observation(flights, observations, station, moment, name)
        assert chosen(both, name) == chosen(alone, name)
    assert both.count() == 120


def test_windows_are_cut_by_time_slice(rows):
    found = asof.nearest_observation(
        rows([(1, "BOS", BASE, "BOS", BASE)], FLIGHTS), rows([(1, "BOS", BASE, 1.0)], OBSERVATIONS), "dep", "sched", "weather"
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    specs = [line.split("windowspecdefinition(")[1] for line in plan.splitlines() if "Window [" in line]
    over_rows = [spec for spec in specs if "_at#" in spec]
    assert len(over_rows) == 2 and all("_slice" in spec.split("_at#")[0] for spec in over_rows)
    assert found.where(F.col("weather.obs_id") == 1).count() == 1


def test_the_session_zone_moves_nothing(spark, rows):
    """In New York, clocks go forward between the two observations."""
    points = rows([(1, "A", at("2024-03-10 03:05"))], "flight_id int, dep string, sched timestamp_ntz")
    observed = rows([("A", at("2024-03-10 01:40"), 1), ("A", at("2024-03-10 04:25"), 2)], "fs string, valid_time timestamp_ntz, obs_id int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        found = asof.nearest_observation(points, observed, "dep", "sched", "w").first()
        assert found.w.obs_id == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_observations_without_a_tie(rows):
    points = rows([(1, "A", at("2024-03-10 03:05"))], "flight_id int, dep string, sched timestamp_ntz")
    same = at("2024-03-10 03:00")
    for extra in ([("A", same, None, 3.0), ("A", same, 2, 9.0)], [("A", same, None, 3.0)]):
        observed = rows(extra, "fs string, valid_time timestamp_ntz, obs_id int, temp double")
        assert asof.nearest_observation(points, observed, "dep", "sched", "w").first().w.temp == 3.0
    observed = rows([("A", same, 5.0), ("A", same, 4.0)], "fs string, valid_time timestamp_ntz, temp double")
    assert asof.nearest_observation(points, observed, "dep", "sched", "w").first().w.temp == 4.0


def test_both_uses_of_the_searched_rows_read_the_same(rows, capsys):
    """A filter in one of them only would make the search read, reduce and shuffle its input twice."""
    flights = rows([(1, "BOS", BASE, "SEA", BASE + timedelta(hours=3))], FLIGHTS)
    observations = rows([(1, "BOS", BASE, 1.0), (2, "SEA", BASE, 2.0)], OBSERVATIONS)
    found = asof.weather_at_both_ends(flights, observations)
    found.explain(mode="extended")
    optimised = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "xxhash64" in optimised and "isnotnull(pmod(" not in optimised
    assert [(r.departureWeather.obs_id, r.arrivalWeather.obs_id) for r in found.collect()] == [(1, 2)]
