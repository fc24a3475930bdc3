"""First rows by a narrow aggregate, against plain Python."""

import random

import pytest
from instants import at
from pyspark.sql import functions as F

from tarmac.operators import asof, joins, selection
from tarmac.sources import landed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_and_last_of_each_key(rows):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), rng.choice([-5, 0, 7, None]), i % 40) for i in range(300)]
    df = rows(data, "k string, g int, pos int, payload int")
    for last in (False, True):
        got = selection.select_rows(df, ["k", "g"], ["pos"], last).collect()
        keys = {(k, g) for k, g, _, _ in data}
        assert {(r.k, r.g) for r in got} == keys and len(got) == len(keys)
        for r in got:
            order = [p for k, g, p, _ in data if (k, g) == (r.k, r.g)]
            smallest = min(order, key=lambda p: (p is not None, p))
            assert r.pos == (max((p for p in order if p is not None), default=None) if last else smallest)
            assert (r.k, r.g, r.pos, r.payload) in data


def test_ties_and_copies_give_one_row_that_is_the_same_every_time(rows):
    df = rows([("a", 1, x) for x in (5.0, 4.0, 4.0, None)] * 3, "k string, pos int, x double")
    found = [selection.select_rows(d, ["k"], ["pos"]).collect() for d in (df, df.repartition(5), df.orderBy("x"))]
    assert len(found[0]) == 1 and found[0] == found[1] == found[2]
    assert selection.select_rows(df.limit(0), ["k"], ["pos"]).count() == 0
    assert selection.select_rows(df, ["k"], []).count() == 1


@pytest.mark.parametrize("last", [False, True])
def test_two_order_columns(rows, last):
    rng = random.Random(8)
    data = [(rng.randrange(4), at(f"20{rng.randrange(10, 30)}-01-0{rng.randrange(1, 9)}"), rng.randrange(-(1 << 40), 1 << 40)) for _ in range(200)]
    df = rows(data, "k int, moment timestamp_ntz, tie bigint")
    got = {r.k: (r.moment, r.tie) for r in selection.select_rows(df, ["k"], ["moment", "tie"], last).collect()}
    pick = max if last else min
    assert got == {k: pick((m, t) for j, m, t in data if j == k) for k in range(4)}


@pytest.mark.parametrize(
    ("kind", "values"),
    [("tinyint", [-3, 5]), ("bigint", [-(1 << 61), 1 << 61]), ("boolean", [False, True]), ("date", ["1969-12-30", "2030-01-01"]), ("timestamp", ["1969-12-30 01:00:00", "2030-01-01 00:00:00"])],
)
def test_order_of_every_kind_of_number(rows, kind, values):
    df = rows([("a", str(v).lower()) for v in values], "k string, v string").withColumn("v", F.col("v").cast(kind))
    low, high = sorted(df.collect(), key=lambda r: r.v)
    assert selection.select_rows(df, ["k"], ["v"]).collect() == [low]
    assert selection.select_rows(df, ["k"], ["v"], last=True).collect() == [high]


def test_what_cannot_be_selected_is_aggregated(rows):
    df = rows([("a", "x", {"m": 1}), ("a", "b", {"m": 2})], "k string, name string, m map<string,int>")
    assert not selection.can_select(df, ["name"]) and not selection.can_select(df, [])
    assert joins.first_per_key(df, ["k"], ["name"]).first().name == "b"
    assert not selection.can_select(rows([(1, 2, 3)], "a int, b int, c int"), ["a", "b", "c"])


def test_no_wide_row_is_sorted_or_aggregated_by_sorting(rows):
    statuses = rows([(1, 0, "L", "x"), (1, 1, "C", "y")], "flight int, pos int, status string, note string")
    flights = rows([(1, "a")], "flight int, name string")
    forecasts = rows([("A", at("2024-01-01"), at("2024-01-01 05:00"), 1, "x")], "fs string, fetched_at timestamp_ntz, fcst_valid timestamp_ntz, forecast_id bigint, note string")
    points = rows([(1, "A", at("2024-01-01 05:05"))], "flight int, dep string, sched timestamp_ntz")
    observed = rows([("A", at("2024-01-01 05:00"), 1, "x")], "fs string, valid_time timestamp_ntz, obs_id int, note string")
    for df in (
        joins.join_status(flights, statuses, ["flight"]),
        joins.first_per_key(statuses, ["flight"], ["pos"]),
        joins.join_forecast_hour(points, forecasts, "dep", "sched", "w"),
        landed.dedupe_observations(observed, tie="obs_id"),
        asof.nearest_observation(points, observed, "dep", "sched", "w"),
        asof.weather_at_both_ends(points.withColumns({"arr": F.col("dep"), "act_arr": F.col("sched")}), observed),
    ):
        assert "SortAggregate" not in plan_of(df)
        assert df.count() == 1


def test_copies_of_a_hot_key_multiply_nothing(rows):
    copies = rows([("HUB", at("2024-01-01 10:00"), 4, 1.0)] * 200 + [("HUB", at("2024-01-01 10:00"), 4, 2.0)], "fs string, valid_time timestamp_ntz, obs_id int, temp double")
    points = rows([(i, "HUB", at("2024-01-01 11:00")) for i in range(30)], "flight int, dep string, sched timestamp_ntz")
    assert asof.nearest_observation(points, copies, "dep", "sched", "w").where("w.obs_id = 4").count() == 30
    assert landed.dedupe_observations(copies, tie="obs_id").count() == 1
