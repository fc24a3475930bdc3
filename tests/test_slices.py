import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import ordering
from tarmac.operators.slices import DAY, HOUR, next_two, row_numbers

EVENTS = "id int, user string, at timestamp_ntz"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    base = datetime(2024, 1, 1)
    users = ["hot"] * 5 + ["a", "b", None]
    data = [
        (i, rng.choice(users), base + timedelta(minutes=rng.choice([0, 5, 1440]) * rng.randrange(8) + rng.randrange(3)))
        for i in range(400)
    ]
    data += [(1000 + i, rng.choice(users), None) for i in range(20)]
    return spark.createDataFrame(data, EVENTS)


@pytest.mark.parametrize("seconds", [HOUR, DAY, 1000 * DAY])
def test_row_numbers_equal_plain_window(events, seconds):
    number = F.row_number().over(Window.partitionBy("user").orderBy(F.col("at").asc_nulls_last(), "id")).cast("bigint")
    plain = events.withColumn("nr", F.when(F.col("user").isNotNull() & F.col("at").isNotNull(), number))
    sliced = row_numbers(events, ["user"], "at", "id", "nr", seconds)
    assert sorted(map(str, sliced.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("seconds", [60, HOUR, DAY, 1000 * DAY])
def test_next_two_equals_lead(events, seconds):
    order = Window.partitionBy("user").orderBy(F.col("at").asc_nulls_last(), "id")
    known = F.col("user").isNotNull() & F.col("at").isNotNull()
    plain = events.withColumn("n1", F.when(known, F.lead("at", 1).over(order))).withColumn(
        "n2", F.when(known, F.lead("at", 2).over(order))
    )
    sliced = next_two(events, "user", "at", "id", "n1", "n2", seconds)
    assert sorted(map(str, sliced.collect())) == sorted(map(str, plain.collect()))


def test_fair_order_takes_turns(rows):
    base = datetime(2024, 1, 1)
    flights = rows(
        [(1, "A", base), (2, "A", base + timedelta(days=2)), (3, "A", base + timedelta(days=3)), (4, "B", base), (5, "C", base)],
        "flight_id int, dep string, sched timestamp_ntz",
    )
    ordered = ordering.fair_interleave(flights).orderBy("turn", "dep").collect()
    assert [r.flight_id for r in ordered] == [1, 4, 5, 2, 3]
    assert [r.flight_id for r in ordering.fair_quota(flights, 4).orderBy("turn", "dep").collect()] == [1, 4, 5, 2]
