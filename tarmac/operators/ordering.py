"""Fair order over airports, and first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.slices import DAY, row_numbers


def fair_interleave(
    flights: DataFrame, airport: str = "dep", at: str = "sched", tie: str = "flight_id", seconds: int = DAY, most: int | None = None
) -> DataFrame:
    """`turn`: flight 1 of every airport comes before flight 2 of any.

    The order itself is (turn, airport); sorting is left to the consumer. With `most`, only
    that many flights of an airport.
    """
    return row_numbers(flights, [airport], at, tie, "turn", seconds, most)


def fair_quota(flights: DataFrame, quota: int, airport: str = "dep", at: str = "sched", tie: str = "flight_id") -> DataFrame:
    """The first `quota` flights in fair order, hence at most so many of an airport."""
    return fair_interleave(flights, airport, at, tie, most=quota).orderBy("turn", airport).limit(quota)


def top_n(df: DataFrame, order: Sequence, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)
