"""Row filters and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import known_coordinate
from tarmac.functions.text import ascii_only, flight_code, place_label

# The five named data sets and their departure airports.
NAMED_SETS = {
    "mega_set": [
        "DFW", "DEN", "CLT", "PHX", "IAH", "MIA", "SEA", "EWR", "MCO", "MSP",
        "DTW", "LGA", "FLL", "BWI", "IAD", "MDW", "SLC", "DCA", "HNL", "TPA",
    ],
    "mega_subset": ["ATL", "LAX", "ORD", "JFK", "SFO", "LAS", "BOS", "PHL", "SAN", "PDX"],
    "training_set": ["BOS", "SFO", "MIA", "AUS", "ORD"],
    "test_set": ["LAS"],
    "blind_set": ["SEA"],
}

# Observation attributes whose name differs in a forecast.
FORECAST_NAMES = {"dewPt": "dewpt"}


def is_landed(scheduled: str, departed: str, arrived: str) -> Column:
    """Whether a flight has a scheduled departure, a take-off and a landing."""
    return F.col(scheduled).isNotNull() & F.col(departed).isNotNull() & F.col(arrived).isNotNull()


def landed_only(df: DataFrame, scheduled: str, departed: str, arrived: str) -> DataFrame:
    return df.where(is_landed(scheduled, departed, arrived))


def resolve_path(path: str) -> Column:
    """Column of a dotted path through nested rows."""
    first, *rest = path.split(".")
    column = F.col(first)
    for name in rest:
        column = column.getField(name)
    return column


def rename_forecast(df: DataFrame, names: Mapping[str, str] = FORECAST_NAMES) -> DataFrame:
    """Forecast columns under their observation names, exact in upper and lower case."""
    to_observation = {forecast: observed for observed, forecast in names.items()}
    return df.select(*[F.col(c).alias(to_observation.get(c, c)) for c in df.columns])


def tag_data_sets(df: DataFrame, airport: str, sets: Mapping[str, Sequence[str]] = NAMED_SETS) -> DataFrame:
    """Each row once per data set its airport belongs to, in column `data_set`.

    The sets are short fixed lists, so this is a projection: no join, no shuffle.
    """
    names = [F.when(F.col(airport).isin(list(codes)), F.lit(name)) for name, codes in sets.items()]
    return df.withColumn("data_set", F.explode(F.array_compact(F.array(*names))))


def in_data_set(df: DataFrame, airport: str, name: str, sets: Mapping[str, Sequence[str]] = NAMED_SETS) -> DataFrame:
    return df.where(F.col(airport).isin(list(sets[name])))


def between_open(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(column) > low) & (F.col(column) < high))


def on_route(df: DataFrame, dep: str, arr: str, dep_code: str, arr_code: str) -> DataFrame:
    return df.where((F.col(dep) == dep_code) & (F.col(arr) == arr_code))


def endpoints(df: DataFrame, *ends: Mapping[str, str]) -> DataFrame:
    """One row per end of a row; each end maps output name to input column."""
    return df.select(F.inline(F.array(*[F.struct(*[F.col(c).alias(n) for n, c in end.items()]) for end in ends])))


def clean_node(df: DataFrame) -> DataFrame:
    """Airport rows as graph nodes: ASCII names, 0.0 for unknown coordinates."""
    return df.select(
        "code",
        ascii_only(F.col("name")).alias("name"),
        known_coordinate(F.col("latitude")).alias("latitude"),
        known_coordinate(F.col("longitude")).alias("longitude"),
    )


def flight_search(
    schedules: DataFrame,
    airports: DataFrame,
    carrier: str = "carrier",
    number: str = "flight_number",
    arr: str = "arr",
    local: str = "local_time",
    utc: str = "utc_time",
) -> DataFrame:
    """Search results: code, local and UTC time, destination code and label."""
    places = airports.select(
        F.col("fs").alias("_fs"), place_label(F.col("name"), F.col("state"), F.col("country")).alias("destination")
    )
    return schedules.join(places, F.col(arr) == F.col("_fs"), "left").select(
        flight_code(F.col(carrier), F.col(number)).alias("flightnumber"),
        F.col(local).alias("time"),
        F.col(utc).alias("time_utc"),
        F.col(arr).alias("dest_airport_code"),
        "destination",
    )


def search_departures(schedules: DataFrame, airport: str, day: str, hour: int, dep: str = "dep", local: str = "local_time") -> DataFrame:
    """Departures of one airport in one local hour of one day.

    A range on the time column rather than functions of it, so that the filter
    reaches the files.
    """
    start = F.timestamp_add("HOUR", F.lit(int(hour)), F.to_timestamp_ntz(F.lit(day)))
    end = F.timestamp_add("HOUR", F.lit(int(hour) + 1), F.to_timestamp_ntz(F.lit(day)))
    return schedules.where((F.col(dep) == airport) & (F.col(local) >= start) & (F.col(local) < end))
