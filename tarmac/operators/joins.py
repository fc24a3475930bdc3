"""Joins of flights with airports, status, forecasts and other flights.

None carries a broadcast hint: Spark broadcasts a side whose measured size is under
`spark.sql.autoBroadcastJoinThreshold` and otherwise sorts and merges, splitting
skewed partitions. So a dimension that outgrows memory changes the plan, not the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.timecols import hour_start
from tarmac.operators import asof
from tarmac.operators.selection import can_select, select_rows


def unique_records(table: DataFrame, key: str) -> DataFrame:
    """`_code` and the record as struct `_record`: of records that repeat a code, the smallest."""
    return table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_code")).agg(F.min(F.struct(*table.columns)).alias("_record"))


def _airport_side(airports: DataFrame, name: str) -> DataFrame:
    return unique_records(airports, "fs").select(F.col("_code").alias(f"_{name}"), F.col("_record").alias(name))


def _with_airports(flights: DataFrame, airports: DataFrame, dep: str, arr: str, how: str) -> DataFrame:
    return (
        flights.join(_airport_side(airports, "departureAirport"), F.col(dep) == F.col("_departureAirport"), how)
        .join(_airport_side(airports, "arrivalAirport"), F.col(arr) == F.col("_arrivalAirport"), how)
        .drop("_departureAirport", "_arrivalAirport")
    )


def join_airports(flights: DataFrame, airports: DataFrame, dep: str = "dep", arr: str = "arr") -> DataFrame:
    """Flights with both airport records; a flight with an unknown airport is left out."""
    return _with_airports(flights, airports, dep, arr, "inner")


def airport_rejects(flights: DataFrame, airports: DataFrame, dep: str = "dep", arr: str = "arr") -> DataFrame:
    """The flights `join_airports` leaves out, with the reason."""
    missing = "no airport record: "
    joined = _with_airports(flights, airports, dep, arr, "left")
    reason = F.when(
        F.col("departureAirport").isNull(), F.concat(F.lit(missing), F.coalesce(F.col(dep), F.lit("")))
    ).when(F.col("arrivalAirport").isNull(), F.concat(F.lit(missing), F.coalesce(F.col(arr), F.lit(""))))
    return (
        joined.withColumn("reject_reason", reason)
        .where(F.col("reject_reason").isNotNull())
        .drop("departureAirport", "arrivalAirport")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, nulls first; of rows equal in the order, one by its hash.

    With one or two numbers or times as order, wide rows are neither sorted nor
    aggregated, see `selection`; any other order takes an aggregate over whole rows, of
    which each task sends one per key on.
    """
    rest = [c for c in df.columns if c not in keys]
    if can_select(df, order):
        return select_rows(df, keys, order).select(*keys, *rest)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def join_status(flights: DataFrame, statuses: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """Flights with the first status entry of their answer; without an answer, no row."""
    first = first_per_key(statuses, keys, [position])
    return flights.join(first, list(keys))


def join_nested_status(flights: DataFrame, answers: DataFrame, keys: Sequence[str], entries: str = "flightStatuses") -> DataFrame:
    """`join_status` for answers that hold their entries as an array."""
    first = answers.where(F.size(entries) > 0).select(*keys, F.get(F.col(entries), F.lit(0)).alias("_status"))
    return flights.join(first, list(keys)).select(*flights.columns, "_status.*")


def hourly_forecasts(forecasts: DataFrame, station: str, fetched_at: str, valid: str, tie: str | None) -> DataFrame:
    """One forecast per answer and hour of day: the last one wins.

    Without a `tie`, of forecasts for one instant the one with the largest values.
    """
    rest = [c for c in forecasts.columns if c != station]
    if tie in forecasts.columns and can_select(forecasts, [valid, tie]):
        known = forecasts.withColumn("_f_hour", F.hour(valid))
        kept = select_rows(known, [station, fetched_at, "_f_hour"], [valid, tie], last=True)
        return kept.select(F.col(station).alias("_f_station"), F.col(fetched_at).alias("_f_run"), "_f_hour", F.struct(*rest).alias("_forecast"))
    order = [valid, tie] if tie in forecasts.columns else [valid, *[c for c in rest if c != valid]]
    return forecasts.groupBy(
        F.col(station).alias("_f_station"), F.col(fetched_at).alias("_f_run"), F.hour(valid).alias("_f_hour")
    ).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_forecast"))


def forecast_runs(flights: DataFrame, forecasts: DataFrame, station: str, scored_at: str, fcst_station: str, fetched_at: str) -> DataFrame:
    """The answer an airport last fetched at or before each scoring instant: `_station`, `_at`, `_run`.

    Only distinct airports and instants take part, in the time slices of the weather search.
    """
    asked = asof.points_of(flights, (station, scored_at))
    fetched = asof.points_of(forecasts, (fcst_station, fetched_at))
    return asof.neighbours(asked, fetched).select("_station", "_at", F.col("_before").alias("_run"))


def join_forecast_hour(
    flights: DataFrame,
    forecasts: DataFrame,
    station: str,
    at: str,
    name: str,
    scored_at: str | None = None,
    fcst_station: str = "fs",
    fetched_at: str = "fetched_at",
    fcst_valid: str = "fcst_valid",
    fcst_tie: str | None = "forecast_id",
) -> DataFrame:
    """Each flight with the forecast whose hour of day equals that of `at` (UTC).

    It is taken from the answer the airport last fetched at or before the instant in
    column `scored_at`; without that column, from its last answer. An answer reaches over
    two days, so it serves flights over midnight and of the next day; of its forecasts
    for an hour of day the last wins. Null where the airport has none. For the nearest
    forecast instead, use `asof.nearest_observation` on the forecasts.
    """
    hourly = hourly_forecasts(forecasts, fcst_station, fetched_at, fcst_valid, fcst_tie)
    if scored_at is None:
        last = forecasts.groupBy(F.col(fcst_station).alias("_station")).agg(F.max(fetched_at).alias("_run"))
        known = flights.join(last, F.col(station) == F.col("_station"), "left")
    else:
        runs = forecast_runs(flights, forecasts, station, scored_at, fcst_station, fetched_at)
        known = flights.join(runs, (F.col(station) == F.col("_station")) & (F.col(scored_at) == F.col("_at")), "left")
    same = (
        (F.col("_station") == F.col("_f_station"))
        & (F.col("_run") == F.col("_f_run"))
        & (F.hour(at) == F.col("_f_hour"))
    )
    joined = known.join(hourly, same, "left").withColumnRenamed("_forecast", name)
    return joined.drop("_station", "_at", "_run", "_f_station", "_f_run", "_f_hour")


def join_appendix(
    flights: DataFrame,
    lookup: DataFrame,
    code: str,
    key: str,
    name: str,
    empty: bool = False,
) -> DataFrame:
    """Look a code up: the record as struct `name`, null if unknown.

    With `empty=True` an unknown code gives a record whose fields are all null.
    """
    joined = flights.join(unique_records(lookup, key), F.col(code) == F.col("_code"), "left").drop("_code")
    if not empty:
        return joined.withColumnRenamed("_record", name)
    fields = F.struct(*[F.col("_record").getField(c).alias(c) for c in lookup.columns])
    return joined.withColumn(name, fields).drop("_record")


def disambiguate_leg(
    requests: DataFrame,
    legs: DataFrame,
    keys: Sequence[str],
    want_hour: str = "want_hour",
    departure_utc: str = "sched",
    order: Sequence[str] = ("sched", "flight_id"),
) -> DataFrame:
    """The leg a request means, when its flight number departs several times a day.

    A lone leg is accepted unchecked; of several, the first one whose UTC hour is
    the wanted one. `reject_reason` says why a request found none. Legs are reduced
    to one row per hour before the join, so a request meets at most 24 of them.
    """
    by = F.struct(*order)
    payload = F.struct(*[c for c in legs.columns if c not in keys])
    by_hour = legs.groupBy(*keys, F.hour(departure_utc).alias("_hour")).agg(
        F.min_by(payload, by).alias("leg"), F.count(F.lit(1)).alias("_legs")
    )
    by_key = by_hour.groupBy(*keys).agg(
        F.sum("_legs").alias("_candidates"), F.any_value("leg").alias("_lone")
    )
    found = _match_hour(requests.join(by_key, list(keys), "left"), by_hour, keys, want_hour)
    chosen = F.when(F.col("_candidates") == 1, F.col("_lone")).otherwise(F.col("_match"))
    return (
        found.withColumn("leg", chosen)
        .withColumn("candidates", F.coalesce(F.col("_candidates"), F.lit(0)).cast("bigint"))
        .withColumn(
            "reject_reason",
            F.when(F.col("_candidates").isNull(), "no scheduled departure").when(
                F.col("leg").isNull(), "no departure at the requested hour"
            ),
        )
        .drop("_candidates", "_lone", "_match")
    )


def _match_hour(requests: DataFrame, by_hour: DataFrame, keys: Sequence[str], want_hour: str) -> DataFrame:
    side = by_hour.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_hour", F.col("leg").alias("_match"))
    same = F.col(want_hour) == F.col("_hour")
    for key in keys:
        same = same & (F.col(key) == F.col(f"_h_{key}"))
    return requests.join(side, same, "left").drop("_hour", *[f"_h_{k}" for k in keys])


def observed_hours(observations: DataFrame, station: str = "fs", valid: str = "valid_time") -> DataFrame:
    """Distinct hours with an observation, per airport."""
    return observations.select(F.col(station).alias("fs"), hour_start(F.col(valid)).alias("obs_hour")).distinct()


def in_observed_hours(flights: DataFrame, hours: DataFrame, dep: str = "dep", at: str = "sched") -> DataFrame:
    """Flights that leave in an hour for which their airport has an observation."""
    same = (F.col(dep) == F.col("fs")) & (hour_start(F.col(at)) == F.col("obs_hour"))
    return flights.join(hours, same, "left_semi")


def two_leg_itinerary(
    first: DataFrame,
    second: DataFrame,
    days_after: int = 0,
    flight: str = "flight_id",
    dep: str = "dep",
    arr: str = "arr",
    at: str = "sched",
) -> DataFrame:
    """What each first leg offers as second leg: flights from its destination on its date.

    One row per first leg, with the number of second legs and the first and last of
    them, from one aggregate per (airport, date). The second legs themselves are the
    same list for all first legs that share destination and date, so they are not
    repeated per first leg: `projections.search_departures` gives that list.
    The second date may not precede the first.
    """
    if days_after < 0:
        raise ValueError("the second flight may not leave on an earlier date")
    options = second.groupBy(F.col(dep).alias("via"), F.to_date(at).alias("second_date")).agg(
        F.count(F.lit(1)).alias("options"),
        F.min(F.struct(at, flight)).alias("_first"),
        F.max(F.struct(at, flight)).alias("_last"),
    )
    legs = first.select(
        F.col(flight).alias("first_flight"),
        F.col(dep).alias("origin"),
        F.col(arr).alias("via"),
        F.date_add(F.to_date(at), days_after).alias("second_date"),
    )
    return legs.join(options, ["via", "second_date"]).select(
        "first_flight",
        "origin",
        "via",
        "second_date",
        "options",
        F.col("_first")[flight].alias("earliest_second"),
        F.col("_last")[flight].alias("latest_second"),
    )
