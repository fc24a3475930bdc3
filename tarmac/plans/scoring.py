"""Score upcoming flights with every model and store the outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.text import carrier_of, number_of
from tarmac.functions.timecols import epoch_ms_to_local, local_to_utc
from tarmac.operators.features import forecast_features
from tarmac.operators.handlers import DefaultHandler
from tarmac.operators.joins import disambiguate_leg, join_appendix, join_forecast_hour
from tarmac.operators.models import ModelRegistry, score
from tarmac.operators.projections import FORECAST_NAMES
from tarmac.operators.voting import vote_in_row
from tarmac.session import written

# Fixed value: the departure airport of a search that names none.
DEFAULT_AIRPORT = "LAS"


def assemble_payload(
    df: DataFrame,
    flight: Sequence[Column],
    overall: Column,
    models: Sequence[tuple[str, Column]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Nested result rows: flight, both airports with forecast, and the predictions.

    Expects the structs departureAirport, departureWeather, arrivalAirport and
    arrivalWeather; `models` pairs a model's name with its class text.
    """

    def end(name: str) -> Column:
        return F.struct(
            F.col(f"{name}Airport").alias("airportInfo"), F.col(f"{name}Weather").alias("weatherForecast")
        )

    entries = [F.struct(F.lit(name).alias("model"), text.alias("prediction")) for name, text in models]
    return df.select(
        *keep,
        F.struct(*flight).alias("flightInfo"),
        end("departure").alias("departureAirportInfo"),
        end("arrival").alias("arrivalAirportInfo"),
        F.struct(overall.alias("overall"), F.array(*entries).alias("models")).alias("prediction"),
    )


def resolve_requests(requests: DataFrame, schedules: DataFrame, airports: DataFrame) -> DataFrame:
    """The scheduled flight each request (flight, epoch_ms, departure_airport) means.

    The date is that at the departure airport, the hour is UTC. Adds struct `leg`,
    null with a `reject_reason` where there is none or one of its airports is unknown.
    """
    zones = airports.groupBy(F.col("fs").alias("_fs")).agg(F.min("timeZoneRegionName").alias("_zone"))
    asked = (
        requests.withColumn("departure_airport", F.coalesce("departure_airport", F.lit(DEFAULT_AIRPORT)))
        .join(zones, F.col("departure_airport") == F.col("_fs"), "left")
        .withColumn("carrierFsCode", carrier_of(F.col("flight")))
        .withColumn("flightNumber", number_of(F.col("flight")))
        .withColumn("day", F.to_date(epoch_ms_to_local(F.col("epoch_ms"), F.col("_zone"))))
        .withColumn("want_hour", F.hour(epoch_ms_to_local(F.col("epoch_ms"))))
        .drop("_fs", "_zone")
    )
    departures = zones.select(F.col("_fs").alias("_dep_fs"), F.col("_zone").alias("_dep_zone"))
    arrivals = zones.select(F.col("_fs").alias("_arr_fs"), F.col("_zone").alias("_arr_zone"))
    unknown = [
        F.when(F.col(f"_{end}_fs").isNull(), F.concat(F.lit("no airport record: "), F.coalesce(code, F.lit(""))))
        for end, code in (("dep", "departureAirportFsCode"), ("arr", "arrivalAirportFsCode"))
    ]
    # Legs are counted before their airports are looked up: a leg of an unknown airport is a leg.
    legs = (
        schedules.join(departures, F.col("departureAirportFsCode") == F.col("_dep_fs"), "left")
        .join(arrivals, F.col("arrivalAirportFsCode") == F.col("_arr_fs"), "left")
        .withColumn("departureTimeUTC", local_to_utc(F.col("departureTime"), F.col("_dep_zone")))
        .withColumn("arrivalTimeUTC", local_to_utc(F.col("arrivalTime"), F.col("_arr_zone")))
        .withColumn("day", F.to_date("departureTime"))
        .withColumn("_unknown", F.coalesce(*unknown))
        .drop("_dep_fs", "_dep_zone", "_arr_fs", "_arr_zone")
    )
    resolved = disambiguate_leg(
        asked,
        legs,
        ["carrierFsCode", "flightNumber", "day"],
        departure_utc="departureTimeUTC",
        order=("departureTimeUTC", "departureAirportFsCode"),
    )
    reason = F.coalesce("reject_reason", F.col("leg._unknown"))
    leg = F.when(reason.isNull(), F.col("leg").dropFields("_unknown"))
    return resolved.withColumns({"reject_reason": reason, "leg": leg})


def score_upcoming(
    requests: DataFrame,
    schedules: DataFrame,
    airports: DataFrame,
    airlines: DataFrame,
    equipment: DataFrame,
    forecasts: DataFrame,
    registry: ModelRegistry,
    handler: DefaultHandler | None = None,
    forecast_names: dict[str, str] = FORECAST_NAMES,
    materialise: bool = True,
    scored_at: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Payload rows of all requests that name a flight, and the rejected requests.

    `scored_at` names a column of the requests with the instant of the scoring; without
    it, the last forecasts count. Both results start from the resolved requests, so
    these are written once first.
    """
    registry.require()
    resolved = resolve_requests(requests, schedules, airports)
    if materialise:
        resolved = written(resolved, "resolved")
    rejects = resolved.where(F.col("reject_reason").isNotNull()).drop("leg")
    keep = ["request_id", *([scored_at] if scored_at else [])]
    found = resolved.where(F.col("reject_reason").isNull()).select(*keep, "carrierFsCode", "flightNumber", "leg.*")
    return score_legs(found, airports, airlines, equipment, forecasts, registry, handler, forecast_names, scored_at), rejects


def score_legs(
    legs: DataFrame,
    airports: DataFrame,
    airlines: DataFrame,
    equipment: DataFrame,
    forecasts: DataFrame,
    registry: ModelRegistry,
    handler: DefaultHandler | None = None,
    forecast_names: dict[str, str] = FORECAST_NAMES,
    scored_at: str | None = None,
) -> DataFrame:
    """Payload rows of known legs: carrier, number, both airports and both times, with `request_id`.

    Look-ups and forecasts are joins, the models and the vote are projections. What a
    leg does not have of the other columns of a schedule is null.
    """
    registry.require()
    handler = handler or DefaultHandler()
    for column in ("flightEquipmentIataCode", "departureTime", "arrivalTime"):
        if column not in legs.columns:
            legs = legs.withColumn(column, F.lit(None).cast("string" if column.endswith("Code") else "timestamp_ntz"))
    found = join_appendix(legs, equipment, "flightEquipmentIataCode", "iata", "equipmentInfo", empty=True)
    found = join_appendix(found, airlines, "carrierFsCode", "fs", "airlineInfo", empty=True)
    found = join_appendix(found, airports, "departureAirportFsCode", "fs", "departureAirport")
    found = join_appendix(found, airports, "arrivalAirportFsCode", "fs", "arrivalAirport")
    found = join_forecast_hour(found, forecasts, "departureAirportFsCode", "departureTimeUTC", "departureWeather", scored_at)
    found = join_forecast_hour(found, forecasts, "arrivalAirportFsCode", "arrivalTimeUTC", "arrivalWeather", scored_at)
    values = forecast_features("departureWeather", "arrivalWeather", handler, forecast_names)
    scored = score(found.withColumn("features", values), registry)
    texts = [handler.class_label(p.cast("int")) for p in registry.predictions()]
    flight = [
        "carrierFsCode",
        "flightNumber",
        "departureAirportFsCode",
        "arrivalAirportFsCode",
        "departureTime",
        "arrivalTime",
        "departureTimeUTC",
        "arrivalTimeUTC",
        "equipmentInfo",
        "airlineInfo",
    ]
    return assemble_payload(
        scored,
        [F.col(c) for c in flight],
        vote_in_row(registry.predictions(), handler.class_label),
        list(zip(registry.models, texts)),
        ["request_id"],
    )
