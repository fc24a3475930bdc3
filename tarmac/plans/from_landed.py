"""From landed service answers to labelled flights, and from requests to the stored history.

The names of the services' records are matched to those of the plans here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.joins import airport_rejects
from tarmac.plans.labelled import build_labelled_flights
from tarmac.plans.scoring import score_upcoming
from tarmac.session import written
from tarmac.sources import history, landed, metadata

KEYS = ("carrier", "flight_number", "dep", "day")

_SCHEDULE = {
    "carrier": "carrierFsCode",
    "flight_number": "flightNumber",
    "dep": "departureAirportFsCode",
    "arr": "arrivalAirportFsCode",
}
_STATUS = {"gate_departure": "scheduledGateDeparture", "act_dep": "actualRunwayDeparture", "act_arr": "actualRunwayArrival"}


def landed_schedules(raw: DataFrame, body: str = "body") -> DataFrame:
    """Schedules of landed answers in the shape of `build_labelled_flights`."""
    return schedules_of(landed.ingest_schedules(raw, body=body))


def schedules_of(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(n) for n, c in _SCHEDULE.items()], F.to_date("departureTime").alias("day"))


def landed_statuses(raw: DataFrame, keys: Sequence[str] = KEYS, body: str = "body") -> DataFrame:
    """First entries of status answers in the shape of `build_labelled_flights`."""
    return statuses_of(landed.ingest_statuses(raw, keys, body), keys)


def statuses_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.lit(0).alias("pos"), "status", *[F.col(c).alias(n) for n, c in _STATUS.items()])


def build_from_landed(
    schedules: DataFrame, statuses: DataFrame, airports: DataFrame, observations: DataFrame, **options
) -> DataFrame:
    """The labelled set from four tables of landed answers; `options` go to `build_labelled_flights`.

    Answers that were fetched twice count once: schedules are distinct, a flight has one
    status, and observations of one airport and instant are one. `build_with_rejects` also
    gives what is left out along the way. Statuses and observations are read more than once,
    so they are parsed into a table first, unless told `materialise=False`.
    """
    parsed = [landed_statuses(statuses), landed.ingest_observations(observations)]
    if options.get("materialise", True):
        parsed = [written(rows, purpose) for rows, purpose in zip(parsed, ("statuses", "observations"), strict=True)]
    known = metadata.load_airports(airports).drop("metadata_type")
    return build_labelled_flights(landed_schedules(schedules).distinct(), parsed[0], known, parsed[1], **options)


@dataclass(frozen=True)
class Built:
    """The labelled flights, what was left out on the way, and how many rows each service gave and lost."""

    flights: DataFrame
    rejects: DataFrame
    counts: dict[str, dict[str, int]]


def build_with_rejects(
    schedules: DataFrame, statuses: DataFrame, airports: DataFrame, observations: DataFrame, **options
) -> Built:
    """`build_from_landed` with the rejects of schedules, statuses, observations and airports.

    Every answer is parsed once: rows and rejects of a service are written side by side.
    `rejects` has service, reject_reason, position, entry (for a flight of an unknown
    airport its code pair) and the answer's text.
    """
    parsed = {
        "schedules": landed.split_schedules(schedules),
        "statuses": landed.split_statuses(statuses, KEYS),
        "observations": landed.split_observations(observations),
    }
    flights = schedules_of(parsed["schedules"].rows).distinct()
    known = metadata.load_airports(airports).drop("metadata_type")
    built = build_labelled_flights(flights, statuses_of(parsed["statuses"].rows, KEYS), known, parsed["observations"].rows, **options)
    columns = ("service", "reject_reason", "position", "entry", "body")
    lost = [p.rejects.withColumn("service", F.lit(name)).select(*columns) for name, p in parsed.items()]
    unknown = airport_rejects(flights, known).select(
        F.lit("airports").alias("service"),
        "reject_reason",
        F.lit(None).cast("int").alias("position"),
        F.concat_ws("-", "dep", "arr").alias("entry"),
        F.lit(None).cast("string").alias("body"),
    )
    return Built(built, reduce(DataFrame.unionByName, [*lost, unknown]), {name: p.counts for name, p in parsed.items()})


def score_and_store(path: str, run: str, *inputs, **options) -> DataFrame:
    """Score requests, store the outcome under the key of the run, and give the rejected requests.

    The inputs are those of `score_upcoming`. A run that is repeated stores nothing twice.
    """
    payload, rejects = score_upcoming(*inputs, **options)
    history.save_history(history.flatten_payload(payload), path, run=run)
    return rejects
