"""From schedules, status, airports and observations to labelled flights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.classify import CANCELED_STATUS, class_message, classify5
from tarmac.functions.timecols import whole_minutes
from tarmac.operators.asof import weather_at_both_ends
from tarmac.operators.joins import join_airports, join_status
from tarmac.operators.projections import is_landed
from tarmac.session import written


def label_flights(
    flights: DataFrame,
    scheduled: str = "gate_departure",
    departed: str = "act_dep",
    arrived: str = "act_arr",
    compat: bool = False,
    keep_cancelled: bool = False,
) -> DataFrame:
    """Delay, class and message of flights with a status.

    Only landed flights are kept; with `keep_cancelled` cancelled ones are too, landed
    or not.
    """
    kept = is_landed(scheduled, departed, arrived)
    if keep_cancelled:
        kept = kept | (F.col("status") == CANCELED_STATUS)
    return (
        flights.where(kept).withColumn("deltaDeparture", whole_minutes(F.col(scheduled), F.col(departed)))
        .withColumn("classification", classify5(F.col("deltaDeparture"), F.col("status"), compat))
        .withColumn("classificationMsg", class_message(F.col("classification")))
    )


def build_labelled_flights(
    schedules: DataFrame,
    statuses: DataFrame,
    airports: DataFrame,
    observations: DataFrame,
    keys: Sequence[str] = ("carrier", "flight_number", "dep", "day"),
    granularity: str = "exact",
    compat: bool = False,
    keep_cancelled: bool = False,
    materialise: bool = True,
) -> DataFrame:
    """The whole data set build.

    Flights are shuffled for the status join and once per end for the weather. The
    weather search reads the flights twice, for its points and for the result, so
    the joined flights are written once in between; `materialise=False` leaves one
    lazy plan that computes them twice.
    """
    known = join_airports(schedules, airports).drop("departureAirport", "arrivalAirport")
    labelled = label_flights(join_status(known, statuses, keys), compat=compat, keep_cancelled=keep_cancelled)
    if materialise:
        labelled = written(labelled, "labelled")
    return weather_at_both_ends(labelled, observations, scheduled="gate_departure", granularity=granularity)
