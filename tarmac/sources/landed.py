"""Landed service answers: rows with a JSON text become typed rows.

An answer is first split into its top-level fields as texts; only the list that is
wanted is then taken apart, and each entry is parsed alone against a declared schema. A
bad answer never fails the job and a bad entry never costs its list: `rejects` gives both
with their reasons.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tarmac.functions.timecols import utc_instant
from tarmac.operators.joins import first_per_key
from tarmac.session import shared_dir
from tarmac.sources.schemas import FLIGHT_STATUS, FORECAST, OBSERVATION, SCHEDULED_FLIGHT


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Further columns, each computed once per row.

    A filter on a plain column is pushed below it and takes the column's whole expression
    along, once for each time it is named: texts would be made and parsed several times.
    Filters do not pass a generator, here over the one record of the values.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def _fields(raw: DataFrame, body: str, names: Sequence[str]) -> DataFrame:
    """Top-level fields of the answer as texts, in struct `_answer`."""
    schema = ", ".join(f"`{n}` string" for n in [*names, "error", "errors"])
    return _once(raw, _answer=F.from_json(F.col(body), schema))


def _listed(raw: DataFrame, body: str, names: Sequence[str], lone_allowed: bool) -> DataFrame:
    """`_texts`, the entries of the answer's list as texts, and `_failure` if it has none."""
    fields = _fields(raw, body, names)
    listed = F.coalesce(*[F.col("_answer")[n] for n in names])
    read = _once(fields, _texts=_texts(listed, lone_allowed))
    return read.withColumn("_failure", _failure(listed, lone_allowed)).withColumn("_texts", F.when(F.col("_failure").isNull(), F.col("_texts"))).drop("_answer")


def _texts(listed: Column, lone_allowed: bool) -> Column:
    """The entries of a list as texts, so that one bad entry spoils no other."""
    lone = F.when(F.lit(lone_allowed), F.array(listed))
    return F.when(F.ltrim(listed).startswith("["), F.from_json(listed, "array<string>")).otherwise(lone)


def _failure(listed: Column, lone_allowed: bool) -> Column:
    """Why an answer has no list; `_texts` holds what was read of it."""
    answer = F.col("_answer")
    reason = F.when(answer["error"].isNotNull() | answer["errors"].isNotNull(), "error answer").when(
        listed.isNull(), "no list in the answer"
    )
    if not lone_allowed:
        reason = reason.when(~F.ltrim(listed).startswith("["), "not a list")
    return reason.when(F.col("_texts").isNull(), "unreadable list")


def _items(
    raw: DataFrame, body: str, names: Sequence[str], item: str, lone_allowed: bool, time: str | None, further: Sequence[str] = ()
) -> DataFrame:
    """One row per list entry as struct `_item`, with `_position`, and `_reason` if it is none.

    An answer that is no list is a row without position. An empty list gives none. A record
    must have `time`; the `further` times it may lack, but what it has of them must be readable.
    """
    marked = _listed(raw, body, names, lone_allowed)
    rows = marked.select("*", F.posexplode_outer("_texts").alias("_position", "_entry")).where(
        F.col("_failure").isNotNull() | F.col("_position").isNotNull()
    )
    record = F.when(F.ltrim(F.col("_entry")).startswith("{"), F.from_json("_entry", f"struct<{item}>"))
    bad = F.when(F.col("_item").isNull(), "not a record")
    if time is not None:
        bad = bad.when(F.col(f"_item.{time}").isNull(), f"no readable {time}")
    for name in further:
        # Most entries have no such name, which is found without parsing; an escape may spell it.
        spelled = F.col("_entry").contains(name) | F.col("_entry").contains("\\")
        told = spelled & F.get_json_object("_entry", f"$.{name}").isNotNull()
        bad = bad.when(F.col(f"_item.{name}").isNull() & told, f"no readable {name}")
    return _once(_once(rows.drop("_texts"), _item=record), _reason=F.coalesce("_failure", bad)).drop("_failure")


def _rows(
    raw: DataFrame, body: str, names: Sequence[str], item: str, lone_allowed: bool, time: str | None = None, further: Sequence[str] = ()
) -> DataFrame:
    """The sound entries of all lists."""
    items = _items(raw, body, names, item, lone_allowed, time, further)
    return items.where(F.col("_reason").isNull()).drop(body, "_position", "_entry", "_reason")


def answer_rejects(raw: DataFrame, names: Sequence[str], body: str = "body", lone_allowed: bool = False) -> DataFrame:
    """Answers that carry no list, with `reject_reason`."""
    read = _listed(raw, body, names, lone_allowed).drop("_texts").withColumnRenamed("_failure", "reject_reason")
    return read.where(F.col("reject_reason").isNotNull())


def rejects(
    raw: DataFrame,
    names: Sequence[str],
    item: str,
    body: str = "body",
    lone_allowed: bool = False,
    time: str | None = None,
    further: Sequence[str] = (),
) -> DataFrame:
    """All that an ingest leaves out: answers without a list, and entries of lists.

    Each with its answer, `reject_reason`, and for an entry its `position` and text
    `entry`. An entry is left out if it is no record, lacks a readable `time`, or has an
    unreadable one of the `further` times.
    """
    items = _items(raw, body, names, item, lone_allowed, time, further).where(F.col("_reason").isNotNull())
    return items.select(*raw.columns, *_reject())


def _reject() -> list[Column]:
    return [F.col("_reason").alias("reject_reason"), F.col("_position").alias("position"), F.col("_entry").alias("entry")]


@dataclass(frozen=True)
class Parsed:
    """Both sides of an ingest, from answers that were parsed once."""

    rows: DataFrame
    rejects: DataFrame
    #: How many `rows` and `rejects` were written.
    counts: dict[str, int]


def parse_once(raw: DataFrame, items: DataFrame, rows: Callable[[DataFrame], DataFrame], purpose: str, body: str = "body", wanted: Column | None = None) -> Parsed:
    """Write sound entries and rejects side by side, by outcome, and read each from its own folder.

    `rows` makes typed rows of the sound entries, of which `wanted` may leave out some.
    Only rejects keep the text of their answer.
    """
    spark, path = raw.sparkSession, shared_dir(raw.sparkSession, purpose)
    sound = F.col("_reason").isNull()
    kept = items if wanted is None else items.where(~sound | wanted)
    told = Observation(purpose)
    split = kept.withColumns(
        {
            "outcome": F.when(sound, "rows").otherwise("rejects"),
            body: F.when(~sound, F.col(body)),
            "_entry": F.when(~sound, F.col("_entry")),
            "_item": F.when(sound, F.col("_item")),
        }
    ).observe(told, F.count_if(sound).alias("rows"), F.count_if(~sound).alias("rejects"))
    split.write.partitionBy("outcome").parquet(path)
    stored = spark.read.schema(split.schema).parquet(path)
    sides = {side: stored.where(F.col("outcome") == side).drop("outcome") for side in ("rows", "rejects")}
    return Parsed(rows(sides["rows"].drop(body, "_position", "_entry", "_reason")), sides["rejects"].select(*raw.columns, *_reject()), dict(told.get))


_OBSERVATIONS = (["observation", "observations"], OBSERVATION, True, "valid_time_gmt")
_SCHEDULES = (["scheduledFlights"], SCHEDULED_FLIGHT, False, "departureTime", ("arrivalTime",))
_FORECASTS = (["forecasts"], FORECAST, False, "fcst_valid")
_STATUSES = (["flightStatuses"], FLIGHT_STATUS, False, None)


def observation_rejects(raw: DataFrame, body: str = "body") -> DataFrame:
    return rejects(raw, ["observation", "observations"], OBSERVATION, body, lone_allowed=True, time="valid_time_gmt")


def schedule_rejects(raw: DataFrame, body: str = "body") -> DataFrame:
    return rejects(raw, ["scheduledFlights"], SCHEDULED_FLIGHT, body, time="departureTime", further=("arrivalTime",))


def forecast_rejects(raw: DataFrame, body: str = "body") -> DataFrame:
    return rejects(raw, ["forecasts"], FORECAST, body, time="fcst_valid")


def status_rejects(raw: DataFrame, body: str = "body") -> DataFrame:
    return rejects(raw, ["flightStatuses"], FLIGHT_STATUS, body)


def _recent_observations(rows: DataFrame, hours: int, station: str, fetched_at: str) -> DataFrame:
    at = utc_instant(F.col("_item.valid_time_gmt") * 1_000_000)
    recent = rows.withColumn("valid_time", at).where(
        (F.col("valid_time") <= F.col(fetched_at))
        & (F.col("valid_time") >= F.timestamp_add("HOUR", F.lit(-hours), F.col(fetched_at)).cast("timestamp_ntz"))
    )
    return recent.select(station, "valid_time", "_item.*")


def ingest_observations(
    raw: DataFrame, hours: int = 23, station: str = "fs", fetched_at: str = "fetched_at", body: str = "body"
) -> DataFrame:
    """Observations of landed answers, from the last `hours` before each fetch.

    The list is under `observation` or `observations`; a lone record is a list of one.
    """
    return _recent_observations(_rows(raw, body, *_OBSERVATIONS), hours, station, fetched_at)


def split_observations(
    raw: DataFrame, hours: int = 23, station: str = "fs", fetched_at: str = "fetched_at", body: str = "body"
) -> Parsed:
    """`ingest_observations` and `observation_rejects` from one parse."""
    items = _items(raw, body, *_OBSERVATIONS)
    return parse_once(raw, items, lambda rows: _recent_observations(rows, hours, station, fetched_at), "observations", body)


def dedupe_observations(observations: DataFrame, keys: Sequence[str] = ("fs", "valid_time"), tie: str | None = None) -> DataFrame:
    """One observation per airport and instant: the one with the smallest `tie`; of those equal in it, or without one, by its hash."""
    return first_per_key(observations, keys, [] if tie is None else [tie])


def ingest_schedules(raw: DataFrame, parts: Sequence[str] = ("year", "month", "day", "hour"), body: str = "body") -> DataFrame:
    """Scheduled flights of landed answers, each with the hour it was fetched for."""
    return _rows(raw, body, *_SCHEDULES).select("_item.*", F.struct(*parts).alias("date"))


def split_schedules(raw: DataFrame, parts: Sequence[str] = ("year", "month", "day", "hour"), body: str = "body") -> Parsed:
    """`ingest_schedules` and `schedule_rejects` from one parse."""
    return parse_once(raw, _items(raw, body, *_SCHEDULES), lambda rows: rows.select("_item.*", F.struct(*parts).alias("date")), "schedules", body)


def _instants(first: str) -> list[Column]:
    names = ("scheduledGateDeparture", "actualRunwayDeparture", "actualRunwayArrival")
    return [utc_instant(F.unix_micros(F.col(f"{first}.operationalTimes.{name}.dateUtc"))).alias(name) for name in names]


def split_statuses(raw: DataFrame, keys: Sequence[str], body: str = "body") -> Parsed:
    """`ingest_statuses` and `status_rejects` from one parse. Rejects of all positions count, rows of the first."""
    items = _items(raw, body, *_STATUSES)

    def flattened(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, F.col("_item.status").alias("status"), *_instants("_item"))

    return parse_once(raw, items, flattened, "statuses", body, wanted=F.col("_position") == 0)


def ingest_statuses(raw: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Status answers with their first entry flattened: status and the three instants.

    Only position 0 counts, so nothing is exploded.
    """
    entries = _once(_listed(raw, body, ["flightStatuses"], lone_allowed=False), _entry=F.get("_texts", F.lit(0)))
    first = F.when(F.ltrim("_entry").startswith("{"), F.from_json("_entry", f"struct<{FLIGHT_STATUS}>"))
    return (
        _once(entries.where(F.col("_failure").isNull()), _first=first)
        .where(F.col("_first").isNotNull())
        .select(*keys, F.col("_first.status").alias("status"), *_instants("_first"))
    )


def ingest_list(raw: DataFrame, name: str, item: str, body: str = "body") -> DataFrame:
    """Rows of any answer that is one named list."""
    return _rows(raw, body, [name], item, lone_allowed=False).select("_item.*")


def _forecasts_in_reach(rows: DataFrame, hours: int, station: str, fetched_at: str) -> DataFrame:
    valid = utc_instant(F.col("_item.fcst_valid") * 1_000_000)
    fields = [F.col("_item").getField(name).alias(name) for name in _names(FORECAST) if name != "fcst_valid"]
    return (
        rows.withColumn("_valid", valid)
        .where(F.col("_valid") <= F.timestamp_add("HOUR", F.lit(hours), F.col(fetched_at)).cast("timestamp_ntz"))
        .select(station, F.col(fetched_at).alias("fetched_at"), F.col("_valid").alias("fcst_valid"), *fields)
    )


def ingest_forecasts(
    raw: DataFrame, hours: int = 48, station: str = "fs", fetched_at: str = "fetched_at", body: str = "body"
) -> DataFrame:
    """Forecasts of landed answers, up to `hours` after each fetch, with the instant of the fetch."""
    return _forecasts_in_reach(_rows(raw, body, *_FORECASTS), hours, station, fetched_at)


def split_forecasts(
    raw: DataFrame, hours: int = 48, station: str = "fs", fetched_at: str = "fetched_at", body: str = "body"
) -> Parsed:
    """`ingest_forecasts` and `forecast_rejects` from one parse."""
    return parse_once(raw, _items(raw, body, *_FORECASTS), lambda rows: _forecasts_in_reach(rows, hours, station, fetched_at), "forecasts", body)


def _names(item: str) -> list[str]:
    return [field.strip().split(" ")[0] for field in item.split(",")]


def ingest_appendix(raw: DataFrame, name: str, item: str, key: str, body: str = "body") -> DataFrame:
    """One record per key from a list in the appendix of schedule answers.

    Every answer repeats the records it mentions; they are reduced before the shuffle.
    """
    appendix = raw.select(F.get_json_object(body, "$.appendix").alias(body))
    listed = ingest_list(appendix, name, item, body).where(F.col(key).isNotNull())
    return first_per_key(listed, [key], [c for c in listed.columns if c != key])
