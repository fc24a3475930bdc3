"""Airlines and airports: one tagged table and the views on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.sources.landed import ingest_list
from tarmac.sources.schemas import AIRLINE, AIRPORT

AIRLINES, AIRPORTS = "airlines", "airports"


def tag(df: DataFrame, metadata_type: str) -> DataFrame:
    return df.withColumn("metadata_type", F.lit(metadata_type))


def load_airlines(raw: DataFrame, body: str = "body") -> DataFrame:
    return tag(ingest_list(raw, "airlines", AIRLINE, body), AIRLINES)


def load_airports(raw: DataFrame, body: str = "body") -> DataFrame:
    return tag(ingest_list(raw, "airports", AIRPORT, body), AIRPORTS)


def metadata_union(airlines: DataFrame, airports: DataFrame) -> DataFrame:
    return airlines.unionByName(airports, allowMissingColumns=True)


def airports_view(metadata: DataFrame) -> DataFrame:
    return metadata.where((F.col("metadata_type") == AIRPORTS) & F.col("fs").isNotNull()).select("fs", "name")


def airlines_view(metadata: DataFrame, key: str = "fs") -> DataFrame:
    return metadata.where(F.col("metadata_type") == AIRLINES).select(key)


def country_airports_view(metadata: DataFrame, country: str = "US", column: str = "countryCode") -> DataFrame:
    return airports_view(metadata.where(F.col(column) == country))
