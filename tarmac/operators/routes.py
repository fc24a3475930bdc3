"""The route graph of the prediction history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.projections import clean_node, endpoints, on_route


def route_links(history: DataFrame, dep: str = "dep", arr: str = "arr") -> DataFrame:
    """The ends of each stored flight as link ends: `src` and `dst`."""
    return history.select(F.col(arr).alias("dst"), F.col(dep).alias("src"))


def route_counts(links: DataFrame) -> DataFrame:
    """Flights per link. Rows without a source count 0."""
    return links.groupBy("src", "dst").agg(F.count("src").alias("count"))


def route_badge(
    history: DataFrame,
    dep_code: str | None = None,
    arr_code: str | None = None,
    keys: Sequence[str] = ("carrierFsCode", "flightNumber", "departureDate", "departureTime", "depAirportName", "arrAirportName"),
    dep: str = "depAirportFSCode",
    arr: str = "arrAirportFSCode",
) -> DataFrame:
    """How often each flight was asked for, on one route or, without codes, per route."""
    if (dep_code is None) != (arr_code is None):
        raise ValueError("give both airport codes or none")
    if dep_code is not None:
        return on_route(history, dep, arr, dep_code, arr_code).groupBy(*keys).agg(F.count(F.lit(1)).alias("passengers"))
    return history.groupBy(dep, arr, *keys).agg(F.count(F.lit(1)).alias("passengers"))


def airport_nodes(history: DataFrame, dep: dict[str, str], arr: dict[str, str]) -> DataFrame:
    """Distinct airports over both ends. `dep` and `arr` map code, name, latitude, longitude to columns."""
    return clean_node(endpoints(history, dep, arr).distinct())


def node_json(nodes: DataFrame) -> DataFrame:
    node = F.struct(F.col("code").alias("id"), "name", "latitude", "longitude")
    return nodes.select(F.col("code").alias("id"), F.to_json(node).alias("node"))


def airport_degree(links: DataFrame) -> DataFrame:
    """Distinct links at each airport; a link to itself counts twice."""
    distinct = links.select("src", "dst").distinct()
    return endpoints(distinct, {"airport": "src"}, {"airport": "dst"}).groupBy("airport").agg(
        F.count(F.lit(1)).alias("degree")
    )


def adjacency_list(links: DataFrame) -> DataFrame:
    """Destinations of each origin, in order.

    Links are made distinct first, so a row holds at most one entry per airport.
    """
    distinct = links.select("src", "dst").distinct()
    return distinct.groupBy("src").agg(
        F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("destinations"), F.count("dst").alias("links")
    )


def origin_flag(nodes: DataFrame, links: DataFrame, code: str = "code") -> DataFrame:
    """Whether each airport has a link that starts there."""
    origins = links.select(F.col("src").alias("_src")).distinct()
    return (
        nodes.join(origins, F.col(code) == F.col("_src"), "left")
        .withColumn("is_origin", F.col("_src").isNotNull())
        .drop("_src")
    )


def rank_airports(degrees: DataFrame) -> DataFrame:
    """Airports by degree, largest first, with their rank.

    The input has one row per airport code, a few ten thousand at most.
    """
    order = [F.col("degree").desc(), F.col("airport").asc()]
    return degrees.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")
