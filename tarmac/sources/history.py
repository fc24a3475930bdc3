"""The history of predictions: flat rows, appended per scoring run, and a log of the runs."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarmac.functions.timecols import clock_time, long_date


def flatten_payload(payload: DataFrame) -> DataFrame:
    """History rows of scored flights."""
    dep, arr = F.col("departureAirportInfo.airportInfo"), F.col("arrivalAirportInfo.airportInfo")
    departure = F.col("flightInfo.departureTime")
    ends = []
    for prefix, airport in (("dep", dep), ("arr", arr)):
        ends += [
            airport["fs"].alias(f"{prefix}AirportFSCode"),
            airport["name"].alias(f"{prefix}AirportName"),
            airport["longitude"].alias(f"{prefix}AirportLong"),
            airport["latitude"].alias(f"{prefix}AirportLat"),
        ]
    return payload.select(
        *ends,
        "prediction",
        F.col("flightInfo.carrierFsCode").alias("carrierFsCode"),
        F.col("flightInfo.flightNumber").alias("flightNumber"),
        long_date(departure).alias("departureDate"),
        clock_time(departure).alias("departureTime"),
        F.trunc(departure, "month").alias("departureMonth"),
    )


_LOG = "run string, number long, version string, partition string, layout string"


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    """The entries of all runs, or None before the first one."""
    try:
        return spark.read.schema(_LOG).json(f"{path}/_runs")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _valid(spark: SparkSession, path: str) -> list[Row]:
    """The entry that counts of each run that has a key, and all entries of runs without one."""
    log = _log(spark, path)
    if log is None:
        return []
    newest = Window.partitionBy("run").orderBy(F.desc("number"), F.desc("version"))
    return log.withColumn("nr", F.row_number().over(newest)).where((F.col("nr") == 1) | F.col("run").isNull()).orderBy("version").collect()


def save_history(rows: DataFrame, path: str, partition: str | None = "departureMonth", run: str | None = None) -> None:
    """Append to the history, creating it when absent. A failed write fails the job.

    Rows are brought together per partition value first, so a run does not leave one
    file per task and value; AQE splits a value that holds too many rows. The default
    partition is a date, the first day of the month, so a range of days reads its own months only.

    Every call writes a folder of its own, and then, as its last step, an entry in the log
    of runs. `load_history` reads the folders that the log names. With `run`, the key of a
    scoring run, the entry takes the place of that run's earlier one: a run that is
    repeated after a failure stores nothing twice, and one that yields less than before
    leaves nothing of it. Rows of both kinds of runs, and of several partitions, share a table.
    """
    spark, version = rows.sparkSession, f"v{uuid.uuid4().hex}"
    keyed = rows.drop("run").withColumn("run", F.lit(run).cast("string"))
    writer = (keyed if partition is None else keyed.hint("rebalance", partition)).write
    if partition is not None:
        writer = writer.partitionBy(partition)
    writer.parquet(f"{path}/version={version}")
    log = _log(spark, path)
    before = None if log is None else log.where(F.col("run").eqNullSafe(F.lit(run).cast("string"))).agg(F.max("number")).first()[0]
    entry = [(run, (before or 0) + 1, version, partition, keyed.schema.json())]
    spark.createDataFrame(entry, _LOG).coalesce(1).write.mode("append").json(f"{path}/_runs")


def load_history(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all runs that count, with column `run` where a run has a key.

    The log has one entry for each run, which the driver reads. Without a declared schema,
    runs with other columns give null for those they lack.
    """
    folders: dict[tuple, list[str]] = {}
    valid = _valid(spark, path)
    for entry in valid:
        folders.setdefault((entry.partition, entry.layout), []).append(f"{path}/version={entry.version}")
    if not folders:
        raise ValueError(f"no history at {path}")
    parts = []
    for (_, layout), of_layout in folders.items():
        stored = StructType.fromJson(json.loads(layout))
        if schema is not None:
            stored = StructType([*(f for f in StructType.fromDDL(schema).fields if f.name != "run"), stored["run"]])
        parts.append(spark.read.schema(stored).option("basePath", path).parquet(*of_layout).drop("version"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows if any(entry.run is not None for entry in valid) else rows.drop("run")


def remove_replaced(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders that no run counts any more, and name them; not while a run is being saved."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {f"version={entry.version}" for entry in _valid(spark, path)}
    stale = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("version=") and s.getPath().getName() not in kept]
    for folder in stale:
        files.delete(folder, True)
    return sorted(folder.getName() for folder in stale)
