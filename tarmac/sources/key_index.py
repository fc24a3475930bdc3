"""Which files of a growing table may hold given keys.

Beside the files of a table, in its folder `_keys` where readers of the table do not look,
lie the smallest and largest keys of each file and 64-bit digests of all its keys. A run
that adds rows asks for the files whose range of keys meets its own, reads the digests of
these files only, and opens the files in which a digest is found. A digest that is found by
chance opens a file in vain and changes nothing. A file that is not in the index yet, for a
run was lost before it could write it, is opened always and indexed by the next run.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGESTS = "file string, digest long, grp string"


def digest(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def plain_name(file: str) -> str:
    """A file's path in one spelling: Spark gives it encoded or not, with one slash after the scheme or three."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(file))


def spelled_plainly(file: str) -> Column:
    """`plain_name` of a column."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(file), F.lit("+"), F.lit("%2B"))), r"^(\w+):/+", "$1:/")


def files_of(df: DataFrame) -> dict[str, str]:
    """The files a table consists of, by plain name."""
    return {plain_name(f): f for f in df.inputFiles()}


def _spelling(df: DataFrame, keys: Sequence[str]) -> str:
    """Names and types of the keys; digests of other types are no use."""
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def _ranges(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Smallest and largest value of each key, and how many are null."""
    return [c for i, k in enumerate(keys) for c in (F.min(k).alias(f"low_{i}"), F.max(k).alias(f"high_{i}"), F.count_if(F.col(k).isNull()).alias(f"nulls_{i}"))]


def _entries(spark: SparkSession, path: str, df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The index entries that hold for these keys, one for each indexed file."""
    kinds = dict(df.dtypes)
    ranges = "".join(f", low_{i} {kinds[k]}, high_{i} {kinds[k]}, nulls_{i} long" for i, k in enumerate(keys))
    name = _folder(df, keys)
    try:
        return spark.read.schema(f"file string, grp string{ranges}").parquet(f"{path}/_keys/{name}/files")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _folder(df: DataFrame, keys: Sequence[str]) -> str:
    """An index is of certain keys and types; others have an index of their own."""
    return f"keys-{uuid.uuid5(uuid.NAMESPACE_OID, _spelling(df, keys)).hex}"


def candidate_files(batch: DataFrame, stored: DataFrame, path: str, keys: Sequence[str]) -> list[str]:
    """Files of the stored table that may hold a key of the batch.

    The driver gets one name for each file of the table, as Spark's own listing does, and
    of the batch the range of its keys.
    """
    spark, listed = batch.sparkSession, files_of(stored)
    entries = _entries(spark, path, batch, keys)
    if entries is None:
        return sorted(listed.values())
    known = {plain_name(r.file) for r in entries.select("file").collect()}
    wanted = [f for name, f in listed.items() if name not in known]
    span = batch.agg(*_ranges(batch, keys)).first()
    meets = [
        ((F.col(f"low_{i}") <= F.lit(span[f"high_{i}"])) & (F.col(f"high_{i}") >= F.lit(span[f"low_{i}"]))
         if span[f"low_{i}"] is not None else F.lit(False))
        | (F.lit(span[f"nulls_{i}"] > 0) & (F.col(f"nulls_{i}") > 0))
        for i in range(len(keys))
    ]
    near = entries.where(F.coalesce(reduce(and_, meets), F.lit(False))).select("file", "grp").collect()
    if near:
        groups = sorted({r.grp for r in near})
        files = spark.createDataFrame([(plain_name(r.file),) for r in near], "plain string")
        root = f"{path}/_keys/{_folder(batch, keys)}/digests"
        digests = spark.read.schema(_DIGESTS).option("basePath", root).parquet(*[f"{root}/grp={g}" for g in groups])
        asked = batch.select(digest(keys).alias("digest")).distinct()
        found = digests.withColumn("plain", spelled_plainly("file")).join(files, "plain", "left_semi").join(asked, "digest", "left_semi").select("file").distinct()
        wanted += [listed[name] for r in found.collect() if (name := plain_name(r.file)) in listed]
    return sorted(wanted)


def index_files(stored: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Index the files of the table that are not indexed yet; gives their number.

    Digests are written before the entries that name them, so a lost run leaves files
    without entry and never an entry without digests.
    """
    spark, listed = stored.sparkSession, files_of(stored)
    entries = _entries(spark, path, stored, keys)
    known = set() if entries is None else {plain_name(r.file) for r in entries.select("file").collect()}
    new = sorted(f for name, f in listed.items() if name not in known)
    if not new:
        return 0
    group, root = uuid.uuid4().hex, f"{path}/_keys/{_folder(stored, keys)}"
    rows = read_files(stored, path, new).select(*keys, F.col("_metadata.file_path").alias("file"))
    rows.select("file", digest(keys).alias("digest")).write.parquet(f"{root}/digests/grp={group}")
    ranges = rows.groupBy("file").agg(*_ranges(rows, keys))
    # A file without rows has an entry as well, that meets no keys.
    every = spark.createDataFrame([(f,) for f in new], "listed string").withColumn("plain", spelled_plainly("listed"))
    known_ranges = ranges.withColumn("plain", spelled_plainly("file")).drop("file")
    entry = every.join(known_ranges, "plain", "left").drop("plain").withColumnRenamed("listed", "file").withColumn("grp", F.lit(group))
    entry.write.mode("append").parquet(f"{root}/files")
    return len(new)


def read_files(stored: DataFrame, path: str, files: Sequence[str]) -> DataFrame:
    """Only these files of the table, named as Spark names the files it reads."""
    return stored.sparkSession.read.schema(stored.schema).option("basePath", path).parquet(*[unquote(f) for f in files])
