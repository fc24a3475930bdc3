"""Batches of documents that ask for what all documents together know about their hashes.

Billions of (hash, document) rows would be shuffled one by one. Instead a task cuts what
it reads into batches, keeps each batch's own data as one row (its body), and asks every
bucket, which is a range of hashes, about the batch's distinct hashes in one row. A bucket
sees one row for each batch, merges them and answers each batch in one row. A hash that
occurs in a third of all documents is asked for once a batch, so no bucket grows with the
occurrences of a hash. Bodies and answers meet by batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.arrays import give_back, portions
from tarmac.session import shared_dir

#: Text bytes and documents of a batch, text bytes for which one bucket is made, and bytes of
#: a row group of the tables of bodies, questions and answers.
BATCH, DOCUMENTS, BUCKET, ROW_GROUP = 8 << 20, 8192, 16 << 20, 8 << 20

BODY, ASK = 0, 1
SCHEMA = "kind int, batch long, bucket int, payload binary"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder, in small row groups: a row has some MB, and tasks hold a whole group."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for table in tables:
        spark, files = table.sparkSession, table.inputFiles()
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the table that they were made for is written: what follows reads the table."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays in a compressed row; the bytes of numbers are put together by their place."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    planes = [(a.dtype.str, len(a), squeeze(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b"") for a in arrays]
    return pickle.dumps(planes)


def load(payload: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, planes in pickle.loads(payload):
        raw = zstandard.ZstdDecompressor().decompress(planes) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind))
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending values, which compress better; `sums` undoes it."""
    return np.diff(ascending, prepend=np.zeros(1, ascending.dtype)) if len(ascending) else ascending


def sums(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending 64-bit hashes, and where the last one ends."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]]).astype(np.int64)


def buckets_for(docs: DataFrame, text_column: str = "text") -> int:
    """Buckets that hold about as much for every size of the table."""
    return buckets_of(docs.agg(F.sum(F.octet_length(text_column).cast("long"))).first()[0] or 0)


def buckets_of(size: int) -> int:
    """Buckets for texts of so many bytes."""
    return max(64, -(-size // BUCKET))


def rows_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds, batches, buckets, payloads = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(batches, pa.int64()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], ["kind", "batch", "bucket", "payload"]
    )


def batched(docs: DataFrame, make: Callable, purpose: str, portion: int = 2 << 20, limit: int = BATCH) -> DataFrame:
    """The written table of bodies and questions, SCHEMA.

    `make(parts)` takes the Arrow batches of one batch of documents (column 1 is the text)
    and gives the body and the questions as (bucket, payload). Batch numbers are made in
    the task that reads the documents and are fixed once the table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = documents = 0

        def flush() -> pa.RecordBatch:
            body, questions = make(held)
            number = (place << 32) | count
            return rows_of([(BODY, number, -1, body), *((ASK, number, b, p) for b, p in questions)])

        for batch in batches:
            for part in portions(batch, "text", portion):
                held.append(part)
                size, documents = size + part.column(1).nbytes, documents + part.num_rows
                if size >= limit or documents >= DOCUMENTS:
                    yield flush()
                    held, size, documents, count = [], 0, 0, count + 1
        if held:
            yield flush()
        held.clear()
        give_back()

    return written(docs.mapInArrow(run, SCHEMA), purpose)


def answered(asked: DataFrame, answer: Callable[[list[bytes]], tuple[list[bytes], list[bytes]]], purpose: str) -> DataFrame:
    """The written table of answers: kind ASK with a batch each, and kind BODY, batch -1 for a bucket's own results.

    `answer` takes all questions of a bucket, in ascending order of their batches, and
    gives the answers in the same order, and further rows of the bucket's own. An empty
    answer is left out.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        batches, payloads = table.column("batch").to_pylist(), table.column("payload").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        answers, own = answer(payloads)
        rows = [(ASK, b, bucket, p) for b, p in zip(batches, answers, strict=True) if p] + [(BODY, -1, bucket, p) for p in own]
        give_back()
        return pa.Table.from_batches([rows_of(rows)] if rows else [], rows_of([(ASK, 0, 0, b"")]).schema)

    grouped = asked.where(F.col("kind") == ASK).groupBy("bucket")
    return written(grouped.applyInArrow(run, SCHEMA), purpose)


def told(bodies: DataFrame, answers: DataFrame, tell: Callable[[bytes, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Rows that `tell` makes of each body and the answers to its batch by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        rows = tell(left.column("payload")[0].as_py(), replies)
        give_back()
        return rows

    body = bodies.where(F.col("kind") == BODY).select("batch", "payload")
    reply = answers.where(F.col("kind") == ASK).select("batch", "bucket", "payload")
    return body.groupBy("batch").cogroup(reply.groupBy("batch")).applyInArrow(run, schema)


def asked_again(bodies: DataFrame, answers: DataFrame, tell: Callable[[bytes, dict[int, bytes]], tuple[bytes, list[tuple[int, bytes]]] | None], purpose: str) -> DataFrame:
    """The written table of new bodies and questions, SCHEMA, that `tell` makes of each body and its answers.

    Batches keep their numbers; one for which `tell` gives None takes no further part.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        number, told = left.column("batch")[0].as_py(), tell(left.column("payload")[0].as_py(), replies)
        rows = [] if told is None else [(BODY, number, -1, told[0]), *((ASK, number, b, p) for b, p in told[1])]
        give_back()
        return pa.Table.from_batches([rows_of(rows)] if rows else [], rows_of([(ASK, 0, 0, b"")]).schema)

    body = bodies.where(F.col("kind") == BODY).select("batch", "payload")
    reply = answers.where(F.col("kind") == ASK).select("batch", "bucket", "payload")
    return written(body.groupBy("batch").cogroup(reply.groupBy("batch")).applyInArrow(run, SCHEMA), purpose)
