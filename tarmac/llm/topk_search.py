"""Exact top-k by inner product: norm buckets, pruned by length or by coordinates.

Vectors are sorted by length into buckets. A query meets a bucket only if its length times
the bucket's largest length reaches the k-th score that the query has from the longest
vectors. In a bucket, the local cosine threshold decides how to prune: a high one bounds
the coordinates a partner may have (coordinate pruning), a lower one cuts the bucket,
which is in order of length, where the lengths no longer suffice (length pruning). What is
left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.arrays import binaries, longs
from tarmac.llm.vectors import dimension, matrix, vectors
from tarmac.session import written

#: Vectors in a bucket, queries in a block, coordinates looked at, and the local cosine
#: threshold from which coordinates are looked at; query blocks in a group, and parts that
#: the buckets of a group are dealt into.
BUCKET, QUERIES, FOCUS, STEEP, GROUP, SALTS = 2048, 256, 4, 0.7, 256, 64

_BLOCK = "block long, top double, ids binary, parts binary"


def whole_parts(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long; what does not fit a long is the nearest long."""
    scaled = np.floor(values * float(scale))
    return np.where(np.abs(scaled) < 2.0**62, scaled, np.sign(scaled) * 2.0**62).astype(np.int64)


def products(left: np.ndarray, right: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer rows; `bound` is the product of the largest lengths.

    Doubles hold them exactly below 2**53, longs below 2**62; larger ones are computed
    with whole numbers of any size and cut to the range of a long.
    """
    if bound < 2.0**52:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0**61:
        return left @ right.T
    exact = left.astype(object) @ right.T.astype(object)
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in row] for row in exact], dtype=np.int64).reshape(exact.shape)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near].astype(np.float64), -scores[near]))[:k]] if len(near) else near


def candidates(query: np.ndarray, length: float, floor: float, unit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places in a bucket, in descending order of length, that may score `floor` or more."""
    if floor == -np.inf or length == 0 or lengths[0] == 0:
        return np.arange(len(lengths))
    near = int(np.searchsorted(-lengths * length, -(floor - 1e-6 * abs(floor)), side="right")) if floor > 0 else len(lengths)
    cosine = floor / (length * lengths[0]) - 1e-9
    if cosine > 1:
        return np.zeros(0, np.int64)
    if near == 0 or cosine < STEEP:
        return np.arange(near)
    direction = query / length
    kept = np.ones(near, dtype=bool)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        middle, reach = direction[f] * cosine, np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - direction[f] ** 2))) + 1e-9
        # The range holds what a unit vector of at least this cosine can have at f.
        low = -1.0 if direction[f] <= -cosine else middle - reach
        high = 1.0 if direction[f] >= cosine else middle + reach
        kept &= (unit[:near, f] >= low) & (unit[:near, f] <= high)
    return np.flatnonzero(kept)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def search_bucket(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """query number, place and score of the best k of this bucket for each query, but below its floor nothing."""
    lengths, query_lengths = _lengths(rows), _lengths(queries)
    order = np.argsort(-lengths, kind="stable")
    rows, ids, lengths = rows[order], ids[order], lengths[order]
    unit = rows / np.maximum(lengths, 1e-300)[:, None]
    bound = float(lengths.max(initial=0) * query_lengths.max(initial=0))
    picked = [candidates(q.astype(np.float64), query_lengths[i], floors[i], unit, lengths) for i, q in enumerate(queries)]
    wide = [i for i, c in enumerate(picked) if 2 * len(c) > len(rows)]
    scored = dict(zip(wide, products(queries[wide], rows, bound), strict=True)) if wide else {}
    for i, near in enumerate(picked):
        if len(near) == 0:
            continue
        scores = scored[i][near] if i in scored else products(queries[i : i + 1], rows[near], bound)[0]
        keep = (ids[near] != query_ids[i]) & (scores >= floors[i])
        near, scores = near[keep], scores[keep]
        top = best(scores, ids[near], k)
        yield i, ids[near[top]], scores[top]


def _to_blocks(dim: int, scale: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, place = 0, TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                rows = whole_parts(matrix(part.column(1), dim), scale)
                top = float(_lengths(rows).max(initial=0))
                ids = np.asarray(part.column(0), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [longs([(place << 32) | count]), pa.array([top]), binaries([ids]), binaries([rows])], ["block", "top", "ids", "parts"]
                )
                count += 1

    return run


def _first_floors(dim: int, scale: int, k: int, longest_ids: np.ndarray, longest: np.ndarray):
    """Queries with the k-th score among the longest vectors, which no result falls below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = whole_parts(matrix(batch.column(1), dim), scale)
            ids = np.asarray(batch.column(0), dtype=np.int64)
            floors = np.full(len(ids), -np.inf)
            if len(longest) and len(ids):
                bound = float(_lengths(rows).max() * _lengths(longest).max())
                for start in range(0, len(ids), QUERIES):
                    scores = products(rows[start : start + QUERIES], longest, bound)
                    for i, row in enumerate(scores, start):
                        row = row[longest_ids != ids[i]]
                        if len(row) >= k:
                            floors[i] = np.partition(row, len(row) - k)[len(row) - k]
            for start in range(0, len(ids), QUERIES):
                part = slice(start, start + QUERIES)
                place = (TaskContext.get().partitionId() << 32) | start
                yield pa.RecordBatch.from_arrays(
                    [longs([place]), binaries([ids[part]]), binaries([rows[part]]), binaries([floors[part]]), pa.array([float(_lengths(rows[part]).max(initial=0))]), pa.array([float(floors[part].min(initial=np.inf))])],
                    ["qblock", "qids", "qparts", "floors", "qtop", "least"],
                )

    return run


def _cells(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                ids, rows = np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["parts"], np.int64).reshape(-1, dim)
                qids, queries = np.frombuffer(cell["qids"], np.int64), np.frombuffer(cell["qparts"], np.int64).reshape(-1, dim)
                found = list(search_bucket(queries, qids, np.frombuffer(cell["floors"], np.float64), rows, ids, k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [longs(np.concatenate([np.full(len(v), qids[i]) for i, v, _ in found])), longs(np.concatenate([v for _, v, _ in found])), longs(np.concatenate([s for _, _, s in found]))],
                        ["query_id", "vec_id", "score"],
                    )

    return run


def top_k(embeddings: DataFrame, is_query: str, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best partners of each query by integer inner product.

    `is_query` is an SQL condition on vec_id. All rows but the query's own id are
    candidates; ties go to the smaller id; a query with fewer partners has fewer rows.
    Vectors that are null or hold null or non-finite components, and rows without an id,
    take no part. Shorter vectors count as filled up with zeros. Rows that repeat an id
    are one candidate each, and one query. An empty table gives no rows. Extra columns
    are ignored.

    Only the `BUCKET` longest vectors go to the driver, and from there to the queries;
    that number does not grow; of each group of `GROUP` query blocks it gets two numbers. A
    vector met by a third of all rows fills several buckets, because buckets are ranges of
    (length, id). Where all vectors have one length, no bucket can be left out: every query
    block meets every bucket, and only coordinates prune.
    """
    spark = embeddings.sparkSession
    rows = written(vectors(embeddings, id_column, vector_column), "topk")
    dim = dimension(rows)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x * F.lit(float(scale))).cast("double") * F.floor(x * F.lit(float(scale))).cast("double"))
    measured = rows.withColumn("length", length)
    longest = measured.orderBy(F.desc("length"), "vec_id").limit(BUCKET).select("vec_id", "embedding").toArrow()
    longest_ids = np.asarray(longest.column(0), dtype=np.int64)
    longest_rows = whole_parts(matrix(longest.column(1).combine_chunks(), dim), scale) if longest.num_rows else np.zeros((0, dim), np.int64)

    ranged = measured.repartitionByRange(F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id")
    blocks = written(ranged.select("vec_id", "embedding").mapInArrow(_to_blocks(dim, scale, BUCKET), _BLOCK), "topk-buckets")
    queries = rows.where(is_query).dropDuplicates(["vec_id"])
    qblocks = written(
        queries.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(
            _first_floors(dim, scale, k, longest_ids, longest_rows), "qblock long, qids binary, qparts binary, floors binary, qtop double, least double"
        ),
        "topk-queries",
    )
    # Bucket and query block meet under (group of query blocks, salt), so that few query blocks
    # still make many tasks. A bucket goes to a group only if its largest length can matter there.
    groups = max(1, -(-qblocks.count() // GROUP))
    grouped = qblocks.withColumn("grp", F.pmod(F.xxhash64("qblock"), F.lit(groups)).cast("int"))
    reach = grouped.groupBy("grp").agg(F.max("qtop").alias("qtop"), F.min("least").alias("least")).collect()
    salts = max(1, min(SALTS, blocks.count()))
    salted_queries = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    told = [F.struct(F.lit(r.grp).alias("grp"), F.lit(r.qtop).alias("qtop"), F.lit(r.least).alias("least")) for r in reach]
    every = F.array(*told) if told else F.array().cast("array<struct<grp:int,qtop:double,least:double>>")
    near = F.filter(every, lambda g: F.col("top") * g["qtop"] * 1.000001 >= g["least"])
    salted_blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).withColumn("grp", F.explode(F.transform(near, lambda g: g["grp"])))
    # Both sides grow with the table: they are shuffled and merged, neither is sent to all.
    cells = salted_blocks.hint("merge").join(salted_queries.hint("merge"), ["grp", "salt"]).where("top * qtop * 1.000001 >= least")
    found = cells.select("ids", "parts", "qids", "qparts", "floors").mapInArrow(_cells(dim, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
