"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines.

Normalised vectors get `width`-wide quantised random projections, `bits` of them for each
of several tables; vectors that agree in all of a table share its bucket. In a bucket all
cosines are computed in double precision as block products, nothing is emitted for a pair:
a bucket gives link counts and one edge for each vector of a linked group. A pair that
shares buckets of several tables counts in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.arrays import binaries, longs, mix
from tarmac.llm.common import components
from tarmac.llm.vectors import dimension, matrix, vectors
from tarmac.session import written

#: Vectors of unrelated content that a bucket of a small table is meant to hold, and how
#: many for each square root of a larger table's rows: every table costs a copy of all
#: vectors, and larger buckets need fewer tables. Width of a projection's cells, the share
#: of pairs at exactly the threshold that must be found, and the vectors of a bucket that
#: one task compares at once.
EXPECTED, PER_ROOT, WIDTH, RECALL, BLOCK = 64, 4, 2.0, 0.99, 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at this distance fall into one cell of a projection."""
    t = width / distance
    normal = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def tables_for(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Projections in a table and number of tables.

    Projections grow with the logarithm of the rows, so that a bucket of unrelated
    (orthogonal) vectors grows with the square root of the rows only; tables follow from
    the recall at the threshold.
    """
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    expected = max(EXPECTED, PER_ROOT * math.sqrt(rows))
    bits = max(1, math.ceil(math.log(max(2.0, rows / expected)) / -math.log(far)))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**bits)))


def units_of(rows: np.ndarray) -> np.ndarray:
    """The rows with length one, in double precision; none may be zero."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, initial=0)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _hashed(dim: int, bits: int, tables: int, seed: int, kind: type = np.float64):
    """Rows for every table: bucket, id, how many vectors are equal to it, the vector as it came, all its bucket numbers."""
    rng = np.random.default_rng(seed)
    directions, shifts = rng.standard_normal((dim, bits * tables)), rng.uniform(0, WIDTH, bits * tables)
    multipliers = rng.integers(1, 1 << 62, bits * tables, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                ids, rows = np.asarray(part.column(0), np.int64), matrix(part.column(1), dim)
                times = np.asarray(part.column(2), np.int64) if part.num_columns > 2 else np.ones(len(ids), np.int64)
                some = np.abs(rows).max(axis=1, initial=0) > 0
                ids, rows, times = ids[some], rows[some], times[some]
                cells = np.floor((units_of(rows) @ directions + shifts) / WIDTH).astype(np.int64).astype(np.uint64)
                buckets = mix((cells * multipliers).reshape(len(ids), tables, bits).sum(axis=2, dtype=np.uint64))
                packed, coded = binaries(list(rows.astype(kind))), binaries(list(buckets))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), t, np.int32)), longs(buckets[:, t].view(np.int64)), longs(ids), longs(times), packed, coded],
                        ["t", "bucket", "vec_id", "times", "vector", "codes"],
                    )

    return run


def link_groups(linked: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place, for a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        reached = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, reached)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(table: int, left: tuple, right: tuple | None, threshold: float):
    """Link counts and edges of two blocks of a bucket, or of one block with itself.

    A block is ids, unit vectors, bucket numbers and, where equal vectors are one, how
    many each stands for.
    """
    ids, units, codes, times = left if len(left) == 4 else (*left, np.ones(len(left[0]), np.int64))
    other = right or left
    other_ids, other_units, other_codes, other_times = other if len(other) == 4 else (*other, np.ones(len(other[0]), np.int64))
    linked = units @ other_units.T >= threshold
    if right is None:
        np.fill_diagonal(linked, False)
    if table:
        rows, columns = np.nonzero(linked)
        for start in range(0, len(rows), 1 << 18):
            r, c = rows[start : start + (1 << 18)], columns[start : start + (1 << 18)]
            linked[r, c] = ~(codes[r, :table] == other_codes[c, :table]).any(axis=1)
    if right is None:
        touched = linked.any(axis=1)
        group = link_groups(linked)
        edges = np.stack([ids, ids[group]], axis=1)[touched]
        return ids[touched], (linked @ times)[touched], edges
    whole = np.zeros((len(ids) + len(other_ids),) * 2, dtype=bool)
    whole[: len(ids), len(ids) :] = linked
    whole[len(ids) :, : len(ids)] = linked.T
    both, degrees = np.concatenate([ids, other_ids]), whole @ np.concatenate([times, other_times])
    edges = np.stack([both, both[link_groups(whole)]], axis=1)
    return both[degrees > 0], degrees[degrees > 0], edges[degrees > 0]


def _linked(dim: int, tables: int, threshold: float, kind: type = np.float64):
    """For each cell (a bucket, or two blocks of a large one): vec_id, partner counts, an edge.

    Cells arrive one after the other; what a task holds is one cell of at most two blocks.
    """

    def results(cell: list[tuple]) -> pa.RecordBatch | None:
        keys, parts = cell[0][0], [np.concatenate(x) for x in zip(*(c[1] for c in cell), strict=True)]
        sides, ids, rows, codes, times = parts
        table, i, j, units = keys[0], keys[2], keys[3], units_of(rows)
        if i == j:
            out = compare(table, (ids, units, codes, times), None, threshold)
        else:
            first = sides == i
            out = compare(table, *((ids[x], units[x], codes[x], times[x]) for x in (first, ~first)), threshold)
        if len(out[0]) == 0:
            return None
        return pa.RecordBatch.from_arrays([longs(out[0]), longs(out[1]), longs(out[2][:, 1])], ["vec_id", "links", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            t, bucket, i, j, side, ids, times = (np.asarray(batch.column(c), np.int64) for c in range(7))
            rows = np.frombuffer(b"".join(batch.column(7).to_pylist()), kind).reshape(-1, dim)
            codes = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(-1, tables)
            keys = np.stack([t, bucket, i, j], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                key = tuple(keys[s])
                if held and held[0][0] != key:
                    if (out := results(held)) is not None:
                        yield out
                    held = []
                held.append((key, (side[s:e], ids[s:e], rows[s:e], codes[s:e], times[s:e])))
        if held and (out := results(held)) is not None:
            yield out

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, recall: float = RECALL, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of the table.

    Two vectors link when a common bucket shows them and their cosine, in double
    precision, is at least `threshold` (above 0); `recall` is the share of pairs at exactly
    the threshold that some bucket shows, closer pairs are found more surely. component_id
    is the smallest id reachable by links; kept marks the vectors that are their own.
    Vectors that are null, zero, or hold null or non-finite components link with nothing.
    Shorter vectors count as filled up with zeros. Rows that repeat an id are taken as one
    vector, the first in the order of their components; a null id gives a row with null
    component_id and kept false. An empty table gives no rows. Extra columns are ignored.

    Equal vectors link, and are one before anything is compared: a group of copies costs a
    row. A bucket of more than `BLOCK` vectors is dealt out as pairs of blocks, so one task
    never holds more than two blocks, however many rows share a bucket.
    """
    every = embeddings.select(F.col(id_column).cast("long").alias("vec_id"))
    rows = vectors(embeddings, id_column, vector_column).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # Two 64-bit hashes stand for a vector.
    marks = [F.xxhash64("embedding").alias("m1"), F.xxhash64("embedding", F.lit(1)).alias("m2")]
    rows = written(rows.select("vec_id", "embedding", *marks), "near-vectors")
    dim, kind = dimension(rows), np.float32 if "array<float>" in dict(embeddings.dtypes)[vector_column] else np.float64
    alike = rows.groupBy("m1", "m2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("times"))
    alike = written(alike, "near-equal")
    firsts = rows.select("vec_id", "embedding").join(alike.select(F.col("first").alias("vec_id"), "times"), "vec_id")
    bits, tables = tables_for(alike.count(), threshold, recall)
    hashed = firsts.mapInArrow(_hashed(dim, bits, tables, seed, kind), "t int, bucket long, vec_id long, times long, vector binary, codes binary")
    hashed = written(hashed, "near-hashed")
    sizes = hashed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = hashed.join(sizes, ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    sized = sized.withColumn("side", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = sized.withColumn("other", partner).select(
        "t", "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "vec_id", "times", "vector", "codes"
    )
    grouped = cells.repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j")
    found = written(grouped.mapInArrow(_linked(dim, tables, threshold, kind), "vec_id long, links long, group long"), "near-links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("group").alias("b"))).withColumnRenamed("node", "first")
    # What the first of equal vectors has found holds for all of them; a vector without length has no equal.
    zero = F.forall("embedding", lambda x: x == 0)
    members = rows.select("vec_id", "m1", "m2", zero.alias("zero")).join(alike, ["m1", "m2"]).where("not zero")
    told = (
        members.select("vec_id", "first", "times")
        .join(counts.withColumnRenamed("vec_id", "first"), "first", "left")
        .join(roots, "first", "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "first").alias("root"))
    )
    root = F.coalesce("root", "vec_id")
    return every.join(told, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(False)).alias("kept")
    )
