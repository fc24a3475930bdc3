"""Hard negatives of anchors by a vertical scan of embeddings.

A block of candidates is stored by dimension, with each dimension's least and largest
value. An anchor reads a block's dimensions in descending order of its own magnitudes and
sums the products. What the dimensions still unread can add lies between the sums of the
products with those least and largest values, so a candidate whose sum can no longer reach
what the anchor asks for leaves the candidate bitmap before most dimensions are read. The
first scan finds the best rows of the anchor's label, its positives; each positive opens a
window of scores, and a second scan finds the best rows of other labels in each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.arrays import binaries, longs
from tarmac.llm.topk_search import whole_parts
from tarmac.llm.vectors import dimension, matrix, sound
from tarmac.session import written

#: Candidates in a block, anchors in a block, dimensions read between two looks at the
#: bitmap, and parts that the candidates of a block of anchors are dealt into at most.
BLOCK, ANCHORS, STEP, SLICES = 4096, 4096, 8, 16

ANCHOR, POSITIVE, CANDIDATES = 0, 1, 2
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_BLOCKS = "block long, low long, high long, ids binary, labels binary, parts binary"
_KEYS = ("ablock", "slice", "kind")


def number_kind(largest: float, dim: int) -> type:
    """The type in which inner products of whole numbers up to `largest` are exact."""
    bound = largest * largest * dim
    return np.float64 if bound < 2.0**52 else np.int64 if bound < 2.0**61 else object


def vertical_scan(anchor: np.ndarray, columns: np.ndarray, lows: np.ndarray, highs: np.ndarray, places: np.ndarray, floor, ceiling) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block, and their inner products, that are from `floor` to `ceiling`.

    `columns` has a row for each dimension; `places` are the candidates to start with.
    """
    if anchor.dtype == object:
        # Sums beyond a long are cut to its range in the end.
        floor, ceiling = (-np.inf if floor <= LEAST else floor), (np.inf if ceiling >= MOST else ceiling)
    order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
    ends = np.stack([anchor * lows, anchor * highs])[:, order]
    # What the dimensions from each place of the order on add at most and at least.
    most, least = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.max(axis=0), ends.min(axis=0)))
    if most[0] < floor or least[0] > ceiling:
        return places[:0], anchor[:0]
    sums, whole = np.zeros(len(places), anchor.dtype), len(places) == columns.shape[1]
    for start in range(0, len(order), STEP):
        read = order[start : start + STEP]
        rows = columns[read]
        sums = sums + anchor[read] @ (rows if whole else rows[:, places])
        done = min(start + STEP, len(order))
        alive = (sums >= floor - most[done]) & (sums <= ceiling - least[done])
        if not alive.all():
            places, sums, whole = places[alive], sums[alive], False
            if len(places) == 0:
                break
    return places, sums if sums.dtype != object else np.clip(sums, LEAST, MOST)


class Best:
    """The k best (score, id) seen, in descending order of score, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    def floor(self):
        """No row below this score can still be among them."""
        return self.found[-1][0] if len(self.found) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[near]
        pairs = self.found + [(int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        self.found = sorted(pairs, key=lambda p: (-p[0], p[1]))[: self.k]


class Anchors:
    """A block of anchors, and what each has found so far among the candidates of its part."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, kind: type):
        self.ids, self.labels, self.rows, self.kind = ids, labels, rows.astype(kind), kind
        self.windows: dict[int, list[tuple[int, int, int, int, Best]]] = {}

    def candidates(self, ids: np.ndarray, labels: np.ndarray, parts: np.ndarray):
        columns = np.ascontiguousarray(parts.T).astype(self.kind)
        return ids, labels, columns, columns.min(axis=1), columns.max(axis=1)


def block_rows(row: dict, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors of a stored block."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["parts"], kind).reshape(dim, -1).T


def _to_blocks(dim: int, scale: int, kind: str, size: int):
    """Blocks in the order of the rows; the vectors are stored dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([np.asarray(b.column(0), np.int64) for b in held])
            labels = np.concatenate([np.asarray(b.column(1), np.int64) for b in held])
            parts = np.concatenate([whole_parts(matrix(b.column(2), dim), scale).astype(kind) for b in held])
            return pa.RecordBatch.from_arrays(
                [longs([(place << 32) | count]), longs([labels.min()]), longs([labels.max()]), binaries([ids]), binaries([labels]), binaries([np.ascontiguousarray(parts.T)])],
                ["block", "low", "high", "ids", "labels", "parts"],
            )

        rows = 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, size - rows)
                held.append(part)
                rows, start = rows + part.num_rows, start + part.num_rows
                if rows == size:
                    yield flush()
                    held, rows, count = [], 0, count + 1
        if rows:
            yield flush()

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict]]:
    """Rows with their (block of anchors, part), in the order of `_KEYS`."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield (row["ablock"], row["slice"]), row


def _best_of_label(dim: int, stored: str, kind: type, k: int):
    """For each anchor the k best other rows of its label in its part: ablock, anchor, other, score."""

    def results(ablock: int, anchors: Anchors, best: list[Best]) -> pa.RecordBatch:
        rows = [(ablock, int(anchors.ids[i]), o, s) for i, b in enumerate(best) for s, o in b.found]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([longs(list(c)) for c in columns], ["ablock", "anchor_id", "positive_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, anchors, best = None, None, []
        for key, row in _units(batches):
            if row["kind"] == ANCHOR:
                if anchors is not None:
                    yield results(unit[0], anchors, best)
                unit, anchors = key, Anchors(*block_rows(row, dim, stored), kind)
                best = [Best(k) for _ in anchors.ids]
                continue
            ids, labels, columns, lows, highs = anchors.candidates(*block_rows(row, dim, stored))
            for i in np.flatnonzero((anchors.labels >= labels.min()) & (anchors.labels <= labels.max())).tolist():
                bitmap = (labels == anchors.labels[i]) & (ids != anchors.ids[i])
                places, scores = vertical_scan(anchors.rows[i], columns, lows, highs, np.flatnonzero(bitmap), best[i].floor(), np.inf)
                best[i].add(scores, ids[places])
        if anchors is not None:
            yield results(unit[0], anchors, best)

    return run


def _best_in_windows(dim: int, stored: str, kind: type, k: int, low: int, high: int):
    """For each anchor and positive the k best rows of other labels in the window: anchor, positive, its score, other, score."""

    def results(anchors: Anchors) -> pa.RecordBatch:
        rows = [(i, p, ps, o, s) for i, windows in anchors.windows.items() for p, ps, _, _, b in windows for s, o in b.found]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([longs(list(c)) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = None
        for _, row in _units(batches):
            if row["kind"] == ANCHOR:
                if anchors is not None:
                    yield results(anchors)
                anchors = Anchors(*block_rows(row, dim, stored), kind)
                continue
            if row["kind"] == POSITIVE:
                score = row["score"]
                # low * score <= 100 * s <= high * score, in whole numbers.
                window = (row["positive_id"], score, -(-low * score // 100), high * score // 100, Best(k))
                if window[2] <= window[3]:
                    anchors.windows.setdefault(row["anchor_id"], []).append(window)
                continue
            ids, labels, columns, lows, highs = anchors.candidates(*block_rows(row, dim, stored))
            for i, anchor in enumerate(anchors.ids.tolist()):
                windows = anchors.windows.get(anchor)
                if not windows:
                    continue
                floors = [max(w[2], w[4].floor()) for w in windows]
                places, scores = vertical_scan(
                    anchors.rows[i], columns, lows, highs, np.flatnonzero(labels != anchors.labels[i]), min(floors), max(w[3] for w in windows)
                )
                for (_, _, _, top, best), floor in zip(windows, floors, strict=True):
                    inside = (scores >= floor) & (scores <= top)
                    best.add(scores[inside], ids[places[inside]])
        if anchors is not None:
            yield results(anchors)

    return run


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is an SQL condition on vec_id. A score is the inner product of
    floor(scale * x) of all components, cut to the range of a long, the higher the better,
    ties to the smaller id. An
    anchor's positives are its `positives` best other rows of the same label, its hard
    negatives for a positive the `negatives` best rows of another label whose score is
    from `low` to `high` hundredths of the positive's; fewer, if there are fewer. An
    anchor without positives, and a positive without negatives, have no rows.

    Labels are whole numbers. Rows with a null id, a null label, a null vector, or any null
    or non-finite component take no part. Shorter vectors count as filled up with zeros.
    Rows that repeat an id are taken as one, the one with the smallest label and
    components. An empty table gives no rows. Extra columns are ignored.

    Blocks of candidates meet blocks of anchors; a task streams the candidates of its part
    and holds one block of each. Rows are in the order of (label, id), so a label of any
    size is cut into blocks. The driver gets the range of labels of each block of anchors.
    """
    spark = embeddings.sparkSession
    chosen = embeddings.where(sound(vector_column) & F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.struct(F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("embedding")).alias("row"),
    )
    rows = written(chosen.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.embedding"), "negatives")
    dim = dimension(rows)
    largest = rows.agg(F.max(F.array_max(F.transform("embedding", F.abs)) * F.lit(float(scale)) + 1)).first()[0] or 0.0
    kind = number_kind(largest, dim)
    stored = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"

    def blocks(df: DataFrame, size: int, purpose: str) -> DataFrame:
        ordered = df.select("vec_id", "label", "embedding").repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id")
        return written(ordered.mapInArrow(_to_blocks(dim, scale, stored, size), _BLOCKS), purpose)

    candidates = blocks(rows, BLOCK, "negatives-candidates")
    anchors = blocks(rows.where(is_anchor), ANCHORS, "negatives-anchors")
    ranges = [(i, r["block"], r["low"], r["high"]) for i, r in enumerate(anchors.select("block", "low", "high").orderBy("block").collect())]
    known = spark.createDataFrame([(i, b) for i, b, _, _ in ranges], "ablock int, block long")
    slices = min(SLICES, max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, len(ranges)))))
    all_slices = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    payload = ["ids", "labels", "parts"]
    of_anchors = anchors.join(known, "block").select("ablock", F.lit(ANCHOR).alias("kind"), *payload, all_slices)

    def met(condition) -> DataFrame:
        """Blocks of candidates for every block of anchors that fulfils the condition."""
        told = [F.struct(F.lit(i).alias("ablock"), F.lit(lo).cast("long").alias("low"), F.lit(hi).cast("long").alias("high")) for i, _, lo, hi in ranges]
        every = F.array(*told) if told else F.array().cast("array<struct<ablock:int,low:bigint,high:bigint>>")
        return candidates.select(
            F.explode(F.transform(F.filter(every, condition), lambda a: a["ablock"])).alias("ablock"),
            F.lit(CANDIDATES).alias("kind"),
            *payload,
            F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"),
        )

    def scanned(parts: DataFrame, scan, schema: str) -> DataFrame:
        return parts.repartition(max(1, len(ranges) * slices), "ablock", "slice").sortWithinPartitions(*_KEYS).mapInArrow(scan, schema)

    same = met(lambda a: (a["low"] <= F.col("high")) & (a["high"] >= F.col("low")))
    found = scanned(of_anchors.unionByName(same), _best_of_label(dim, stored, kind, positives), "ablock long, anchor_id long, positive_id long, score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    first = written(found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= positives).drop("rank"), "negatives-positives")

    opened = first.select(F.col("ablock").cast("int").alias("ablock"), F.lit(POSITIVE).alias("kind"), "anchor_id", "positive_id", "score", all_slices)
    other = met(lambda a: (a["low"] != a["high"]) | (F.col("low") != F.col("high")) | (a["low"] != F.col("low")))
    asked = of_anchors.unionByName(opened, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    hard = scanned(
        asked, _best_in_windows(dim, stored, kind, negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
