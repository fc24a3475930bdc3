"""Quality of texts: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairs come
from 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), in time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.arrays import SPACE, binaries, buffer_of, counts_by, give_back, longs, portions, prefix_hashes, runs, span_hashes, words
from tarmac.llm.labelled_sample import labelled_sample

#: Labelled documents that are fitted on, at most; hash places of words; rank of the pairs.
SAMPLE, PLACES, RANK = 8192, 1 << 16, 8

#: Byte classes whose shares of a text are features.
SIGNS = [b"|", b"%$#&*", b"!?", b".,;:", b"\n", b"0123456789", b"@/<>=_{}[]()\"'-+", b" \t", bytes(range(ord("A"), ord("Z") + 1)), bytes(range(0x80, 0x100))]
STATISTICS = len(SIGNS) + 10


@dataclass
class Features:
    """Hashed words of texts in rows: place and value of each, where rows begin; and dense statistics."""

    places: np.ndarray
    values: np.ndarray
    sizes: np.ndarray
    dense: np.ndarray


def features(buf: np.ndarray, offsets: np.ndarray, metadata: np.ndarray) -> Features:
    """Features of whole texts; an empty text has no words and zero shares."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    dense = np.zeros((n, STATISTICS + 2 * metadata.shape[1]))
    for c, signs in enumerate(SIGNS):
        table = np.zeros(256, dtype=np.int64)
        table[list(signs)] = 1
        sums = np.concatenate([[0], np.cumsum(table[buf])])
        dense[:, c] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(lengths, 1)
    starts, ends, owner = words(buf, offsets)
    hashes = span_hashes(prefix_hashes(buf), starts, ends)
    count = counts_by(owner, n)
    size = np.bincount(owner, weights=ends - starts, minlength=n)
    # A letter with a capital in front, capitals only, and the same word as before.
    capital = (buf[starts] >= 65) & (buf[starts] <= 90) if len(starts) else np.zeros(0, bool)
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    key, of = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    distinct = counts_by(of[first], n)
    most = np.zeros(n)
    np.maximum.at(most, of[first], times)
    lines, line_ends, line_owner = words(buf, offsets, np.arange(256) == 10)
    line_hashes = span_hashes(prefix_hashes(buf), lines, line_ends)
    line_order = np.lexsort((line_hashes, line_owner))
    lh, lo = line_hashes[line_order], line_owner[line_order]
    new = np.concatenate([[True], (lh[1:] != lh[:-1]) | (lo[1:] != lo[:-1])]) if len(lh) else np.zeros(0, bool)
    at = len(SIGNS)
    some = np.maximum(count, 1)
    dense[:, at] = np.log1p(lengths)
    dense[:, at + 1] = np.log1p(count)
    dense[:, at + 2] = size / some
    dense[:, at + 3] = distinct / some
    dense[:, at + 4] = most / some
    dense[:, at + 5] = np.bincount(owner, weights=capital, minlength=n) / some
    dense[:, at + 6] = np.bincount(owner, weights=again, minlength=n) / some
    dense[:, at + 7] = np.log1p(counts_by(line_owner, n))
    dense[:, at + 8] = np.bincount(lo, weights=new, minlength=n) / np.maximum(counts_by(line_owner, n), 1)
    dense[:, at + 9] = np.bincount(owner, weights=(ends - starts) == 1, minlength=n) / some
    known = np.isfinite(metadata)
    dense[:, STATISTICS : STATISTICS + metadata.shape[1]] = np.log1p(np.abs(np.where(known, metadata, 0)))
    dense[:, STATISTICS + metadata.shape[1] :] = known
    # Words of one place are added up; rows have length one.
    rows, place, value = of[first], (key[first] >> np.uint64(48)).astype(np.int64) % PLACES, 1 + np.log(times)
    merged = np.lexsort((place, rows))
    rows, place, value = rows[merged], place[merged], value[merged]
    keep = np.concatenate([[True], (rows[1:] != rows[:-1]) | (place[1:] != place[:-1])]) if len(rows) else np.zeros(0, bool)
    value = np.add.reduceat(value, np.flatnonzero(keep)) if len(rows) else value
    rows, place = rows[keep], place[keep]
    norm = np.sqrt(np.bincount(rows, weights=value * value, minlength=n))
    return Features(place, value / np.maximum(norm, 1e-12)[rows], counts_by(rows, n), dense)


@dataclass
class Machine:
    """Parameters of a factorisation machine; dense statistics have the places after the words."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and scaled statistics together: place, value, row."""
        n, d = f.dense.shape
        scaled = np.clip((f.dense - self.mean) / self.spread, -5, 5) / np.sqrt(d)
        owner = np.concatenate([np.repeat(np.arange(n), f.sizes), np.repeat(np.arange(n), d)])
        return np.concatenate([f.places, np.tile(PLACES + np.arange(d), n)]), np.concatenate([f.values, scaled.ravel()]), owner

    def logits(self, place: np.ndarray, value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = self.bias + np.bincount(owner, weights=self.linear[place] * value, minlength=n)
        sums = np.zeros((n, self.factors.shape[1]))
        for f in range(self.factors.shape[1]):
            part = self.factors[place, f] * value
            sums[:, f] = np.bincount(owner, weights=part, minlength=n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(owner, weights=part * part, minlength=n))
        return out, sums

    def scores(self, f: Features) -> np.ndarray:
        logits, _ = self.logits(*self.rows(f), len(f.dense))
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def fit(f: Features, labels: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.08, penalty: float = 2e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss. Without rows, or with one class only, the score is that class's smoothed share."""
    n, d = f.dense.shape
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (n + 2)
    m = Machine(
        float(np.log(share / (1 - share))), np.zeros(PLACES + d), np.zeros((PLACES + d, RANK)), f.dense.mean(axis=0) if n else np.zeros(d), np.maximum(f.dense.std(axis=0), 1e-6) if n else np.ones(d)
    )
    if n == 0 or labels.min() == labels.max():
        return m
    m.factors = rng.normal(0, 0.05, m.factors.shape)
    seen_linear, seen_factors, seen_bias = np.full(len(m.linear), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    begins = np.cumsum(f.sizes) - f.sizes
    for _ in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            take = order[start : start + batch]
            words_at = np.concatenate([np.arange(begins[i], begins[i] + f.sizes[i]) for i in take]) if len(take) else np.zeros(0, np.int64)
            part = Features(f.places[words_at], f.values[words_at], f.sizes[take], f.dense[take])
            place, value, owner = m.rows(part)
            logits, sums = m.logits(place, value, owner, len(take))
            error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[take]) / len(take)
            used, where = np.unique(place, return_inverse=True)
            pull = error[owner] * value
            g = np.bincount(where, weights=pull) + penalty * m.linear[used]
            seen_linear[used] += g * g
            m.linear[used] -= rate * g / np.sqrt(seen_linear[used])
            for k in range(RANK):
                old = m.factors[used, k]
                g = np.bincount(where, weights=pull * (sums[owner, k] - old[where] * value)) + penalty * old
                seen_factors[used, k] += g * g
                m.factors[used, k] = old - rate * g / np.sqrt(seen_factors[used, k])
            g = float(error.sum())
            seen_bias += g * g
            m.bias -= rate * g / seen_bias**0.5
    return m


def _metadata(part: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    if not columns:
        return np.zeros((part.num_rows, 0))
    return np.stack([np.asarray(part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.float64) for c in columns], axis=1)


def _featured(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                f = features(*buffer_of(part.column(1)), _metadata(part, columns))
                cut = np.split(np.arange(len(f.places)), np.cumsum(f.sizes)[:-1]) if part.num_rows else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), binaries([f.places[c].astype(np.uint16) for c in cut]), binaries([f.values[c].astype(np.float32) for c in cut]), binaries(list(f.dense))],
                    ["doc_id", "label", "places", "values", "dense"],
                )

    return run


def _scored(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(**model.value)
        for batch in batches:
            for part in portions(batch, "text"):
                scores = machine.scores(features(*buffer_of(part.column(1)), _metadata(part, columns)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])
        give_back()

    return run


def _inputs(docs: DataFrame, metadata: list[str], id_column: str, text_column: str) -> DataFrame:
    numbers = [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)]
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), *numbers)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_folds: list[int] | None = None, metadata: list[str] | None = None, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Machine:
    """Fit on at most `sample` labelled documents outside the held folds."""
    metadata = ["n_chars"] if metadata is None else metadata
    columns = [f"m{i}" for i in range(len(metadata))]
    chosen = labelled_sample(_inputs(docs, metadata, id_column, text_column), labels, label, folds, [0] if held_folds is None else held_folds, sample, ["text", *columns])
    table = chosen.select("doc_id", "text", "label", *columns).mapInArrow(_featured(columns), "doc_id long, label int, places binary, values binary, dense binary").toArrow().sort_by("doc_id")
    places, values, dense = (table.column(c).to_pylist() for c in ("places", "values", "dense"))
    width = STATISTICS + 2 * len(metadata)
    rows = Features(
        np.frombuffer(b"".join(places), np.uint16).astype(np.int64),
        np.frombuffer(b"".join(values), np.float32).astype(np.float64),
        np.array([len(p) // 2 for p in places], np.int64),
        np.frombuffer(b"".join(dense), np.float64).reshape(-1, width),
    )
    return fit(rows, np.asarray(table.column("label").to_numpy(), np.float64) if table.num_rows else np.zeros(0))


def score(docs: DataFrame, machine: Machine, metadata: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score: one row for each row of the table, 0 to 1.

    A null text counts as empty; an empty text is scored by its statistics; null metadata
    is a feature of its own; null ids stay null and repeated rows are scored one by one;
    an empty table gives no rows; extra columns are ignored. Labels, language, source and
    id are no inputs of the score.
    """
    metadata = ["n_chars"] if metadata is None else metadata
    model = docs.sparkSession.sparkContext.broadcast(vars(machine))
    rows = _inputs(docs, metadata, id_column, text_column)
    return rows.mapInArrow(_scored(model, [f"m{i}" for i in range(len(metadata))]), "doc_id long, score double")
