"""Log-probabilities of texts: add-one unigrams, and a log-bilinear neural model.

The model predicts a word from the two before it: the sum of their vectors, scaled by
position, times the word's vector, plus its bias. It is trained with noise-contrastive
estimation on every training document: tasks descend on what they read, from the same
start, and their parameters are averaged by tokens, in rounds that each take another third
of the documents. Normalised log-probabilities come from matrix products: with
s(w) = a(h1, w) + b(h2, w), the sum over w of exp(s) for all pairs of contexts is the
product of exp(a) and the transposed exp(b).

Words outside the model's vocabulary are one class; a word's share of that class is its
add-one share of the counts of all such words, with one count for words never seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.arrays import binaries, buffer_of, counts_by, longs, runs, word_hashes
from tarmac.llm.common import crc_fold
from tarmac.llm.exchange import BODY, answered, batched, bucket_edges, buckets_for, deltas, dump, load, sums, told

#: Words of the model, numbers in a word's vector, noise words and tokens of a step, rounds.
VOCABULARY, WIDTH, NOISE, STEP, ROUNDS = 2048, 16, 64, 1024, 3

#: The end of a text is a token of its own, with this in place of a hash.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def _make(buckets: int):
    def make(parts: list[pa.RecordBatch]) -> tuple[bytes, list[tuple[int, bytes]]]:
        hashes, lengths = [], []
        for part in parts:
            found, owner = word_hashes(*buffer_of(part.column(1)))
            n = counts_by(owner, part.num_rows) + 1
            closed = np.full(len(found) + part.num_rows, END, np.uint64)
            inside = np.ones(len(closed), dtype=bool)
            inside[np.cumsum(n) - 1] = False
            closed[inside] = found
            hashes.append(closed)
            lengths.append(n)
        lengths, stream = np.concatenate(lengths), np.concatenate(hashes)
        ids = np.concatenate([np.asarray(p.column(0).fill_null(0), np.int64) for p in parts])
        known = np.concatenate([np.asarray(p.column(0).is_valid(), np.uint8) for p in parts])
        held = np.concatenate([np.asarray(p.column(2), np.uint8) for p in parts])
        distinct, inverse, times = np.unique(stream, return_inverse=True, return_counts=True)
        learnt = np.bincount(inverse, weights=np.repeat(held == 0, lengths), minlength=len(distinct)).astype(np.uint32)
        # Frequent words get small numbers, which compress better.
        rank = np.empty(len(distinct), np.uint32)
        order = np.argsort(-times, kind="stable")
        rank[order] = np.arange(len(distinct), dtype=np.uint32)
        body = dump(ids, known, held, lengths, deltas(distinct), rank, rank[inverse])
        edges = bucket_edges(distinct, buckets)
        return body, [(b, dump(deltas(distinct[s:e]), learnt[s:e])) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]

    return make


def _count(vocabulary: int):
    def answer(questions: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        asked = [load(q) for q in questions]
        hashes = [sums(a[0]) for a in asked]
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([a[1] for a in asked]), minlength=len(distinct)).astype(np.int64)
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        top = np.lexsort((distinct, -total))[:vocabulary]
        top = top[total[top] > 0]
        own = dump(np.array([total.sum(), (total > 0).sum()], np.int64), distinct[top], total[top])
        return [dump(total[part]) for part in np.split(inverse, cuts)], [own]

    return answer


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            (n, v), hashes, counts = load(payload)
            none = np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [longs(np.append(hashes.view(np.int64), none)), longs(np.append(counts, none)), longs(np.append(np.zeros(len(hashes), np.int64), n)), longs(np.append(np.zeros(len(hashes), np.int64), v))],
                ["hash", "count", "n", "v"],
            )


@dataclass
class Model:
    """Vocabulary by ascending hash, counts, and parameters. The last two rows are the class of other words and the begin of a text."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    context: np.ndarray
    target: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    @property
    def other(self) -> int:
        return len(self.hashes)

    def places(self, distinct: np.ndarray) -> np.ndarray:
        """Number of each hash in the model."""
        if len(self.hashes) == 0:
            return np.zeros(len(distinct), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
        return np.where(self.hashes[at] == distinct, at, self.other)

    def noise(self) -> np.ndarray:
        """Shares of the words and of the class of others, which are also the noise."""
        other = self.tokens + self.types - (self.counts + 1).sum() + 1
        shares = np.append(self.counts + 1, other).astype(np.float64)
        return shares / shares.sum()

    def log_other(self) -> float:
        """Logarithm of what the counts of other words, one more each, sum up to."""
        return float(np.log(max(1, self.tokens + self.types - int((self.counts + 1).sum()) + 1)))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a(h1, w), b(h2, w) and the logarithm of the sum for each (h1, h2)."""
        a = (self.context * self.scale[0]) @ self.target.T + self.bias
        b = (self.context * self.scale[1]) @ self.target.T
        high_a, high_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        log_sum = np.log(np.exp(a - high_a) @ np.exp(b - high_b).T) + high_a + high_b.T
        return a.astype(np.float32), b.astype(np.float32), log_sum.astype(np.float32)


def start(hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int, seed: int = 3) -> Model:
    rng, n = np.random.default_rng(seed), len(hashes) + 1
    order = np.argsort(hashes)
    m = Model(hashes[order], counts[order], tokens, types, rng.normal(0, 0.1, (n + 1, WIDTH)), rng.normal(0, 0.1, (n, WIDTH)), np.ones((2, WIDTH)), np.zeros(n))
    m.bias = np.log(m.noise())
    return m


def histories(words: np.ndarray, lengths: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; `begin` where the text has none."""
    first = np.cumsum(lengths) - lengths
    one, two = np.roll(words, 1), np.roll(words, 2)
    one[first], two[first] = begin, begin
    later = first[lengths > 1] + 1
    two[later] = begin
    return one, two


class Trainer:
    """Noise-contrastive steps with AdaGrad from a model's parameters."""

    def __init__(self, model: Model, rate: float, seed: int):
        self.m, self.rate = model, rate
        self.rng = np.random.default_rng(seed)
        self.share = model.noise()
        self.cumulated = np.cumsum(self.share)
        self.log_noise = np.log(NOISE * self.share)
        self.now = [model.context.copy(), model.target.copy(), model.scale.copy(), model.bias.copy()]
        self.seen = [np.full(x.shape, 0.1) for x in self.now]

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        context, target, scale, bias = self.now
        n = len(word)
        c1, c2 = context[one], context[two]
        predicted = c1 * scale[0] + c2 * scale[1]
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), len(self.share) - 1)
        hit = target[word]
        up = (predicted * hit).sum(axis=1) + bias[word] - self.log_noise[word]
        down = predicted @ target[noise].T + bias[noise] - self.log_noise[noise]
        pull = 1 / (1 + np.exp(np.clip(up, -30, 30)))
        push = -1 / (1 + np.exp(-np.clip(down, -30, 30)))
        back = pull[:, None] * hit + push @ target[noise]
        d_target, d_context = np.zeros_like(target), np.zeros_like(context)
        np.add.at(d_target, noise, push.T @ predicted)
        lifted, left, right = pull[:, None] * predicted, back * scale[0], back * scale[1]
        for k in range(WIDTH):
            d_target[:, k] += np.bincount(word, weights=lifted[:, k], minlength=len(target))
            d_context[:, k] += np.bincount(one, weights=left[:, k], minlength=len(context))
            d_context[:, k] += np.bincount(two, weights=right[:, k], minlength=len(context))
        d_scale = np.stack([(back * c1).sum(axis=0), (back * c2).sum(axis=0)])
        d_bias = np.bincount(word, weights=pull, minlength=len(bias))
        np.add.at(d_bias, noise, push.sum(axis=0))
        for x, seen, d in zip(self.now, self.seen, (d_context, d_target, d_scale, d_bias), strict=True):
            d /= n
            seen += d * d * n
            x += self.rate * d * np.sqrt(n) / np.sqrt(seen)


def _train(shared, turn: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        trainer, weight = Trainer(model, rate, turn), 0
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                _, _, held, lengths, distinct, rank, stream = load(payload)
                numbers = np.empty(len(rank), np.int64)
                numbers[rank] = model.places(sums(distinct))
                words = numbers[stream]
                one, two = histories(words, lengths, model.other + 1)
                mine = (held == 0) & (np.arange(len(lengths)) % ROUNDS == turn)
                at = np.flatnonzero(np.repeat(mine, lengths))
                for s in range(0, len(at), STEP):
                    t = at[s : s + STEP]
                    trainer.step(one[t], two[t], words[t])
                weight += len(at)
        if weight:
            flat = np.concatenate([x.ravel() for x in trainer.now]) * weight
            yield pa.RecordBatch.from_arrays([longs([weight]), binaries([flat])], ["weight", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sums of all rows, of which it holds one batch at a time."""
    weight, flat = 0, np.zeros(0)
    for batch in batches:
        weight += sum(batch.column(0).to_pylist())
        for payload in batch.column(1).to_pylist():
            more = np.frombuffer(payload, np.float64)
            flat = more.copy() if len(flat) == 0 else flat + more
    if len(flat):
        yield pa.RecordBatch.from_arrays([longs([weight]), binaries([flat])], ["weight", "sums"])


def _round(bodies: DataFrame, model: Model, turn: int, rate: float) -> Model:
    """Parameters after a round: the mean over tasks, weighted by their tokens.

    Sums are added in two steps by tasks that hold one sum each; the driver gets one row
    for each task of the last step.
    """
    shared = bodies.sparkSession.sparkContext.broadcast(vars(model))
    found = bodies.mapInArrow(_train(shared, turn, rate), "weight long, sums binary")
    for tasks in (64, 8):
        found = found.repartition(tasks).mapInArrow(_added, "weight long, sums binary")
    rows = found.select("weight", "sums").toArrow()
    summed = next(_added(iter(rows.to_batches())), None)
    if summed is None:
        return model
    flat = np.frombuffer(summed.column(1)[0].as_py(), np.float64) / summed.column(0)[0].as_py()
    shapes = [model.context.shape, model.target.shape, model.scale.shape, model.bias.shape]
    parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    return Model(model.hashes, model.counts, model.tokens, model.types, *(p.reshape(s) for p, s in zip(parts, shapes, strict=True)))


def _tell(shared, buckets: int):
    def tell(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        parts, a, b, log_sum = shared.value
        model = Model(**parts)
        ids, known, held, lengths, distinct, rank, stream = load(payload)
        distinct = sums(distinct)
        counts = np.zeros(len(distinct), np.int64)
        edges = bucket_edges(distinct, buckets)
        for bucket, reply in replies.items():
            counts[edges[bucket] : edges[bucket + 1]] = load(reply)[0]
        places = model.places(distinct)
        base = np.log10((counts + 1) / (model.tokens + model.types + 1))
        extra = np.where(places == model.other, np.log(counts + 1) - model.log_other(), 0.0)

        def by_rank(values: np.ndarray) -> np.ndarray:
            out = np.empty(len(values), values.dtype)
            out[rank] = values
            return out[stream]

        words = by_rank(places)
        one, two = histories(words, lengths, model.other + 1)
        logs = a[one, words].astype(np.float64) + b[two, words] - log_sum[one, two] + by_rank(extra)
        begins = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
        n = len(lengths)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=known == 0),
                "held_out": pa.array(held.astype(bool)),
                "n_tokens": longs(lengths),
                "n_known": longs(add(by_rank((counts > 0).astype(np.int64)))),
                "train_tokens": longs(np.full(n, model.tokens)),
                "base_score": pa.array(add(by_rank(base))),
                "score": pa.array(add(logs) / np.log(10)),
            }
        )

    return tell


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, vocabulary: int = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of the table.

    A-Z count as small letters; words are what white space of ASCII separates; every text
    has an end token more. A null text counts as empty and has the end token only; a null
    id belongs to the training texts; rows that repeat an id are learnt from and scored one
    by one; without training texts all scores come from one unseen word; an empty table
    gives no rows; extra columns are ignored. Scores are logarithms to base 10.

    Counts and parameters are learnt from all training texts. The model's size is bounded
    by `vocabulary`; it is broadcast. Each word of the corpus is counted in the bucket of
    its hash; no list of words goes to the driver but the vocabulary.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        (crc_fold(id_column, folds) == held_fold).cast("byte").alias("held"),
    )
    buckets = buckets_for(rows)
    table = batched(rows, _make(buckets), "language-model")
    answers = answered(table, _count(vocabulary), "language-model-counts")
    own = answers.where(F.col("kind") == BODY).select("payload").mapInArrow(_summaries, "hash long, count long, n long, v long")
    tokens, types = (int(x or 0) for x in own.agg(F.sum("n"), F.sum("v")).first())
    top = own.where("count > 0").orderBy(F.desc("count"), "hash").limit(vocabulary).toArrow()
    model = start(np.asarray(top.column("hash"), np.int64).view(np.uint64), np.asarray(top.column("count"), np.int64), tokens, types)
    bodies = table.where(F.col("kind") == BODY).select("payload")
    if tokens:
        for turn in range(ROUNDS):
            model = _round(bodies, model, turn, 0.15 / (1 + turn))
    shared = spark.sparkContext.broadcast((vars(model), *model.tables()))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told(table, answers, _tell(shared, buckets), schema)
