"""Toxicity of texts by their nearest labelled examples.

Examples are TF-IDF vectors over all their terms; the weight of a term grows with how far
its presence goes with the label, by a chi-square test on the sample, but no term is left
out. An inverted index holds the weights of each term. The most frequent terms, whose
postings are most of the work, are a table of examples by terms instead; their share of
the cosines is a matrix product for a group of texts, to which the postings of a text's
other terms are added, so the neighbours are exact. They vote with weights that fall with
their distance; leave-one-out votes of the examples calibrate the share of votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarmac.llm.arrays import NO_LETTER, binaries, buffer_of, distinct, expand, give_back, longs, mix, portions, word_hashes
from tarmac.llm.common import texts
from tarmac.llm.labelled_sample import labelled_sample

#: Labelled documents in the index, at most; chi-square and examples at which a term has half
#: of its extra weight, each; that weight; neighbours that vote; texts in a matrix
#: product; frequent terms, at most, which one of so many examples has; bins of the calibration.
SAMPLE, CHI_SQUARE, LEAST, EXTRA, NEIGHBOURS, GROUP, FREQUENT, ONE_OF, BINS = 8192, 30.0, 6, 100.0, 15, 128, 512, 16, 10

#: Examples in a block, and blocks that a search sums first.
BLOCK, FIRST = 256, 1


def term_counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term hash and count of each distinct term of each text, in this order."""
    hashes, owner = word_hashes(buf, offsets, NO_LETTER)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    return owner[first], hashes[first], np.diff(np.append(first, len(hashes)))


@dataclass
class Index:
    """Terms with their factors, postings by term and block, frequent terms by example, the examples' ids and labels, calibration.

    `begins` says where the blocks of each term begin, `blocks` and `most` which block each
    is and the largest weight in it, `starts` where its postings begin.
    """

    terms: np.ndarray
    factors: np.ndarray
    begins: np.ndarray
    blocks: np.ndarray
    most: np.ndarray
    starts: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    columns: np.ndarray
    frequent: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    steps: np.ndarray
    bare: float

    def vectors(self, owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int):
        """Rows of unit vectors: row, term, weight. Terms that no example has count in the length only."""
        if len(self.terms) == 0 or len(hashes) == 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        weight = (1 + np.log(counts)) * np.where(known, self.factors[at], np.log(len(self.ids) + 1) + 1)
        norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=n))
        row, term = owner[known], at[known]
        return row, term, weight[known] / norm[row]

    def common(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """What frequent terms add to the cosines of n rows with all examples."""
        asked, column = np.zeros((n, self.frequent.shape[1])), self.columns[term]
        asked[row[column >= 0], column[column >= 0]] = weight[column >= 0]
        return asked @ self.frequent.T

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, ties to the smaller id; only cosines above 0.

        A block's bound is the largest share that frequent terms give one of its examples,
        and for every other term the largest weight in the block. The blocks with the
        largest bounds are summed first; of the others only those whose bound reaches the
        k-th cosine known by then.
        """
        n = len(self.ids)
        if common is None:
            common = self.common(np.zeros(len(term), np.int64), term, weight, 1)[0]
        cosines = common.copy()
        if skip >= 0:
            cosines[skip] = -1.0
        rare = self.columns[term] < 0
        term, weight = term[rare], weight[rare]
        count = self.begins[term + 1] - self.begins[term]
        lists = expand(self.begins[term], count)
        blocks, weight = self.blocks[lists], np.repeat(weight, count)
        edges = np.arange(0, n, BLOCK)
        bound = np.maximum.reduceat(cosines, edges) + np.bincount(blocks, weights=self.most[lists] * weight, minlength=len(edges))
        left = np.ones(len(edges), dtype=bool)

        def add(chosen: np.ndarray) -> None:
            mine = chosen[blocks]
            some = lists[mine]
            size = self.starts[some + 1] - self.starts[some]
            places = expand(self.starts[some], size)
            cosines[:] += np.bincount(self.examples[places], weights=self.weights[places] * np.repeat(weight[mine], size), minlength=n)
            left[chosen] = False

        if len(edges) > FIRST:
            add(bound >= np.partition(bound, len(edges) - FIRST)[len(edges) - FIRST])
        # Sums of part of the terms are too small, never too large.
        reached = np.partition(cosines, n - k)[n - k] if n > k else -np.inf
        add(left & (bound + 1e-8 >= reached))
        if skip >= 0:
            cosines[skip] = -1.0
        kth = np.partition(cosines, n - k)[n - k] if n > k else 0.0
        near = np.flatnonzero((cosines > 0) & (cosines + 2e-9 >= kth))
        cosines = cosines[near]
        # Cosines of equal vectors may differ in their last bits; they count as ties.
        cosines = np.round(cosines, 9)
        best = np.lexsort((self.ids[near], -cosines))[:k]
        best = best[cosines[best] > 0]
        return near[best], cosines[best]

    def share(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the votes for label 1; a vote weighs 1 / (0.1 + distance)."""
        weight = 1 / (0.1 + np.sqrt(np.maximum(0.0, 2 - 2 * cosines)))
        return float((weight * self.labels[found]).sum() / weight.sum())

    def calibrated(self, share: float) -> float:
        return float(self.steps[min(BINS - 1, int(share * BINS))])


def unlike(owner: np.ndarray, hashes: np.ndarray, labels: np.ndarray, least: int = 4) -> np.ndarray:
    """True for one example of those that agree in their label and their `least` smallest hashes.

    Copies of one text would else make all its words look like words of its label.
    """
    # An example's hashes are in ascending order.
    begins = np.searchsorted(owner, np.arange(len(labels) + 1))
    small = expand(begins[:-1], np.minimum(np.diff(begins), least))
    signs = np.zeros(len(labels), np.uint64)
    np.add.at(signs, owner[small], mix(hashes[small]))
    _, first = np.unique(np.stack([signs, labels.astype(np.uint64)]), axis=1, return_index=True)
    out = np.zeros(len(labels), dtype=bool)
    out[first] = True
    return out


def association(owner: np.ndarray, hashes: np.ndarray, term: np.ndarray, n_terms: int, labels: np.ndarray) -> np.ndarray:
    """From 0 to 1 for each term: how far its presence in an example goes with the label."""
    none = np.zeros(n_terms)
    if len(hashes) == 0 or labels.min() == labels.max():
        return none
    single = unlike(owner, hashes, labels)
    kept = single[owner]
    owner, term = owner[kept], term[kept]
    n, ones = single.sum(), labels[single].sum()
    if len(term) == 0 or ones in (0, n):
        return none
    present = np.bincount(term, minlength=n_terms).astype(np.float64)
    hit = np.bincount(term, weights=labels[owner], minlength=n_terms)
    # Chi-square of the two-by-two table of presence and label.
    cross = hit * (n - ones) - (present - hit) * ones
    spread = present * (n - present) * ones * (n - ones)
    statistic = np.where(spread > 0, n * cross * cross / np.maximum(spread, 1), 0)
    high, often = statistic**4, present**4
    return high / (high + CHI_SQUARE**4) * often / (often + LEAST**4)


def build(
    ids: np.ndarray, labels: np.ndarray, owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS, spread: tuple[np.ndarray, int] | None = None
) -> Index:
    """Index of the examples; without any, every text gets the share of an even chance.

    `spread` says in how many documents each term is, in ascending order of the terms, and
    how many documents there are; without it, the examples are all documents.
    """
    n = len(ids)
    labels = labels.astype(np.float64)
    prior = float((labels.sum() + 1) / (n + 2))
    nothing, none = np.zeros(0, np.int64), np.zeros(0)
    index = Index(np.zeros(0, np.uint64), none, nothing, nothing, none, nothing, nothing, none, nothing, np.zeros((n, 0)), ids, labels, np.full(BINS, prior), prior)
    if n == 0 or len(hashes) == 0:
        return index
    terms, _, at = distinct(hashes)
    present = np.bincount(at)
    index.terms = terms
    had, of = (present, n) if spread is None else spread
    index.factors = (np.log((of + 1) / (had + 1)) + 1) * (1 + EXTRA * association(owner, hashes, at, len(terms), labels))
    del at
    row, term, weight = index.vectors(owner, hashes, counts, n)
    row, term = row.astype(np.int32), term.astype(np.int32)
    often = np.argsort(-present, kind="stable")[:FREQUENT]
    often = often[present[often] * ONE_OF > n]
    index.columns = np.full(len(terms), -1, np.int16)
    index.columns[often] = np.arange(len(often))
    column = index.columns[term]
    index.frequent = np.zeros((n, len(often)))
    index.frequent[row[column >= 0], column[column >= 0]] = weight[column >= 0]
    by = np.lexsort((row, term))
    by = by[column[by] < 0]
    index.examples, index.weights = row[by], weight[by]
    # A list for each term and block of examples, with its largest weight.
    block, of_term = (index.examples // BLOCK).astype(np.int32), term[by]
    heads = np.flatnonzero(np.concatenate([[True], (of_term[1:] != of_term[:-1]) | (block[1:] != block[:-1])])) if len(by) else nothing
    index.blocks, index.starts = block[heads], np.append(heads, len(by))
    index.most = np.maximum.reduceat(index.weights, heads) if len(heads) else none
    index.begins = np.searchsorted(of_term[heads], np.arange(len(terms) + 1))
    begins = np.searchsorted(row, np.arange(n + 1))
    del by, column, block, of_term, heads
    # Calibration: each example is scored by the others.
    hits, tries = np.zeros(BINS), np.zeros(BINS)
    for me in range(n):
        if me % GROUP == 0:
            common = index.frequent[me : me + GROUP] @ index.frequent.T
        mine = slice(begins[me], begins[me + 1])
        found, cosines = index.nearest(term[mine], weight[mine], k, me, common[me % GROUP])
        if len(found):
            b = min(BINS - 1, int(index.share(found, cosines) * BINS))
            hits[b] += index.labels[me]
            tries[b] += 1
    bare = np.diff(begins) == 0
    index.bare = float((index.labels[bare].sum() + prior) / (bare.sum() + 1))
    index.steps = rising((hits + (np.arange(BINS) + 0.5) / BINS) / (tries + 1), tries + 1)
    return index


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([float(v), float(w), 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, "text"):
            owner, hashes, counts = term_counts(*buffer_of(part.column(1)))
            cut = np.split(np.arange(len(owner)), np.cumsum(np.bincount(owner, minlength=part.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), binaries([hashes[c] for c in cut]), binaries([counts[c].astype(np.uint32) for c in cut])], ["doc_id", "label", "terms", "counts"]
            )


def _scored(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(**shared.value)
        for batch in batches:
            for part in portions(batch, "text"):
                n = part.num_rows
                row, term, weight = index.vectors(*term_counts(*buffer_of(part.column(1))), n)
                begins = np.searchsorted(row, np.arange(n + 1))
                scores, evidence, cosines = np.full(n, index.bare), [[] for _ in range(n)], [[] for _ in range(n)]
                seen: dict[bytes, tuple] = {}
                keys = [term[s:e].tobytes() + weight[s:e].tobytes() for s, e in zip(begins[:-1], begins[1:], strict=True)]
                # Of equal texts one is searched for.
                first = dict(zip(reversed(keys), reversed(range(n)), strict=True))
                alone = np.array(sorted(i for key, i in first.items() if key), np.int64)
                for g in range(0, len(alone), GROUP):
                    group = alone[g : g + GROUP]
                    places = expand(begins[group], begins[group + 1] - begins[group])
                    common = index.common(np.repeat(np.arange(len(group)), begins[group + 1] - begins[group]), term[places], weight[places], len(group))
                    for i, own in zip(group, common, strict=True):
                        found, near = index.nearest(term[begins[i] : begins[i + 1]], weight[begins[i] : begins[i + 1]], k, common=own)
                        if len(found):
                            seen[keys[i]] = index.calibrated(index.share(found, near)), index.ids[found].tolist(), near.tolist()
                for i in (i for i, key in enumerate(keys) if key in seen):
                    scores[i], evidence[i], cosines[i] = seen[keys[i]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores), pa.array(evidence, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "cosines"]
                )
        give_back()

    return run


def _having(shared):
    """A row for the task: its texts, and in how many of them each term of the examples is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        had, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for part in portions(batch, "text"):
                _, hashes, _ = term_counts(*buffer_of(part.column(1)))
                at = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
                if len(terms):
                    had += np.bincount(at[terms[at] == hashes], minlength=len(terms))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([longs([n]), binaries([had])], ["n", "had"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sums of all rows, of which it holds one batch at a time."""
    n, had = 0, np.zeros(0, np.int64)
    for batch in batches:
        n += sum(batch.column(0).to_pylist())
        for payload in batch.column(1).to_pylist():
            more = np.frombuffer(payload, np.int64)
            had = had + more if len(had) else more.copy()
    if n:
        yield pa.RecordBatch.from_arrays([longs([n]), binaries([had])], ["n", "had"])


def spread_of(rows: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are.

    A task sends on one row, and rows are added by tasks before the driver adds the last few.
    """
    found = rows.mapInArrow(_having(rows.sparkSession.sparkContext.broadcast(terms)), "n long, had binary")
    for tasks in (64, 4):
        found = found.repartition(tasks).mapInArrow(_added, "n long, had binary")
    summed = next(_added(iter(found.toArrow().to_batches())), None)
    if summed is None:
        return np.zeros(len(terms), np.int64), 0
    return np.frombuffer(summed.column(1)[0].as_py(), np.int64), summed.column(0)[0].as_py()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_folds: list[int] | None = None, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """Index of at most `sample` labelled documents outside the held folds; rarity counts over all documents."""
    rows = texts(docs, id_column, text_column)
    chosen = labelled_sample(rows, labels, label, folds, [2] if held_folds is None else held_folds, sample, ["text"])
    table = chosen.select("doc_id", "text", "label").mapInArrow(_counted, "doc_id long, label int, terms binary, counts binary").toArrow().sort_by("doc_id")
    ids, known = (np.asarray(table.column(c).to_numpy(), np.int64) for c in ("doc_id", "label"))
    # The binary columns' own buffers hold all terms and counts, one example after the other.
    raw_terms, ends = buffer_of(table.column("terms"))
    raw_counts, _ = buffer_of(table.column("counts"))
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends) // 8)
    hashes = raw_terms.view(np.uint64)
    spread = spread_of(rows, np.unique(hashes)) if len(hashes) else None
    return build(ids, known, owner, hashes, raw_counts.view(np.uint32), spread=spread)


def score(docs: DataFrame, index: Index, k: int = NEIGHBOURS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score, evidence, cosines: one row for each row of the table.

    evidence lists the labelled documents that voted, nearest first. A text without any
    term of the index (also an empty or null one) has no neighbours and gets the share
    of label 1 among the examples without such terms. Null ids stay null, repeated rows
    are scored one by one, an empty table gives no rows, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(index))
    return texts(docs, id_column, text_column).mapInArrow(_scored(shared, k), "doc_id long, score double, evidence array<long>, cosines array<double>")
