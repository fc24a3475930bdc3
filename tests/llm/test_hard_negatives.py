"""Hard negatives against plain Python over all pairs."""

import math

import numpy as np
import pytest

from tarmac.llm import hard_negatives as hard

NAN, INF = float("nan"), float("inf")


def brute(rows, every, positives=5, negatives=3, low=50, high=95, scale=256):
    """Rows of (anchor, positive, rank, negative, scores) from (id, label, vector)."""
    sound = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept = (label, list(vector))
        sound[i] = min(sound[i], kept) if i in sound else kept
    whole = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in sound.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:positives]:
            inside = [i for i in order if whole[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    made = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, score string, ids string")
    return sorted(tuple(r) for r in hard.hard_negatives(made, f"vec_id % {every} = 0", **options).collect())


def clustered(rng, n, dim=16, labels=4, hot=0.4):
    centres = rng.standard_normal((labels, dim))
    label = np.where(rng.random(n) < hot, 0, rng.integers(0, labels, n))
    vectors = centres[label] + 0.8 * rng.standard_normal((n, dim))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    return [(i, int(k), [float(x) for x in v]) for i, (k, v) in enumerate(zip(label, vectors, strict=True))]


@pytest.mark.parametrize("size", [(7, 3), (64, 5), (4096, 4096)])
def test_equals_brute_force_whatever_the_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(hard, "BLOCK", size[0])
    monkeypatch.setattr(hard, "ANCHORS", size[1])
    rows = clustered(np.random.default_rng(size[0]), 300)
    rows += [(1000 + i, label, v) for i, label, v in rows[:60]]
    expected = brute(rows, 10)
    assert len(expected) > 100 and found(spark, rows, 10) == expected


def test_other_bounds(spark):
    rows = clustered(np.random.default_rng(9), 200)
    for options in ({"positives": 1, "negatives": 10}, {"low": 0, "high": 100, "scale": 8}):
        assert found(spark, rows, 7, **options) == brute(rows, 7, **options)


def test_ties_and_scores_below_zero(spark):
    rows = [(i, i % 3, [float(i % 2), -float(i % 4 == 1)]) for i in range(60)]
    assert found(spark, rows, 5) == brute(rows, 5)
    away = [(i, i % 2, [1.0 if i == 0 else -1.0]) for i in range(12)]
    assert found(spark, away, 12) == brute(away, 12) == []


def test_odd_rows(spark):
    rows = clustered(np.random.default_rng(2), 80, dim=4)
    rows += [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (201, 1, None), (202, 1, [1.0, None, 0.0, 0.0]), (203, 1, [NAN] * 4), (204, 2, [INF] * 4)]
    rows += [(205, 1, [0.5, 0.5]), (206, 2, []), (210, 3, [0.0] * 4), (0, 0, [0.1] * 4), (0, 0, [0.1] * 4), (5, 3, [0.9, 0.1, 0.0, 0.0])]
    padded = [(i, label, v if v is None else v + [0.0] * (4 - len(v))) for i, label, v in rows]
    assert found(spark, rows, 5) == brute(padded, 5)
    assert found(spark, [], 5) == [] and found(spark, rows[:1], 5) == []
    empty = hard.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), "vec_id = 0")
    assert empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    for size in (2.0**20, 2.0**22):
        rows = [(i, label, [x * size for x in v]) for i, label, v in clustered(rng, 60, dim=5)]
        assert found(spark, rows, 6) == brute(rows, 6)
    # Products beyond a long count as the largest long.
    beyond = [(i, i % 2, [2.0**50]) for i in range(8)]
    assert found(spark, beyond, 6, low=100, high=100) == [(a, p, r, n, 2**63 - 1, 2**63 - 1) for a, p, r, n in beyond_pairs()]


def beyond_pairs():
    for a in (0, 6):
        for p in [i for i in range(0, 8, 2) if i != a]:
            yield from ((a, p, r, n) for r, n in enumerate((1, 3, 5), 1))


@pytest.mark.parametrize("kind", [np.float64, np.int64, object])
def test_scan_keeps_what_is_inside(kind):
    rng = np.random.default_rng(6)
    columns = rng.integers(-200, 200, (24, 500)).astype(kind)
    anchor = rng.integers(-200, 200, 24).astype(kind)
    scores = (anchor @ columns).astype(np.float64)
    start = np.flatnonzero(rng.random(500) < 0.7)
    for low, high in ((-np.inf, np.inf), (40_000, np.inf), (-10_000, 5_000), (10**9, np.inf)):
        places, got = hard.vertical_scan(anchor, columns, columns.min(axis=1), columns.max(axis=1), start, low, high)
        expected = [i for i in start if low <= scores[i] <= high]
        assert places.tolist() == expected and [float(x) for x in got] == scores[expected].tolist()


def test_the_bitmap_shrinks_before_all_dimensions_are_read(monkeypatch):
    """A candidate that can no longer reach the floor costs no more dimensions."""
    read = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and self.ndim == 2:
                read.append(len(key))
            return super().__getitem__(key)

    columns = np.zeros((64, 100)).view(Counting)
    columns[0] = np.arange(100)
    anchor = np.ones(64)
    anchor[0] = 10.0
    columns[1:, 99] = 1.0
    places, _ = hard.vertical_scan(anchor, columns, np.asarray(columns.min(axis=1)), np.asarray(columns.max(axis=1)), np.arange(99), 1050.0, np.inf)
    assert len(places) == 0 and sum(read) == hard.STEP
