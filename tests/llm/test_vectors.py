import math

import numpy as np
import pytest

from tarmac.llm.near_vectors import collision, compare, near_duplicates, tables_for
from tarmac.llm.topk_search import candidates, products, search_bucket, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, bucket string, codes string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def brute_links(rows, threshold):
    units = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and any(v) and all(x is not None and math.isfinite(x) for x in v)}
    links = {i: {j for j in units if j != i and units[i] @ units[j] >= threshold} if i in units else set() for i, _ in rows}
    label = {i: i for i in links}
    for _ in links:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
    return {i: (len(links[i]), label[i], label[i] == i) for i in links}


def test_near_vectors_as_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 40] + rng.normal(0, 0.12, 16))]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 16), (304, [float("nan")] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, []), (307, [1e30] * 16), (308, [1.0] * 16)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table(spark, rows), 0.9, recall=0.9999).collect()}
    assert got == brute_links(rows, 0.9)
    assert got[302] == (0, 302, True) and got[307][0] == 1


def test_a_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("tarmac.llm.near_vectors.BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(np.ones(8) + rng.normal(0, 0.15, 8))]) for i in range(120)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table(spark, rows), 0.95, recall=0.99999).collect()}
    assert got == brute_links(rows, 0.95)


def test_near_vectors_odd_tables(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    rows = near_duplicates(table(spark, [(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [2.0, 0.0])])).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in rows], key=str) == sorted(
        [(None, 0, None, False), (7, 1, 3, False), (7, 1, 3, False), (3, 1, 3, True)], key=str
    )


def test_tables_follow_rows_and_recall():
    bits, tables = tables_for(1 << 20, 0.9, 0.99)
    near = collision(math.sqrt(0.2))
    assert 1 - (1 - near**bits) ** tables >= 0.99
    assert tables_for(1 << 30, 0.9)[0] > bits


def test_recall_at_the_threshold():
    """Pairs just above the threshold share a bucket as often as promised."""
    from tarmac.llm.near_vectors import _hashed
    import pyarrow as pa

    rng = np.random.default_rng(1)
    a = rng.standard_normal((400, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((400, 32))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    bits, tables = tables_for(50_000, 0.9, 0.99)
    both = np.concatenate([a, b])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(800)), pa.array(both.tolist())], ["vec_id", "embedding"])
    codes = np.zeros((800, tables), np.int64)
    for out in _hashed(32, bits, tables, 1)(iter([batch])):
        codes[np.asarray(out.column(2)), np.asarray(out.column(0))] = np.asarray(out.column(1))
    assert (codes[:400] == codes[400:]).any(axis=1).mean() >= 0.96


def test_pairs_count_in_their_first_table():
    ids, units, codes = np.array([1, 2]), np.eye(2)[[0, 0]], np.array([[5, 9], [5, 9]], np.uint32)
    assert compare(0, (ids, units, codes), None, 0.9)[1].tolist() == [1, 1]
    assert len(compare(1, (ids, units, codes), None, 0.9)[1]) == 0


def brute_top(rows, k):
    sound = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in sound:
        if i % 100 == 0:
            best = sorted(((-int(v @ w), j) for j, w in sound if j != i))[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_top_k_as_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr("tarmac.llm.topk_search.BUCKET", 32)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(6) * np.exp(spread * rng.standard_normal()))]) for i in range(350)]
    rows += [(i, rows[100][1]) for i in range(350, 420)]  # ties
    rows += [(500, None), (600, [float("inf")] * 6), (700, [0.0] * 6), (800, [None] * 6)]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(table(spark, rows), "vec_id % 100 = 0").collect()}
    assert got == brute_top(rows, 10)


def test_top_k_odd_tables(spark):
    assert top_k(table(spark, []), "vec_id % 100 = 0").count() == 0
    few = top_k(table(spark, [(100, [1.0, 2.0]), (5, [1.0]), (None, [9.0, 9.0])]), "vec_id % 100 = 0").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(100, 1, 5, 1024 * 1024)]
    assert top_k(table(spark, [(100, [1.0])]), "vec_id % 100 = 0").count() == 0


def test_pruning_keeps_every_partner():
    rng = np.random.default_rng(3)
    rows = np.floor(1024 * rng.standard_normal((500, 5))).astype(np.int64)
    lengths = np.sqrt((rows.astype(float) ** 2).sum(1))
    rows, lengths = rows[np.argsort(-lengths)], np.sort(lengths)[::-1]
    unit = rows / lengths[:, None]
    pruned = 0
    for q in rows[::7]:
        scores = rows @ q
        for k in (1, 10, 100):
            floor = float(np.sort(scores)[-k])
            near = candidates(q.astype(float), float(np.sqrt((q.astype(float) ** 2).sum())), floor, unit, lengths)
            assert set(np.flatnonzero(scores >= floor)) <= set(near)
            pruned += len(near) < len(rows)
    assert pruned


def test_products_of_any_size():
    big = np.array([[1 << 40, 3]], np.int64)
    assert products(big, big, 2.0**80)[0, 0] == (1 << 63) - 1
    assert products(np.array([[1 << 28, 3]]), np.array([[1 << 28, 5]]), 2.0**57)[0, 0] == (1 << 56) + 15
    assert list(search_bucket(big[:0], np.zeros(0, int), np.zeros(0), big, np.array([1]), 10)) == []


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_recall_of_the_tables_of_a_large_table(threshold):
    """A hundred thousand vectors, half of them at exactly the threshold from the other half."""
    from tarmac.llm.near_vectors import _hashed
    import pyarrow as pa

    rng, n = np.random.default_rng(7), 50_000
    a = rng.standard_normal((n, 16))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((n, 16))
    b -= (a * b).sum(1)[:, None] * a
    b = threshold * a + math.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1)[:, None]
    bits, tables = tables_for(2 * n, threshold, 0.99)
    both = np.concatenate([a, b])
    shared = np.zeros(n, dtype=bool)
    codes = np.zeros((tables, 2 * n), np.int64)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), 16).cast(pa.list_(pa.float64()))
    for out in _hashed(16, bits, tables, 3)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(2 * n)), flat], ["vec_id", "embedding"])])):
        codes[np.asarray(out.column(0)), np.asarray(out.column(2))] = np.asarray(out.column(1))
    for t in range(tables):
        shared |= codes[t, :n] == codes[t, n:]
    assert shared.mean() >= 0.985


def test_equal_vectors_are_one_before_they_are_compared(spark, monkeypatch):
    """A group of copies costs a row: no cell has more vectors than there are different ones."""
    from tarmac.llm import near_vectors

    seen = []
    real = near_vectors._hashed
    monkeypatch.setattr(near_vectors, "tables_for", lambda rows, *_: seen.append(rows) or (1, 2))
    monkeypatch.setattr(near_vectors, "_hashed", real)
    rows = [(i, [1.0, 0.0]) for i in range(500)] + [(500 + i, [1.0, 0.01 * i]) for i in range(1, 4)] + [(900, [0.0, 0.0]), (901, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table(spark, rows), 0.9).collect()}
    assert seen == [5]
    assert all(got[i] == (502, 0, i == 0) for i in range(503) if i != 500) and got[900] == (0, 900, True) and got[901] == (0, 901, True)


def test_top_k_sends_no_side_to_all(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(400)]
    plan = top_k(table(spark, rows), "vec_id % 100 = 0")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
