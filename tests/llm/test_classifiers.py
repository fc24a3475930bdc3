import numpy as np
import pytest

from tarmac.llm import quality, toxicity
from tarmac.llm.common import crc_fold
from tarmac.llm.labelled_sample import labelled_sample

LABELS = "doc_id long, quality int, toxic int"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    for v in np.unique(scores):
        rank[scores == v] = rank[scores == v].mean()
    ones = labels == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.fixture(scope="module")
def sf01(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "folds", "held"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(sf01, module, label, folds, held):
    docs, labels = sf01
    model = module.train(docs, labels, label, folds, [held])
    held_out = module.score(docs, model).join(labels, "doc_id").where(crc_fold("doc_id", folds) == held).toPandas()
    assert held_out.score.between(0, 1).all()
    assert auc(held_out[label].values, held_out.score.values) > 0.95
    predicted, true = held_out.score.values >= 0.3, held_out[label].values == 1
    assert (predicted == true).mean() > 0.96


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=12), rng.normal(size=(12, 3)), np.zeros(0), np.ones(0))
    place, value, owner = rng.integers(0, 12, 9), rng.normal(size=9), np.array([0, 0, 0, 0, 1, 1, 1, 1, 1])
    got, _ = m.logits(place, value, owner, 3)
    for row in range(3):
        at = np.flatnonzero(owner == row)
        pairs = sum(m.factors[place[i]] @ m.factors[place[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert np.isclose(got[row], 0.3 + (m.linear[place[at]] * value[at]).sum() + pairs)


def test_structure_of_texts():
    texts = ["A a | a\nA a | a\n%%", "", "x"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    f = quality.features(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.array([[5.0], [np.nan], [0.0]]))
    at = len(quality.SIGNS)
    assert np.isclose(f.dense[0, 0], 2 / 18) and np.isclose(f.dense[0, 1], 2 / 18)
    assert np.isclose(f.dense[0, at + 3], 4 / 9) and np.isclose(f.dense[0, at + 8], 2 / 3)
    assert f.sizes.tolist() == [4, 0, 1] and f.dense[1, : at + 10].sum() == 0
    assert f.dense[:, quality.STATISTICS + 1].tolist() == [1, 0, 1]
    assert np.isclose((f.values[:4] ** 2).sum(), 1)


def test_nearest_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "CHI_SQUARE", 8.0)
    rng = np.random.default_rng(4)
    n, vocabulary = 900, rng.integers(0, 1 << 60, 60).astype(np.uint64)
    labels = (rng.random(n) < 0.4).astype(int)
    owner, hashes = [], []
    for i in range(n):
        for t in np.unique(rng.choice(60, rng.integers(0, 6))):
            if t >= 40 or labels[i] == (t % 2) or rng.random() < 0.1:
                owner.append(i), hashes.append(vocabulary[t])
    owner, hashes = np.array(owner), np.array(hashes, np.uint64)
    counts = rng.integers(1, 4, len(owner))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    index = toxicity.build(np.arange(n)[::-1] * 3, labels, owner, hashes, counts)
    assert len(index.terms) >= 10
    row, term, weight = index.vectors(owner, hashes, counts, n)
    dense = np.zeros((n, len(index.terms)))
    dense[row, term] = weight
    by_id = dict(zip((np.arange(n)[::-1] * 3).tolist(), range(n), strict=True))
    examples = dense[[by_id[i] for i in index.ids.tolist()]]
    for i in range(0, n, 7):
        t, w = term[row == i], weight[row == i]
        if len(t) == 0:
            continue
        cosines = np.round(examples @ dense[i], 9)
        best = np.lexsort((index.ids, -cosines))[:15]
        best = best[cosines[best] > 0]
        found, near = index.nearest(t, w, 15)
        assert found.tolist() == best.tolist() and np.allclose(near, cosines[best])


def test_rising():
    assert toxicity.rising(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1.0, 1, 1, 2, 1])).round(6).tolist() == [0.1, 0.3, 0.3, 0.3, 0.9]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_tables(spark, documents, module):
    docs = documents([(1, "good words"), (2, None), (3, ""), (None, "good words"), (4, "word " * 60_000), (4, "word"), (6, "\u0000 é 😀")])
    inputs = {"metadata": []} if module is quality else {}
    for rows in ([], [(1, 1, 1), (1, 0, 0), (99, 1, 1), (None, 1, 1), (4, None, None)], [(1, 1, 1), (6, 0, 0), (3, 1, 0)]):
        model = module.train(docs, spark.createDataFrame(rows, LABELS), **inputs)
        scores = module.score(docs, model, **inputs).collect()
        assert len(scores) == 7 and all(0 <= r.score <= 1 for r in scores)
        assert len({r.score for r in scores if r.doc_id in (2, 3)}) == 1
        assert module.score(documents([]), model, **inputs).count() == 0


def test_sample_is_bounded_and_never_from_held_folds(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'x' as text")
    labels = spark.range(600).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    got = labelled_sample(docs, labels, "quality", 5, [0], 100, ["text"])
    ids = [r.doc_id for r in got.collect()]
    assert 50 < len(ids) <= 100
    assert got.where(crc_fold("doc_id", 5) == 0).count() == 0


def test_labels_without_a_document_do_not_use_up_the_bound(spark):
    docs = spark.range(60).selectExpr("id * 50 as doc_id", "'x' as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = labelled_sample(docs, labels, "quality", 5, [], 40, ["text"]).collect()
    assert len({r.doc_id for r in got}) == len(got) == 40 and {r.doc_id for r in got} <= {50 * i for i in range(60)}


def test_of_rows_that_repeat_an_id_the_same_one_is_taken(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.range(5).selectExpr("id as doc_id", "1 as quality")
    taken = [sorted(labelled_sample(d, labels, "quality", 5, [], 9, ["text"]).collect()) for d in (docs, docs.repartition(7), docs.orderBy("text"))]
    assert taken[0] == taken[1] == taken[2] and len(taken[0]) == 5


@pytest.mark.parametrize("module", [quality, toxicity])
def test_what_is_broadcast_needs_no_package_to_be_read(spark, documents, module, tmp_path):
    import pickle
    import subprocess
    import sys

    inputs = {"metadata": []} if module is quality else {}
    model = module.train(documents([(1, "good words"), (2, "bad words")]), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS), **inputs)
    (tmp_path / "model").write_bytes(pickle.dumps(vars(model)))
    read = "import pickle, sys; sys.path = [p for p in sys.path if 'repo' not in p]; print(len(pickle.load(open('model', 'rb'))))"
    out = subprocess.run([sys.executable, "-c", read], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin"})
    assert int(out.stdout) == len(vars(model))


@pytest.mark.parametrize("block", [8, 64])
def test_blocks_that_cannot_matter_are_left_out(monkeypatch, block):
    """The neighbours are those of brute force, and most blocks' postings stay unread."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(block)
    n, groups = 640, 10
    words = np.sort(rng.integers(0, 1 << 60, (groups, 40)).astype(np.uint64), axis=1)
    owner = np.repeat(np.arange(n), 12)
    hashes = np.concatenate([np.sort(rng.choice(words[i * groups // n], 12, replace=False)) for i in range(n)])
    index = toxicity.build(np.arange(n), (np.arange(n) % 3 == 0).astype(int), owner, hashes, np.ones(len(owner), np.int64))
    row, term, weight = index.vectors(owner, hashes, np.ones(len(owner), np.int64), n)
    dense = np.zeros((n, len(index.terms)))
    dense[row, term] = weight
    for i in range(0, n, 41):
        cosines = np.round(dense @ dense[i], 9)
        best = np.lexsort((np.arange(n), -cosines))[:15]
        found, near = index.nearest(term[row == i], weight[row == i], 15)
        assert found.tolist() == best[cosines[best] > 0].tolist() and np.allclose(near, cosines[found])
    assert len(index.blocks) < len(index.examples) and (np.diff(index.starts) > 0).all()
    assert all(index.most[k] == index.weights[index.starts[k] : index.starts[k + 1]].max() for k in range(0, len(index.most), 37))


def test_rarity_counts_all_documents(spark, documents):
    rows = [(i, "common rare" if i < 4 else "common") for i in range(40)]
    index = toxicity.train(documents(rows), spark.createDataFrame([(i, 1, i % 2) for i in range(3, 9)], LABELS), "toxic", 4, [])
    assert len(index.ids) == 6
    had = {1 + np.log(41 / (c + 1)) for c in (40, 4)}
    assert np.allclose(sorted(index.factors), sorted(had))
    assert [x.tolist() if hasattr(x, "tolist") else x for x in toxicity.spread_of(documents([]).select("doc_id", "text"), index.terms)] == [[0, 0], 0]
