"""The toxicity index holds all terms of its examples, also those that tell nothing about the label."""

import numpy as np

from tarmac.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_copy_without_label_words_finds_its_example(spark, documents):
    rng = np.random.default_rng(8)
    plain = [" ".join(chr(97 + int(c)) * 3 + "abcdefghij"[int(d)] for c, d in rng.integers(0, (26, 10), (40, 2))) for _ in range(60)]
    rows = [(i, t + (" vile" if i < 20 else "")) for i, t in enumerate(plain)]
    # Example 50 is labelled as toxic, but has none of the words that go with the label.
    labels = spark.createDataFrame([(i, 1, int(i < 20 or i == 50)) for i, _ in rows], LABELS)
    index = toxicity.train(documents(rows), labels, "toxic", 4, [])
    words = {w for _, t in rows for w in t.split()}
    assert len(index.terms) == len(words)
    got = toxicity.score(documents([(100, plain[50]), (101, "vile"), (102, "unheardof"), (103, None)]), index).toPandas().set_index("doc_id")
    assert got.evidence[100][0] == 50 and np.isclose(got.cosines[100][0], 1)
    assert set(got.evidence[101]) <= set(range(20))
    assert got.score[102] == got.score[103] == index.bare and len(got.evidence[102]) == 0


def test_cosines_are_over_all_terms():
    rng = np.random.default_rng(5)
    n, words = 700, np.sort(rng.integers(0, 1 << 60, 900).astype(np.uint64))
    sets = [np.unique(np.minimum(rng.geometric(0.02, 25), 900) - 1) for _ in range(n)]
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    hashes, counts = words[np.concatenate(sets)], rng.integers(1, 5, len(owner))
    labels = (rng.random(n) < 0.3).astype(int)
    index = toxicity.build(np.arange(n), labels, owner, hashes, counts)
    assert 0 < index.frequent.shape[1] < len(index.terms) == len(np.unique(hashes))
    rarity = {h: np.log((n + 1) / (c + 1)) + 1 for h, c in zip(*np.unique(hashes, return_counts=True), strict=True)}
    at = np.searchsorted(words, hashes)
    factor = np.array([index.factors[np.searchsorted(index.terms, h)] for h in hashes])
    assert (factor >= [rarity[h] - 1e-9 for h in hashes]).all()
    dense = np.zeros((n, len(words)))
    dense[owner, at] = (1 + np.log(counts)) * factor
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, term, weight = index.vectors(owner, hashes, counts, n)
    for i in range(0, n, 9):
        cosines = np.round(dense @ dense[i], 9)
        best = np.lexsort((np.arange(n), -cosines))[:15]
        found, near = index.nearest(term[row == i], weight[row == i], 15)
        assert index.ids[found].tolist() == best.tolist() and np.allclose(near, cosines[best])
