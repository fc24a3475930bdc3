import re

import numpy as np
import pytest

from tarmac.llm import jaccard_join as jj

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    return frozenset(zip(words, words[1:], words[2:])) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def brute(rows, percent=90):
    """Expected (id, size, component) of each row."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    linked = [(i, s) for i, s in sets if i is not None and s]
    label = {i: i for i, _ in linked}
    for _ in range(len(linked)):
        before = dict(label)
        for i, s in linked:
            for j, t in linked:
                if label[i] != label[j] and 100 * len(s & t) >= percent * len(s | t):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return sorted(((i, len(s), label.get(i, i) if i is not None else None) for i, s in sets), key=str)


def got(docs, percent=90):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.linked_texts(docs, percent).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def family(rng, n, length, most):
    base = [f"w{rng.integers(1 << 30)}" for _ in range(length)]
    return [edited(rng, base, int(rng.integers(0, most + 1))) for _ in range(n)]


@pytest.mark.parametrize("cell", [512, 12])
def test_families_as_brute_force(documents, monkeypatch, cell):
    monkeypatch.setattr(jj, "CELL", cell)
    monkeypatch.setattr(jj, "LEAF", 4)
    rng = np.random.default_rng(cell)
    texts = family(rng, 40, 120, 4) + family(rng, 30, 200, 6) + family(rng, 12, 60, 1) + [f"own{i} text{i} words{i} here{i}" for i in range(20)]
    texts += ["common line of words " + t for t in family(rng, 20, 12, 3)]
    rows = list(enumerate(rng.permutation(texts).tolist()))
    assert got(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (None, "one two three"), (7, "ONE two\nthree"), (8, "one"), (9, long), (10, long + " end"), (11, "é É x"), (12, "é É X"), (13, "é é x")]
    assert got(documents(rows)) == brute(rows)
    assert got(documents([])) == []
    again = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (3, "other words are here")]
    assert got(documents(again)) == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (3, 2, 3)], key=str)


def test_other_thresholds(documents):
    rng = np.random.default_rng(9)
    rows = list(enumerate(family(rng, 25, 60, 5)))
    for percent in (60, 100):
        assert got(documents(rows), percent) == brute(rows, percent)


def test_real_documents(real, real_texts):
    assert got(real) == brute(list(real_texts.items()))


def test_linked_sets_share_their_first_shingles():
    n = np.arange(1, 500)
    for percent in (50, 90, 100):
        first, need = jj.first_sizes(n, percent)
        o = jj.least_overlap(n, percent)
        assert (100 * o >= percent * n).all() and (first <= n).all()
        for size in (1, 7, 55, 300):
            partners = n[(n >= o[size - 1]) & (o <= size)]
            for m in partners:
                overlap = max(o[size - 1], o[m - 1])
                k = min(first[size - 1] - (size - overlap), first[m - 1] - (m - overlap))
                assert k >= need[size - 1]
