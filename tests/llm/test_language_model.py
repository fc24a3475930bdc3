import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from tarmac.llm import exchange, language_model as lm
from tarmac.llm.arrays import buffer_of, word_hashes

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL)), None]


def trained(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def check(rows, got):
    counts = collections.Counter(w for i, t in rows if trained(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), not trained(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 or n == 0 for r in got)


def test_base_scores(real, real_texts):
    got = lm.score(real).collect()
    check(list(real_texts.items()), got)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, "a b A"), (None, "a c"), (4, "word " * 70_000), (4, "a"), (18, "never seen before"), (5, "é É")]
    check(rows, lm.score(documents(rows)).collect())
    assert lm.score(documents([])).count() == 0
    only_held = [(i, "a b") for i in range(100) if not trained(i)][:3]
    check(only_held, lm.score(documents(only_held)).collect())


def test_model_beats_the_base_on_held_out_texts(documents):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(900):
        at, text = int(rng.integers(40)), []
        for _ in range(60):
            text.append(words[at])
            at = (at + int(rng.choice([1, 2, 7]))) % 40
        rows.append((i, " ".join(text)))
    held = [r for r in lm.score(documents(rows)).collect() if r.held_out]
    base, model = (sum(getattr(r, c) for r in held) / sum(r.n_tokens for r in held) for c in ("base_score", "score"))
    assert model > base + 0.15


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    m = lm.start(rng.integers(1, 1 << 60, 30).astype(np.uint64), rng.integers(1, 50, 30), 2000, 90)
    m.target = rng.normal(0, 1, m.target.shape)
    a, b, log_sum = m.tables()
    for one, two in [(0, 1), (30, 31), (31, 31), (5, 29)]:
        assert np.isclose(np.exp(a[one].astype(float) + b[two] - log_sum[one, two]).sum(), 1, atol=1e-4)
    # The class of other words is shared out to the other types and one that is unseen.
    other = m.tokens + m.types - (m.counts + 1).sum() + 1
    assert np.isclose(np.exp(m.log_other()), other)


def test_histories():
    one, two = lm.histories(np.array([5, 6, 7, 8, 9]), np.array([3, 1, 1]), 99)
    assert one.tolist() == [99, 5, 6, 99, 99] and two.tolist() == [99, 99, 5, 99, 99]


def test_rows_of_an_exchange_survive():
    arrays = [np.arange(5, dtype=np.int64) * 1_000_003, np.zeros(0, np.uint32), np.frombuffer("é x".encode(), np.uint8)]
    back = exchange.load(exchange.dump(*arrays))
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(arrays, back, strict=True))
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (exchange.sums(exchange.deltas(hashes)) == hashes).all()
    edges = exchange.bucket_edges(hashes, 7)
    assert edges[0] == 0 and edges[-1] == 1000 and all(int(h) * 7 >> 64 == b for b in range(7) for h in hashes[edges[b] : edges[b + 1]])


def test_words_and_hashes():
    texts = ["A b\x0b\x0cc", "", "a", " é x ", "b"]
    hashes, owner = word_hashes(*buffer_of(pa.array(texts)))
    assert owner.tolist() == [0, 0, 0, 2, 3, 4]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[5] and len(set(hashes.tolist())) == 4
