"""Phrases of words against plain Python over all documents."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarmac.llm import collocations as col
from tarmac.llm import exchange

LOWERED = {c: c + 32 for c in range(65, 91)}


def counted(rows, longest):
    """Occurrences of every phrase, and words, by language."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f, n


def brute(rows, least, longest=5, most=2000, cover=100):
    f, n = counted(rows, longest)
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        scored.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out += [(lang, r, p, a, left, right, n[lang], score) for r, (score, a, p, left, right) in enumerate(scored[:most], 1)]
    return sorted(out)


def found(spark, rows, *arguments, parts=3, **options):
    made = spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, a int")
    return sorted(tuple(r) for r in col.collocations(made.repartition(parts), *arguments, **options).collect())


def prose(seed, documents, vocabulary="abcdefgh", langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [c * rng.randrange(1, 4) for c in vocabulary]
    phrases = [rng.sample(words, k) for k in (2, 3, 4, 5, 5, 6)]
    rows = []
    for _ in range(documents):
        text = []
        for _ in range(rng.randrange(1, 25)):
            text += rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(words)]
            text.append(rng.choice(["", "", "", ".", ", ", "\n", "A", "é!"]))
        rows.append((rng.choice(langs), " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "options"), [(0, (8, 5, 2000, 100)), (1, (3, 3, 10, 100)), (2, (5, 4, 50, 60)), (3, (4, 2, 2000, 100))])
def test_equals_brute_force(spark, seed, options):
    rows = prose(seed, 150)
    expected = brute(rows, *options)
    assert expected and found(spark, rows, *options) == expected


def test_many_small_shards_and_buckets(spark, monkeypatch):
    rows = prose(7, 200)
    expected = brute(rows, 6)
    monkeypatch.setattr(exchange, "DOCUMENTS", 3)
    assert found(spark, rows, 6, parts=8) == expected


@pytest.mark.parametrize("bits", [0, 2, 6])
def test_short_hashes_that_are_shared_change_nothing(spark, monkeypatch, bits):
    """Rare pairs and triples that share the short hash of others stay for a while, and count by their own."""
    rows = prose(11, 120)
    monkeypatch.setattr(col, "short_bits", lambda size: np.uint64(((1 << bits) - 1) << (64 - bits)))
    assert found(spark, rows, 6) == brute(rows, 6)


def test_a_phrase_is_counted_over_all_shards(spark):
    rows = [("en", "one two three")] * 100 + [("en", "one two")] * 99 + [("fr", "one two")] * 99
    assert found(spark, rows, 100, parts=9) == brute(rows, 100) == [
        ("en", 1, "one two", 199, 199, 199, 498, 2502),
        ("en", 2, "one two three", 100, 199, 100, 498, 2502),
    ]


def test_ties_overlaps_and_separators(spark):
    rows = [("en", "a a a a a, b\tb  b;C c.c!"), ("en", "A A\x0bA"), ("x.y", "a\x0ca b. a"), ("en", "b b b")] * 3
    for least in (1, 3):
        assert found(spark, rows, least) == brute(rows, least)


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", None), ("", "p q p q"), ("und", "p q"), (None, "p q r"), ("en", " \t\n.,"), ("en", "\x00 \x00 \x00")]
    assert found(spark, rows, 1) == brute(rows, 1)
    long = [("en", "alpha beta gamma " * 60_000)]
    assert found(spark, long, 100) == brute(long, 100)
    assert found(spark, rows[:3], 1) == [] == found(spark, [], 1)
    with pytest.raises(ValueError):
        found(spark, rows, 1, 1)


def test_scores_beyond_64_bits(spark):
    """The decimals of the score against whole numbers of any size."""
    a, n, left, right = 10**15 + 7, 4 * 10**17 + 3, 10**16 + 1, 3 * 10**15 + 11
    row = spark.createDataFrame([([left], [right], a, n)], "ls array<long>, rs array<long>, a long, n long")
    assert row.select(col.lowest_cut()["score"].alias("s")).first().s == 1000 * a * n // (left * right)


def test_index_lists_all_phrases_with_heads_and_tails():
    rng = np.random.default_rng(1)
    for _ in range(60):
        ids = np.concatenate([[0], rng.integers(0, rng.integers(2, 7), rng.integers(1, 60)), [0]]).astype(np.uint32)
        depth, hashes = int(rng.integers(2, 6)), np.concatenate([[0], rng.integers(1, 1 << 62, 6)]).astype(np.uint64)
        listed = col.phrases(ids, hashes, depth)

        def spelled(level, i, listed=listed):
            p = listed[level]
            return (int(p.first[i]), *(spelled(level - 1, p.tail[i]) if level else ()))

        for k, p in enumerate(listed):
            windows = [tuple(ids[i : i + k + 1].tolist()) for i in range(len(ids) - k)]
            assert {spelled(k, i): int(c) for i, c in enumerate(p.counts)} == Counter(w for w in windows if 0 not in w)
            if k:
                assert all(spelled(k - 1, p.head[i]) == spelled(k, i)[:-1] for i in range(len(p.counts)))


def test_extension_keeps_both_directions_in_step():
    rng = np.random.default_rng(2)
    ids = np.concatenate([[0], rng.integers(0, 5, 400), [0]]).astype(np.uint32)
    forward, reverse = col.Index(ids, 4), col.Index(ids[::-1], 4)
    starts, sizes, _ = forward.roots()
    near, far = (starts, sizes, starts), (starts, sizes, starts)
    for _ in range(3):
        f, r = forward.extended(*near), reverse.extended(*far)
        assert sorted(f[4].tolist()) == r[0].tolist() and sorted(r[4].tolist()) == f[0].tolist()
        near, far = (f[0], f[1], f[4]), (r[0], r[1], r[4])


def test_stretches_keep_what_runs_cover():
    ids = np.array([0, 1, 2, 3, 4, 0, 5, 6, 7, 0], np.uint32)
    hashes = np.arange(1, 8, dtype=np.uint64)
    at, runs = col.runs_of(ids, hashes, 3)
    assert at.tolist() == [1, 2, 6] and runs[0] == ((hashes[:1] * col.BASE + hashes[1:2]) * col.BASE + hashes[2:3])[0]
    assert col.stretches(ids, at[[0]], 3).tolist() == [0, 1, 2, 3, 0]
    assert col.stretches(ids, at[[1, 2]], 3).tolist() == [0, 2, 3, 4, 0, 5, 6, 7, 0]
    assert col.stretches(ids, np.array([1, 3]), 2).tolist() == [0, 1, 2, 0, 3, 4, 0] and col.stretches(ids, at[:0], 3).tolist() == [0]
