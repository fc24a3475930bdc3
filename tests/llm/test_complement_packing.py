"""Packing by complements: counts against plain sums, tokens against the library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tarmac.llm.arrays import buffer_of
from tarmac.llm.complement_packing import Complements, StretchIds, cut_sizes, pack_tightly, places_of

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "don't stop  it's\n\n x", "café au lait, été.   x", "　    y", "a\x1c b\x85 c", "1,2 'st,'re", "x\t\ty \r\n z  ", "×, ÷ .", "w" * 5000]


def packed_counts(counts, capacity):
    """Fill of every sequence, after checking that each piece has one slot."""
    packed = Complements(counts, capacity)
    table, met = packed.table(), np.zeros(capacity + 1, np.int64)
    fill = [[] for _ in range(packed.sequences)]
    for n, first, times, sequence, offset in table.tolist():
        assert first == met[n]
        met[n] += times
        for k in range(times):
            fill[sequence + k].append((offset, n))
    assert (met == counts).all()
    for pieces in fill:
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    return [sum(n for _, n in pieces) for pieces in fill]


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_has_one_place_and_no_sequence_overflows(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    np.add.at(counts, np.minimum(64, 1 + rng.geometric([0.02, 0.05, 0.2][seed % 3], 2000)), 1)
    fill = packed_counts(counts, 64)
    total = int((counts * np.arange(65)).sum())
    assert sum(fill) == total and max(fill) <= 64
    if seed % 3:
        # Short pieces are there to fill what longer ones leave.
        assert len(fill) <= 1.01 * total / 64 + 1


def test_singles_pairs_and_triples_fill_gaps():
    def of(**lengths):
        counts = np.zeros(101, np.int64)
        for n, times in lengths.items():
            counts[int(n[1:])] = times
        return packed_counts(counts, 100)

    assert of(n70=3, n30=3) == [100] * 3
    assert of(n60=2, n25=2, n15=2) == [100] * 2
    assert of(n55=4, n20=4, n15=4, n10=4) == [100] * 4
    assert of(n40=1, n20=3) == [100]
    assert sorted(of(n100=2, n51=3)) == [51, 51, 51, 100, 100]
    assert of(n1=250) == [100, 100, 50] and of() == []


def test_best_fit_where_nothing_fills():
    counts = np.zeros(101, np.int64)
    counts[[70, 60, 29, 39]] = [1, 1, 1, 1]
    assert sorted(packed_counts(counts, 100)) == [99, 99]


def test_only_the_first_piece_is_shorter():
    pieces, lengths, starts = cut_sizes(np.array([1, 10, 11, 25]), 10)
    assert pieces.tolist() == [1, 1, 2, 3] and lengths.tolist() == [1, 10, 1, 10, 5, 10, 10] and starts.tolist() == [0, 0, 0, 1, 0, 5, 15]


def test_places_by_number():
    table = Complements(np.array([0, 0, 5, 0, 3]), 4).table()
    sequence, offset = places_of(table, np.array([2] * 5 + [4] * 3), np.array([0, 1, 2, 3, 4, 0, 1, 2]))
    assert len(set(zip(sequence.tolist(), offset.tolist(), strict=True))) == 8 and set(offset[5:].tolist()) == {0}


@pytest.mark.parametrize("special", [True, False])
def test_stretches_have_the_ids_of_whole_texts(special):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("ab'stRE,.19 \n\té × 　\U0001f600\x1c\x00", k=rng.randrange(50))) for _ in range(1500)]
    texts += ["<|endoftext|> a <|endoftext|>b", "x<|endoftext|>"] if special else []
    encoder = StretchIds(PATH)
    assert encoder.cuttable
    for _ in range(2):
        ids, counts = encoder.encode(*buffer_of(pa.array(texts)))
        expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_a_tokenizer_of_another_kind_encodes_whole_texts():
    encoder = StretchIds(public.path("word_bpe_49k.json"))
    ids, counts = encoder.encode(*buffer_of(pa.array(ODD)))
    assert not encoder.cuttable and ids.tolist() == [i for t in ODD for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]


def whole(rows, texts, length, end=0):
    """Checks every document's pieces and every sequence; gives the number of sequences."""
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_document) == set(texts)
    for i, pieces in by_document.items():
        pieces.sort(key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, end]
        assert [r.piece for r in pieces] == list(range(len(pieces))) and all(len(r.ids) == 4 * r.length for r in pieces)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert all(r.length == length for r in pieces[1:]) and 0 < pieces[0].length <= length
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= length
    return len(by_sequence)


def test_real_documents(real, real_texts):
    rows = pack_tightly(real.repartition(5), PATH).collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert least <= whole(rows, real_texts, 2048) <= least + 1


def test_odd_rows(spark, documents):
    texts = {i: t for i, t in enumerate([None, "", "a", "a", " ".join(str(k) for k in range(3000)), "a <|endoftext|> b", *ODD])}
    rows = pack_tightly(documents(list(texts.items())), PATH, 64).collect()
    whole(rows, texts, 64)
    assert [r.length for r in rows if r.doc_id in (0, 1)] == [1, 1]
    twice = pack_tightly(documents([(1, "a b"), (1, "a b"), (None, "c")]), PATH, 64).collect()
    assert sorted((r.doc_id is None, r.length) for r in twice) == [(False, 3), (False, 3), (True, 2)]
    empty = pack_tightly(documents([]), PATH, 64)
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
