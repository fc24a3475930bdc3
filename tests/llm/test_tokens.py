import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tarmac.llm import packing, sentence_pieces  # noqa: E402
from tarmac.llm.arrays import buffer_of  # noqa: E402

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a  ", "Don't we'll 'rest x''s I'VE", "a b c", "É é H̱ ẖ İ ΣΑΣ K", "12 3.4,5%%% a&&&", "x<|endoftext|>y <|startoftext|>", "\u0000\x1c\x85 tab\tnew\nline\r",
    "😀😀 👩‍👩‍👧", "a" * 3000, "▁x▁ y", "a▁", "▁", "<s>x</s> <unk> <0x41>", "a" + " " * 40 + "b", "\n\n  x   ", "ﬁ ǅ ß ŉ",
]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_encode_like_whole_texts(real_texts):
    import pyarrow as pa

    texts = ODD + [t for t in real_texts.values()][:150]
    for group in (texts, [t for t in texts if "<|" not in t]):
        flat, counts = packing.WordIds(WORDS).encode(*buffer_of(pa.array(group)))
        expected = reference(group)
        assert counts.tolist() == [len(e) - 1 for e in expected]
        assert flat.tolist() == [i for e in expected for i in e[:-1]]


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_fill_sequences(documents, monkeypatch, length):
    monkeypatch.setattr(packing, "WINDOW", 3000)
    rng = np.random.default_rng(length)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "gamma's", "x!"], int(n))) for n in rng.integers(0, 300, 60)] + ["word " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None)]
    pieces = packing.pack(documents(rows).repartition(2), WORDS, length).toPandas()
    expected = dict(zip(range(len(texts)), reference(texts), strict=True)) | {900: [2]}
    for doc, part in pieces.groupby("doc_id"):
        part = part.sort_values("start")
        assert np.concatenate([np.frombuffer(b, "<u4") for b in part.ids]).tolist() == expected[doc]
        assert (part.start.values == np.cumsum(part.length.values) - part.length.values).all() and (part.doc_tokens == len(expected[doc])).all()
    assert set(pieces.doc_id) == set(expected)
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.values == np.cumsum(s.length.values) - s.length.values).all()
        total = int(s.length.sum())
        assert total <= length and (total == length or total & (total - 1) == 0)


def test_sequences_are_balanced_and_little_is_cut():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(6, 1, 4000).astype(int) + 1, 40_000)
    pieces = packing.pack_window(sizes, 4096, 1.0, 1 / 12288)
    assert pieces[:, 2].sum() == sizes.sum()
    cost = np.bincount(pieces[:, 3], weights=pieces[:, 2] + pieces[:, 2] ** 2 / 12288)
    total = np.bincount(pieces[:, 3], weights=pieces[:, 2])
    mixed = np.bincount(pieces[:, 3]) > 1
    full = (total == 4096) & mixed
    assert (cost[full].max() - cost[full].min()) / cost[full].mean() < 0.35
    assert len(pieces) - len(sizes) - (sizes // 4096).sum() < full.sum()


def test_packing_odd_tables(documents):
    assert packing.pack(documents([]), WORDS).count() == 0
    rows = packing.pack(documents([(None, "a"), (3, "a"), (3, "a")]).coalesce(1), WORDS).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows) == [("3", 2), ("3", 2), ("None", 2)]
    costs = packing.sequence_costs(packing.pack(documents([(1, "a b c")]), WORDS)).collect()
    assert [(r.tokens, round(r.cost, 6)) for r in costs] == [(4, round(4 + 16 / 12288, 6))]


def test_sentence_pieces_agree_and_round_trip(documents, real_texts):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(enumerate(ODD + list(real_texts.values())[:120]))
    encoded = sentence_pieces.encode(documents([*texts.items(), (5000, None)]), PIECES, back=True)
    rows = {r.doc_id: r for r in sentence_pieces.decode(encoded.withColumnRenamed("decoded", "back"), PIECES).collect()}
    for i, t in texts.items():
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == other.encode(t), t
        assert rows[i].n_unlike == 0
        assert rows[i].decoded == rows[i].back == t.replace("▁", " ")
    assert rows[5000].ids == b"" and rows[5000].decoded == ""
    assert sentence_pieces.encode(documents([]), PIECES).count() == 0


def unigram(tmp_path, **flags):
    """A unigram model written by hand; the library never trains one here."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    byte_fallback = flags.pop("byte_fallback")
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
    pieces += [(f"<0x{i:02X}>", 0, 6) for i in range(256)] if byte_fallback else []
    rng = np.random.default_rng(3)
    spelled = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁abc", "ca", "cab", "▁b", "é"]
    pieces += [(p, float(-s), 1) for p, s in zip(spelled, rng.uniform(1, 9, len(spelled)), strict=True)]
    for piece, score, kind in pieces:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, byte_fallback
    model.normalizer_spec.name = "identity"
    for key in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"):
        setattr(model.normalizer_spec, key, flags.get(key, key != "remove_extra_whitespaces"))
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("flags", [{}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": True}])
def test_unigram_models(tmp_path, flags):
    import pyarrow as pa
    import sentencepiece

    path = unigram(tmp_path, byte_fallback=True, **flags)
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abc é"), n)) for n in rng.integers(0, 40, 200)] + ["xyz 😀", "a  b", " a "]
    flat, counts, unlike = sentence_pieces.Stretches(path).encode(pa.array(texts))
    parts = np.split(flat, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [other.encode(t) for t in texts] and unlike.sum() == 0


def test_other_kinds_are_an_error(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.pieces.add(piece="<unk>", score=0, type=2)
    model.trainer_spec.model_type = 3
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="model type"):
        sentence_pieces.rebuild(str(tmp_path / "m"))
