"""The pipeline on a small folder of its own, against plain Python for each stage."""

import hashlib

import numpy as np
import pytest
from test_near_copies_stage import smallest_of_groups
from test_suffix_dedup import brute as brute_passages

import corpus_pipeline
from tarmac.llm import catalog, quality, stages, toxicity

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def kept(spark, folder):
    """The documents after each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_stages_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.without_toxic, stages.good_enough, stages.one_of_each_group, stages.without_repeated_passages, stages.packed]


def test_columns_of_documents_stay(kept):
    for df in kept[1:5]:
        assert df.dtypes == kept[0].dtypes


def test_rejected_documents_go(spark, folder, kept):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = toxicity.score(kept[0], toxicity.train(kept[0], labels)).where(f"score >= {stages.TOXIC}")
    assert set(texts(kept[1])) == set(texts(kept[0])) - {r.doc_id for r in toxic.collect()}
    bad = quality.score(kept[1], quality.train(kept[1], labels)).where(f"score < {stages.GOOD}")
    assert set(texts(kept[2])) == set(texts(kept[1])) - {r.doc_id for r in bad.collect()}
    assert 0 < len(texts(kept[2])) < len(texts(kept[0]))


def test_one_document_of_each_group_stays(kept):
    assert set(texts(kept[3])) == smallest_of_groups(list(texts(kept[2]).items()))


def test_repeated_passages_go(kept):
    before, after = texts(kept[3]), texts(kept[4])
    assert set(before) == set(after)
    expected = {i: digest for i, *_, digest in brute_passages(list(before.items()))}
    for i, t in after.items():
        if "�" not in t:
            assert hashlib.sha256(t.encode()).hexdigest() == expected[i]
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())


def test_all_tokens_are_packed(kept):
    pieces = kept[5].toPandas()
    assert set(pieces.doc_id) == set(texts(kept[4]))
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096


def test_run_gives_the_last_stage(spark, folder, kept):
    # Where documents are cut depends on how tasks read them, their tokens do not.
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == kept[5].columns
    tokens = [{(r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").collect()} for df in (got, kept[5])]
    assert tokens[0] == tokens[1]


def test_rows_without_an_id_or_text_pass(spark, folder, documents):
    rows = [(None, "Some plain words here."), (1, None), (2, ""), (3, "Some plain words here, and more.")]
    docs = documents(rows).selectExpr("doc_id", "text", "label as lang", "score as source", "cast(1 as bigint) as n_chars", "kept", "ids")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "ids"]
    left = {r.doc_id for r in docs.collect()}
    assert None in left
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_queries_and_sql(spark, folder):
    from oracle import compare, connect

    assert sorted(catalog.QUERIES, key=lambda n: int(n[2:].split("_")[0])) and len(catalog.QUERIES) == 13
    duck = connect(folder)
    for name, sql in catalog.ORACLES.items():
        assert compare(spark, duck, folder, catalog.QUERIES[name], sql) is None, name
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"op2_quality", "op3_toxicity", "op4_packing", "op5_sentence_pieces", "op9_language_model", "op11_complement_packing"}


def test_query_columns(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    import zlib

    out = catalog.QUERIES["op4_packing"](spark, folder).toPandas()
    docs = texts(spark.read.parquet(f"{folder}/documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out.sample(40, random_state=1).itertuples():
        ids = np.array([*tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids) == r.doc_tokens
    for name, columns in (("op2_quality", ["doc_id", "held_out", "score", "predicted"]), ("op3_toxicity", ["doc_id", "held_out", "score", "predicted", "evidence"])):
        assert catalog.QUERIES[name](spark, folder).columns == columns
    pieces = catalog.QUERIES["op5_sentence_pieces"](spark, folder)
    assert pieces.where("not round_trip or n_unlike > 0").count() == 0 and pieces.count() == len(docs)
