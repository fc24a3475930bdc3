import pytest

CLASHING = "label string, score string, held string, payload string, ids string, set_id string, kept string, m0 string, embedding2 string"


@pytest.fixture
def documents(spark):
    """A table of documents from (id, text), with further columns whose names operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, *["x"] * 9) for i, t in rows], f"doc_id long, text string, {CLASHING}")

    return make


@pytest.fixture(scope="session")
def real(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def real_texts(real):
    return {r.doc_id: r.text or "" for r in real.select("doc_id", "text").collect()}
