"""Every registered query on the smallest tables, against its SQL."""

import pytest

from oracle import compare, connect

import __spark_entry__ as entry
from tarmac.catalog import ORACLES as SQL
from tarmac.catalog import QUERIES

TRAINED = [n for n in QUERIES if n not in SQL]


@pytest.fixture(scope="module")
def duck(folder):
    pytest.importorskip("duckdb")
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, duck, name):
    assert compare(spark, duck, folder, QUERIES[name], SQL[name]) is None


def test_only_trained_models_go_without_sql():
    assert set(TRAINED) == {
        "train_logreg",
        "train_decision_tree",
        "train_random_forest",
        "score_batch",
        "score_with_label",
        "score_upcoming",
        "compare_handlers",
    }


def test_sql_names_only_registered_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:3] == ["dep", "classification", "flights"]
    assert result.count() > 0
