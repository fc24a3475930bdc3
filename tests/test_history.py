"""The log of runs: what counts after runs are repeated."""

import pytest
from pyspark.sql import functions as F

from tarmac.session import shared_dir
from tarmac.sources import history

SCHEMA = "dep string, month string, n int"


def months(df):
    return {(r.run, r.month): r.n for r in df.groupBy("run", "month").agg(F.sum("n").alias("n")).collect()}


def test_a_repeated_run_leaves_nothing_of_the_one_before(spark, rows):
    path = shared_dir(spark, "history")
    history.save_history(rows([("A", "m1", 1), ("A", "m2", 2)], SCHEMA), path, "month", run="x")
    history.save_history(rows([("A", "m1", 10)], SCHEMA), path, "month", run="y")
    history.save_history(rows([("A", "m2", 5)], SCHEMA), path, "month", run="x")
    assert months(history.load_history(spark, path)) == {("x", "m2"): 5, ("y", "m1"): 10}
    history.save_history(rows([], SCHEMA), path, "month", run="x")
    assert months(history.load_history(spark, path)) == {("y", "m1"): 10}


def test_plain_and_keyed_runs_and_all_layouts_share_a_table(spark, rows):
    path = shared_dir(spark, "history")
    for n, (partition, run) in enumerate([("month", None), ("month", None), ("month", "007"), (None, "7"), ("dep", "x=1/ y")]):
        history.save_history(rows([("A", "m1", 10**n)], SCHEMA), path, partition, run)
    loaded = history.load_history(spark, path)
    assert months(loaded) == {(None, "m1"): 11, ("007", "m1"): 100, ("7", "m1"): 1000, ("x=1/ y", "m1"): 10000}
    assert history.load_history(spark, path, SCHEMA).where("month = 'm1'").count() == 5


def test_a_write_that_fails_changes_nothing(spark, rows):
    path = shared_dir(spark, "history")
    history.save_history(rows([("A", "m1", 1)], SCHEMA), path, "month", run="x")
    bad = rows([("A", "m1", 2)], SCHEMA).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        history.save_history(bad, path, "month", run="x")
    assert months(history.load_history(spark, path)) == {("x", "m1"): 1}


def test_replaced_folders_can_be_removed(spark, rows):
    path = shared_dir(spark, "history")
    for n in (1, 2, 3):
        history.save_history(rows([("A", "m1", n)], SCHEMA), path, "month", run="x")
    history.save_history(rows([("B", "m1", 4)], SCHEMA), path, "month")
    assert len(history.remove_replaced(spark, path)) == 2 and history.remove_replaced(spark, path) == []
    assert months(history.load_history(spark, path)) == {("x", "m1"): 3, (None, "m1"): 4}


def test_runs_with_other_columns_and_no_history(spark, rows):
    path = shared_dir(spark, "history")
    with pytest.raises(ValueError):
        history.load_history(spark, path)
    history.save_history(rows([("A", "m1", 1)], SCHEMA), path, "month")
    assert history.load_history(spark, path).columns == ["dep", "n", "month"]
    history.save_history(rows([("A", "m1", "new")], "dep string, month string, note string"), path, "month")
    assert sorted(str(tuple(r)) for r in history.load_history(spark, path).select("n", "note").collect()) == ["(1, None)", "(None, 'new')"]
