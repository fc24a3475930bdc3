"""Accumulated tables: which files a run opens, and what a lost run leaves."""

import pytest
from pyspark.sql import functions as F

from tarmac.session import shared_dir
from tarmac.sources import accumulate, key_index
from tarmac.streaming import accumulate as stream

SCHEMA = "flight bigint, day string, n int"
KEYS = ["flight", "day"]


def run_of(spark, low, high, day="d", n=1):
    return spark.range(low, high).select(F.col("id").alias("flight"), F.lit(day).alias("day"), F.lit(n).alias("n"))


def stored(spark, path):
    return spark.read.schema(SCHEMA).parquet(path)


def opened(batch, path):
    table = accumulate.existing(batch, path)
    return set(key_index.candidate_files(batch, table, path, KEYS))


@pytest.fixture
def three_runs(spark):
    path = shared_dir(spark, "acc")
    files = []
    for k in range(3):
        before = set(files[-1]) if files else set()
        accumulate.append_new(run_of(spark, 1000 * k, 1000 * k + 500).coalesce(1), path, KEYS)
        files.append(set(stored(spark, path).inputFiles()))
    return path, [files[0], files[1] - files[0], files[2] - files[1]]


def test_a_run_opens_only_files_that_may_hold_its_keys(spark, three_runs):
    path, (first, second, third) = three_runs
    # A range that meets no file, one that meets the second, and keys between others' keys.
    assert opened(run_of(spark, 5000, 5100), path) == set()
    assert opened(run_of(spark, 1100, 1200), path) == second
    assert opened(run_of(spark, 2100, 2200).unionByName(run_of(spark, 100, 101)), path) == first | third
    assert opened(run_of(spark, 600, 900).unionByName(run_of(spark, 2499, 2500)), path) == third


def test_new_rows_read_no_old_file(spark, three_runs):
    path, (first, second, third) = three_runs
    fresh = accumulate.new_rows(run_of(spark, 2400, 2600), path, KEYS)
    read = set(fresh.inputFiles())
    assert third <= read and not (first | second) & read
    assert fresh.count() == 100
    later = accumulate.new_rows(run_of(spark, 9000, 9010), path, KEYS)
    assert not (first | second | third) & set(later.inputFiles()) and later.count() == 10


def test_digests_found_by_chance_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(key_index, "digest", lambda keys: F.pmod(F.xxhash64(*keys), F.lit(3)))
    path = shared_dir(spark, "acc")
    for k in range(3):
        accumulate.append_new(run_of(spark, 100 * k, 100 * k + 150), path, KEYS)
    assert stored(spark, path).count() == stored(spark, path).distinct().count() == 350


def test_a_lost_run_leaves_files_without_entry_that_are_still_read(spark, three_runs, monkeypatch):
    path, _ = three_runs
    with monkeypatch.context() as m:
        m.setattr(key_index, "index_files", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            accumulate.append_new(run_of(spark, 7000, 7100), path, KEYS)
    assert accumulate.new_rows(run_of(spark, 7050, 7150), path, KEYS).count() == 50
    accumulate.append_new(run_of(spark, 7050, 7150), path, KEYS)
    assert stored(spark, path).count() == 1650
    table = stored(spark, path)
    assert key_index.index_files(table, path, KEYS) == 0


@pytest.mark.parametrize("partition", [None, "day"])
def test_nulls_partitions_and_empty_runs(spark, rows, partition):
    path = shared_dir(spark, "acc")
    runs = [
        [(1, "a b", 1), (None, "x+y%", 2), (2, None, 3)],
        [],
        [(None, "x+y%", 9), (2, None, 9), (1, "a b", 9), (None, None, 4)],
        [(None, None, 9), (3, "é", 5)],
    ]
    for run in runs:
        accumulate.append_new(rows(run, SCHEMA), path, KEYS, partition)
    assert sorted(r.n for r in stored(spark, path).collect()) == [1, 2, 3, 4, 5]


def test_an_index_of_other_keys_or_types_does_not_count(spark):
    path = shared_dir(spark, "acc")
    accumulate.append_new(run_of(spark, 0, 10), path, KEYS)
    assert accumulate.new_rows(run_of(spark, 5, 15, "other"), path, ["flight"]).count() == 5
    assert accumulate.new_rows(run_of(spark, 5, 15, "other"), path, KEYS).count() == 10


def test_a_replayed_batch_reads_nothing(spark, tmp_path, monkeypatch):
    target, marks = str(tmp_path / "target"), str(tmp_path / "marks")
    batch = run_of(spark, 0, 20)
    assert stream.append_batch(batch, 0, target, marks, KEYS)

    def never(*_):
        raise AssertionError("a batch that is done was looked at")

    with monkeypatch.context() as m:
        m.setattr(stream, "append_new", never)
        assert not stream.append_batch(batch, 0, target, marks, KEYS, transform=never)
    assert stored(spark, target).count() == 20
    # Another target, and the next number, are batches of their own.
    assert stream.append_batch(batch, 0, target + "2", marks, KEYS)
    assert stream.append_batch(run_of(spark, 10, 30), 1, target, marks, KEYS)
    assert stored(spark, target).count() == 30


def test_a_batch_lost_before_its_mark_is_appended_once(spark, tmp_path, monkeypatch):
    target, marks = str(tmp_path / "target"), str(tmp_path / "marks")
    with monkeypatch.context() as m:
        m.setattr(stream, "mark_done", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            stream.append_batch(run_of(spark, 0, 20), 7, target, marks, KEYS)
    assert not stream.is_done(spark, marks, 7, target)
    assert stream.append_batch(run_of(spark, 0, 20), 7, target, marks, KEYS)
    assert stored(spark, target).count() == 20 and stream.is_done(spark, marks, 7, target)
