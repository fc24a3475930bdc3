"""Shuffle files of the rounds of op13 are gone when their tables are written."""

import time

import pytest

from tarmac.llm import collocations as col
from tarmac.llm import exchange

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def left_over(spark, before):
    """What is there beyond what was there before; files are removed in the background."""
    end = time.time() + 20
    while (new := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return new


def test_no_shuffle_file_of_the_rounds_is_left(spark):
    docs = spark.createDataFrame([("en", "one two three, four five six seven")] * 60, "lang string, text string").repartition(3)
    before, setting = shuffle_files(spark), spark.conf.get(SETTING)
    found = col.frequent_phrases(docs, 20)
    assert not left_over(spark, before)
    assert spark.conf.get(SETTING) == setting
    # two, three words of the first piece; two, three and four of the second
    assert len(found.collect()) == 3 + 6


def test_the_setting_is_put_back_after_a_failure(spark):
    setting = spark.conf.get(SETTING)
    with pytest.raises(KeyError), exchange.shuffles_removed(spark):
        assert spark.conf.get(SETTING) == "true"
        raise KeyError
    assert spark.conf.get(SETTING) == setting
