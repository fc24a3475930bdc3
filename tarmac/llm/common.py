"""What several operators share: input columns, folds, written tables, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.session import written


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo `folds`; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id and the whole text, null as the empty text; further columns cannot clash."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of an edge can reach.

    `edges` has two long columns a and b. Rounds of large-star and small-star steps turn
    the edges into one star for each component; every step is an aggregate by node, whose
    sums are partial before the shuffle, and a join that can be split where a node is
    hot. Each round is written to the shared folder, so a lost executor costs one round.
    An edge of a node with itself names a component of one.
    """
    current = written(_oriented(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "components")
    before = None
    for _ in range(rounds):
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)") * 31 + F.col("b"))).first())
        if state == before or state[0] == 0:
            break
        before = state
        current = written(_small_star(_large_star(current)), "components")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return current.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.where("b >= a").join(least, "a")
    return _oriented(linked.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return _oriented(
        linked.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select(
            "e.a", "e.b"
        )
    )
