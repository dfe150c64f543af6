"""Connected components over a table of links, with joins and group-bys only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.shared import cut


SALTS = 8


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m`` of their node a from ``least`` (a, m); a node's edges are dealt out to several tasks."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    every = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every.hint("shuffle_merge"), ["a", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of every node of ``links`` (a, b); root is the smallest node that links lead to.

    Large stars and small stars in turn: every node hands its larger neighbours, then its
    smaller ones, to the smallest of them, until nothing changes.  Nodes may be of any
    type that can be compared.  Nulls link nothing.  The number of rounds grows with the
    logarithm of the longest chain, and no neighbourhood is ever gathered in one row or task.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = cut(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, down).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    tops = edges.select(F.col("b").alias("a")).distinct().join(roots.select("a").hint("shuffle_merge"), "a", "left_anti").select("a", F.col("a").alias("root"))
    return roots.unionByName(tops).withColumnRenamed("a", "node")
