"""Connected components as a distributed union-find by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.llm.common import durable
from opscheck.operators.keyed import probe


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of the links (``a``, ``b``); the smallest node of a component is its root.

    In each round every node is united with its smallest neighbour and follows that one's
    choice; links are then redrawn between what the nodes were united into. The number of
    links left at least halves in each round, and only that they are gone is asked by the driver. A node
    with very many links collapses in the partial aggregate, and the joins on it can be split.
    """
    left = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter("a <> b").distinct())
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = (both.groupBy("a").agg(F.min("b").alias("b"))
                  .select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        onward = choice.select(F.col("node").alias("root"), F.col("root").alias("next"))
        united = durable(probe(choice, onward, "root").select("node", F.col("next").alias("root")))
        ends = united.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        moved = probe(left, ends, "a").select("b", "ra")
        moved = probe(moved, ends.withColumnsRenamed({"a": "b", "ra": "rb"}), "b")
        left = durable(moved.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                       .distinct())
        if found is None:
            found = united
        else:
            onward = united.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = probe(found, onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    smallest = found.groupBy("root").agg(F.min("node").alias("_least"))
    smallest = smallest.select("root", F.least("root", "_least").alias("_least"))
    return probe(found, smallest, "root").select("node", F.col("_least").alias("root"))
