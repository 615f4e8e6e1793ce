"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import stash


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (long) to ``node, component``: the smallest node reachable, for each node with a link.

    In each round every node points to its neighbour of the smallest hash, if
    that is below its own; pointers are followed four steps and the links drawn
    between what they point to. Hashes are new in each round, so chains of any
    order shrink by a constant factor. Only minima are kept for each node, so a
    node with many links is combined before the shuffle. Links with nulls and
    from a node to itself are dropped.
    """
    edges = stash(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        hashed = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rounds)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), hashed("b").alias("to")), F.struct(F.col("b").alias("node"), hashed("a").alias("to")))).alias("e")).select("e.*")
        step = stash(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(F.col("to"), hashed("node"))["n"].alias("to")), "pointers")
        for _ in range(2):
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("onward"))
            step = stash(step.join(onward, "to", "left").select("node", F.coalesce("onward", "to").alias("to")), "pointers")
        moved = step.select(F.col("node").alias("root"), "to")
        nodes = stash(nodes.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        end = lambda side: step.select(F.col("node").alias(side), F.col("to").alias(f"{side}2"))  # noqa: E731, B023
        drawn = edges.join(end("a"), "a").join(end("b"), "b").where("a2 <> b2")
        edges = stash(drawn.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    smallest = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(smallest, "root").select("node", "component")
