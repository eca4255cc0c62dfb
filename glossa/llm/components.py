"""Connected components of a link table by alternating large and small stars, no link list in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import materialize


def _pairs(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest node around."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _pairs(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select("a", F.col("m").alias("b"))
    return _pairs(moved.unionByName(least.select(F.col("b").alias("a"), F.col("m").alias("b"))))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of links (a, b) but the roots; the root is the component's smallest node.

    The number of rounds grows with the logarithm of the longest chain; each round is a table of its own.
    """
    links = materialize(_pairs(links), name)
    state = _state(links)
    while state[0]:
        links = materialize(_small_star(_large_star(links)), name)
        state, before = _state(links), state
        if state == before:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
