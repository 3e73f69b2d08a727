"""Connected components by alternating stars over link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import keep


def _smallest(links: DataFrame) -> DataFrame:
    """Each node ``u`` with its smallest neighbour or itself; map-side, so a hub stays in no one task."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(u, root)`` for every node of ``links (u, v)``: the smallest node it is connected with.

    Large-star links a node's larger neighbours to its smallest neighbour, small-star its
    smaller ones; each round about halves the distance to the root and is written once.
    When a round leaves the links as they were, every node links to its root. Null ends and
    loops are no links. The number of rounds grows with the logarithm of the longest chain;
    ``rounds`` only guards against a fault and raises.
    """
    links = keep(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = _both_ways(links)
        large = both.join(_smallest(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _smallest(large)
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = keep(small.filter(F.col("u") != F.col("v")).distinct(), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select("u", F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")
