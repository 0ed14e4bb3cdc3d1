"""Connected components as Spark joins: alternating large and small stars.

Each round is two aggregates and two joins on the edges and is written out, so its
lineage is short; rounds grow with the logarithm of a component's diameter. A node
with very many neighbours is a skewed key of an inner join, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable): only nodes other than their component.

    ``edges`` has columns u and v, in any order, repeated or equal; nulls are ignored.
    """
    found = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found, before = stored(found, "edges"), None
    for _ in range(rounds):
        state = found.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == before:
            return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(state)
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = stored(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components aren't stable after {rounds} rounds")
