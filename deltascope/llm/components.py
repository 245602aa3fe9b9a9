"""Connected components by alternating star contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Every vertex of ``edges`` (a, b) with the smallest vertex it can reach: v, component.

    Self-loops, repeated and reversed edges are allowed; nulls are ignored; no edges give no rows.
    """
    pairs = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n, before = pairs.count(), None  # no later round has more edges
    for _ in range(most_rounds):
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        joined = large.join(least, large["b"] == least["u"])
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        pairs = materialize(small, n)
        now = pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("b").alias("v"), F.col("a").alias("component")).union(pairs.select("a", "a").distinct())
