"""Connected components by rounds of star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import materialize, release


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reached.

    Alternating large-star and small-star steps: each node links its larger neighbours, then its
    smaller ones, to its smallest neighbour. A step pre-aggregates its minimum on the map side and
    joins it back, so that one node with a third of all edges is a skewed join which AQE splits, and
    never a group held by one task. Rounds needed grow with the logarithm of the longest chain.
    Edges with a null end and loops tie nothing; a node of only such edges is not returned. Strings
    compare by code points. An empty table gives an empty result.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(links, "cc")
    for _ in range(max_rounds):
        # a forest of stars: each node names one smaller node, which names none
        stars = now.agg(F.count("*"), F.countDistinct("u")).first()
        if stars[0] == stars[1] and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now, old = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc"), now
        release(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
