"""Set-similarity join of two tables by prefixes of rare tokens, exact at its threshold."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar(left: DataFrame, lkey: str, right: DataFrame, rkey: str, column: str, t: Fraction) -> DataFrame:
    """(lkey, rkey, jaccard) of all pairs whose sets in ``column`` (arrays without repeats) have similarity t or more.

    Tokens are ordered by how many sets of both sides hold them, rare first. Only the first
    |x| - ceil(t |x|) + 1 tokens of each set are joined: similar sets share one of them. Pairs are then
    checked on the sets. Empty and null sets have no partner.
    """
    n, d = t.numerator, t.denominator
    sides = []
    for df, key in ((left, lkey), (right, rkey)):
        sides.append(df.where(F.size(column) > 0).select(F.col(key).alias("key"), F.col(column).alias("set")))
    often = sides[0].select(F.explode("set").alias("tok")).union(sides[1].select(F.explode("set").alias("tok"))).groupBy("tok").agg(F.count("*").alias("df"))
    cut = []
    for s in sides:
        each = s.select("key", F.explode("set").alias("tok")).join(often, "tok").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("xs"))
        size = F.size("xs")
        first = F.slice("xs", 1, size - F.ceil(size * n / d).cast("int") + 1)
        cut.append(each.select("key", F.explode(first).alias("x")).select("key", F.col("x.tok").alias("tok")))
    pairs = cut[0].withColumnRenamed("key", "a").join(cut[1].withColumnRenamed("key", "b"), "tok").select("a", "b").distinct()
    full = pairs.join(sides[0].select(F.col("key").alias("a"), F.col("set").alias("sa")), "a").join(sides[1].select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return full.where(both * d >= union * n).select(F.col("a").alias(lkey), F.col("b").alias(rkey), (both / union).alias("jaccard"))
