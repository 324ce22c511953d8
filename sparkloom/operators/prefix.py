"""Running totals, positions and exact quantiles over a whole table without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.runtime import fixed_broadcast, materialize, parts


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``totals``, the sum of the expression over all rows up to and with this one.

    Rows are range-partitioned by ``order``; sums run within a partition and start at the sum of the
    partitions before, of which there are as many as shuffle partitions. Rows that ``order`` leaves
    equal may come in any order within it, so ``order`` should be unique. Nulls add nothing.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(max(2, parts(spark)), *order).withColumn("_part", F.spark_partition_id())
    cut = materialize(cut, "ranges")
    sums = cut.groupBy("_part").agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in totals.items()])
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_before_{n}") for n in totals])
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(fixed_broadcast(before, parts(spark) + 1), "_part")
    for n, e in totals.items():
        out = out.withColumn(n, F.coalesce(F.sum(e).over(w), F.lit(0)) + F.col(f"_before_{n}"))
    return out.drop("_part", *[f"_before_{n}" for n in totals])


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with the 1-based place of each row in ``order``."""
    return running_totals(df, order, {name: F.lit(1)})


def quantiles(df: DataFrame, value: str, key: str, fractions: list[float]) -> DataFrame:
    """(convention, fraction, value): exact quantiles of the values that are not null, by three conventions.

    ``linear`` interpolates between the neighbours of f (n - 1); ``floor`` takes place floor(n f), at
    most the last, from 0; ``median`` is linear at one half, once.
    """
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(key).alias("k")).where("v is not null")
    placed = materialize(positions(rows, [F.col("v"), F.col("k")]), "placed")
    n = placed.count()
    if not n:
        return df.sparkSession.createDataFrame([], "convention string, fraction double, value double")
    need: set[int] = set()
    for f in [*fractions, 0.5]:
        at = f * (n - 1)
        need |= {int(at) + 1, min(int(at) + 2, n), min(int(n * f), n - 1) + 1}
    got = {r["position"]: r["v"] for r in placed.where(F.col("position").isin(*need)).select("position", "v").collect()}

    def linear(f: float) -> float:
        at = f * (n - 1)
        low, high = got[int(at) + 1], got[min(int(at) + 2, n)]
        return low + (high - low) * (at - int(at))

    out = [("linear", f, linear(f)) for f in fractions] + [("floor", f, got[min(int(n * f), n - 1) + 1]) for f in fractions] + [("median", 0.5, linear(0.5))]
    return df.sparkSession.createDataFrame(out, "convention string, fraction double, value double")
