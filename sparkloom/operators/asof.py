"""As-of join without one task per key: running last values over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.runtime import fixed_broadcast, materialize, parts


def latest_before(left: DataFrame, right: DataFrame, by: str, at: str, key: str, value: str) -> DataFrame:
    """(key, value): for each left row the value of the last right row with the same ``by`` and at most its ``at``.

    Both sides are merged in order of (by, at), right rows first, and range-partitioned; within a partition
    the last value runs on, and each partition starts from the last of those before it. Of right rows at one
    place the largest value counts. Left rows without an earlier right row get null; null ``by`` or ``at`` take no part.
    """
    spark = left.sparkSession
    kinds = dict(left.dtypes) | dict(right.dtypes)
    r = right.where(F.col(value).isNotNull()).select(by, at, F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(kinds[key]).alias(key))
    both = r.unionByName(left.select(by, at, F.lit(1).alias("_side"), F.lit(None).cast(kinds[value]).alias("_v"), key)).where(F.col(by).isNotNull() & F.col(at).isNotNull())
    order = [F.col(by), F.col(at), F.col("_side"), F.col("_v")]
    cut = materialize(both.repartitionByRange(max(2, parts(spark)), by, at, "_side").withColumn("_part", F.spark_partition_id()), "asof")
    mark = F.when(F.col("_side") == 0, F.struct(by, "_v"))
    tails = cut.where("_side = 0").groupBy("_part").agg(F.max_by(F.struct(by, "_v"), F.struct(by, at, "_v")).alias("_t"))
    known = cut.select("_part").distinct().join(tails, "_part", "left")
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = known.select("_part", F.last("_t", ignorenulls=True).over(w).alias("_before"))
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    got = cut.join(fixed_broadcast(before, parts(spark) + 1), "_part").withColumn("_last", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.col("_before")))
    return got.where("_side = 1").select(key, F.when(F.col(f"_last.{by}") == F.col(by), F.col("_last._v")).alias(value))
