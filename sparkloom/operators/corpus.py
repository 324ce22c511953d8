"""Fingerprints, differences and statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import doc_digest


def digests(docs: DataFrame, key: str, *parts: str) -> DataFrame:
    """(key, digest, n_chars), one row a key; repeated rows count once (of several contents under one key the least digest)."""
    each = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), doc_digest(F.col(key).cast("string"), *[F.col(p) for p in parts]).alias("digest"), sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0)).alias("n_chars"))
    return each.groupBy("key").agg(F.min(F.struct("digest", "n_chars")).alias("x")).select("key", "x.digest", "x.n_chars")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row of a whole corpus of digests: documents, characters and a digest of the set of digests.

    The set's digest is that of the sums of four 60-bit slices of the digests: sums need no order and no
    task that holds all digests, and any changed, added or removed document changes them.
    """
    part = lambda k: F.sum(F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    sums = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), *[F.coalesce(part(k), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{k}") for k in range(4)])
    return sums.select("n_docs", "n_chars", F.sha2(F.concat_ws(",", F.col("n_docs").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("digest"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change): added, removed or changed between two tables of digests."""
    o, n = old.select("key", F.col("digest").alias("_o")), new.select("key", F.col("digest").alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return o.join(n, "key", "full").select("key", change.alias("change")).where("change is not null")


def stale(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(state): ``fresh``, ``stale``, or ``unknown`` without a record."""
    r = recorded.select(F.col("digest").alias("_r")).limit(1)
    return current.join(r, how="left").select(F.when(F.col("_r").isNull(), "unknown").when(F.col("_r") == F.col("digest"), "fresh").otherwise("stale").alias("state"))
