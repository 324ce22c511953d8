"""Orphan references by dictionary-encoded keys and compressed bitmaps per key range and period."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import filled
from sparkloom.runtime import materialize, maybe_broadcast

#: Keys of one range: one bitmap holds a bit for each.
RANGE_BITS = 15


def _pack(bits: np.ndarray) -> bytes:
    """A set of bit positions as a bitmap of a whole range, compressed."""
    row = np.zeros(1 << RANGE_BITS, np.uint8)
    row[bits] = 1
    return zlib.compress(np.packbits(row).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8))


def encode_keys(keys: DataFrame) -> DataFrame:
    """(tab, ref_key) -> (tab, ref_key, key_range, bit): a dictionary code without a global counter.

    The distinct keys are spread over the session's shuffle partitions; within one they are numbered by
    ``monotonically_increasing_id``, whose upper part is the partition. Ranges of 2^15 successive codes
    share a bitmap. The result must be materialised before use: numbering depends on the partitioning.
    """
    ids = keys.distinct().withColumn("code", F.monotonically_increasing_id())
    return ids.select("tab", "ref_key", F.shiftright("code", RANGE_BITS).alias("key_range"), (F.col("code").bitwiseAND((1 << RANGE_BITS) - 1)).cast("int").alias("bit"))


def _bitmaps(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """One compressed bitmap for each group of ``by``; rows are distinct, so a group holds at most 2^15 bits."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1][by].copy()
        first[name] = [_pack(pdf["bit"].to_numpy())]
        return first

    types = dict(rows.dtypes)
    return rows.select(*by, "bit").distinct().groupBy(*by).applyInPandas(build, ", ".join(f"{c} {types[c]}" for c in by) + f", {name} binary")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Referring rows whose key is missing, deleted or late.

    refs: (src_table, src_key, ref_field, tab, ref_key, at timestamp); parents: (tab, ref_key, removed
    boolean, at timestamp). Returns distinct (src_table, src_key, ref_field, ref_key, state, ref_month).
    Bitmaps of the referenced keys, one per key range and month of the reference, are AND-NOTed with
    those of the parents that are in place by the end of the month before (arrived earlier, not
    removed). Bits that survive are decoded, and only their rows are compared with the parent itself:
    ``missing`` without a parent, ``deleted`` if every row of it is removed, ``late`` if its first
    arrival is after ``at`` of the referring row. Null keys are skipped; a null ``at`` gives a null
    month and is never late. Repeated rows count once; empty tables give an empty result.
    """
    month = F.date_format("at", "yyyy-MM")
    refs = refs.where("ref_key is not null").withColumn("ref_month", month).distinct()
    parents = parents.where("ref_key is not null").groupBy("tab", "ref_key").agg(F.bool_and("removed").alias("removed"), F.min("at").alias("arrived"))
    parents = materialize(parents, "parents")
    codes = materialize(encode_keys(refs.select("tab", "ref_key").union(parents.select("tab", "ref_key"))), "codes")
    # '' is the period of references without a date
    asked = refs.select("tab", "ref_key", F.coalesce("ref_month", F.lit("")).alias("period")).distinct().join(codes, ["tab", "ref_key"])
    asked = _bitmaps(asked, ["key_range", "period"], "asked")
    there = parents.where(~F.col("removed")).select("tab", "ref_key", F.coalesce(F.date_format("arrived", "yyyy-MM"), F.lit("")).alias("since")).join(codes, ["tab", "ref_key"])
    there = _bitmaps(there, ["key_range", "since"], "there")

    def surviving(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of one key range: months are few, and each has one bitmap."""
        arrivals = sorted(zip(right["since"], right["there"]))
        out, k, seen = [], 0, np.zeros(1 << RANGE_BITS, np.uint8)
        for period, blob in sorted(zip(left["period"], left["asked"])):
            while k < len(arrivals) and (arrivals[k][0] < period or not arrivals[k][0]):
                seen |= _unpack(arrivals[k][1])
                k += 1
            bits = np.flatnonzero(_unpack(blob) & (seen ^ 1))
            out.append(pd.DataFrame({"key_range": left["key_range"].iloc[0] if len(left) else 0, "period": period, "bit": bits.astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"key_range": [], "period": [], "bit": []})

    left = asked.groupBy("key_range").cogroup(there.groupBy("key_range")).applyInPandas(surviving, "key_range long, period string, bit int")
    open_keys = left.join(codes, ["key_range", "bit"]).select("tab", "ref_key", "period")
    open_keys = open_keys.join(parents, ["tab", "ref_key"], "left")
    open_keys = materialize(open_keys, "open")
    rows = refs.withColumn("period", F.coalesce("ref_month", F.lit(""))).join(maybe_broadcast(open_keys, 160), ["tab", "ref_key", "period"])
    state = F.when(F.col("removed").isNull(), "missing").when(F.col("removed"), "deleted").when(F.col("arrived") > F.col("at"), "late")
    return rows.withColumn("state", state).where("state is not null").select("src_table", "src_key", "ref_field", "ref_key", "state", "ref_month").distinct()


def doc_references(man_docs: DataFrame, questions: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of man_docs.see_also, emacs_questions.gold_sec_ids and emacs_questions.doc, and the rows they name.

    Parts are trimmed; a reference with a null or blank part is skipped, as are null arrays.
    """
    see = man_docs.select(F.lit("man_docs").alias("src_table"), F.col("doc_id").alias("src_key"), F.lit("see_also").alias("ref_field"), F.lit("page").alias("tab"), F.explode("see_also").alias("r"), F.col("loaded_at").alias("at"))
    see = see.withColumn("ref_key", F.concat(filled("r.name"), F.lit("."), filled("r.section"))).drop("r")
    gold = questions.select(F.lit("emacs_questions").alias("src_table"), F.col("qid").alias("src_key"), F.lit("gold_sec_ids").alias("ref_field"), F.lit("section").alias("tab"), F.explode("gold_sec_ids").alias("r"), F.col("loaded_at").alias("at"))
    gold = gold.withColumn("ref_key", filled("r")).drop("r")
    doc = questions.select(F.lit("emacs_questions").alias("src_table"), F.col("qid").alias("src_key"), F.lit("doc").alias("ref_field"), F.lit("page").alias("tab"), F.col("loaded_at").alias("at"), filled("doc").alias("ref_key"))
    refs = see.unionByName(gold).unionByName(doc)
    pages = man_docs.select(F.lit("page").alias("tab"), F.col("doc_id").alias("ref_key"), F.col("removed_at").isNotNull().alias("removed"), F.col("loaded_at").alias("at"))
    secs = sections.select(F.lit("section").alias("tab"), F.col("sec_id").alias("ref_key"), F.lit(False).alias("removed"), F.col("loaded_at").alias("at"))
    return refs, pages.unionByName(secs)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, state and month."""
    return orphans.groupBy("src_table", "ref_field", "state", "ref_month").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
