import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import models as M
from sparkloom.functions import scalars as S
from sparkloom.operators import corpus as CO
from sparkloom.runtime import materialize, maybe_broadcast, release


def test_stand_ins_are_row_functions(spark):
    df = spark.createDataFrame([("how to list files", "Use ls to list files\nother"), ("zzz", "x"), (None, None)], "q string, t string")
    r = df.select(M.embed("q").alias("v"), M.rerank_score("q", "t").alias("s"), M.read_answer("q", "t").alias("a"), M.query_text(F.col("q")).alias("w"), M.rewrites(F.col("q")).alias("x")).collect()
    assert abs(np.linalg.norm(r[0]["v"]) - 1) < 1e-6 and not any(r[2]["v"]) and r[0]["s"] > 0.5 and r[0]["a"] == "Use ls to list files [1]" and r[1]["a"] == S.REFUSAL
    assert r[0]["w"].endswith("Query: how to list files") and r[0]["x"] == "list files"
    again = df.repartition(3).select("q", M.embed("q").alias("v")).where("q = 'zzz'").first()["v"]
    assert again == r[1]["v"]


def test_guards(spark):
    df = spark.createDataFrame([("abc", "abd"), ("abc", ""), ("abc", "x" * 40)], "a string, b string")
    assert [r[0] for r in df.select(M.guarded_correction(F.col("a"), F.col("b"))).collect()] == ["abd", "abc", "abc"]
    s = spark.createDataFrame([(1, 0.5), (1, None), (2, None)], "g int, s double").select("g", "s", M.batch_scores(F.col("s"), ["g"]).alias("x")).collect()
    assert sorted(r["x"] for r in s) == [-0.5, 0.0, 0.5]
    j = spark.createDataFrame([(0.5,), (0.4,), (None,)], "s double").select(M.judge(F.col("s"))).collect()
    assert [r[0] for r in j] == [1.0, 0.0, None]
    c = spark.createDataFrame([(S.REFUSAL,), ("Use -x [1]. Or -y [2][3]",), ("no citation",)], "a string").select(M.is_cited_answer(F.col("a"))).collect()
    assert [r[0] for r in c] == [True, True, False] and '"9"' in M.grammar_cited(12) and "claim ::=" not in M.grammar_cited(0)


def test_fingerprint(spark):
    rows = [("a", "t", "x"), ("b", None, "y"), ("a", "t", "x"), (None, "t", "z")]
    df = spark.createDataFrame(rows, "k string, t string, digest string")
    one = CO.fingerprint(CO.digests(df, "k", "t")).first()
    assert one == CO.fingerprint(CO.digests(df.orderBy(F.desc("k")).repartition(3), "k", "t")).first() and one["n_docs"] == 2
    other = CO.fingerprint(CO.digests(df.withColumn("t", F.lit("u")), "k", "t"))
    assert other.first()["digest"] != one["digest"] and CO.fingerprint(CO.digests(df.where("false"), "k", "t")).first()["n_docs"] == 0
    now = CO.fingerprint(CO.digests(df, "k", "t"))
    states = [CO.stale(r, now).first()["state"] for r in (now, other, now.where("false"))]
    assert states == ["fresh", "stale", "unknown"]
    d = CO.difference(CO.digests(df, "k", "t"), CO.digests(spark.createDataFrame([("a", "new", ""), ("c", "t", "")], "k string, t string, digest string"), "k", "t"))
    assert {tuple(r) for r in d.collect()} == {("a", "changed"), ("b", "removed"), ("c", "added")}


def test_materialize(spark):
    m = materialize(spark.range(5), "test")
    assert m.count() == 5 and "sparkloom-test" in m.inputFiles()[0]
    assert maybe_broadcast(m, limit=1).count() == 5
    release(m)
