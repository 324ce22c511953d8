import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluate as E
from sparkloom.operators import spelling as SP
from sparkloom.operators.prefix import positions, quantiles, running_totals
from sparkloom.operators.setjoin import similar


def run_of(spark, rows):
    return spark.createDataFrame(rows, "key string, answerable boolean, correct boolean, abstained boolean, score double, supported boolean, evidence boolean")


def test_running_totals(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(100), None if r.random() < 0.2 else r.randrange(5)) for i in range(1000)]
    got = {x["i"]: x["t"] for x in running_totals(spark.createDataFrame(rows, "i long, v int, n int"), [F.col("v"), F.col("i")], {"t": F.col("n")}).collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda x: (x[1], x[0])):
        total += n or 0
        assert got[i] == total
    assert positions(spark.range(0).withColumn("v", F.col("id")), [F.col("v")]).collect() == []


def test_quantiles(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([4, 1, 3, 2, None])], "i long, v double")
    got = {(r["convention"], r["fraction"]): r["value"] for r in quantiles(df, "v", "i", [0.5, 0.9]).collect()}
    assert got["linear", 0.5] == 2.5 and got["floor", 0.5] == 3 and got["floor", 0.9] == 4 and got["median", 0.5] == 2.5
    assert quantiles(df.where("false"), "v", "i", [0.5]).collect() == []


def test_compare(spark):
    c = run_of(spark, [(f"k{i}", True, i < 3, False, 0.5, True, True) for i in range(8)] + [("u", False, False, False, 0.1, True, True)])
    a = run_of(spark, [(f"k{i}", True, i > 0, False, 0.5, True, True) for i in range(8)] + [("u", False, False, True, 0.1, True, True)])
    r = E.compare(c, a).first()
    assert (r["kept"], r["lost"], r["gained"], r["net"], r["abstention"], r["passed"]) == (2, 1, 5, 4, 1, True) and abs(r["p"] - 0.21875) < 1e-9
    with pytest.raises(Exception, match="differ"):
        E.compare(c, a.where("key <> 'k0'")).collect()


def test_sweep_against_replay(spark):
    r = random.Random(4)
    rows = [(f"k{i}", r.random() < 0.7, r.random() < 0.6, r.random() < 0.2, None if r.random() < 0.1 else round(r.random(), 1), r.random() < 0.5, r.random() < 0.5) for i in range(200)]
    pts = sorted(E.sweep(run_of(spark, rows)).collect(), key=lambda x: x["threshold"])
    assert len(pts) == len({x[4] for x in rows if x[4] is not None}) + 1 and pts[0]["fired"] == 0
    for p in pts:
        hit = lambda x, p=p: x[4] is not None and x[4] < p["threshold"]
        right = sum(x[1] and x[2] and not x[3] and not hit(x) for x in rows)
        assert abs(p["accuracy"] - right / sum(x[1] for x in rows)) < 1e-6
        assert abs(p["abstention_recall"] - sum(not x[1] and (x[3] or hit(x)) for x in rows) / sum(not x[1] for x in rows)) < 1e-6
    assert E.sweep(run_of(spark, [])).collect() == []


def test_overlay_errors(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in E.overlay(base, spark.createDataFrame([("a", 9)], "k string, v int"), "k", "v").collect()} == {("a", 9), ("b", 2)}
    for bad in ([("c", 1)], [("a", 1), ("a", 2)]):
        with pytest.raises(Exception, match="unknown or repeated"):
            E.overlay(base, spark.createDataFrame(bad, "k string, v int"), "k", "v").collect()


def test_family_roots(spark):
    q = spark.createDataFrame([("a", None, None), ("b", " a ", None), ("c", None, "b"), ("d", "gone", None), ("x", "y", None), ("y", "x", None), ("b", " a ", None), ("z", "x", None)], "qid string, variant_of string, paraphrase_of string")
    assert {r["qid"]: r["root"] for r in E.family_root(q).collect()} == {"a": "a", "b": "a", "c": "a", "d": "gone", "x": "x", "y": "x", "z": "x"}
    assert {r["qid"]: r["root"] for r in E.family_root(q, True).collect()}["d"] == "d"


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "g string, n int")
    assert {r["g"]: r["quota"] for r in E.largest_remainder(df, "g", "n", 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_gate_fit_is_deterministic(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), 1.0 if i > 10 else 0.0) for i in range(20)], "key string, x double, y double")
    fitted = E.fit_gate(df, ["x"], "y")
    p = [r["p"] for r in E.predict_gate(df, ["x"], fitted).orderBy("x").collect()]
    assert p == sorted(p) and p[0] < 0.3 < 0.7 < p[-1] and fitted == E.fit_gate(df.orderBy(F.rand(1)), ["x"], "y")


def test_osa_and_bands():
    assert SP.osa("ca", "abc") == 3 and SP.osa("frmo", "from") == 1 and SP.osa("", "ab") == 2 and SP.osa("abcd", "abcd") == 0
    assert SP.band(7) == 1 and SP.band(8) == 2 and SP.beside("cst", "cat") and not SP.beside("cpt", "cat")
    assert set(SP.shortened("abc", 1)) == {"abc", "ab", "ac", "bc"}


def test_repair(spark):
    v = spark.createDataFrame([("option", 9), ("file", 5), ("field", 2), ("directory", 3)], "word string, n long")
    q = spark.createDataFrame([("a", "Which opion, FIEL --opion /opion dirctroy?"), ("b", None), ("c", "")], "qid string, question string")
    assert {r["qid"]: r["repaired"] for r in SP.repair(q, v).collect()} == {"a": "Which option, FILE --opion /opion directory?", "c": ""}


def test_set_join(spark):
    from fractions import Fraction

    r = random.Random(5)
    sets = lambda p: [(f"{p}{i}", r.sample("abcdefghij", r.randrange(0, 8))) for i in range(60)]
    x, y = sets("l"), sets("r")
    got = {(a["lk"], a["rk"]) for a in similar(spark.createDataFrame(x, "lk string, s array<string>"), "lk", spark.createDataFrame(y, "rk string, s array<string>"), "rk", "s", Fraction(1, 2)).collect()}
    assert got == {(a, b) for a, s in x for b, t in y if s and t and 2 * len(set(s) & set(t)) >= len(set(s) | set(t))}


def test_judging(spark):
    schema = "key string, answer string, abstained boolean, correct boolean"
    c = spark.createDataFrame([("a", "x", False, True), ("b", "y", True, False), ("c", None, False, True)], schema)
    a = spark.createDataFrame([("a", "z", False, False), ("b", "w", False, True), ("c", "v", False, True)], schema)
    items = E.judge_items(c, a, 0)
    assert {(r["key"], r["side"]) for r in items.collect()} == {("a", "control"), ("a", "arm"), ("b", "arm")}
    labels = items.selectExpr("item", "1 as seq", "case when answer in ('x', 'w') then 'right' else 'wrong' end as label")
    assert {r["verdict"]: r["n"] for r in E.judge_pairs(items, labels).collect()} == {"lost": 1, "gained": 1}
