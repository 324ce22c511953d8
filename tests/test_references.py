from datetime import datetime

from sparkloom.operators.references import doc_references, orphan_references, orphan_report

REFS = "src_table string, src_key string, ref_field string, tab string, ref_key string, at timestamp"
PARENTS = "tab string, ref_key string, removed boolean, at timestamp"
T = lambda m, d=1: datetime(2025, m, d)


def test_states(spark):
    refs = [("t", "r1", "f", "p", k, T(3, 10)) for k in ("ok", "gone", "late", "missing", "same", "other")]
    refs += [("t", "r2", "f", "p", "late", T(5)), ("t", "r3", "f", "p", "missing", None), ("t", "r1", "f", "p", "missing", T(3, 10)), ("t", "r4", "f", "p", None, T(3)), ("t", "r5", "f", "q", "ok", T(3))]
    parents = [("p", "ok", False, T(1)), ("p", "ok", False, T(1)), ("p", "gone", True, T(1)), ("p", "late", False, T(4)), ("p", "same", False, T(3, 11)), ("p", "other", False, T(3, 9)), ("p", None, False, T(1))]
    got = {tuple(r) for r in orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()}
    assert got == {
        ("t", "r1", "f", "gone", "deleted", "2025-03"), ("t", "r1", "f", "late", "late", "2025-03"), ("t", "r1", "f", "missing", "missing", "2025-03"),
        ("t", "r1", "f", "same", "late", "2025-03"), ("t", "r3", "f", "missing", "missing", None), ("t", "r5", "f", "ok", "missing", "2025-03"),
    }


def test_many_keys_cross_ranges(spark):
    refs = spark.range(100_000).selectExpr("'t' src_table", "string(id) src_key", "'f' ref_field", "'p' tab", "concat('k', id) ref_key", "timestamp '2025-02-02' at")
    parents = spark.range(100_000).where("id % 1000 <> 7").selectExpr("'p' tab", "concat('k', id) ref_key", "id % 1000 = 9 removed", "timestamp '2025-01-01' at")
    got = orphan_references(refs, parents)
    assert {r["state"]: r["count"] for r in got.groupBy("state").count().collect()} == {"missing": 100, "deleted": 100}
    assert orphan_report(got).count() == 2


def test_empty(spark):
    assert orphan_references(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)).collect() == []
    some = spark.createDataFrame([("t", "r", "f", "p", "k", T(1))], REFS)
    assert [r["state"] for r in orphan_references(some, spark.createDataFrame([], PARENTS)).collect()] == ["missing"]


def test_parts(spark):
    man = spark.createDataFrame(
        [("a.1", [(" b\t", "1 "), (None, "1"), ("c", " ")], T(1), None, "x"), ("b.1", None, T(1), None, "x"), ("d.1", [None], T(1), T(2), "x")],
        "doc_id string, see_also array<struct<name:string,section:string>>, loaded_at timestamp, removed_at timestamp, ref_key string",
    )
    q = spark.createDataFrame([("q", [" s ", None, ""], " d.1", T(3)), ("r", None, " ", T(3))], "qid string, gold_sec_ids array<string>, doc string, loaded_at timestamp")
    s = spark.createDataFrame([("s", T(1))], "sec_id string, loaded_at timestamp")
    assert {(r["src_key"], r["ref_key"], r["state"]) for r in orphan_references(*doc_references(man, q, s)).collect()} == {("q", "d.1", "deleted")}
