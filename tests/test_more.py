from sparkloom.operators import lexical, spelling, tools
from sparkloom.operators import retrieval as R
from sparkloom.sources import manuals


def test_question_vectors(spark):
    ix = spark.createDataFrame([(1, "a", "qa1", [1.0, 0.0]), (2, "a", "qa2", [0.9, 0.1]), (3, "b", "qb", [0.0, 1.0])], "question_id long, chunk_id string, question string, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "question_id long, embedding array<float>")
    got = R.nearest_by_questions(ix, q, 3)
    assert [(r["chunk_id"], r["question"]) for r in got.orderBy("rank").collect()] == [("a", "qa1"), ("b", "qb")]
    pool = spark.createDataFrame([(9, "a", 1)], "query_id long, chunk_id string, rank int")
    assert [(r["chunk_id"], r["route"]) for r in R.with_question_route(pool, got).orderBy("place").collect()] == [("a", "chunk"), ("b", "question")]
    lists = spark.createDataFrame([(1, 0, 1, "x"), (1, 1, 1, "y"), (1, 1, 2, "x"), (1, 0, 30, "z")], "query_id int, list_no int, rank int, chunk_id string")
    hits, won = R.fused_variants(lists)
    assert [r["chunk_id"] for r in hits.orderBy("rank").collect()] == ["x", "y"] and won.first()["list_no"] == 0


def test_postings(spark):
    c = spark.createDataFrame([("c", "Tar", "tar files tar"), ("c", "Tar", "tar files tar"), (None, "x", "y"), ("d", None, None)], "chunk_id string, prefix string, text string")
    assert {tuple(r) for r in lexical.postings(c).collect()} == {("tar", "c", 1, 2), ("files", "c", 0, 1)}
    assert {r["term"] for r in lexical.postings(c, True).collect()} == {"tar", "file"}


def test_request_violations(spark):
    r = spark.createDataFrame([("r1", "q", "d", "answer", "d", None, "x"), ("r2", "no", "d", "fly", "gone", "tar", "x"), ("r3", "q", "e", "refuse", None, "zzz", "x")], "qid string, source_qid string, doc string, expect_tool string, page string, missing_tool string, request string")
    q, p = spark.createDataFrame([("q", "d")], "qid string, doc string"), spark.createDataFrame([("d", "tar")], "doc_id string, name string")
    assert {tuple(x) for x in tools.request_violations(r, q, p).collect()} == {("r2", "unknown source"), ("r2", "no such page"), ("r2", "tool is there"), ("r2", "unknown tool"), ("r3", "other document")}
    assert tools.registry(spark).count() == 4 and tools.registry(spark, True).count() == 8


def test_find_section_and_report(spark):
    e = spark.createDataFrame([("Key  Bindings ",), ("None",)], "node string")
    s = spark.createDataFrame([("m#2", "key bindings"), ("m#1", "Key Bindings"), ("m#3", None)], "sec_id string, heading string")
    assert {r["node"]: r["sec_id"] for r in manuals.find_section(e, s).collect()} == {"Key  Bindings ": "m#1", "None": None}
    q = spark.createDataFrame([("a", "x"), ("b", "x")], "qid string, kind string")
    rep = spark.createDataFrame([("a", "t", 2), ("b", "t", 0)], "qid string, repaired string, n_edits long")
    assert tuple(spelling.report(q, rep).first()) == ("x", 2, 1, 2)
