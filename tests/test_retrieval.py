import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import retrieval as R
from sparkloom.operators.lexical import bm25, stem


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    rows = [(i, x.tolist(), i % 4) for i, x in enumerate(v)] + [(500, None, 1)]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nearest_against_brute_force(vectors):
    v, df = vectors
    got = R.nearest(df, df.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", exclude_self=True).collect()
    for q in (0, 50, 100):
        d = sorted((round(float(np.linalg.norm(v[q] - x)), 5), i) for i, x in enumerate(v) if i != q)[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in d]
    by = R.nearest(df, df.where("vec_id = 0"), 2, "vec_id", "embedding", by="label").collect()
    assert len(by) == 8 and {r["label"] for r in by} == set("0123")


def test_cells_change_nothing(vectors, monkeypatch):
    _, df = vectors
    whole = {tuple(r) for r in R.nearest(df, df.where("vec_id % 10 = 0"), 4, "vec_id", "embedding").select("query_id", "rank", "vec_id").collect()}
    monkeypatch.setattr(R, "CORPUS_CELL", 17)
    monkeypatch.setattr(R, "QUERY_CELL", 5)
    assert whole == {tuple(r) for r in R.nearest(df, df.where("vec_id % 10 = 0"), 4, "vec_id", "embedding").select("query_id", "rank", "vec_id").collect()}


def test_nearest_empty(spark, vectors):
    _, df = vectors
    none = df.where("false")
    assert R.nearest(none, df, 3, "vec_id", "embedding").collect() == [] and R.nearest(df, none, 3, "vec_id", "embedding").collect() == []


def test_floor_identities(vectors):
    _, df = vectors
    q = df.where("vec_id < 2")
    by = R.nearest(df, q, 20, "vec_id", "embedding", by="label")
    whole = R.nearest(df, q, 20, "vec_id", "embedding").join(df.select("vec_id", F.col("label").cast("string").alias("label")), "vec_id")
    pool = lambda f: {(r["query_id"], r["vec_id"]) for r in R.floor_quota(by, whole, "query_id", "vec_id", "label", f, 20, 4).collect()}
    assert pool(0) == {(r["query_id"], r["vec_id"]) for r in whole.collect()}
    assert pool(5) == {(r["query_id"], r["vec_id"]) for r in R.quota(by, df.select(F.col("label").cast("string").alias("label")), "query_id", "label", 20).collect()}
    with pytest.raises(ValueError):
        R.floor_quota(by, whole, "query_id", "vec_id", "label", 6, 20, 4)


def test_fuse_vote_cap_cascade(spark):
    lists = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "c")], "q int, list_no int, rank int, k string")
    fused = R.fuse(lists, "q", "k")
    assert [r["k"] for r in fused.orderBy("rank").collect()] == ["b", "a", "c"]
    assert R.winner(lists, fused, "q", "k").first()["list_no"] == 1
    assert [r["k"] for r in R.pooled(lists, "q", "k").orderBy("place").collect()] == ["a", "b", "c"]
    hits = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate("xxyyx")] + [(2, 1, "y"), (2, 2, "x")] + [(3, 1, None)], "q int, rank int, d string")
    assert {r["q"]: r["routed"] for r in R.vote(hits, "q", "d").collect()} == {1: "x", 2: "y", 3: None}
    capped = R.cap_per_document(hits.where("q = 1"), "q", "d", 1, 4).orderBy("place").collect()
    assert [r["rank"] for r in capped] == [1, 3, 2, 4]
    tiers = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, False), (3, 0, True), (3, 1, True), (3, 2, True)], "q int, tier int, refused boolean")
    assert {r["q"]: r["tier"] for r in R.cascade(tiers, "q").collect()} == {1: 1, 2: 0, 3: 2}
    g = R.gate_scores(spark.createDataFrame([(1,), (9,)], "q int"), spark.createDataFrame([(1, 1, 0.5)], "q int, rank int, score double"), "q", 0.6)
    assert {r["q"]: (r["gate_score"], r["gated"]) for r in g.collect()} == {1: (0.5, True), 9: (float("-inf"), True)}


def test_expand_budget(spark):
    near = spark.createDataFrame([(1, 1, "c2", f"c{i}", i, "x" * 10) for i in (1, 2, 3)] + [(1, 2, "c4", f"c{i}", i, "y" * 10) for i in (3, 4, 5)], "query_id int, rank int, chunk_id string, near_id string, near_ord int, near_text string")
    a = {r["rank"]: r for r in R.expand(near, budget=60).collect()}
    assert a[1]["expanded"] and len(a[1]["text"]) == 32 and a[2]["text"].count("y") == 20
    b = {r["rank"]: r for r in R.expand(near, budget=35).collect()}
    assert b[2]["text"] == "y" * 10 and not b[2]["expanded"]


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "formalize": "formal", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: stem(w) for w in pairs} == pairs


def test_bm25(spark):
    c = spark.createDataFrame([("a", "", "tar archive tar"), ("b", "tar", "other words here"), ("c", None, None), ("d", "", "nothing")], "chunk_id string, prefix string, text string")
    q = spark.createDataFrame([("q1", "tar?"), ("q2", "what is the"), ("q3", None), (None, "tar")], "qid string, question string")
    got = bm25(c, q).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["chunk_id"]) for r in got] == [("q1", "a"), ("q1", "b")] and got[0]["score"] >= got[1]["score"]
    assert bm25(c.where("false"), q).collect() == []
