"""Classes of more than 64 records: all pairs of different contents, and links by class sizes."""

from collections import Counter
from itertools import combinations

from sparkloom.llm import neardup as N

WORDS = [f"x{i}" for i in range(30)]
SCHEMA = "chunk_id string, text string"


def spelled(k):
    """One content for each k of the same words."""
    return " ".join(w.upper() if k >> i & 1 else w for i, w in enumerate(WORDS))


def test_all_pairs_of_different_contents(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = [(f"c{k:03}", spelled(k)) for k in range(70)] + [("near", spelled(0) + " y"), ("near2", spelled(1) + " Y")]
    got = {tuple(r) for r in N.near_duplicate_chunks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(combinations(sorted(k for k, _ in rows), 2))


def test_copies_of_one_content_in_a_large_class(spark):
    rows = [(f"c{k:03}", spelled(0)) for k in range(66)] + [("d1", spelled(1)), ("d2", spelled(2))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in N.near_duplicate_chunks(df).collect()}
    assert got == {("c000", f"c{k:03}") for k in range(1, 66)} | {("c000", "d1"), ("c000", "d2"), ("d1", "d2")}
    links = {(r["key"], r["group"], r["links"]) for r in N.class_groups(*N.similar_classes(*N.chunk_args(df))).collect()}
    assert links == {(k, "c000", 67) for k, _ in rows}


def test_links_are_those_of_all_pairs(spark):
    rows = [(f"a{k}", spelled(k)) for k in range(3)] + [("b", spelled(0) + " y"), ("b", spelled(0)), ("b2", spelled(0) + " y z"), ("e", "e " * 30), ("f", " ".join(f"w{i}" for i in range(40)))]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = [tuple(r) for r in N.near_duplicate_chunks(df).collect()]
    want = Counter(k for p in pairs for k in p)
    got = {r["key"]: (r["group"], r["links"]) for r in N.class_groups(*N.similar_classes(*N.chunk_args(df))).collect()}
    assert got == {k: ("a0", n) for k, n in want.items()} and len(got) == 5
