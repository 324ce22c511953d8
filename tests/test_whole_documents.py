"""Answers are checked against all chunks of the documents they cite."""

import pytest

from sparkloom.operators import answers as A


@pytest.fixture(scope="module")
def tables(spark):
    said = [(1, "q", 'Say "open the file" [1]', ["d1"]), (2, "q", "Use `--far` and `-z`. [1]", ["d1"]), (3, "q", "Use `--far` or `--none`. [2]", ["d0", "d1"]), (4, "r", "Use `-k`. [1] It is `--far`. [3]", ["d2"])]
    a = spark.createDataFrame([(*x, "how") for x in said], "answer_id long, qid string, answer string, retrieved_docs array<string>, kind string")
    c = [(1, "d1", "d1#A", 0, "P\n", "nothing\n  here"), (2, "d1", "d1#B", 1, None, "you open\n the  file\n  with --far or --farther"), (3, "d1", "d1#C", 2, "", "--far -z again"), (3, "d1", "d1#C", 2, "", "--far -z again"), (9, "d2", "d2#A", 0, "", None), (8, "d2", "d2#B", 1, "", "-k"), (7, None, "x", 0, "", "--none")]
    return a, spark.createDataFrame(c, "rowid long, doc_id string, sec_id string, ord int, prefix string, text string")


def test_every_chunk_counts(spark, tables):
    a, c = tables
    ext = A.whole_extracts(a, c)
    q = spark.createDataFrame([("q", ["--far", "-z"]), ("r", ["-k"])], "qid string, answer_contains array<string>")
    assert {r["answer_id"]: (r["cite_supported"], r["out_of_range"]) for r in A.verify_citations(a, q, ext).collect()} == {1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (True, 1)}
    assert {r["answer_id"]: (r["n_quotes"], r["verified"]) for r in A.verify_quotes(a, ext).collect()} == {1: (1, True), 2: (0, False), 3: (0, False), 4: (0, False)}
    assert {(r["answer_id"], r["claim"]): r["score"] for r in A.score_claims(A.claims(a), ext, a).collect()} == {(1, 0): None, (2, 0): 1.0, (3, 0): 0.5, (4, 0): 1.0, (4, 1): 0.0}
    assert {(r["answer_id"], r["n"]): (r["line"], r["pointer"][-1]) for r in A.evidence_lines(a, ext).collect()} == {(2, 1): ("with --far or --farther", "B"), (3, 2): ("with --far or --farther", "B"), (4, 1): ("-k", "B")}
    assert tuple(A.grounding(a, ext).first()) == ("how", 4, 3, 2, 3)


def test_one_chunk_is_not_the_document(tables):
    a, c = tables
    seen = {r["answer_id"] for r in A.verify_quotes(a, A.first_extracts(a, c)).where("verified").collect()}
    assert seen == set()
