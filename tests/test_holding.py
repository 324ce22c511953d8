"""Sets of needles in the extracts of a document, against comparing each with each."""

import random

import pytest

from sparkloom.operators import answers as A
from sparkloom.operators import holding as H

WAYS = "doc_id string, ways array<array<string>>"
TEXTS = "doc_id string, sec_id string, ord int, text string"


def _each(sets, texts):
    hold = lambda ways, t: 2 * all(w[0] in t for w in ways) or all(any(x in t for x in w) for w in ways)
    best = {(d, repr(w)): max([int(hold(w, t)) for e, *_, t in texts if e == d], default=0) for d, w in sets}
    return {k: v for k, v in best.items() if v}


def _held(spark, sets, texts):
    got = H.fulfilled(spark.createDataFrame(sets, WAYS), spark.createDataFrame(texts, TEXTS)).collect()
    assert len({(r["doc_id"], repr(r["ways"])) for r in got}) == len(got)
    return {(r["doc_id"], repr(r["ways"])): r["found"] for r in got}


def _made(seed, docs, n_texts, n_sets):
    r = random.Random(seed)
    word = lambda most: "".join(r.choice("ab-é ") for _ in range(r.randint(1, most)))
    texts = [(f"d{r.randrange(docs)}", f"s{i}", i, word(60)) for i in range(n_texts)]
    sets = [(f"d{r.randrange(docs + 1)}", [[word(9) for _ in range(r.randint(1, 2))] for _ in range(r.randint(0, 3))]) for _ in range(n_sets)]
    return list({(d, repr(w)): (d, w) for d, w in sets}.values()), texts


@pytest.mark.parametrize("block,cell,sets_a_cell,part", [(1 << 20, (2 << 20, 16 << 20), 200_000, 4 << 20), (7, (300, 700), 9, 2_000)])
def test_as_each_with_each(spark, monkeypatch, block, cell, sets_a_cell, part):
    # whole documents, then a grid of cells
    for name, value in (("BLOCK", block), ("CELL_BYTES", cell), ("CELL_SETS", sets_a_cell), ("PART_BYTES", part)):
        monkeypatch.setattr(H, name, value)
    sets, texts = _made(1, 3, 120, 150)
    want = _each(sets, texts)
    assert _held(spark, sets, texts) == want and {1, 2} == set(want.values()) and len(want) < len(sets)


def test_odd_sets_and_texts(spark):
    long = "x" * 41 + "y"
    texts = [("d", "s", 0, long + "z"), ("d", "s", 1, ""), ("d", None, None, "ab"), ("d", "s", 3, "cd"), ("d", "s", 3, "cd"), ("e", "s", 0, "")]
    sets = [(d, w) for d in ("d", "e", "f") for w in ([], [[""]], [[long]], [[long + "zz"]], [["abc"]], [["bc"]], [["ab"], ["cd"]], [["cd"], ["c"], ["d"]], [["no", "ab"]], [["no", ""], ["cd"]], [["x" * 42]])]
    want = _each(sets, texts)
    assert _held(spark, sets, texts) == want and want["d", repr([[long]])] == 2 and ("d", repr([["bc"]])) not in want and ("e", repr([])) in want
    assert _held(spark, sets, []) == {} == _held(spark, [], texts)


def test_frequent_needles_that_never_meet(spark):
    texts = [("d", "s", i, "-a x" if i % 2 else "-b x") for i in range(400)] + [("d", "s", 400, "-c -a")]
    sets = [("d", [["-a"], ["-b"]]), ("d", [["-a"], ["x"]]), ("d", [["x"], ["-b"], ["-a", "-b"]]), ("d", [["-a"], ["-c"]]), ("d", [["-b"], ["-c"]])]
    assert _held(spark, sets, texts) == _each(sets, texts)


def test_evidence_in_a_hot_document_does_not_grow_with_the_square(spark):
    """Sets and extracts of one document must not meet in pairs: a join with more than equal keys as its condition looks at every pair."""
    n = 300
    c = spark.createDataFrame([("hot", f"s{i}", 0, "", f"--opt{i:04d} is told") for i in range(n)], "doc_id string, sec_id string, ord int, prefix string, text string")
    q = spark.createDataFrame([(f"q{i}", [f"--opt{i:04d}" if i % 3 else f"--OPT{i:04d}"]) for i in range(n)], "qid string, answer_contains array<string>")
    a = spark.createDataFrame([(i, f"q{i}", ["hot"]) for i in range(n)], "answer_id long, qid string, retrieved_docs array<string>")
    al = q.selectExpr("qid", "answer_contains[0] as token", "replace(answer_contains[0], 'OPT', 'opt') as alias")
    df = A.evidence_in(a, q, al, A.whole_extracts(a, c))
    assert {(r["answer_id"], r["strict"], r["aliased"]) for r in df.collect()} == {(i, i % 3 > 0, True) for i in range(n)}
    nodes, joins = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().endswith("Join"):
            joins += 1
            assert node.condition().isEmpty() and node.leftKeys().size(), node.toString()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert joins
