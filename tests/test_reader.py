"""Answer modes, evidence, targets, training plans, places."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import modes as M
from sparkloom.functions import scalars as S
from sparkloom.operators import answers as A
from sparkloom.operators import chunking as C
from sparkloom.operators import evaluate as E
from sparkloom.operators import gold as G
from sparkloom.operators import training as TR
from sparkloom.plans import pipeline


@pytest.mark.parametrize("mode,version", [("quote", "v2"), ("line", "v3"), ("line-id", "v2"), ("cite", "v9"), ("what", "v1")])
def test_modes_that_do_not_go_together(mode, version):
    with pytest.raises(ValueError):
        M.check_mode(mode, version)


def test_validators(spark):
    xs = ["--all  lists \"every\" file\n  plain line here", "no flag"]
    said = [
        S.REFUSAL, "Use it [1]", "Use it [1] And that [2]", "Use it [3]", "no citation", '"every file" is listed [1]', '"--all  lists "every" file" means all [1]', '"plain line here" so [1]', '"plain line here" so [2]', '"no flag" is it [2]', None, "a [1]\n",
        "a [1] b [1] c [1] d [1] e [1]", "x [[y [1]",
    ]
    df = spark.createDataFrame([(i, t, xs) for i, t in enumerate(said)], "i int, t string, xs array<string>")
    got = {r["i"]: r for r in df.select("i", *[M.is_valid(m, F.col("t"), F.col("xs")).alias(m.replace("-", "_")) for m in M.MODES]).collect()}
    ok = lambda m: {i for i in got if got[i][m]}
    assert ok("cite") == {0, 1, 2, 5, 6, 7, 8, 9, 13} and ok("quote") == {0, 5, 7, 8, 9} and ok("line") == {0, 6, 7, 9} and ok("line_id") == {0, 6}


def test_line_grammar_and_messages(spark):
    df = spark.createDataFrame([(["say \"x\\y\"\nabc", "ab", "--all it"],), (["ab"],)], "xs array<string>")
    a, b = [r["g"] for r in df.select(M.line_grammar(F.col("xs")).alias("g")).collect()]
    assert 'claim ::= claim1 | claim3\n' in a and 'line1 ::= "say \\"x\\\\y\\""\n' in a and "claim2" not in a and b == f'root ::= refusal\nrefusal ::= "{S.REFUSAL}"\n'
    assert "claim ::= claim3\n" in df.select(M.line_grammar(F.col("xs"), True).alias("g")).first()["g"]
    m = df.select(M.messages(F.lit("Why?"), F.col("xs"), "cite", "v2").alias("m")).first()["m"]
    assert m[0]["role"] == "system" and m[1]["content"].startswith("Documentation extracts:\n\n[1] say") and m[1]["content"].endswith("Question: Why?")


def test_evidence(spark):
    a = spark.createDataFrame([(1, "q", ["d", "e"]), (2, "q", ["e"]), (3, "n", ["e"]), (4, "n", None), (5, "r", ["d", None])], "answer_id long, qid string, retrieved_docs array<string>")
    q = spark.createDataFrame([("q", ["-x", "tar"]), ("n", None), ("r", ["Long Name"]), ("q", ["-x", "tar"])], "qid string, answer_contains array<string>")
    c = spark.createDataFrame([("d", "s", 0, "tar", "use -x"), ("d", "s", 1, "", "tar -x, ln"), ("e", "s", 0, "", "tar --extract")], "doc_id string, sec_id string, ord int, prefix string, text string")
    al = spark.createDataFrame([("q", "-x", "--extract"), ("r", "Long Name", "ln"), ("r", "Long Name", None)], "qid string, token string, alias string")
    got = {r["answer_id"]: (r["strict"], r["aliased"]) for r in A.evidence_in(a, q, al, A.whole_extracts(a, c)).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, True), 4: (False, False), 5: (False, True)}


def test_targets(spark):
    s = spark.createDataFrame([(0.1,), (0.2,), (0.2,), (0.9,), (None,)], "score double")
    at = lambda k: tuple(E.threshold_at_target(s, k).first())
    assert at(1) == (0.1 + 1e-12, 1) and at(2) == at(3) == (0.2 + 1e-12, 3) and at(99) == (0.9 + 1e-12, 4) and tuple(E.threshold_at_target(s.where("false"), 1).first()) == (None, None)


def test_single_typo_changes_one_plain_word():
    for i in range(50):
        q = "Which option makes `TAR` list every single entry?"
        got = TR.single_typo(f"q{i}", q)
        a, b = q.split(" "), got.split(" ")
        assert sum(x != y for x, y in zip(a, b)) <= 1 and len(a) == len(b) and abs(len(q) - len(got)) <= 1 and got == TR.single_typo(f"q{i}", q)
    assert TR.single_typo("q", "ls -l ?") == "ls -l ?"


def test_eligible_and_cached_pairs(spark):
    pairs = spark.createDataFrame([("a", "Why?", "c2"), ("a", "Why?", "c1"), ("b", " ", "c1"), ("c", "How?", "c3"), ("d", "What?", "c1"), ("e", None, "c1"), ("f", "So?", "c4")], "qid string, question string, chunk_id string")
    chunks = spark.createDataFrame([("c1", "x", "t"), ("c2", "x", "t"), ("c3", "exam", "t"), ("c4", "x", None), ("c1", "x", "t")], "chunk_id string, doc_id string, text string")
    exam, leak = spark.createDataFrame([(" exam ",), (None,)], "doc string"), spark.createDataFrame([("d",)], "qid string")
    assert [tuple(r) for r in TR.eligible_pairs(pairs, chunks, exam, leak).collect()] == [("a", "Why?", "c1")]
    got = {tuple(r) for r in TR.question_pairs(pairs.unionByName(spark.createDataFrame([("z", " why? ", "c1"), ("y", "new", "gone")], pairs.schema)), chunks).collect()}
    assert got == {("c2", "Why?", "a"), ("c1", "Why?", "a"), ("c3", "How?", "c"), ("c1", "What?", "d"), ("c4", "So?", "f")}


def test_sample_and_plan(spark):
    rows = spark.createDataFrame([(f"k{i}", "big" if i % 4 else "small") for i in range(100)] + [("k1", "big"), (None, "big")], "k string, g string")
    got = TR.proportional_sample(rows, "k", "g", 20).toPandas()
    assert got["g"].value_counts().to_dict() == {"big": 15, "small": 5} and got["k"].is_unique
    plan = TR.step_plan(rows, "k", 2, 30, 1).toPandas()
    assert plan.groupby("step").size().tolist() == [30, 30, 30, 10] * 2 and plan.groupby("epoch")["k"].nunique().tolist() == [100, 100]
    assert plan[plan["step"] == 0]["k"].tolist() != plan[plan["step"] == 4]["k"].tolist()


def test_places_and_rules(spark):
    c = spark.createDataFrame([("s", 0, 3, "abc"), ("s", 2, 5, " c d"), ("s", 0, 2, "xx"), ("no", 0, 1, "a"), ("s", None, 1, "a")], "sec_id string, char_start int, char_end int, text string")
    assert tuple(C.location_report(c, spark.createDataFrame([("s", "abc def")], "sec_id string, text string")).first()) == (4, 1, 1, False)
    al = spark.createDataFrame([("q", "t", x, "synonym", "s") for x in "abcd"] + [("q", "t", "a", "synonym", "s2"), ("r", "t", "k", "keybinding", "s"), ("r", "t", None, "x", "s")], G.ALIASES)
    rules, crowded = G.alias_statistics(al)
    assert {tuple(r) for r in rules.collect()} == {("synonym", 4, 1), ("keybinding", 1, 1)} and [tuple(r) for r in crowded.collect()] == [("q", "t", 4)]
    assert spark.createDataFrame([("Éclair à la Carte",)], "t string").select(S.slug("t").alias("s")).first()["s"] == "eclair-a-la-carte"


def test_widened_by_spelling(spark):
    v = spark.createDataFrame([("archive", 5), ("files", 5)], "word string, n long")
    q = spark.createDataFrame([("a", "archvie files"), ("b", "files"), (None, "x")], "qid string, question string")
    found = {"archvie files": ["c1", "c2"], "archive files": ["c2", "c3"], "files": ["c4"]}
    rows = [(t, k + 1, c) for t, cs in found.items() for k, c in enumerate(cs)]
    hits = spark.createDataFrame(rows, "question string, rank int, chunk_id string")
    pool, audit = pipeline.widen_spell(q, v, lambda asked: asked.join(hits, "question").select("qid", "rank", "chunk_id"))
    assert [tuple(r) for r in pool.select("query_id", "place", "chunk_id").orderBy("query_id", "place").collect()] == [("a", 1, "c1"), ("a", 2, "c2"), ("a", 3, "c3"), ("b", 1, "c4")]
    assert [(r["qid"], r["repaired"]) for r in audit.collect()] == [("a", "archive files")]
