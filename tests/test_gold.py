from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import gold as G
from sparkloom.operators import spelling as SP

Q = "qid string, question string, kind string, answer_contains array<string>, gold_sec_ids array<string>, variant_of string, paraphrase_of string"


def questions(spark):
    return spark.createDataFrame([("a", "How to list all?", "answerable", ["--all"], [" s1 ", None], None, None), ("a.y", "How to lsit all?", "answerable", ["--all"], None, "a ", None), ("b", "Where is file.conf?", "answerable", ["file.conf"], ["gone"], None, None), ("u", "x", "unanswerable", None, None, None, None), (None, "x", "answerable", ["y"], ["s1"], None, None), ("a", "How to list all?", "answerable", ["--all"], [" s1 ", None], None, None)], Q)


def sections(spark):
    return spark.createDataFrame([("s1", "OPTIONS", "-a, --all\n       List all.\n--sort=WORD\n       Sort."), ("s2", "KEYS", "'C-x'\n     Runs (do-it).\n"), ("s1", "OPTIONS", "-a, --all\n       List all.\n--sort=WORD\n       Sort."), (None, "h", "t")], "sec_id string, heading string, text string")


def test_violations(spark):
    got = {tuple(r) for r in G.gold_violations(questions(spark), sections(spark)).collect()}
    assert got == {("b", "gone", "missing section"), ("b", None, "token in question")}


def test_derive_propagate_merge(spark):
    q = questions(spark)
    a = G.derive_aliases(q, sections(spark))
    assert {(r["qid"], r["token"], r["alias"], r["rule"]) for r in a.collect()} == {("a", "--all", "-a", "synonym")}
    p = G.propagate(a, q)
    assert {r["qid"] for r in p.collect()} == {"a", "a.y"}
    assert G.alias_violations(p, q).collect() == []
    bad = spark.createDataFrame([("zz", "t", "x y z", "r", None), ("a", "--none", "all", "r", None)], G.ALIASES)
    assert {(r["qid"], r["problem"]) for r in G.alias_violations(bad, q).collect()} == {("zz", "unknown question"), ("zz", "shape"), ("a", "foreign token"), ("a", "echo")}
    assert G.merge_aliases(a, p).count() == 2 and G.merge_aliases(p, a).count() == 2 and G.stale_aliases(p, a).count() == 1


def test_correctness(spark):
    q = questions(spark)
    ans = spark.createDataFrame([(1, "a", "use --all"), (2, "a", "use -a"), (3, "a.y", "use -a"), (4, "a", "use -abc"), (5, "u", "x"), (6, "a", None)], "answer_id long, qid string, answer string")
    al = spark.createDataFrame([("a", "--all", "-a", "synonym", "s1")], G.ALIASES)
    got = {r["answer_id"]: (r["strict"], r["aliased"]) for r in G.correctness(ans, q, al).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, True), 4: (False, False), 5: (True, True), 6: (False, False)}
    own = al.union(spark.createDataFrame([("a.y", "--all", None, "none", None)], G.ALIASES))
    assert {r["answer_id"]: r["aliased"] for r in G.correctness(ans, q, own).collect()}[3] is False


def test_evidence_and_primary(spark):
    e = G.evidence_sections(questions(spark), sections(spark))
    assert {(r["qid"], r["sec_id"]) for r in e.collect()} == {("a", "s1"), ("a.y", "s1")}
    two = spark.createDataFrame([("q", "s2", "KEYS"), ("q", "s1", "Long OPTIONS")], "qid string, sec_id string, heading string")
    assert G.primary_section(two).first()["sec_id"] == "s1"


def test_shapes(spark):
    df = spark.createDataFrame([("--all",), ("-s WORD",), ("x",), ("a b",), ("C-x C-f",), ("C-x NAME RET",)], "c string").select(G.is_alias_shaped(F.col("c")).alias("a"), G.normal_key(F.col("c")).alias("k"), G.is_key_shaped(F.col("c")).alias("s"))
    rows = df.collect()
    assert [r["a"] for r in rows[:5]] == [True, True, False, False, True] and rows[5]["k"] == "C-x" and rows[4]["s"] and not rows[0]["s"]


def test_small_scalars(spark):
    df = spark.createDataFrame([("1. One?\n\n- Two?\nThree?", "d#A/B")], "t string, s string")
    r = df.select(S.parse_questions("t", 2).alias("q"), S.heading_path("s").alias("h"), S.swap_once(F.col("s"), "A", "Z").alias("w")).first()
    assert r["q"] == ["One?", "Two?"] and r["h"] == "A / B" and r["w"] == "d#Z/B"


def test_modes_and_recovery(spark):
    v = spark.createDataFrame([("option", 9), ("makes", 5), ("which", 2)], "word string, n long")
    t = spark.createDataFrame([("a.y1", "typo1", "which option makes", "which opion makes"), ("b.y1", "typo1", "which zzzzq makes", "which zzqzz makes")], "qid string, variant_kind string, base string, question string")
    r = SP.recovery(t, SP.normalize(t, "spell", v)).first()
    assert (r["n"], r["reverted"], r["partial"], r["new_wrong"]) == (2, 1, 0, 0)
    assert SP.normalize(t, "off").count() == 2
    local = spark.createDataFrame([("b.y1", "zzzqz", 1)], "qid string, word string, n long")
    assert {x["qid"]: x["repaired"] for x in SP.normalize(t, "local", v, local).collect()}["b.y1"] in ("which zzqzz makes", "which zzzqz makes")
