import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.functions.text import WordHashes, filled, grams, trimmed, words
from sparkloom.operators import answers as A


def one(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(c.alias("x")).first()["x"]


def test_words():
    assert words("Ａb_c­1 été—x") == ["ab", "c1", "été", "x"] and words(None) == words("") == words("_ -") == []
    assert words("ﬁle ①") == ["file", "1"]


def test_trim(spark):
    df = spark.createDataFrame([("  \t　a b\x1c\n",), ("  ",), (None,)], "v string")
    assert [r[0] for r in df.select(trimmed("v")).collect()] == ["a b", "", None]
    assert [r[0] for r in df.select(filled("v")).collect()] == ["a b", None, None]


def test_grams_stay_within_texts():
    h = WordHashes()
    flat, lens = h.flat(["a b c", "", None, "a b", "a b c d"])
    g, rec, start = grams(flat, lens, 3)
    assert rec.tolist() == [0, 4, 4] and start.tolist() == [0, 0, 1] and g[0] == g[1] != g[2]
    assert len(grams(*h.flat([]), 3)[0]) == 0 and len(np.unique(g)) == 2


def test_terms(spark):
    assert one(spark, S.query_terms("q"), q="How do I use tar --exclude=FILE, tar? /etc/x.conf a") == ["tar", "exclude=file", "etc/x.conf"]


def test_abstained(spark):
    said = ["I don't know. [1]", "Use -x [1]. I don't know.", "", "No relevant information. I do not know!"]
    assert [one(spark, S.abstained("a"), a=x) for x in said] == [True, False, False, True]
    assert one(spark, S.abstained("a"), a=None) is False


def test_citations(spark):
    assert one(spark, S.citations("a"), a="x [2] y [1] [2] [10] [0]") == [2, 1]


def test_identifiers(spark):
    got = one(spark, S.identifiers("a"), a="use --long-flag or -x, C-x C-f and M-x find-file; not utf-8-1")
    assert set(got) == {"--long-flag", "-x", "C-x", "C-f", "M-x find-file", "M-x"}


def test_hash_buckets(spark):
    pins = {"q1": 3, "q2": 1, "q3": 9, "q4": 6, "u1": 7, "u2": 8, "fam-a": 3}
    df = spark.createDataFrame([(k,) for k in pins], "q string").select("q", S.hash_mod("q", 10).alias("b"))
    assert {r["q"]: r["b"] for r in df.collect()} == pins


def test_sign_test(spark):
    from sparkloom.operators.evaluate import exact_p

    pairs = [(4, 0, 0.125), (4, 1, 0.375), (0, 6, 0.03125), (0, 0, 1.0), (3, 3, 1.0)]
    df = spark.createDataFrame([(g, x) for g, x, _ in pairs] + [(900, 800)], "g int, l int").select(S.exact_sign_p(F.col("g"), F.col("l")).alias("p"))
    got = [r["p"] for r in df.collect()]
    assert np.allclose(got[:5], [p for *_, p in pairs]) and abs(got[5] - exact_p(900, 800)) < 1e-9


def test_pointer_prefix_slug(spark):
    assert one(spark, S.pointer("d", "s"), d="tar.1", s="") == "man 1 tar"
    assert one(spark, S.pointer("d", "s"), d="emacs.emacs", s="emacs#Keys") == "Info manual emacs, section Keys"
    assert one(spark, S.slug("d"), d="  A b/C!! ") == "a-b-c" and one(spark, S.slug("d"), d="!!") == "untitled"


def test_claims_and_quotes(spark):
    a = spark.createDataFrame([(1, "q", "Use `-C`. [2] Or `grep -A`. [1]", ["d1", "d2"]), (2, "q", S.REFUSAL, None), (3, "q", 'Say "a  b" here [1]', ["d1"]), (4, None, None, None)], "answer_id long, qid string, answer string, retrieved_docs array<string>")
    c = spark.createDataFrame([(1, "d1", "s", 0, "", "grep -A a b"), (2, "d2", "s", 1, None, "-C dir")], "rowid long, doc_id string, sec_id string, ord int, prefix string, text string")
    ext = A.first_extracts(a, c)
    claims = A.claims(a)
    assert [(r["text"], r["cites"]) for r in claims.where("answer_id = 1").orderBy("claim").collect()] == [("Use `-C`.", [2]), ("Or `grep -A`.", [1])]
    s = {r["answer_id"]: r["score"] for r in A.score_answers(A.score_claims(claims, ext, a)).collect()}
    assert s[1] == 1.0
    q = {r["answer_id"]: (r["n_quotes"], r["verified"]) for r in A.verify_quotes(a, ext).collect()}
    assert q == {1: (0, False), 2: (0, False), 3: (1, True), 4: (0, False)}
    e = {(r["answer_id"], r["n"]): r["line"] for r in A.evidence_lines(a, ext).collect()}
    assert e[1, 1] == "grep -A a b" and e[1, 2] == "-C dir"
    asked = spark.createDataFrame([("q", ["-C"])], "qid string, answer_contains array<string>")
    v = {r["answer_id"]: r for r in A.verify_citations(a, asked, ext).collect()}
    assert v[1]["cite_supported"] and v[3]["cite_supported"] is False and v[4]["uncited"] and v[2]["n_citations"] == 0
