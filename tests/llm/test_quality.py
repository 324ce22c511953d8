import numpy as np
import pytest

from sparkloom.llm import quality as Q

PROSE = "The program reads the file and then writes every line of it to the log.\nIf this fails, it is an error and the user has to start again."
SAMPLES = {
    "prose": [PROSE, PROSE.replace("\n", " "), PROSE.replace(".", ""), "HEADING\n" + PROSE, "Die Option schreibt die Sitzung in die Sicherung, bevor die Grenze gelesen wird. Das Verfahren ist nicht neu und es wird oft genutzt.", PROSE + " " + PROSE + "\n- one\n- two", "Some modes convert repeatedly, while initial\npackages install after the first of them has\nended."],
    "list": ["- red door\n- blue door\n- green door\n- old door", "Options\n=======\n1. open the door\n2. close the door\n3. paint the door\n4. sell the door", "/usr/bin/a\n/etc/passwd\n~/.profile\n/var/lib/x", "The following are known:\nC-w C-j     skip-folder\nC-b a       handle-mode\nC-v w       format-prefix", "tar(1), gzip(1), cpio(5), star(1p)", "history\n    prunes old tokens\ntoken\n    queries lists", "[x] copy files,\n[ ] move files;\n[x] drop files"],
    "table": ["a,b,c\n1,2,3\n4,5,6", "| A | B |\n|---|---|\n| 1 | no |\n| yes | - |", "NAME\tSIZE\tKIND\nx\t1\tno\ny\t2\tyes", "   12    345     6\n    1      2    33\n  444     55     6", "+----+----+\n| A  | B  |\n| 1  | no |\n+----+----+", "<tr><td>A</td><td>B</td></tr>\n<tr><td>1</td><td>no</td></tr>", "Heading\n\na;b;c\n-;1;no\nx;y;z"],
    "junk": ["km? km? km? km? km? km? km? km? km?", "#####\n~~~~~~~\n______", "WCe0xhqGyps1M+UK9xntAkH32lOvfwUGyl21omBXUtw1Y+aBIOqUgKJLZlCN6qGV\nB+hPdBqTX+AHfpY2cOeCzZ/sMW3RNaW5ktEuUQ6cZi0Pv7jxDnmHdaiq7KPQBxcl", "<p>&nbsp;</div>&nbsp;<span>&nbsp;<td>&nbsp;", "%% ?? && $_ ;; }{ || << @# 0x1f", "00000000  aa a5 68 ca e9 cb d8 07\n00000010  d5 26 3c ea ab be bb b0", "rcuxxgvihkfy nvyuhfksvbgrk kyczux yfhcx pvysh hzgxdhjlb xxghg", ".PP \\fB\\-\\|87\\&\\{\n.nr \\fI\\-\\|66\\&\\{"],
}


@pytest.mark.parametrize("form", Q.FORMS)
def test_forms_without_labels(form):
    p = Q.Profiles(Q.Measures(0), np.empty(0, int))
    assert list(zip(SAMPLES[form], p.forms(Q.measure(SAMPLES[form])))) == [(t, form) for t in SAMPLES[form]]


def test_statistics(spark):
    rows = [(1, "The cat sat.\nOn a mat", "x"), (2, None, "x"), (3, " \n", "x"), (4, "word " * 200_000, "x"), (5, "--\n", "x"), (1, "The cat sat.\nOn a mat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    labels = spark.createDataFrame([(1, " Prose ", "r"), (1, "prose", "s"), (2, "junk", "r"), (4, "what", "r"), (None, "list", "r"), (9, "list", "r")], "doc_id long, form string, rater string")
    got = {}
    for r in Q.text_statistics(docs, labels).collect():
        got[r["doc_id"]] = r
    assert (got[1]["n_words"], got[1]["punctuated_lines"], got[1]["form"]) == (6, 0.5, "prose") and abs(got[1]["common_words"] - 0.5) < 1e-9 and abs(got[1]["mean_word_length"] - 15 / 6) < 1e-9 and abs(got[1]["symbol_ratio"] - 1 / 16) < 1e-9
    assert got[2]["n_words"] == got[3]["n_words"] == 0 and got[2]["form"] is None and got[3]["symbol_ratio"] is None
    assert got[4]["form"] == "junk" and got[5]["n_words"] == 0 and got[5]["form"] == "junk"
    assert Q.text_statistics(docs.where("false"), labels).collect() == []
    assert {r["doc_id"]: r["form"] for r in Q.text_statistics(docs, labels.where("false")).collect()}[1] == "prose"


def test_divergence():
    """Sparse divergences agree with the definition."""
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (6, 9)) * (rng.random((6, 9)) < 0.5)
    counts[2] = 0
    q = rng.random((4, 9)) * (rng.random((4, 9)) < 0.6)
    q /= q.sum(1, keepdims=True)

    def plain(p, q):
        if not p.sum():
            return 1.0
        p = p / p.sum()
        m = (p + q) / 2
        half = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
        return (half(p) + half(q)) / 2

    r, c = np.nonzero(counts)
    got = Q.divergences(r, c, counts[r, c].astype(float), 6, q)
    assert np.allclose(got, [[plain(p, x) for x in q] for p in counts], atol=1e-5)


def test_views_of_a_long_text_add_up():
    text = "".join(f"The file {i} is read and written.\n" for i in range(30_000))
    whole, half = Q.measure([text]), Q.measure([text[: len(text) // 2], text[len(text) // 2 :]])
    assert len(text) > Q.SLICE and whole.words[0] == 7 * 30_000
    for v in ("words", "lines", "function"):
        a, b = (np.bincount(m.view(v)[1], m.view(v)[2], Q.VIEWS[v]) for m in (whole, half))
        assert abs(a - b).sum() <= 0.001 * a.sum() and whole.lines[0] == 30_000


def test_counts_agree_with_words_one_by_one():
    from sparkloom.functions.text import words

    texts = ["Ab1 the_file,x \tand\r\nthe 2nd", "Ünïcode ﬁle…\u2028 über 12\x85", "", " ", "a" * 70 + " b", "😀 𝔸 ok"]
    m = Q.measure(texts)
    assert m.words.tolist() == [len(words(t)) for t in texts] and m.word_chars.tolist() == [sum(map(len, words(t))) for t in texts]
    assert m.lines.tolist() == [2, 2, 0, 0, 1, 1] and m.symbols.tolist()[0] == 2 and m.common.tolist()[0] == 3


def _labelled():
    import os

    import duckdb

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    rows = duckdb.connect().execute(f"SELECT DISTINCT doc_id, lower(trim(form)), text FROM '{d}/labels.parquet' JOIN '{d}/documents.parquet' USING (doc_id) WHERE form IS NOT NULL AND text IS NOT NULL").fetchall()
    return sorted(x for x in rows if x[2].strip() and x[1] in Q.FORMS)


def test_held_out_labels():
    """Accuracy on hand-labelled documents that took no part in the fit, of which some labels are wrong."""
    rows = _labelled()
    hit = 0
    for k in range(10):
        fit, held = [x for i, x in enumerate(rows) if i % 10 != k], rows[k::10]
        p = Q.Profiles(Q.measure([t for _, _, t in fit]), np.array([Q.FORMS.index(f) for _, f, _ in fit]))
        hit += sum(a == f for a, (_, f, _) in zip(p.forms(Q.measure([t for _, _, t in held])), held))
    assert hit / len(rows) > 0.93


def test_divergences_decide():
    """Without the divergences nothing is left to tell forms apart."""
    rows = _labelled()
    m = Q.measure([t for _, _, t in rows])
    p = Q.Profiles(m, np.array([Q.FORMS.index(f) for _, f, _ in rows]))
    was = p.forms(m)
    p.vectors = lambda m: np.zeros((m.n, p.place.shape[1]))
    assert len(set(p.forms(m))) == 1 and len(set(was)) == 4
