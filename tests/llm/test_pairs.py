import pytest

from sparkloom.llm import pairs as P

EN = ["The option writes the field into the file before the other list is read by the program.", "If the file is missing, the command creates it when it starts and reads every line after that.", "This setting keeps the old value unless you change it, and the user can do so at any time."]
FR = ["L'option écrit le champ dans le fichier avant que l'autre liste ne soit lue par le programme.", "Si le fichier manque, la commande le crée au démarrage et lit ensuite chaque ligne du texte.", "Ce réglage garde l'ancienne valeur sauf si vous la changez, et l'utilisateur peut le faire à tout moment."]


def docs(spark):
    rows = [(i, x * 3, lang) for i, (x, lang) in enumerate([(t, l) for l, ts in (("en", EN), ("fr", FR)) for t in ts * 4])]
    return spark.createDataFrame(rows + [(900, None, "en"), (901, "zz", None)], "doc_id long, text string, lang string")


GOOD = [("How do I list files?", "Use `ls -l` to list every file in the folder [1].", "answerable"), ("Where is the setting kept?", "It is kept in the folder and read at startup [2]", "answerable")]
CASES = [
    ("How do I list files?", None, "answerable", "empty"), ("How do I list files?", " [1] ", "answerable", "empty"), ("How do I list files?", "N/A", "answerable", "empty"), ("How?", "​", "answerable", "empty"), ("How?", "``", "unanswerable", "empty"),
    ("How do I list files here?", "You asked: how do i list files here", "answerable", "copy"), ("How do I list files here?", "How do I list files here?\nHow do I list files here?", "answerable", "copy"),
    ("How do I list files here?", "How do I list files here?\nUse `ls` in the folder [1].", "answerable", None),
    ("How do I list files?", "I don't know [1]. Please consult the full manual.", "answerable", "refusal"), ("How do I list files?", "I don't know.", "unanswerable", None),
    ("How do I list files?", "The extracts do not mention it directly, but `-x` lists the files [1].", "answerable", None),
    ("How do I list files in the folder?", FR[0] + " [1]", "answerable", "language"), ("How do I list files in the folder?", "Yes.", "answerable", None), ("How do I list files in the folder?", 'The message “' + FR[1] + '” means that the file is missing [1].', "answerable", None),
    ("How do I list files?", "Use the list of every file, which", "answerable", "truncated"), ("How do I list files?", "Use `ls -l", "answerable", "truncated"), ("How do I list files?", "Run this in the folder (for example", "answerable", "truncated"),
    ("How do I list files?", "It is kept in the folder and read at startup", "answerable", None), ("How do I list files?", "Run this:\n\n    ls --all /tmp", "answerable", None), (None, "It is read at startup [1].", None, None),
]


def test_cases(spark):
    rows = [(i, q, a, k) for i, (q, a, k, _) in enumerate(CASES)] + [(100 + i, *g) for i in range(20) for g in GOOD[i % 2 : i % 2 + 1]] + [(0, *CASES[0][:3]), (None, "a", "b", "answerable")]
    rows += [(200 + i, "Where?", "The list which is read at startup is kept, which means it is read at startup [1].", "answerable") for i in range(5)]
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], "answer_id long, question string, answer string, kind string, abstained boolean, key string")
    got = {r["answer_id"]: r["defect"] for r in P.defective_pairs(df, docs(spark)).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: d for i, (*_, d) in enumerate(CASES)}
    assert not any(k >= 100 for k in got)


def test_empty(spark):
    a = spark.createDataFrame([], "answer_id long, question string, answer string, kind string, abstained boolean")
    assert P.defective_pairs(a, docs(spark)).collect() == [] and P.defective_pairs(a, docs(spark).where("false")).collect() == []


def test_held_out_languages(spark):
    m = P.fit_languages(docs(spark))
    assert m.names == ["en", "fr"]
    assert m.differ("How can the user change the value of the setting?", "L'utilisateur peut changer la valeur avec la commande.")
    assert not m.differ("How can the user change the value of the setting?", "The user can change the value with the command.")


@pytest.mark.parametrize("text,cut", [("a (b", True), ("a “b", True), ("a “b”", False), ("end,", True), ("done", False), ("x `--", True)])
def test_open_ends(text, cut):
    assert P.breaks_off_openly(text) is cut


def test_refusals_are_learnt_from_the_record(spark):
    """A way of declining that no ideal refusal has, recorded as abstained with one mistake in ten."""
    rows = [(i, f"What does tool{i} do?", f"Tool{i} stays a riddle to these pages.", i % 10 != 0) for i in range(200)]
    rows += [(1000 + i, f"What does tool{i} do?", f"Tool{i} sorts the pages it is given.", i % 10 == 0) for i in range(200)]
    got = P.fit_refusals(spark.createDataFrame(rows, "key long, question string, answer string, abstained boolean"), 100)
    assert got.declines("What does x9 do?", "x9 stays a riddle to these pages.") and not got.declines("What does x9 do?", "x9 sorts the pages it is given.")
    assert not got.declines("What does x9 do?", "x9 stays a riddle to these pages. x9 sorts the pages it is given.") and not got.declines("", "")


def test_more_languages_than_sixteen(spark):
    rows = [(i, EN[i % 3] if i % 20 else FR[i % 3], "en" if i % 20 else "fr") for i in range(60)] + [(1000 + i, "zz qq " * 9, chr(97 + i) + "x") for i in range(20)]
    assert len(P.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).names) == 22


def test_smoothed_ends():
    c = P.EndCounts()
    for _ in range(50):
        c.add("The tool reads the folder. It then writes the folder.")
        c.add("It keeps what it reads of the folder in the cache.")
    rows = c.rows().to_pylist()
    at = {(r["kind"], r["context"]): (r["n"], r["ends"]) for r in rows}
    assert at["word", "folder"] == (150, 100) and at["pair", "the folder"] == (150, 100) and at["all", ""] == (50 * 21, 150) and at["chars", "^fo"] == (150, 0) and at["chars", "der"] == (150, 150)
    assert not c.n["word"]
