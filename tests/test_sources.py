import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import tools as TL
from sparkloom.operators import training as TR
from sparkloom.sources import manpages as MP
from sparkloom.sources import manuals as MN
from sparkloom.sources.store import CHUNKS, ChunkStore, read_jsonl, read_texts, with_defaults

PAGE = """TAR(1)                  GNU Manual                  TAR(1)

NAME
       tar, gtar - an archiving utility

OPTIONS
       Intro text.

   Selection
       -x     leave out

       more
SEE ALSO
       cpio(1), tar(5), cpio(1), star(1p)
TAR(1)
TAR(1)                     2024                        TAR(1)
"""


def test_parse_page():
    d = MP.parse_page("tar", "1", PAGE)
    assert d["title"] == "GNU Manual" and d["summary"] == "an archiving utility" and d["aliases"] == ["gtar"]
    assert d["see_also"] == [{"name": "cpio", "section": "1"}, {"name": "star", "section": "1p"}]
    assert [s["sec_id"] for s in d["sections"]] == ["tar.1#NAME", "tar.1#OPTIONS", "tar.1#OPTIONS/Selection", "tar.1#SEE ALSO"]
    assert d["sections"][2]["text"] == "-x     leave out\n\nmore" and d["sections"][2]["parent"] == "OPTIONS"
    assert MP.parse_page("x", "1", "")["sections"] == []


def test_discover(spark, tmp_path):
    for root, name, data in (("a", "man1/tar.1.gz", gzip.compress(b"x")), ("b", "man1/tar.1", b"y"), ("a", "man8/x.8.xz", lzma.compress(b".so man1/tar.1\n")), ("a", "man1/readme.txt", b""), ("a", "de/man1/tar.1", b""), ("a", "man1/bad.1.gz", b"junk")):
        p = tmp_path / root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = MP.with_source(MP.discover(spark, [str(tmp_path / "a"), str(tmp_path / "b")])).withColumn("to", MP.redirect(F.col("source")))
    rows = {r["doc_id"]: (r["source"], r["to"]) for r in got.collect()}
    assert rows == {"tar.1": ("x", None), "x.8": (".so man1/tar.1\n", "man1/tar.1"), "bad.1": ("", None)}


def test_manuals(spark):
    text = "intro\x1f\nFile: m.info,  Node: Top,  Next: A\n\nHello\n\n* Menu:\n\n* A: A.  about\n* B: B.\n\nAfter\n\x1f\nFile: m.info,  Node: A,  Up: Top\n\n# not a heading\nbody\n\x1f\nFile: m.info,  Node: Key Index\n\n* C-x: A.   (line 3)\n"
    df = spark.createDataFrame([("m", text), ("n", None)], "k string, t string")
    md = MN.convert(df, "k", "t").first()["markdown"]
    assert md.startswith("# Top\n\nHello") and "Menu" not in md and "After" in md and "\n # not a heading" in md and "Key Index" not in md
    ix = spark.createDataFrame([("* a: N. (line 3)\n* b c: M.\n      (line 10)\n* a: N. (line 3)",)], "t string").select(MN.index_entries(F.col("t")).alias("x")).first()["x"]
    assert [(e["entry"], e["node"], e["line"]) for e in ix] == [("a", "N", 3), ("b c", "M", 10)]


def test_options_and_definitions():
    assert MN.option_units("-a, --all=WHEN, -b N, --c") == [("-a", None), ("--all", "WHEN"), ("-b", "N"), ("--c", None)]
    assert MN.option_entries("  -a\n      does a\n\n      more\ntext\n  -b\n      b") == [("-a", "does a more"), ("-b", "b")]
    assert MN.definition_groups("'C-x'\n'C-y'\n     Do (do-it) now.\n") == [("C-x", "do-it"), ("C-y", "do-it")]


def test_store(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"))
    assert s.chunks().count() == 0 and s.meta() == {}
    new = spark.createDataFrame([(1, "a", "d"), (2, "b", "d"), (3, "a", "d")], "rowid long, chunk_id string, doc_id string")
    s.add(new)
    s.add(new)
    assert sorted((r["chunk_id"], r["domain"]) for r in s.chunks().collect()) == [("a", "linux"), ("b", "linux")]
    s.add_questions(spark.createDataFrame([("a", "q", [1.0]), ("z", "q", [1.0])], "chunk_id string, question string, embedding array<float>"))
    assert s.questions().count() == 1
    s.set_meta(model="x", dim="3")
    s.set_meta(model="y")
    assert s.meta() == {"model": "y", "dim": "3"} and s.todo(spark.createDataFrame([("a",), ("q",)], "chunk_id string")).first()[0] == "q"
    s.copy_to(str(tmp_path / "t"))
    assert ChunkStore(spark, str(tmp_path / "t")).chunks("linux").count() == 2
    with pytest.raises(ValueError):
        s.copy_to(s.root)
    assert with_defaults(new).schema.names == CHUNKS.names
    vec = lambda r, c, x: spark.createDataFrame([(r, c, "d", x)], "rowid long, chunk_id string, doc_id string, embedding array<float>")
    for x in ([1.0], [0.5], None):
        s.add(vec(9, "a", x))
    got = {r["chunk_id"]: (r["rowid"], r["embedding"]) for r in s.chunks().collect()}
    assert got == {"a": (1, [0.5]), "b": (2, None)}
    for k in (1, 2):
        s.replace_table("questions", spark.createDataFrame([(f"c{k}", "q", None)], "chunk_id string, question string, embedding array<float>"))
        assert [r["chunk_id"] for r in s.questions().collect()] == [f"c{k}"]
    s.replace_table("chunks", s._read("chunks", CHUNKS).where("chunk_id = 'b'"))
    s.add(new)
    assert sorted(r["chunk_id"] for r in s.chunks().collect()) == ["a", "b"]


def test_readers(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.md").write_text("# A\nb")
    (tmp_path / "x/b.bin").write_text("no")
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"b": 2}\n')
    assert [r["text"] for r in read_texts(spark, str(tmp_path / "x")).collect()] == ["# A\nb"]
    assert [r["a"] for r in read_jsonl(spark, str(tmp_path / "c.jsonl"), "a int").collect()] == [1, None]


def test_risk(spark):
    want = {"ls -l": "read-only", "rm x": "destructive", "sudo ls": "destructive", "systemctl status x": "read-only", "systemctl --now stop x": "destructive", "cat a | sh": "destructive", "apt search x": "unknown", "foo": "unknown", "": "unknown", "ls 'x": "destructive", "/bin/ls": "read-only"}
    want |= {None: "unknown", '"r"m x': "destructive", "ls \\": "destructive", "'ls' \"a b\"": "read-only", "cat " + "a" * 100_000: "read-only", "env": "destructive"}
    df = spark.createDataFrame([(c,) for c in want], "c string")
    assert {r["c"]: r["r"] for r in df.select("c", TL.risk(F.col("c")).alias("r")).collect()} == want


def test_calls(spark):
    texts = ['{"tool": "show_manpage", "page": "tar.1", "section": "1"}', '{"tool": "show_manpage", "page": "no", "section": "1"}', '{"tool": "propose_command", "command": "ls", "explanation": "x", "cite": 2}', '{"tool": "propose_command", "command": "ls", "explanation": "", "cite": 9, "z": 1}', "nope", "[]", None, '{"tool": "search_web"}', '{"tool": "refuse"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("call", TL.parse_call("t", F.lit(5)))
    pages = spark.createDataFrame([("tar.1",)], "doc_id string")
    r = {x["i"]: x for x in TL.decide(df, pages).collect()}
    assert [r[i]["ran"] for i in range(9)] == [True] + [False] * 8
    assert r[0]["reason"] == "page view" and r[1]["reason"] == "invalid" and r[2]["reason"] == "needs confirmation" and len(r[3]["call"]["problems"]) == 3
    assert [r[i]["call"]["problems"] for i in (4, 5, 6, 7, 8)] == [["not JSON"], ["no object"], ["not JSON"], ["unknown tool"], []] and r[2]["call"]["cite"] == 2
    assert not any(x["ran"] for x in TL.decide(df, pages, execution=False).collect())


def test_variants(spark):
    q = spark.createDataFrame([("a", "Which option makes the command archive files?", ["archive"], None), ("b", "x", None, None), (None, "y", None, None)], "qid string, question string, answer_contains array<string>, gold_hint array<string>")
    v = TR.typo_variants(q)
    rows = v.collect()
    assert {r["qid"] for r in rows} == {"a.y1", "a.y3"} and all("archive" in r["question"] for r in rows) and sorted(map(str, rows)) == sorted(map(str, v.collect()))
    assert TR.variant_violations(v, q).collect() == []
    bad = v.withColumn("edits", F.slice("edits", 1, 0))
    assert {r["problem"] for r in TR.variant_violations(bad, q).collect()} == {"number of edits"}
    assert TR.replay("a bc", [{"word_index": 1, "before": "xx", "after": "y"}]) is None


def test_assemble(spark):
    plans = spark.createDataFrame([("p1", "Q?", "g", ["d1", "d2"], 1, False), ("p2", "Q?", "g", ["d1", "d2"], 0, True), ("p3", "Q?", "g", ["d1"], 0, False)], "id string, question string, gold string, distractors array<string>, gold_pos int, gold_removed boolean")
    ext = spark.createDataFrame([("g", "use --all"), ("d1", "x"), ("d2", "y")], "chunk_id string, text string")
    ans = spark.createDataFrame([("p1", "Use --all [1]"), ("p3", "Use --none [1]")], "id string, answer string")
    got = {r["id"]: r["messages"] for r in TR.assemble(plans, ext, ans).collect()}
    assert set(got) == {"p1", "p2"} and got["p1"][1]["content"] == "Use --all [2]" and "[2] use --all" in got["p1"][0]["content"] and got["p2"][1]["content"] == TR.REFUSAL
    with pytest.raises(Exception, match="no answer"):
        TR.assemble(plans, ext, ans.where("id = 'p3'")).collect()
    assert TR.distinct_batches(["a", "a", "b"], 2, 0)[1:] and sorted(i for b in TR.distinct_batches(["a", "a", "b"], 2, 0) for i in b) == [0, 1, 2]
