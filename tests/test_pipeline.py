import pytest
from pyspark.sql import functions as F

from sparkloom.plans import pipeline as P
from sparkloom.sources.store import ChunkStore


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    pages = spark.createDataFrame([("tar.1", "tar", "1", "archive files", "linux"), ("emacs.e", "emacs", "e", None, "emacs")], "doc_id string, name string, section string, summary string, domain string")
    secs = spark.createDataFrame([("tar.1", "tar.1#A", "A", "Use --extract to unpack the archive into a folder."), ("tar.1", "tar.1#B", "B", "Use --list to show the members of the archive."), ("emacs.e", "emacs.e#K", "K", "Type C-x C-f to open a file in a buffer."), ("x.2", "x.2#N", "N", None)], "doc_id string, sec_id string, heading string, text string")
    store = ChunkStore(spark, str(tmp_path_factory.mktemp("index")))
    got = P.build_index(pages, secs, store)
    assert got.count() == 4 and P.build_index(pages, secs, store).count() == 4
    return got


QS = [("q1", "How to unpack the archive into a folder", "linux"), ("q2", "Open a file in a buffer", "emacs"), ("q3", "zzz qqq", None), ("q4", None, None)]


def asked(spark):
    return spark.createDataFrame(QS, "qid string, question string, domain string")


@pytest.mark.parametrize("how", [{}, {"mode": "bm25"}, {"mode": "hybrid"}, {"route": "quota"}, {"route": "floor"}, {"route": "vote"}, {"route": "oracle"}, {"cap": 1}])
def test_every_way_finds_the_section(spark, chunks, how):
    hits = P.retrieve(asked(spark), chunks, **how)
    top = {r["query_id"]: r["sec_id"] for r in hits.where("rank = 1").collect()}
    assert top["q1"] == "tar.1#A"
    # most of this small corpus is of one domain, which wins every vote
    assert top["q2"] == "emacs.e#K" or how.get("route") == "vote"
    r = {x["qid"]: x for x in P.answer(asked(spark), hits, gate=0.3).collect()}
    assert r["q1"]["answer"].startswith("Use --extract") and not r["q1"]["abstained"] and r["q3"]["abstained"] and r["q4"]["gated"] and set(r) == {"q1", "q2", "q3", "q4"}


def test_cascade(spark, chunks):
    got = {r["qid"]: r for r in P.answer_in_tiers(asked(spark), chunks, [{"mode": "bm25", "keep": 1}, {"mode": "dense"}], 0.3).collect()}
    assert got["q1"]["tier"] == 0 and got["q3"]["tier"] == 1 and len(got) == 4


def test_bad_combinations(spark, chunks):
    for how in ({"mode": "bm25", "route": "quota"}, {"mode": "x"}, {"route": "y"}):
        with pytest.raises(ValueError):
            P.candidates(asked(spark), chunks, **how)
    assert P.retrieve(asked(spark).where(F.lit(False)), chunks).collect() == []
