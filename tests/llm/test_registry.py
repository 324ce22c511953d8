import os

import pytest

from sparkloom.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_runs_on_the_smallest_tables(spark, name):
    df = registry.queries()[name](spark, DIR)
    assert df.count() >= 0 and df.columns


def test_found_columns(spark):
    want = {"p1_found": ["qid", "family"], "p3_found": ["tab", "key_a", "key_b"], "p4_found": ["field", "term", "mark"], "p5_found": ["chunk_id", "qid"], "p7_found": ["answer_id", "defect"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "form"]}
    assert {k: registry.queries()[k](spark, DIR).columns for k in want} == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_results_hold_together(spark):
    """Relations between the results that hold on any tables."""
    q = {k: f(spark, DIR).toPandas() for k, f in registry.queries().items() if k in ("p1_found", "p1_split", "p3_found", "p3_groups", "p4_found", "p4_terms", "p5_found", "p5_report", "p8_roundtrip", "p9_containers", "p10_found", "p10_stats")}
    split = q["p1_split"]
    assert split["qid"].is_unique and split.groupby("family")["split"].nunique().max() == 1 and set(split["split"]) <= {"train", "validation", "test"}
    assert set(q["p1_found"].itertuples(index=False, name=None)) <= set(split[["qid", "family"]].itertuples(index=False, name=None))
    pairs = q["p3_found"]
    assert (pairs["key_a"] < pairs["key_b"]).all() and not pairs.duplicated().any()
    assert {*pairs["key_a"], *pairs["key_b"]} == set(q["p3_groups"]["key"]) and q["p3_groups"]["links"].sum() == 2 * len(pairs)
    t = q["p4_terms"]
    assert not t.duplicated(["field", "term"]).any() and (t["n"] >= t["records"]).all()
    assert set(q["p4_found"].itertuples(index=False, name=None)) == set(t[t["mark"].notna() & ~t["term"].str.contains(" ")][["field", "term", "mark"]].itertuples(index=False, name=None))
    assert q["p5_found"].groupby("qid").size().to_dict() == q["p5_report"].set_index("qid")["n_chunks"].to_dict()
    assert len(q["p8_roundtrip"]) == 0
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").toPandas()["doc_id"]
    packed = q["p9_containers"]
    assert set(packed["doc_id"]) == set(docs) and packed.groupby("container")["n_tokens"].sum().max() <= 2048 and not packed.duplicated(["container", "place"]).any()
    s = q["p10_stats"]
    assert set(q["p10_found"].itertuples(index=False, name=None)) == set(s[s["form"].notna() & (s["form"] != "prose")][["doc_id", "form"]].itertuples(index=False, name=None))
