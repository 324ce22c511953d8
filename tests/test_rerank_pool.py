"""The reranker sees the whole pool of candidates."""

from pyspark.sql import functions as F

from sparkloom.plans import pipeline_queries as P


def test_a_candidate_beyond_the_first_five_can_win(spark, tmp_path, monkeypatch):
    # the longer a chunk, the worse its BM25 rank; this reranker prefers long ones
    rows = [(k, f"c{k:02}", "d", "s", 0, None, "alpha" + " beta" * k) for k in range(1, 61)] + [(99, "z", "d", "s", 0, None, "gamma " * 500)]
    spark.createDataFrame(rows, "rowid long, chunk_id string, doc_id string, sec_id string, ord int, prefix string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("q50", "alpha"), ("q51", "alpha")], "qid string, question string").write.parquet(f"{tmp_path}/emacs_questions.parquet")
    monkeypatch.setattr(P.M, "rerank_score", lambda q, text: F.length(text).cast("double"))
    assert [(r["query_id"], r["chunk_id"]) for r in P.rerank_and_read(spark, str(tmp_path)).collect()] == [("q50", "c50")]
