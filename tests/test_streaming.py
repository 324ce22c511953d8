from datetime import datetime, timedelta

from sparkloom.sources.store import ChunkStore
from sparkloom.streaming import ingest as ST

T0 = datetime(2025, 1, 1)


def test_sessions_agree_with_islands(spark):
    rows = [("u", T0 + timedelta(seconds=s)) for s in (0, 100, 699, 1299, 1300, 5000)] + [("v", T0), (None, T0), ("w", None)]
    e = spark.createDataFrame(rows, "user_id string, ts timestamp")
    a = {tuple(r) for r in ST.idle_sessions(e, "user_id", "ts").collect()}
    assert a == {tuple(r) for r in ST.islands(e, "user_id", "ts").select("user", "begin", "stop", "n").collect()}
    assert {r[3] for r in a} == {5, 1} and len(a) == 3


def test_ingest_is_idempotent(spark, tmp_path):
    c = spark.createDataFrame([(i, f"c{i % 7}", "d") for i in range(20)], "rowid long, chunk_id string, doc_id string")
    c.repartition(3).write.parquet(str(tmp_path / "in/chunks.parquet"))
    store = ChunkStore(spark, str(tmp_path / "store"))
    for k in range(2):
        ST.ingest_stream(ST.table_stream(spark, str(tmp_path / "in"), "chunks"), store, str(tmp_path / f"check{k}")).awaitTermination()
    assert store.chunks().count() == 7
