import os
import random

import pytest

from sparkloom.llm import encode as E
from sparkloom.llm import pack as K

pytestmark = pytest.mark.skipif(not os.path.exists(E.VOCABULARY), reason="no vocabulary")
ALPHABET = " \n\t\r\x1c\x85   a'sB1é.😀　<|"


def odd_texts(n=400):
    r = random.Random(1)
    return ["", None, " ", "  a  b", "'s it's 'll", " x", "  \x1cfoo", "a" * 3000 + " <|endoftext|> b", "日本語 テスト", *("".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 60))) for _ in range(n))]


def frame(spark, ts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ts)], "doc_id long, text string, key string, block int")


def test_ids_agree_with_two_libraries(spark):
    from tokenizers import Tokenizer

    ts = odd_texts()
    got = {r["doc_id"]: r["ids"] for r in E.encode_corpus(frame(spark, ts), "doc_id", "text").collect()}
    enc = E.encoder()
    tok = Tokenizer.from_file(E.VOCABULARY.replace(".tiktoken", ".json"))
    tok.encode_special_tokens = True
    for i, t in enumerate(ts):
        assert got[i] == (enc.encode_ordinary(t) if t else []) == (tok.encode(t, add_special_tokens=False).ids if t else [])


def test_round_trip_and_blocks(spark, monkeypatch):
    ts = odd_texts(100)
    monkeypatch.setattr(E, "BLOCK_CHARS", 50)
    df = frame(spark, ts + ts[:3])
    back = {r["doc_id"]: r["text"] for r in E.decode_corpus(E.encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ts)) and len(back) == len(ts) + 3


def test_empty(spark):
    none = frame(spark, ["a"]).where("false")
    assert E.encode_corpus(none, "doc_id", "text").collect() == [] and K.pack_corpus(none, "doc_id", "text").collect() == []


def test_fill_is_tight_and_within_limits():
    r = random.Random(2)
    sizes = [r.choice([0, 1, 5, 60, 180, 300, 700, 2048]) for _ in range(3000)]
    got = K.fill(sizes, 2048, 256)
    assert sorted(i for c in got for i in c) == list(range(3000))
    assert all(sum(sizes[i] for i in c) <= 2048 and len(c) <= 256 for c in got)
    assert len(got) <= 1.01 * -(-sum(sizes) // 2048) + 1
    assert all(len(c) <= 2 for c in K.fill([0] * 5, 10, 2)) and K.fill([], 10, 2) == []
    assert all(sum(max(0, sizes[i] - 1) for i in c) <= 2048 for c in K.fill(sizes, 2048, 256, 2048))
    with pytest.raises(ValueError):
        K.fill([11], 10, 2)


def test_containers_hold_every_text(spark):
    ts = odd_texts(60) + ["word é😀 " * 3000, "x" * 9000]
    got = K.pack_corpus(frame(spark, ts), "doc_id", "text", capacity=256).toPandas()
    assert got.groupby("container")["n_tokens"].sum().max() <= 256 and not got.duplicated(["container", "place"]).any()
    joined = got.sort_values(["doc_id", "piece"]).groupby("doc_id")["text"].apply(lambda x: "".join(t or "" for t in x))
    assert [joined[i] for i in range(len(ts))] == [t or "" for t in ts]
    n = {i: len(E.encoder().encode_ordinary(t)) if t else 0 for i, t in enumerate(ts)}
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == n
    assert set(got[got["piece"] > 0]["doc_id"]) == {i for i, k in n.items() if k > 256}


def test_instruction_pairs_keep_three_limits(spark):
    r = random.Random(3)
    rows = [(i, " ".join("what" for _ in range(r.randrange(0, 40))), " ".join("word" for _ in range(r.randrange(0, 60)))) for i in range(300)] + [(900, None, None), (901, "q", "a " * 200), (902, " q ", None)]
    got = K.pack_pairs(spark.createDataFrame([(*x, "clash") for x in rows], "id long, q string, a string, block string"), "id", "q", "a", capacity=120, segments=4, loss=70).toPandas().set_index("id")
    enc = E.encoder().encode_ordinary
    assert len(got) == len(rows) and got["container"].isna().sum() == 1 and got.loc[901, "place"] != got.loc[901, "place"]
    for i, q, a in rows:
        q, a = (q or "").strip(), (a or "").strip()
        assert (got.loc[i, "n_tokens"], got.loc[i, "n_loss"], got.loc[i, "text"]) == (len(enc(q + "\n" + a)), len(enc(a)), q + "\n" + a)
    one = got.groupby("container").agg(n=("n_tokens", "sum"), loss=("n_loss", "sum"), k=("text", "count"))
    assert one["n"].max() <= 120 and one["loss"].max() <= 70 and one["k"].max() <= 4
    # each of the limits binds somewhere
    assert (one["loss"] > 60).any() and (one["k"] == 4).any() and (one["n"] > 110).any()
