import random

import numpy as np
import pytest

from sparkloom.functions.text import words
from sparkloom.llm import leakage as L


def test_fm_index():
    rng = np.random.default_rng(0)
    for size, top, m in ((1, 3, 1), (400, 3, 4), (3000, 9, 5)):
        text = rng.integers(1, top, size)
        fm = L.FMIndex(text)
        asked = np.vstack([rng.integers(1, top, (100, m)), np.full((1, m), -1)])
        lo, hi = fm.search(asked)
        view = np.lib.stride_tricks.sliding_window_view(text, m)
        for p, a, b in zip(asked, lo, hi):
            assert set(fm.locate(np.arange(a, b)).tolist()) == set(np.flatnonzero((view == p).all(1)).tolist())


def frames(spark, seed, n=80):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    qs = [(f"q{i}", " ".join(r.choice(vocab) for _ in range(r.randrange(3, 20))), [r.choice([f" s{i % 9} ", None, ""])] if r.random() < 0.7 else None) for i in range(40)]
    cs = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.6:
            q = words(r.choice(qs)[1])
            a = r.randrange(0, max(1, len(q) - 4))
            w[len(w) // 2 : len(w) // 2] = q[a : a + r.randrange(6, 16)]
        cs.append((f"c{i}", f"s{i % 9}" if i % 11 else None, " ".join(w).upper() if i % 3 else ", ".join(w)))
    cs += [("null", "s", None), ("empty", "s", ""), (None, "s", cs[0][2]), cs[1]]
    qs += [("qn", None, None), (None, qs[0][1], None), qs[0]]
    c = spark.createDataFrame([(*x, "clash", 1) for x in cs], "chunk_id string, sec_id string, text string, qid string, word int")
    return cs, qs, c, spark.createDataFrame([(*x, 2) for x in qs], "qid string, question string, gold_sec_ids array<string>, shard int")


def brute(cs, qs):
    out = set()
    for c, s, t in cs:
        w = words(t)
        runs = {tuple(w[i : i + 8]): i for i in range(len(w) - 7)}
        for q, x, _ in qs:
            v = words(x)
            if c and q and any(tuple(v[i : i + 8]) in runs for i in range(len(v) - 7)):
                out.add((c, s, q))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    cs, qs, c, q = frames(spark, seed)
    want = brute(cs, qs)
    gold = {(k, (g or "").strip()) for k, _, gs in qs for g in gs or []}
    kept = {(a, k) for a, s, k in want if (k, s) not in gold}
    found = L.leaks(c, q)
    assert {(r["chunk_id"], r["sec_id"], r["qid"]) for r in found.collect()} == want and len(want) > 10
    assert {(r["chunk_id"], r["qid"]) for r in L.without_evidence(found, q).collect()} == kept != {(a, k) for a, _, k in want}
    monkeypatch.setattr(L, "SHARD_WORDS", 60)
    monkeypatch.setattr(L, "SHARD_PHRASES", 3)
    assert {(r["chunk_id"], r["sec_id"], r["qid"]) for r in L.leaks(c, q).collect()} == want


def test_spans(spark):
    f = spark.createDataFrame([("c", "q", w) for w in (0, 1, 9, 30)] + [("d", "q", 2), ("c", "r", 1)], "chunk_id string, qid string, word int")
    assert {tuple(r) for r in L.removal_spans(f).collect()} == {("c", 0, 16), ("c", 30, 37), ("d", 2, 9)}


def test_empty(spark):
    _, _, c, q = frames(spark, 1, 3)
    assert L.leaks(c.where("false"), q).collect() == [] and L.leaks(c, q.where("false")).collect() == []
