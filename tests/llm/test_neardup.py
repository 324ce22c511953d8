import random
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.functions.text import words
from sparkloom.llm import neardup as N

T = Fraction(7, 10)


def brute(sets, t):
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) * t.denominator >= t.numerator * len(sets[a] | sets[b])}


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def texts(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocab) for _ in range(r.randrange(15, 80))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = w[: -r.randrange(1, 6)]
        out.append(" ".join(w))
    return out


def frame(spark, ts):
    rows = [(f"c{i:03}", t, i, "clash", "clash") for i, t in enumerate(ts)]
    rows += [("null", None, 1, "", ""), ("blank", " \n", 1, "", ""), (None, ts[0], 1, "", ""), rows[0]]
    return spark.createDataFrame(rows, "chunk_id string, text string, cls long, key string, part string")


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_against_brute_force(spark, seed):
    ts = texts(seed)
    sets = {f"c{i:03}": shingles(t) for i, t in enumerate(ts)}
    want = brute({k: s for k, s in sets.items() if s}, T)
    got = {(r["key_a"], r["key_b"]) for r in N.near_duplicate_chunks(frame(spark, ts)).collect()}
    assert got == want and len(want) > 20


def test_cells_of_hot_anchors_lose_nothing(spark, monkeypatch):
    common = " ".join(f"common{i}" for i in range(40))
    ts = [f"{common} tail{i} more{i}" for i in range(40)] + [common]
    whole = {tuple(r) for r in N.near_duplicate_chunks(frame(spark, ts)).collect()}
    monkeypatch.setattr(N, "CELL", 7)
    assert whole == {tuple(r) for r in N.near_duplicate_chunks(frame(spark, ts)).collect()} and len(whole) == 41 * 40 // 2


def test_splitting_by_true_numbers_loses_no_pair():
    """Entries of large buckets, of one group and of two, meet in the cells of the grid as they did in the bucket."""
    r = np.random.default_rng(5)
    e = np.zeros(400, N.ENTRY)
    e["bucket"] = np.repeat([5, 6, 7], [100, 180, 120])
    e["side"] = np.where(e["bucket"] == 6, np.arange(400) % 2, 2)
    e["id"], e["size"] = r.permutation(400), 10
    calm, hot, part = N.split_hot(e, 8, 30)
    assert len(calm) == 0 and len(hot) == len(part) and part.max() < 8
    t = Fraction(1, 10)
    whole = {tuple(x) for x in N._pairs_of_part(e, t).tolist()}
    cells = [N._pairs_of_part(hot[part == p], t) for p in range(8)]
    assert whole == {tuple(x) for c in cells for x in c.tolist()} and len(whole) == 100 * 99 // 2 + 90 * 90 + 120 * 119 // 2
    # each pair in one cell, and no cell larger than two groups of some 30
    assert sum(map(len, cells)) == len(whole) and np.unique(hot["bucket"], return_counts=True)[1].max() < 120
    calm, hot, _ = N.split_hot(e, 8, 100)
    assert len(calm) == 400 and not len(hot)


def test_copies(spark, monkeypatch):
    t = " ".join(f"x{i}" for i in range(30))
    got = [tuple(r) for r in N.near_duplicate_chunks(frame(spark, [t] * 5)).collect()]
    assert len(got) == 10
    monkeypatch.setattr(N, "COPIES", 3)
    near = t + " y"
    got = {tuple(r) for r in N.near_duplicate_chunks(frame(spark, [t] * 5 + [near])).collect()}
    assert got == {("c000", f"c00{i}") for i in range(1, 6)}


def test_very_long_and_empty(spark):
    long = " ".join(f"v{i % 70_000}" for i in range(100_000))
    assert [tuple(r) for r in N.near_duplicate_chunks(frame(spark, [long, long + " z", "short"])).collect()] == [("c000", "c001")]
    assert N.near_duplicate_chunks(frame(spark, ["a"]).where("false")).collect() == []
    assert N.groups(N.near_duplicate_chunks(frame(spark, ["a"]).where("false"))).collect() == []


def test_aliases(spark):
    r = random.Random(4)
    rows = [(f"d{i:02}", [x if r.random() < 0.5 else f" {x.upper()} " for x in r.sample("abcdefg", r.randrange(0, 7))] + [None, " "]) for i in range(60)] + [("n", None), (None, list("abcd"))]
    df = spark.createDataFrame(rows, "doc_id string, aliases array<string>")
    sets = {k: {x.strip().lower() for x in v if x and x.strip()} for k, v in rows if k and v}
    want = brute({k: s for k, s in sets.items() if len(s) >= 4}, Fraction(6, 10))
    assert {tuple(x) for x in N.near_duplicate_aliases(df).collect()} == want and want


def test_groups(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "key_a string, key_b string")
    assert {tuple(r) for r in N.groups(p).collect()} == {("a", "a", 1), ("b", "a", 2), ("c", "a", 1), ("x", "x", 1), ("y", "x", 1)}


def test_fingerprints_bound_the_difference():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 80).astype(np.uint64)
    b = np.concatenate([a[:70], r.integers(0, 2**63, 9).astype(np.uint64)])
    f = N._fingerprints(np.concatenate([a, b]), np.repeat([0, 1], [80, 79]), 2)
    assert np.bitwise_count(f[0] ^ f[1]).sum() <= 19
