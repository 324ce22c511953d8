"""Folds of a verifier keep the variants of a question together."""

import zlib

from sparkloom.plans.evaluation_queries import held_out


def test_folds_against_brute_force(spark):
    rows = [(f"q{k}{v}", ((k * 7 + i * 3) % 10) / 10, (k * 5 + i) % 3 == 0) for k in range(30) for i, v in enumerate(("", ".synonym", ".typo1"))]
    fold = lambda k: zlib.crc32(k.split(".")[0].encode()) % 2 == 1
    want = {}
    for f in (True, False):
        own, rest = ([(s, g) for k, s, g in rows if (fold(k) == f) == x] for x in (True, False))
        gain = {t: sum(1 if not g else -1 for s, g in own if s <= t) for t, _ in own}
        best = min((t for t in gain if gain[t] == max(gain.values())))
        want[f] = (gain[best], sum(g for s, g in rest if s <= best), sum(not g for s, g in rest if s <= best))
    got = {r["fold"]: (r["gain"], r["removed_good"], r["removed_bad"]) for r in held_out(spark.createDataFrame(rows, "key string, score double, good boolean")).collect()}
    assert got == want
