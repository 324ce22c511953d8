import random
from collections import Counter

import pytest

from sparkloom.functions.text import words
from sparkloom.llm import terms as TM

SCHEMA = "rowid long, chunk_id string, text string, prefix string, suffix string, field string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_counts(spark, sigma):
    r = random.Random(sigma)
    rows = [(i, f"c{i}", " ".join(r.choice(["a", "b", "ab", "É", "b_a", "zz9"]) for _ in range(r.randrange(0, 12))), r.choice([None, "", "  ", "a b a"])) for i in range(80)]
    rows += [(100, "c3", rows[3][2], rows[3][3]), (101, None, "solo word", None), (102, "n", None, None), (103, "long", "q " * 50_000, None)]
    got = TM.marked_terms(TM.without_repeats(frame(spark, rows), "chunk_id", "rowid"), ["text", "prefix"], sigma).collect()
    want = {}
    for f, k in (("text", 2), ("prefix", 3)):
        n, rec, whole = Counter(), Counter(), 0
        for x in [x for x in rows if x[0] != 100]:
            ws = words(x[k])
            whole += bool(x[k] and x[k].strip())
            g = [" ".join(ws[i : i + m]) for m in range(1, sigma + 1) for i in range(len(ws) - m + 1)]
            n.update(g)
            rec.update(set(g))
        want |= {(f, w): (n[w], rec[w], "rare" if rec[w] <= 2 else "common" if 5 * rec[w] > whole else None) for w in n}
    assert {(x["field"], x["term"]): (x["n"], x["records"], x["mark"]) for x in got} == want and len(got) == len(want)


def test_flushing_changes_nothing(spark, monkeypatch):
    rows = [(i, f"c{i}", f"a{i % 7} b c{i % 3} d", None) for i in range(50)]
    whole = {tuple(r) for r in TM.suffix_counts(frame(spark, rows), ["text"], 2).collect()}
    monkeypatch.setattr(TM, "HELD", 3)
    assert whole == {tuple(r) for r in TM.suffix_counts(frame(spark, rows), ["text"], 2).collect()}


def test_empty(spark):
    assert TM.marked_terms(frame(spark, [(1, "a", "b", "c")]).where("false"), ["text", "prefix"], 2).collect() == []
