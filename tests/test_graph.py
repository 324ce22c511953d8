import random

import pytest

from sparkloom.operators.graph import connected_components
from sparkloom.operators.hierarchy import descendants, hierarchy

SCHEMA = "sec_id string, parent string, level int, heading string, node string, root string, text string"


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in list(up)}


@pytest.mark.parametrize("n,m", [(6, 3), (40, 30), (200, 150)])
def test_components(spark, n, m):
    r = random.Random(n)
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(n // 2)]
    edges += [("hub", f"leaf{i}") for i in range(n)] + [(None, "x"), ("y", None), ("z", "z")] + edges[:3]
    got = connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    assert {tuple(r) for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def row(sec, parent=None, level=None, heading="h"):
    return (sec, parent, level, heading, "clash", "clash", None)


def test_hierarchy_faults(spark):
    rows = [row("a", None, 1, "A"), row("b", " a ", 2, "B"), row("b", " a ", 2, "B"), row("c", "b", 9, None), row("d", "gone", 1), row("e", "d", None), row("x", "y"), row("y", "z"), row("z", "y"), row("s", "s"), row("t", "  "), (None, "a", 1, "", "", "", "")]
    rows += [row("n0")] + [row(f"n{i}", f"n{i - 1}", i + 1, f"H{i}") for i in range(1, 12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["node"]: r for r in hierarchy(df, "sec_id", "parent", "heading", "level").collect()}
    fault = {k: (v["root"], v["depth"], v["fault"]) for k, v in got.items()}
    assert fault["a"] == ("a", 0, None) and fault["b"] == ("a", 1, "none") and fault["c"] == ("a", 2, "level")
    assert fault["d"] == ("d", 0, "missing") and fault["e"] == ("d", 1, "missing") and fault["t"] == ("t", 0, "missing")
    assert all(fault[k] == ("cycle", -1, "cycle") for k in "xyzs")
    assert got["b"]["path"] == "A / B" and got["c"]["path"] == "A / B / " and got["x"]["path"] is None
    assert fault["n11"] == ("n0", 11, "none") and len(got) == 22
    below = {tuple(r) for r in descendants(df, "sec_id", "parent").collect()}
    assert ("a", "c", 2) in below and ("n0", "n11", 11) in below and sum(1 for x in below if x[1].startswith("n")) == 66
    assert not any(x[0] in "xyzs" or x[1] in "xyzs" for x in below)


def test_empty_hierarchy(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hierarchy(df, "sec_id", "parent", "heading", "level").collect() == [] and descendants(df, "sec_id", "parent").collect() == []
