"""Parent-child links to full hierarchies by level-wise frontier joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import trimmed
from sparkloom.runtime import materialize, release

#: Levels joined in one job before the frontier is written and tested for being empty.
LEVELS_PER_JOB = 4


def _nodes(df: DataFrame, key: str, parent: str, extra: dict[str, str]) -> DataFrame:
    """One row a key: repeats count once; of differing rows with one key the least row counts."""
    cols = [F.col(key).alias("node"), F.col(parent).alias("raw"), *[F.col(c).alias(n) for n, c in extra.items()]]
    rest = F.struct("raw", *extra)
    out = df.select(*cols).where("node is not null").groupBy("node").agg(F.min(rest).alias("r"))
    return out.select("node", "r.*").withColumn("parent", trimmed("raw"))


def _reach(df: DataFrame, key: str, parent: str, heading: str | None, level: str | None, ancestors: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all nodes, those that a root reaches with root, depth, path, broken and, if asked for, ``above``: the nodes from the root down to the parent)."""
    extra = {"heading": heading or key, "level": level or key}
    nodes = _nodes(df, key, parent, extra).withColumn("level", F.col("level").cast("int") if level else F.lit(None).cast("int"))
    nodes = materialize(nodes, "nodes")
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    kin = nodes.join(known, "parent", "left")
    # one row a node; top: it has no existing parent
    kin = materialize(kin.withColumn("top", F.col("known").isNull()), "kin")
    name = F.coalesce(F.col("heading"), F.lit(""))
    none = F.array().cast(f"array<{dict(nodes.dtypes)['node']}>")
    frontier = kin.where("top").select(
        "node", F.col("node").alias("root"), F.lit(0).alias("depth"),
        (name if heading else F.lit("")).alias("path"), F.col("raw").isNotNull().alias("broken"), none.alias("above"),
    )
    below = kin.where("not top").select(F.col("node").alias("child"), "parent", name.alias("name"))
    frontier, base = materialize(frontier, "frontier"), 0
    done = [frontier]
    while True:
        levels, at = [], frontier
        for _ in range(LEVELS_PER_JOB):
            at = at.join(below, at["node"] == below["parent"]).select(
                F.col("child").alias("node"), "root", (F.col("depth") + 1).alias("depth"),
                (F.concat_ws(" / ", "path", "name") if heading else F.col("path")).alias("path"), "broken",
                (F.concat("above", F.array("node")) if ancestors else F.col("above")).alias("above"),
            )
            levels.append(at)
        reach = materialize(reduce(DataFrame.union, levels), "frontier")
        if reach.isEmpty():
            release(reach)
            break
        done.append(reach)
        base += LEVELS_PER_JOB
        frontier = reach.where(F.col("depth") == base)
    return kin, reduce(DataFrame.union, done)


def hierarchy(df: DataFrame, key: str, parent: str, heading: str | None = None, level: str | None = None) -> DataFrame:
    """(node, parent, has_parent, level, root, depth, path, fault) for every node.

    Roots are the nodes whose parent is null or does not exist. Each round joins the frontier with the
    nodes below it and extends root, depth and path. What no root reaches lies on or under a cycle: its
    root is 'cycle', its depth -1, its path null. fault (null for nodes without a parent): ``cycle``;
    ``missing`` if the root names a parent that does not exist; ``level`` if the stated level is not
    null and differs from depth + 1; else ``none``. A blank parent names no existing node. Rows with a
    null key are left out; repeated rows count once. A null heading enters the path as ''.
    """
    kin, reached = _reach(df, key, parent, heading, level)
    out = kin.join(reached, "node", "left")
    fault = (
        F.when(F.col("raw").isNull(), None)
        .when(F.col("root").isNull(), "cycle")
        .when(F.col("broken"), "missing")
        .when(F.col("level").isNotNull() & (F.col("level") != F.col("depth") + 1), "level")
        .otherwise("none")
    )
    return out.select(
        "node", "parent", F.col("raw").isNotNull().alias("has_parent"), "level", F.coalesce("root", F.lit("cycle")).alias("root"),
        F.coalesce("depth", F.lit(-1)).alias("depth"), "path", fault.alias("fault"),
    )


def descendants(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(ancestor, node, distance): every node below every node, in trees and not on cycles.

    The frontier carries the nodes above it down from the roots; these are the pairs, and take no more
    room than the result. What no root reaches has none.
    """
    _, reached = _reach(df, key, parent, None, None, ancestors=True)
    pairs = reached.where("depth > 0").select("node", "depth", F.posexplode("above").alias("place", "ancestor"))
    return pairs.select("ancestor", "node", (F.col("depth") - F.col("place")).alias("distance"))
