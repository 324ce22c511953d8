"""Splits that keep related records together: components, then grouped iterative stratification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import filled
from sparkloom.operators.graph import connected_components
from sparkloom.operators.prefix import positions
from sparkloom.runtime import materialize, maybe_broadcast

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: A family of more than one in so many records is placed by itself; there can't be more of them.
LARGE = 1000
#: Pairs of labels that occur together in some family at most; labels are categories, whose number does not grow with the rows.
PAIRS = 1_000_000
# Multiples of the golden ratio are spread evenly over the unit interval.
GOLDEN = 0.6180339887498949


def families(df: DataFrame, key: str, refs: list[str], prefix_end: str = ".") -> DataFrame:
    """(key, family, members) for every distinct key that is not null.

    Ties: a trimmed reference that is the key of another record; two records naming the same key,
    whether it exists or not; keys that agree up to the first ``prefix_end``. Ties carry on. Null or
    blank references tie nothing. family is the smallest key of the component by code points, members
    its number of keys. Repeated rows count once; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("key"), *[filled(c).alias(f"ref{i}") for i, c in enumerate(refs)]).where("key is not null")
    me = F.concat(F.lit("q:"), "key")
    # one explode keeps this a single scan
    to = F.array(F.concat(F.lit("p:"), F.substring_index("key", prefix_end, 1)), *[F.concat(F.lit("q:"), f"ref{i}") for i in range(len(refs))])
    edges = rows.select(me.alias("a"), F.explode(to).alias("b")).where("b is not null")
    found = connected_components(edges, "a", "b")
    keys = rows.select("key", me.alias("node")).distinct().join(found, "node").select("key", "component")
    named = keys.groupBy("component").agg(F.min("key").alias("family"), F.count("*").alias("members"))
    return keys.join(named, "component").select("key", "family", "members")


def _place(families: list[tuple[str, dict[str, int]]], need: dict[str, list[float]]) -> dict[str, int]:
    """Split of each family (name, records by label; label '' counts all), changing ``need`` by label and split as it goes."""
    out: dict[str, int] = {}
    left: dict[str, int] = {}
    by_label: dict[str, list[tuple[str, dict[str, int]]]] = {}
    for name, vec in sorted(families, key=lambda f: (-f[1][""], f[0])):
        for label, n in vec.items():
            left[label] = left.get(label, 0) + n
            by_label.setdefault(label, []).append((name, vec))
    while by_label:
        label = min(by_label, key=lambda x: (left[x], x))
        for name, vec in by_label.pop(label):
            if name in out:
                continue
            s = out[name] = max(range(len(need[""])), key=lambda s: (round(need[label][s], 9), round(need[""][s], 9), -s))
            for k, n in vec.items():
                need[k][s] -= n
                left[k] -= n
    return out


def levels(need: list[float], mass: float) -> list[float]:
    """What each split gets of ``mass`` if each record goes to the split in most need: the one in most
    need gets all until it is level with the next, then both take turns, and so on."""
    order = sorted(range(len(need)), key=lambda s: (-need[s], s))
    amounts, left = [0.0] * len(need), float(mass)
    for j in range(1, len(order) + 1):
        part = left if j == len(order) else min(left, j * (need[order[j - 1]] - need[order[j]]))
        for s in order[:j]:
            amounts[s] += part / j
        left -= part
    return amounts


def grouped_splits(members: DataFrame, labels: Column, splits=SPLITS) -> DataFrame:
    """(key, family, split): all keys of a family in one split, with the given shares of every label.

    members: (key, family, ...) with the columns that ``labels`` (an array of strings) uses. Label
    vectors are added up by family, and the rarest label goes first: its families, largest first, go to
    the split that needs it most. A family belongs to the rarest of its labels. What a label's families
    take of the other labels is known from sums by pairs of labels, so needs are followed on those sums,
    label by label; then all families are dealt at once, in order of label and size, by an evenly spread
    sequence, so that each split gets its amount of each label in families of every size. Families above N/1000 records, at most 1000, are placed one by one before. Null and empty
    labels don't count; families without labels come last, by records. Every family gets a split; an
    empty table gives an empty result. More than ``PAIRS`` pairs of labels are an error.
    """
    spark = members.sparkSession
    names, share = [s for s, _ in splits], [p for _, p in splits]
    fam = members.groupBy("family").agg(F.count("*").alias("size"))
    each = members.select("family", F.explode(F.array_distinct(F.filter(labels, lambda x: x.isNotNull() & (x != "")))).alias("label")).groupBy("family", "label").agg(F.count("*").alias("n"))
    each = materialize(each.join(fam, "family"), "labels")
    whole = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.sum("n").alias("n")).limit(PAIRS + 1).collect()}
    fam = materialize(fam, "families")
    n = whole[""] = fam.agg(F.sum("size")).first()[0] or 0
    if len(whole) > PAIRS:
        raise ValueError(f"more than {PAIRS} labels")
    need = {label: [p * total for p in share] for label, total in whole.items()}

    # large families one by one: at most LARGE rows by arithmetic, each with its labels
    bound = n / LARGE
    first: dict[str, dict[str, int]] = {r["family"]: {"": r["size"]} for r in fam.where(F.col("size") > bound).collect()}
    for r in each.where(F.col("size") > bound).collect():
        first[r["family"]][r["label"]] = r["n"]
    placed = _place(list(first.items()), need)

    # the rest by their rarest label
    rest = each.where(F.col("size") <= bound)
    rarity = maybe_broadcast(spark.createDataFrame([(k, v) for k, v in whole.items() if k], "label string, total long"), 128)
    home = rest.join(rarity, "label").groupBy("family").agg(F.min_by(F.struct("label", "n"), F.struct("total", "label")).alias("h")).select("family", F.col("h.label").alias("home"), F.col("h.n").alias("mass"))
    home = fam.where(F.col("size") <= bound).join(home, "family", "left").select("family", "size", F.coalesce("home", F.lit("")).alias("home"), F.coalesce("mass", "size").alias("mass"))
    home = materialize(home, "home")
    sums = rest.join(home.select("family", "home"), "family").groupBy("home", "label").agg(F.sum("n").alias("n"))
    sums = sums.unionByName(home.groupBy("home").agg(F.sum("size").alias("n")).select("home", F.lit("").alias("label"), "n")).limit(PAIRS + 1).collect()
    if len(sums) > PAIRS:
        raise ValueError(f"more than {PAIRS} pairs of labels")
    takes: dict[str, dict[str, int]] = {}
    for r in sums:
        takes.setdefault(r["home"], {})[r["label"]] = r["n"]
    plan = []
    for h in sorted(takes, key=lambda x: (x == "", whole[x], x)):
        mass = takes[h][h]
        amounts = levels(need[h], mass)
        plan.append((h, [sum(amounts[: j + 1]) / mass for j in range(len(names) - 1)]))
        for label, k in takes[h].items():
            for s, a in enumerate(amounts):
                need[label][s] -= k * a / mass
    plan = maybe_broadcast(spark.createDataFrame(plan, "home string, cuts array<double>"), 128)
    dealt = positions(home, [F.col("home"), F.desc("mass"), F.desc("size"), F.col("family")], "_no").join(plan, "home")
    spread = F.col("_no") * GOLDEN - F.floor(F.col("_no") * GOLDEN)
    out = dealt.select("family", F.element_at(F.array(*map(F.lit, names)), 1 + F.size(F.filter("cuts", lambda x: x <= spread))).alias("split"))
    if placed:
        out = out.union(spark.createDataFrame([(f, names[s]) for f, s in placed.items()], "family string, split string"))
    return members.join(out, "family").select("key", "family", "split")


def question_splits(questions: DataFrame, refs: list[str]) -> DataFrame:
    """Splits of evaluation questions, stratified by kind, domain, kind of variant and tags; rows without a qid are left out."""
    fam = materialize(families(questions, "qid", refs), "family")
    facts = questions.where("qid is not null").groupBy(F.col("qid").alias("key")).agg(F.min(F.struct("kind", "domain", "variant_kind", "tags")).alias("f")).select("key", "f.*")
    tag = lambda c: F.concat(F.lit(c + "="), F.col(c))
    labels = F.concat(F.array(tag("kind"), tag("domain"), tag("variant_kind")), F.coalesce(F.transform("tags", lambda t: F.concat(F.lit("tag="), t)), F.array().cast("array<string>")))
    return grouped_splits(fam.join(facts, "key"), labels)
