from pyspark.sql import functions as F

from sparkloom.llm import splits

REFS = ["variant_of", "paraphrase_of"]
SCHEMA = "qid string, variant_of string, paraphrase_of string, kind string, domain string, variant_kind string, tags array<string>, family string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(q, v, p, "a" if i % 4 else "u", "d", None, ["t", None] if i % 3 else None, "clash", "clash") for i, (q, v, p) in enumerate(rows)], SCHEMA)


def test_ties(spark):
    rows = [("a", None, None), ("b", " a ", None), ("c", None, "b"), ("d", "ghost", None), ("e", None, "ghost "), ("f.1", None, None), ("f.2.x", "  ", ""), ("f", None, None), ("g", None, None), ("ghost.2", None, None), (None, "a", None), ("b", " a ", None), ("h", "h", None)]
    got = {r["key"]: (r["family"], r["members"]) for r in splits.families(frame(spark, rows), "qid", REFS).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 2), "e": ("d", 2), "f": ("f", 3), "f.1": ("f", 3), "f.2.x": ("f", 3), "g": ("g", 1), "ghost.2": ("ghost.2", 1), "h": ("h", 1)}


def test_empty(spark):
    df = frame(spark, [("x", None, None)]).where("false")
    assert splits.families(df, "qid", REFS).collect() == [] and splits.question_splits(df, REFS).collect() == []


def test_splits_keep_families_and_shares(spark, monkeypatch):
    rows = [(f"q{i:04}", f"q{i - i % 5:04}" if i % 5 else None, None) for i in range(1500)] + [(f"big{i}", "hub", None) for i in range(300)]
    df = frame(spark, rows)
    # with 10**6 every family is placed by itself, in turn
    for large in (splits.LARGE, 10**6):
        monkeypatch.setattr(splits, "LARGE", large)
        got = splits.question_splits(df, REFS).toPandas()
        assert len(got) == 1800 and got.groupby("family")["split"].nunique().max() == 1
        share = got["split"].value_counts(normalize=True)
        assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02
    assert set(splits.question_splits(df, REFS).toPandas().itertuples(index=False)) == set(got.itertuples(index=False))


def test_many_families_and_labels(spark):
    """60,000 families, 1,600 labels; each label of some size has its shares."""
    i = F.col("id")
    fam = F.floor(i / (1 + F.pmod(F.xxhash64(F.floor(i / 4)), F.lit(3))))
    members = spark.range(150_000).select(i.cast("string").alias("key"), fam.cast("string").alias("family"), i)
    labels = F.array(F.concat(F.lit("k"), (i % 7).cast("string")), F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(1600)).cast("string")), F.lit(None), F.lit(""))
    members = members.withColumn("labels", labels)
    got = splits.grouped_splits(members, F.col("labels")).join(members.select("key", "labels"), "key").toPandas()
    assert len(got) == 150_000 and got["family"].nunique() > 60_000 and got.groupby("family")["split"].nunique().max() == 1
    share = got["split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.005 and abs(share["validation"] - 0.1) < 0.005 and abs(share["test"] - 0.1) < 0.005
    one = got.assign(label=got["labels"].str[0]).groupby("label")["split"].value_counts(normalize=True).unstack()
    assert (abs(one - [0.1, 0.8, 0.1]) < 0.02).all(axis=None)
    two = got.assign(label=got["labels"].str[1]).groupby("label")["split"].value_counts(normalize=True).unstack().fillna(0)
    assert two["train"].std() < 0.04  # by chance it were 0.041


def test_levels():
    """As dealing one record after another to the split in most need."""
    for need, mass in (([8.0, 1.0, 1.0], 10), ([3.0, -2.0, 3.0], 4), ([5.0, 5.0, 5.0], 7), ([1.0, 2.0, 9.0], 3)):
        left, got = list(need), [0] * 3
        for _ in range(mass):
            s = max(range(3), key=lambda s: (left[s], -s))
            left[s] -= 1
            got[s] += 1
        assert all(abs(a - b) < 1.0001 for a, b in zip(splits.levels(need, mass), got)), (need, mass)
