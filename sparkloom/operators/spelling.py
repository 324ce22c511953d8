"""Spelling repair against the corpus vocabulary: deletion neighbourhoods joined on equal strings, then verified."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.scalars import found

# Letters beside each letter on a QWERTY keyboard.
KEYS_BESIDE = {
    "q": "wa", "w": "qeas", "e": "wrds", "r": "etdf", "t": "ryfg", "y": "tugh", "u": "yihj", "i": "uojk", "o": "ipkl", "p": "ol",
    "a": "qwsz", "s": "awedxz", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "j": "huikmn", "k": "jiolm", "l": "kop",
    "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}
#: Punctuation that may stand at a token's edges; marks of options, paths and versions belong to the token.
EDGES = "!\"#$%&'()*+,:;<>?@[\\]^`{|}"


def vocabulary(chunks: DataFrame, least: int = 2, letters: int = 3) -> DataFrame:
    """(word, n): runs of ASCII letters in prefixes and texts, each chunk once."""
    c = chunks.select("chunk_id", F.lower(F.concat(F.coalesce("prefix", F.lit("")), F.coalesce("text", F.lit("")))).alias("t")).dropDuplicates(["chunk_id"])
    w = c.select(F.explode(found("t", "[a-z]+")).alias("word")).where(F.length("word") >= letters)
    return w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def osa(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours counting as one and no part edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def beside(a: str, b: str) -> bool:
    """The words differ in one letter, which was hit beside the right key."""
    if len(a) != len(b):
        return False
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return len(off) == 1 and off[0][1] in KEYS_BESIDE.get(off[0][0], "")


def band(n: int) -> int:
    """Largest distance allowed for a word of n letters."""
    return 1 if n <= 7 else 2


def shortened(word: str, most: int) -> list[str]:
    """The word and all strings from dropping up to ``most`` letters."""
    out = {word}
    for k in range(1, min(most, len(word)) + 1):
        out.update("".join(word[i] for i in kept) for kept in combinations(range(len(word)), len(word) - k))
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _shortened(words: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([shortened(w, int(m)) for w, m in zip(words, most)])


@F.pandas_udf(T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("far", T.BooleanType())]))
def _compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"distance": [osa(x, y) for x, y in zip(a, b)], "far": [not beside(x, y) for x, y in zip(a, b)]})


def tokens(questions: DataFrame, key: str = "qid", text: str = "question") -> DataFrame:
    """(key, place, token, head, core, tail): tokens at single blanks; the core is without punctuation at its edges."""
    edge = "[" + "".join("\\" + c for c in EDGES) + "]*"
    out = questions.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, " ")).alias("place", "token"))
    part = lambda k: F.regexp_extract("token", f"(?s)^({edge})(.*?)({edge})$", k)
    return out.withColumns({"head": part(1), "core": part(2), "tail": part(3)})


def candidates(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(core, word, distance): the best word for each core that may be repaired and has one.

    A core of four or more ASCII letters outside the vocabulary is repaired by the word of least
    distance; ties go to a neighbouring key, then to the more frequent, then to the smaller word.
    """
    core = F.lower("core")
    odd = toks.where(F.col("core").rlike("^[A-Za-z]{4,}$")).select(core.alias("core")).distinct().join(vocab.select(F.col("word").alias("core")), "core", "left_anti")
    most = F.when(F.length("core") <= 7, 1).otherwise(2)
    left = odd.select("core", F.explode(_shortened("core", most)).alias("short"))
    # a word can only be reached by a core whose length is within its band
    right = vocab.select("word", "n", F.explode(_shortened("word", F.lit(2))).alias("short"))
    near = left.join(right, "short").select("core", "word", "n").distinct()
    near = near.withColumn("c", _compare("core", "word")).where(F.col("c.distance") <= F.when(F.length("core") <= 7, 1).otherwise(2))
    best = near.withColumn("k", F.row_number().over(W.partitionBy("core").orderBy("c.distance", "c.far", F.desc("n"), "word"))).where("k = 1")
    return best.select("core", "word", F.col("c.distance").alias("distance"))


def repair(questions: DataFrame, vocab: DataFrame, key: str = "qid", text: str = "question") -> DataFrame:
    """(key, repaired, n_edits): questions with their misspelt tokens replaced; case and punctuation are kept."""
    toks = tokens(questions, key, text)
    found_ = candidates(toks, vocab).select(F.col("core").alias("low"), "word")
    j = toks.withColumn("low", F.lower("core")).join(found_, "low", "left")
    cased = F.when(F.col("core") == F.upper("core"), F.upper("word")).when(F.col("core") == F.initcap("core"), F.initcap("word")).otherwise(F.col("word"))
    new = F.when(F.col("word").isNull(), F.col("token")).otherwise(F.concat("head", cased, "tail"))
    rows = j.select(key, F.struct("place", new.alias("t")).alias("x"), F.col("word").isNotNull().cast("int").alias("e"))
    got = rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"), F.sum("e").alias("n_edits"))
    return got.select(key, F.array_join(F.transform("xs", lambda x: x["t"]), " ").alias("repaired"), "n_edits")


def local_repair(questions: DataFrame, targets: DataFrame, vocab: DataFrame, key: str = "qid", text: str = "question") -> DataFrame:
    """(key, core, word): repairs by the words of each question's own extracts, given as (key, word, n).

    Words of the vocabulary stay as they are. Targets out of reach by length are cut before comparing.
    """
    odd = tokens(questions, key, text).where(F.col("core").rlike("^[A-Za-z]{4,}$")).select(key, F.lower("core").alias("core")).distinct()
    odd = odd.join(vocab.select(F.col("word").alias("core")), "core", "left_anti").join(targets.select(key, F.col("word").alias("core")), [key, "core"], "left_anti")
    most = F.when(F.length("core") <= 7, 1).otherwise(2)
    near = odd.join(targets, key).where(F.abs(F.length("core") - F.length("word")) <= most)
    near = near.withColumn("c", _compare("core", "word")).where(F.col("c.distance") <= most)
    return near.withColumn("k", F.row_number().over(W.partitionBy(key, "core").orderBy("c.distance", "c.far", F.desc("n"), "word"))).where("k = 1").select(key, "core", "word", F.col("c.distance").alias("distance"))


def normalize(questions: DataFrame, mode: str, vocab: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(qid, repaired, n_edits) by mode: ``off``, ``spell`` (needs a vocabulary) or ``local`` (needs the words of each question's extracts as well)."""
    if mode == "off":
        return questions.where("question is not null").select("qid", F.col("question").alias("repaired"), F.lit(0).cast("long").alias("n_edits"))
    if mode not in ("spell", "local") or vocab is None or (mode == "local") != (targets is not None):
        raise ValueError("mode and arguments don't agree")
    if mode == "spell":
        return repair(questions, vocab)
    fixes = local_repair(questions, targets, vocab).select("qid", F.col("core").alias("low"), "word")
    j = tokens(questions).withColumn("low", F.lower("core")).join(fixes, ["qid", "low"], "left")
    new = F.when(F.col("word").isNull(), F.col("token")).otherwise(F.concat("head", "word", "tail"))
    got = j.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", new.alias("t")))).alias("xs"), F.count("word").alias("n_edits"))
    return got.select("qid", F.array_join(F.transform("xs", lambda x: x["t"]), " ").alias("repaired"), "n_edits")


def recovery(typos: DataFrame, repaired: DataFrame) -> DataFrame:
    """(variant_kind, n, reverted, partial, new_wrong) of mistyped variants (qid, variant_kind, base, question): words put right, questions with some put right, and words spoilt."""
    split = lambda c: F.split(c, " ")
    j = typos.join(repaired.select("qid", "repaired"), "qid").where(F.size(split("base")) == F.size(split("question")))
    words = F.zip_with(F.zip_with(split("base"), split("question"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), split("repaired"), lambda x, c: F.struct(x["a"].alias("a"), x["b"].alias("b"), c.alias("c")))
    wrong, fixed, spoilt = (F.size(F.filter("ws", f)) for f in (lambda x: x["a"] != x["b"], lambda x: (x["a"] != x["b"]) & (x["a"] == x["c"]), lambda x: (x["a"] == x["b"]) & (x["a"] != x["c"])))
    r = j.withColumn("ws", words).select("variant_kind", wrong.alias("w"), fixed.alias("f"), spoilt.alias("s"))
    n = lambda c: F.count(F.when(c, 1))
    return r.groupBy("variant_kind").agg(F.count("*").alias("n"), n((F.col("w") > 0) & (F.col("f") == F.col("w"))).alias("reverted"), n((F.col("f") > 0) & (F.col("f") < F.col("w"))).alias("partial"), F.sum("s").alias("new_wrong"))


def report(questions: DataFrame, repaired: DataFrame) -> DataFrame:
    """(kind, n, changed, edits) of repaired questions by kind."""
    j = questions.select("qid", "kind").dropDuplicates(["qid"]).join(repaired, "qid")
    return j.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_edits") > 0, 1)).alias("changed"), F.sum("n_edits").alias("edits"))
