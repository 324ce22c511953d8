"""Gold answers: tokens and their aliases, validation of gold sections, and aliases derived from the documentation.

Aliases are rows (qid, token, alias, rule, sec_id).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import filled
from sparkloom.sources.manuals import definition_groups, option_entries, option_units

ALIASES = "qid string, token string, alias string, rule string, sec_id string"


def on_boundaries(text: Column, alias: Column) -> Column:
    """The alias stands in the text, not inside a longer word or option."""
    return F.coalesce(F.rlike(text, F.concat(F.lit(r"(?<![\w-])\Q"), alias, F.lit(r"\E(?![\w-])"))), F.lit(False))


def aliases_with_fallback(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, token, alias) for each question: its own aliases if it has any row, be it one with a null alias, else those of its base."""
    base = F.coalesce(filled("variant_of"), filled("paraphrase_of"))
    q = questions.where("qid is not null").groupBy("qid").agg(F.min(base).alias("base"))
    own = aliases.select("qid").distinct().withColumn("_own", F.lit(True))
    q = q.join(own, "qid", "left").select("qid", F.when(F.col("_own"), F.col("qid")).otherwise(F.col("base")).alias("source"))
    return q.join(aliases.select(F.col("qid").alias("source"), "token", "alias"), "source").where("alias is not null").select("qid", "token", "alias").distinct()


def correctness(answers: DataFrame, questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(answer_id, strict, aliased): every token of the question is in the answer, verbatim or by an alias; without tokens both hold."""
    none = F.array().cast("array<string>")
    q = questions.where("qid is not null").groupBy("qid").agg(F.min(F.filter(F.coalesce("answer_contains", none), lambda t: t.isNotNull())).alias("toks"))
    a = answers.join(q, "qid").select("answer_id", "qid", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("toks", none).alias("toks"))
    each = a.select("answer_id", "qid", "answer", F.explode("toks").alias("token")).withColumn("strict", F.contains("answer", "token"))
    by = aliases_with_fallback(questions, aliases)
    also = each.join(by, ["qid", "token"]).where(on_boundaries(F.col("answer"), F.col("alias"))).select("answer_id", "token").distinct().withColumn("_also", F.lit(True))
    ok = each.join(also, ["answer_id", "token"], "left").groupBy("answer_id").agg(F.bool_and("strict").alias("strict"), F.bool_and(F.col("strict") | F.coalesce("_also", F.lit(False))).alias("aliased"))
    return a.select("answer_id").join(ok, "answer_id", "left").select("answer_id", F.coalesce("strict", F.lit(True)).alias("strict"), F.coalesce("aliased", F.lit(True)).alias("aliased"))


def _gold(questions: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    q = questions.where("qid is not null").groupBy("qid").agg(F.min(F.struct("gold_sec_ids", "answer_contains", "question", "kind")).alias("x")).select("qid", "x.*")
    return q.select("qid", "question", "kind", F.array_distinct(F.filter(F.transform(F.coalesce("gold_sec_ids", none), filled), lambda s: s.isNotNull())).alias("gold"), F.filter(F.coalesce("answer_contains", none), lambda t: t.isNotNull()).alias("toks"))


def gold_violations(questions: DataFrame, sections: DataFrame, most: int = 5) -> DataFrame:
    """(qid, sec_id, problem): gold sections that are missing or lack a token, questions with more than ``most`` of them, and tokens of more than three letters that the question gives away."""
    g = _gold(questions).where("kind = 'answerable'")
    s = sections.where("sec_id is not null").groupBy("sec_id").agg(F.min(F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("body"))
    each = g.select("qid", "toks", F.explode("gold").alias("sec_id")).join(s, "sec_id", "left")
    problem = F.when(F.col("body").isNull(), "missing section").when(~F.forall("toks", lambda t: F.contains(F.col("body"), t)), "token not in section")
    a = each.select("qid", "sec_id", problem.alias("problem")).where("problem is not null")
    nothing = F.lit(None).cast("string")
    b = g.where(F.size("gold") > most).select("qid", nothing.alias("sec_id"), F.lit("many sections").alias("problem"))
    c = g.where(F.exists("toks", lambda t: (F.length(t) > 3) & F.contains(F.coalesce("question", F.lit("")), t))).select("qid", nothing.alias("sec_id"), F.lit("token in question").alias("problem"))
    return a.unionByName(b).unionByName(c)


def evidence_sections(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(qid, sec_id, heading): each question's gold sections, those of its base where it names none."""
    g = _gold(questions).select("qid", "gold")
    base = questions.where("qid is not null").groupBy("qid").agg(F.min(F.coalesce(filled("variant_of"), filled("paraphrase_of"))).alias("base"))
    other = g.select(F.col("qid").alias("base"), F.col("gold").alias("_base_gold"))
    ids = g.join(base, "qid").join(other, "base", "left").select("qid", F.explode(F.when(F.size("gold") > 0, F.col("gold")).otherwise(F.coalesce("_base_gold", F.col("gold")))).alias("sec_id"))
    return ids.join(sections.select("sec_id", "heading").groupBy("sec_id").agg(F.min("heading").alias("heading")), "sec_id")


def primary_section(evidence: DataFrame, words: tuple[str, ...] = ("option", "synopsis", "description", "example")) -> DataFrame:
    """(qid, sec_id): of each question's sections the one whose heading holds the first of the words, then the shortest, then the smaller id."""
    place = F.lit(len(words))
    for k in range(len(words) - 1, -1, -1):
        place = F.when(F.contains(F.lower(F.coalesce("heading", F.lit(""))), F.lit(words[k])), k).otherwise(place)
    return evidence.groupBy("qid").agg(F.min_by("sec_id", F.struct(place.alias("k"), F.length("heading").alias("n"), "sec_id")).alias("sec_id"))


def documented(text: str | None) -> list[dict]:
    """Aliases that a section documents: other spellings of an option, an option with its argument, the key of a command."""
    out = []
    for line, _ in option_entries(text or ""):
        units = option_units(line)
        for flag, arg in units:
            out += [(flag, other, "synonym") for other, _ in units if other != flag]
            if arg:
                out.append((flag, f"{flag}={arg}" if flag.startswith("--") else f"{flag} {arg}", "argument"))
    for key, command in definition_groups(text or ""):
        out += [(command, key, "keybinding"), (key, command, "keybinding")]
    return [dict(zip(("token", "alias", "rule"), x)) for x in out]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("alias", T.StringType()), T.StructField("rule", T.StringType())])))
def _documented(text: pd.Series) -> pd.Series:
    return text.map(documented)


def derive_aliases(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Aliases of the tokens of each question that its own gold sections document."""
    g = _gold(questions).select("qid", "toks", F.explode("gold").alias("sec_id"))
    s = sections.where("sec_id is not null and text is not null").groupBy("sec_id").agg(F.min("text").alias("text"))
    found = g.join(s, "sec_id").select("qid", "sec_id", "toks", F.explode(_documented("text")).alias("x"))
    return found.where(F.array_contains("toks", F.col("x.token"))).select("qid", "x.token", "x.alias", "x.rule", "sec_id").distinct()


def propagate(aliases: DataFrame, questions: DataFrame) -> DataFrame:
    """The aliases, and those of a base for each variant that has none of its own."""
    base = questions.where("qid is not null").groupBy("qid").agg(F.min(F.coalesce(filled("variant_of"), filled("paraphrase_of"))).alias("base")).where("base is not null")
    fresh = base.join(aliases.select("qid").distinct(), "qid", "left_anti").join(aliases.withColumnRenamed("qid", "base"), "base")
    return aliases.unionByName(fresh.select("qid", "token", "alias", "rule", "sec_id"))


def merge_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append-only merge: the old rows as they are, and new (qid, token, alias) that they lack."""
    return old.unionByName(new.join(old.select("qid", "token", "alias"), ["qid", "token", "alias"], "left_anti").select(*old.columns))


def stale_aliases(old: DataFrame, now: DataFrame) -> DataFrame:
    """Old rows that a fresh derivation no longer gives."""
    return old.join(now.select("qid", "token", "alias", "rule"), ["qid", "token", "alias", "rule"], "left_anti")


def alias_violations(aliases: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, alias, problem): unknown questions, tokens that the question doesn't have, aliases of a wrong shape, that echo the question or equal the token."""
    g = _gold(questions).select("qid", "toks", "question", F.lit(True).alias("_known"))
    j = aliases.join(g, "qid", "left")
    checks = {
        "unknown question": F.col("_known").isNull(), "foreign token": F.col("_known") & ~F.array_contains("toks", F.col("token")), "shape": ~is_alias_shaped(F.col("alias")),
        "echo": F.contains(F.coalesce("question", F.lit("")), F.col("alias")), "same as token": F.col("alias") == F.col("token"),
    }
    return j.select("qid", "alias", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())).alias("problem"))


def is_alias_shaped(c: Column) -> Column:
    """Two characters or more: an option, with an argument or not, a key chord, or a name or path without blanks."""
    return (F.length(c) >= 2) & (c.rlike(r"^--?[\w?-]+([= ]\S+)?$") | c.rlike(r"^(?:[CMs]-\S+)(?: \S+)*$") | c.rlike(r"^[\w./~:-]+$"))


def normal_key(c: Column) -> Column:
    """A key without placeholders in capitals or ``<RET>`` at its end."""
    return F.trim(F.regexp_replace(c, r"(?:\s+(?:<RET>|RET|[A-Z]{2,}))+$", ""))


def is_key_shaped(c: Column) -> Column:
    """Starts with a modifier, or is a function key, or a prefix with one more key."""
    return c.rlike(r"^(?:[CMsHSA]-\S+|<?f\d{1,2}>?|ESC \S+)(?: \S+)*$")


def alias_statistics(aliases: DataFrame, many: int = 3) -> tuple[DataFrame, DataFrame]:
    """((rule, n, questions), (qid, token, n)): distinct aliases and questions by rule, and tokens with more than ``many`` aliases."""
    one = aliases.where("alias is not null").select("qid", "token", "alias", "rule").distinct()
    by_rule = one.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("questions"))
    crowded = one.groupBy("qid", "token").agg(F.countDistinct("alias").alias("n")).where(F.col("n") > many)
    return by_rule, crowded
