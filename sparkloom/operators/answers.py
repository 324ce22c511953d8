"""Checks of answers against the extracts they were generated from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators.holding import fulfilled
from sparkloom.runtime import materialize

#: Salts by which a document's chunks are spread.
SALTS = 32

#: Documents asked for, (answer_id, n, doc_id), and their extracts, (doc_id, sec_id, ord, text, body).
Extracts = tuple[DataFrame, DataFrame]


def whole_extracts(answers: DataFrame, chunks: DataFrame) -> Extracts:
    """The n-th retrieved document of each answer, and all chunks of these documents. Null documents have none.

    Repeats of a chunk change nothing: every check is an any, a most, a union or a first over the extracts.
    """
    asked = answers.select("answer_id", F.posexplode("retrieved_docs").alias("p", "doc_id")).select("answer_id", (F.col("p") + 1).alias("n"), "doc_id").where("doc_id is not null")
    text = F.coalesce("text", F.lit(""))
    return asked, chunks.where("doc_id is not null").select("doc_id", "sec_id", "ord", text.alias("text"), F.concat(F.coalesce("prefix", F.lit("")), text).alias("body"))


def first_extracts(answers: DataFrame, chunks: DataFrame) -> Extracts:
    """As :func:`whole_extracts`, of documents whose first chunk is all that was shown."""
    first = chunks.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("sec_id", "ord", "prefix", "text"), "rowid").alias("c"))
    return whole_extracts(answers, first.select("doc_id", "c.*"))


def _over_extracts(each: DataFrame, extracts: Extracts, needle: str, value: Column, best: Callable[[str], Column]) -> DataFrame:
    """``each`` (answer_id, n, needle, ...) with its document and ``found``, the best value over all extracts of the document; null without any.

    Equal needles for one document are looked up once. The document's chunks are spread by salt, the
    few needles go to each salt, and an extract without a value (null) is left where it was met: the
    texts are not sorted or sent again.
    """
    asked, texts = extracts
    each = each.join(asked, ["answer_id", "n"], "left")
    keys = each.where("doc_id is not null").select("doc_id", needle).distinct()
    keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = texts.withColumn("salt", F.pmod(F.xxhash64("sec_id", "ord", "body"), F.lit(SALTS)).cast("int"))
    met = keys.join(spread, ["doc_id", "salt"]).select("doc_id", needle, value.alias("value")).where("value is not null")
    got = met.groupBy("doc_id", needle).agg(best("value").alias("found"))
    return each.join(got, ["doc_id", needle], "left")


def verify_citations(answers: DataFrame, questions: DataFrame, extracts: Extracts) -> DataFrame:
    """Citations of each answer against the extracts of the cited documents, one of which must hold all tokens.

    A question without tokens is supported by any cited extract.
    """
    none = F.array().cast("array<string>")
    toks = questions.select("qid", F.filter(F.coalesce("answer_contains", none), lambda t: t.isNotNull()).alias("toks"))
    c = answers.join(toks, "qid", "left").select("answer_id", S.citations("answer").alias("cites"), F.coalesce(F.size("retrieved_docs"), F.lit(0)).alias("n_ext"), F.coalesce("toks", none).alias("toks"))
    c = c.withColumn("n_ext", F.greatest("n_ext", F.lit(0)))
    each = _over_extracts(c.select("answer_id", "toks", F.explode("cites").alias("n")), extracts, "toks", F.when(S.holds_all(F.col("body"), F.col("toks")), True), F.bool_or)
    ok = each.groupBy("answer_id").agg(F.bool_or("found").alias("ok"))
    return c.join(ok, "answer_id", "left").select(
        "answer_id", F.array_join(F.transform(F.array_sort("cites"), lambda x: x.cast("string")), ",").alias("cites"), F.size("cites").cast("long").alias("n_citations"), (F.size("cites") == 0).alias("uncited"),
        F.size(F.filter("cites", lambda x: x > F.col("n_ext"))).cast("long").alias("out_of_range"), F.coalesce("ok", F.lit(False)).alias("cite_supported"),
    )


def verify_quotes(answers: DataFrame, extracts: Extracts) -> DataFrame:
    """Whether every quotation with a citation stands, blanks squeezed, in an extract of the cited document; none is not verified."""
    pattern = r'[“"]([^”"\n]+)[”"][^\[\]\n]*\[([1-9])\]'
    pairs = answers.select("answer_id", F.explode(F.arrays_zip(S.found("answer", pattern, 1).alias("q"), S.found("answer", pattern, 2).alias("n"))).alias("p"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    pairs = pairs.select("answer_id", squeeze("p.q").alias("quote"), F.col("p.n").cast("int").alias("n"))
    asked, texts = extracts
    held = _over_extracts(pairs, (asked, texts.withColumn("body", squeeze("body"))), "quote", F.when(F.contains("body", "quote"), True), F.bool_or)
    v = held.groupBy("answer_id").agg(F.count("*").alias("n_quotes"), F.bool_and(F.coalesce("found", F.lit(False))).alias("ok"))
    return answers.select("answer_id").join(v, "answer_id", "left").select("answer_id", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("ok", F.lit(False)).alias("verified"))


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim, text, cites): runs of text with the citations that follow; a refusal has none."""
    pattern = r"([^\[\]]+?)\s*((?:\[\d+\])+)"
    got = answers.where(F.trim("answer") != S.REFUSAL).select("answer_id", F.posexplode(F.arrays_zip(S.found("answer", pattern, 1).alias("t"), S.found("answer", pattern, 2).alias("c"))).alias("claim", "x"))
    return got.select("answer_id", "claim", F.trim("x.t").alias("text"), F.transform(S.found("x.c", r"\d+"), lambda n: n.cast("int")).alias("cites"))


def score_claims(claimed: DataFrame, extracts: Extracts, answers: DataFrame) -> DataFrame:
    """(answer_id, claim, score): the best share of a claim's literals found in one extract of a cited document.

    Null without literals; a citation out of range scores 0.
    """
    n = answers.select("answer_id", F.greatest(F.coalesce(F.size("retrieved_docs"), F.lit(0)), F.lit(0)).alias("n_ext"))
    each = claimed.join(n, "answer_id").select("answer_id", "claim", "n_ext", S.anchors("text").alias("lits"), F.explode("cites").alias("n"))
    held = F.size(F.filter("lits", lambda a: F.contains("body", a)))
    each = _over_extracts(each.where("size(lits) > 0"), extracts, "lits", F.nullif(held, F.lit(0)), F.max).unionByName(each.where("size(lits) = 0"), allowMissingColumns=True)
    share = F.coalesce("found", F.lit(0)) / F.size("lits")
    score = F.when((F.col("n") < 1) | (F.col("n") > F.col("n_ext")), 0.0).when(F.size("lits") > 0, share)
    return each.groupBy("answer_id", "claim").agg(F.max(score).alias("score"))


def score_answers(scored: DataFrame) -> DataFrame:
    """(answer_id, score): the least of the claims that have a score."""
    return scored.groupBy("answer_id").agg(F.min("score").alias("score"))


def evidence_lines(answers: DataFrame, extracts: Extracts, cut: int = 200) -> DataFrame:
    """(answer_id, n, line, pointer): of each cited document the first line, by the places of its extracts, that names an identifier of the answer.

    An option counts on its own boundaries only, other identifiers anywhere.
    """
    asked = answers.where(F.trim("answer") != S.REFUSAL).select("answer_id", S.identifiers(S.strip_citations("answer")).alias("ids"), F.explode(S.citations("answer")).alias("n")).where(F.size("ids") > 0)
    named = lambda line: F.exists("ids", lambda i: F.contains(line, i) & (~i.startswith("-") | F.array_contains(S.identifiers(line), i)))
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & named(x))
    # most extracts hold none of the identifiers, and are not split
    line = F.when(F.exists("ids", lambda i: F.contains("body", i)), F.get(lines, F.lit(0)))
    place = F.when(line.isNotNull(), F.struct("ord", "sec_id", F.substring(line, 1, cut).alias("line")))
    got = _over_extracts(asked, extracts, "ids", place, F.min).where("found is not null")
    return got.select("answer_id", "n", "found.line", S.pointer("doc_id", "found.sec_id").alias("pointer"))


def grounding(answers: DataFrame, extracts: Extracts) -> DataFrame:
    """(kind, answers, named, ungrounded, mid_fragment): by kind of question, answers that name identifiers, those with one that no extract
    of a retrieved document holds, and those with an extract that begins within a sentence."""
    asked, texts = extracts
    there = texts.select("doc_id", F.explode(S.identifiers("body")).alias("id")).distinct()
    mid = texts.groupBy("doc_id").agg(F.bool_or((F.col("ord") > 0) & F.substring("text", 1, 1).rlike("[a-z0-9]")).alias("mid"))
    mid = asked.join(mid, "doc_id").groupBy("answer_id").agg(F.bool_or("mid").alias("mid"))
    a = answers.select("answer_id", "kind", S.identifiers(S.strip_citations("answer")).alias("ids"))
    wanted = a.select("answer_id", F.explode("ids").alias("id")).join(asked.select("answer_id", "doc_id"), "answer_id").distinct()
    held = wanted.join(there, ["doc_id", "id"]).groupBy("answer_id").agg(F.countDistinct("id").alias("held"))
    a = a.join(held, "answer_id", "left").join(mid, "answer_id", "left")
    missing = F.size("ids") > F.coalesce("held", F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    return a.groupBy("kind").agg(F.count("*").alias("answers"), n(F.size("ids") > 0).alias("named"), n(missing).alias("ungrounded"), n(F.col("mid")).alias("mid_fragment"))


def evidence_in(answers: DataFrame, questions: DataFrame, aliases: DataFrame, extracts: Extracts) -> DataFrame:
    """(answer_id, strict, aliased): one extract of a retrieved document holds, in its text (not its prefix), every token of the question; or for each the token or one of its aliases (qid, token, alias).

    A question without tokens has evidence in any extract, one without extracts has none.
    """
    none = F.array().cast("array<string>")
    toks = questions.where("qid is not null").groupBy("qid").agg(F.min(F.filter(F.coalesce("answer_contains", none), lambda t: t.isNotNull())).alias("toks"))
    other = aliases.where("alias is not null").groupBy("qid", "token").agg(F.array_sort(F.collect_set("alias")).alias("also"))
    ways = toks.select("qid", F.explode_outer("toks").alias("token")).join(other, ["qid", "token"], "left")
    ways = ways.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.concat(F.array("token"), F.coalesce("also", none))))).alias("ways"))
    asked, texts = extracts
    need = materialize(answers.select("answer_id", "qid").join(ways, "qid").join(asked, "answer_id").select("answer_id", "doc_id", "ways"), "need")
    found = fulfilled(need.select("doc_id", "ways").distinct(), texts)
    best = need.join(found, ["doc_id", "ways"]).groupBy("answer_id").agg(F.max("found").alias("found"))
    return answers.select("answer_id").join(best, "answer_id", "left").select("answer_id", F.coalesce(F.col("found") == 2, F.lit(False)).alias("strict"), F.col("found").isNotNull().alias("aliased"))
