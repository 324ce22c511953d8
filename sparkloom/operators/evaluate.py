"""Evaluation of runs: paired comparisons, exact tests, gate sweeps, calibrated gates and reports.

A run is a table with one row a question: key, answerable, correct, abstained, gated, score (null: none), supported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.scalars import exact_sign_p, hash_mod
from sparkloom.functions.text import filled
from sparkloom.operators.graph import connected_components
from sparkloom.operators.prefix import running_totals
from sparkloom.runtime import materialize

# Verdict of a comparison; training of the calibrated gate; nudges of thresholds.
MIN_NET, MAX_LOST, MIN_ABSTENTION = 4, 1, 0
LEARNING_RATE, ITERATIONS, L2 = 0.1, 2000, 1.0
BELOW, ABOVE, JUST_ABOVE = 1e-6, 1e-9, 1e-12
DEPTHS = (1, 3, 5, 10, 20)


def n(c: Column) -> Column:
    """Number of rows for which a condition holds."""
    return F.count(F.when(c, 1))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, with a whole of 0 counting as 1; six digits."""
    return F.round(part / F.greatest(whole, F.lit(1)), 6)


def arms(answers: DataFrame, questions: DataFrame, last: bool) -> DataFrame:
    """The run of each question's first (or last) answer."""
    pick = F.max_by if last else F.min_by
    cols = ["kind", "tags", "variant_kind", "answer", "abstained", "gated", "top_score", "correct", "correct_strict", "evidence_retrieved", "cite_supported", "retrieved_docs", "uncited"]
    a = answers.where("qid is not null").groupBy("qid").agg(pick(F.struct(*cols), "answer_id").alias("x")).select(F.col("qid").alias("key"), "x.*")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return a.select(
        "key", (F.coalesce("kind", F.lit("")) == "answerable").alias("answerable"), no("correct"), no("correct_strict"), no("abstained"), no("gated"), F.col("top_score").alias("score"),
        F.coalesce("cite_supported", F.lit(False)).alias("supported"), F.coalesce("evidence_retrieved", F.lit(False)).alias("evidence"), "tags", "variant_kind", "kind", "retrieved_docs", no("uncited"), "answer",
    )


def compare(control: DataFrame, arm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Paired counts over answerable questions of both runs, [by group]: kept, lost, gained, both_wrong, net, exact p, abstentions gained, verdict.

    Keys that only one run has are an error, raised when the result is computed.
    """
    b = by or []
    c = control.select("key", *b, F.col("answerable").alias("a"), (F.col("correct") & ~F.col("abstained")).alias("x"), F.col("abstained").alias("xa"))
    r = arm.select("key", (F.col("correct") & ~F.col("abstained")).alias("y"), F.col("abstained").alias("ya"))
    both = c.join(r, "key", "full")
    both = both.where(F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("the runs differ in their questions"))).otherwise(F.lit(True)))
    ok = F.col("a")
    g = both.groupBy(*b) if b else both
    out = g.agg(
        n(ok & F.col("x") & F.col("y")).alias("kept"), n(ok & F.col("x") & ~F.col("y")).alias("lost"), n(ok & ~F.col("x") & F.col("y")).alias("gained"), n(ok & ~F.col("x") & ~F.col("y")).alias("both_wrong"),
        (n(~ok & F.col("ya")) - n(~ok & F.col("xa"))).alias("abstention"),
    )
    out = out.withColumn("net", F.col("gained") - F.col("lost")).withColumn("p", F.round(exact_sign_p(F.col("gained"), F.col("lost")) + 1e-11, 6))
    return out.withColumn("passed", (F.col("net") >= MIN_NET) & (F.col("lost") <= MAX_LOST) & (F.col("abstention") >= MIN_ABSTENTION))


def sweep(run: DataFrame) -> DataFrame:
    """Operating points of the gate: one for each distinct score, and one below all.

    A threshold just above a score makes every row with at most that score abstain; rows without a score
    never. Counts come from running totals in order of score, so no task holds all rows.
    """
    s = run.where("score is not null").groupBy("score").agg(
        F.count("*").alias("fired"), n(F.col("answerable")).alias("fa"), n(~F.col("answerable")).alias("fu"), n(F.col("answerable") & F.col("correct") & ~F.col("abstained")).alias("fc"),
        n(~F.col("abstained") & F.col("answerable")).alias("sa"), n(~F.col("abstained") & ~F.col("answerable")).alias("su"), n(~F.col("abstained") & ~F.col("supported")).alias("fs"), n(~F.col("abstained") & F.col("answerable") & ~F.col("evidence")).alias("fb"),
    )
    names = ["fired", "fa", "fu", "fc", "sa", "su", "fs", "fb"]
    tot = running_totals(s.select("score", *[F.col(c).alias("_" + c) for c in names]), [F.col("score")], {c: F.col("_" + c) for c in names})
    base = run.agg(
        F.count("*").alias("n"), n(F.col("answerable")).alias("na"), n(~F.col("answerable")).alias("nu"), n(F.col("answerable") & F.col("correct") & ~F.col("abstained")).alias("nc"),
        n(F.col("abstained") & F.col("answerable")).alias("aa"), n(F.col("abstained") & ~F.col("answerable")).alias("au"), n(~F.col("abstained") & ~F.col("supported")).alias("ns"), n(~F.col("abstained") & F.col("answerable") & ~F.col("evidence")).alias("nb"), F.min("score").alias("least"),
    )
    zero = [F.lit(0).cast("long").alias(c) for c in names]
    points = tot.select((F.col("score") + ABOVE).alias("threshold"), *names).unionByName(base.where("least is not null").select((F.col("least") - BELOW).alias("threshold"), *zero))
    j = points.join(F.broadcast(base))
    return j.select(
        "threshold", F.col("fired").cast("long").alias("fired"), rate(F.col("nc") - F.col("fc"), F.col("na")).alias("accuracy"), rate(F.col("au") + F.col("su"), F.col("nu")).alias("abstention_recall"),
        rate(F.col("aa") + F.col("sa"), F.col("na")).alias("false_abstention"), rate(F.col("ns") - F.col("fs"), F.col("n")).alias("unsupported"), rate(F.col("nb") - F.col("fb"), F.col("na")).alias("spoke_blind"),
    )


def choose(points: DataFrame, accuracy_loss: float = 0.02) -> DataFrame:
    """The point of least unsupported answers, then most abstention, then lowest threshold, that keeps the ungated accuracy but for a loss."""
    whole = points.agg(F.max("accuracy").alias("top"))
    ok = points.join(F.broadcast(whole)).where(F.col("accuracy") >= F.col("top") - accuracy_loss)
    return ok.agg(F.min_by(F.struct("threshold", "accuracy", "abstention_recall", "unsupported"), F.struct("unsupported", -F.col("abstention_recall"), "threshold")).alias("x")).select("x.*")


def matched_threshold(control: DataFrame, arm: DataFrame) -> DataFrame:
    """The lowest threshold at which the arm abstains as often on unanswerable questions as the control; null if none does."""
    target = control.agg(n(~F.col("answerable") & F.col("abstained")).alias("target"))
    base = arm.agg(n(~F.col("answerable") & F.col("abstained")).alias("base"))
    s = arm.where("score is not null").groupBy("score").agg(n(~F.col("answerable") & ~F.col("abstained")).alias("_g"))
    cum = running_totals(s, [F.col("score")], {"more": F.col("_g")})
    ok = cum.join(F.broadcast(target.join(base))).where(F.col("base") + F.col("more") >= F.col("target"))
    got = ok.agg(F.min("score").alias("s"))
    return got.join(target.join(base)).select(F.when(F.col("base") >= F.col("target"), F.lit(0.0)).otherwise(F.col("s") + ABOVE).alias("threshold"), "target", "base")


def answer_report(run: DataFrame) -> DataFrame:
    """Accuracy, accuracy with evidence, false abstention, abstention recall, answers spoken without evidence, unsupported and uncited answers."""
    a, spoke = F.col("answerable"), ~F.col("abstained")
    right = a & F.col("correct") & spoke
    return run.agg(
        F.count("*").alias("n"), rate(n(right), n(a)).alias("accuracy"), rate(n(right & F.col("evidence")), n(a & F.col("evidence"))).alias("accuracy_with_evidence"),
        rate(n(a & ~spoke), n(a)).alias("false_abstention"), rate(n(~a & ~spoke), n(~a)).alias("abstention_recall"), rate(n(a & spoke & ~F.col("evidence")), n(a)).alias("spoke_blind"),
        rate(n(spoke & ~F.col("supported")), n(spoke)).alias("unsupported"), rate(n(spoke & F.col("uncited")), n(spoke)).alias("uncited"),
    )


def robustness(control: DataFrame, arm: DataFrame, groups: list[str]) -> DataFrame:
    """Paired counts by the first of ``groups`` overall and together with the second."""
    j = control.select("key", *groups, "answerable", (F.col("correct") & ~F.col("abstained")).alias("x")).join(arm.select("key", (F.col("correct") & ~F.col("abstained")).alias("y")), "key").where("answerable")
    g, h = groups
    return j.groupingSets([[F.col(g)], [F.col(g), F.col(h)]], F.col(g), F.col(h)).agg(
        F.grouping(h).cast("int").alias("overall"), F.count("*").alias("n"), n(F.col("x") & F.col("y")).alias("kept"), n(F.col("x") & ~F.col("y")).alias("lost"), n(~F.col("x") & F.col("y")).alias("gained"),
    )


def retrieval_metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall at five depths and mean reciprocal rank at 10 of (key, hit): hit is the first rank found, null for none."""
    g = ranks.groupBy(*by) if by else ranks
    at = lambda k: F.round(F.avg((F.coalesce("hit", F.lit(10**6)) <= k).cast("int")), 6).alias(f"recall_{k}")
    return g.agg(F.count("*").alias("n"), *[at(k) for k in DEPTHS], F.round(F.avg(F.when(F.col("hit") <= 10, 1 / F.col("hit")).otherwise(0.0)), 6).alias("mrr_10"))


def combine(base: DataFrame, alternative: DataFrame, least: float) -> DataFrame:
    """The base run with the alternative's answers where the base abstained ungated at a score of ``least`` or more."""
    a = alternative.select("key", F.col("correct").alias("_c"), F.col("abstained").alias("_a"))
    take = F.col("abstained") & ~F.col("gated") & (F.col("score") >= least) & F.col("_a").isNotNull()
    take = F.coalesce(take, F.lit(False))
    return base.join(a, "key", "left").select("key", "answerable", F.when(take, F.col("_c")).otherwise(F.col("correct")).alias("correct"), F.when(take, F.col("_a")).otherwise(F.col("abstained")).alias("abstained"), take.alias("replaced"))


def overlay(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """``base`` with values replaced by key; a key that base lacks, or two values for one key, is an error when computed."""
    c = changes.groupBy(key).agg(F.min(value).alias("_v"), F.count("*").alias("_n"))
    j = base.join(c, key, "full").where(F.when(F.col(value).isNull() & F.col("_v").isNotNull() | (F.col("_n") > 1), F.raise_error(F.lit("unknown or repeated key"))).otherwise(F.lit(True)))
    return j.select(key, F.coalesce("_v", value).alias(value))


def verifier_points(scored: DataFrame) -> DataFrame:
    """Operating points of a verifier on (key, score, good): a threshold at each distinct score removes what is under it.

    Rows without a score are kept. gain is removed bad minus removed good; 'off' is the threshold null.
    """
    s = scored.where("score is not null").groupBy("score").agg(n(F.col("good")).alias("_g"), n(~F.col("good")).alias("_b"))
    cum = running_totals(s, [F.col("score")], {"g": F.col("_g"), "b": F.col("_b")})
    return cum.select((F.col("score") + ABOVE).alias("threshold"), F.col("g").cast("long").alias("removed_good"), F.col("b").cast("long").alias("removed_bad"), (F.col("b") - F.col("g")).cast("long").alias("gain"))


def choose_verifier(points: DataFrame) -> DataFrame:
    """The threshold of most gain above 0, ties to the lower; none above 0 is off (null)."""
    return points.where("gain > 0").agg(F.max_by("threshold", F.struct("gain", -F.col("threshold"))).alias("threshold"), F.max("gain").alias("gain"))


def fit_gate(rows: DataFrame, features: list[str], label: str, most: int = 20_000) -> tuple[list[float], list[float], list[float]]:
    """(weights with the intercept last, means, deviations) of a logistic gate fitted on at most ``most`` labelled rows, those of least hash of ``key``.

    Full-batch descent from zero, penalty 1/n on the weights; a deviation of 0 counts as 1.
    """
    pdf = rows.where(F.col(label).isNotNull()).select("key", F.xxhash64("key").alias("_h"), label, *features).orderBy("_h", "key").limit(most).toPandas().sort_values("key")
    x, y = pdf[features].fillna(0).to_numpy(float), pdf[label].to_numpy(float)
    if not len(x):
        return [0.0] * (len(features) + 1), [0.0] * len(features), [1.0] * len(features)
    mean, dev = x.mean(0), x.std(0)
    dev[dev == 0] = 1.0
    z = (x - mean) / dev
    w, b = np.zeros(z.shape[1]), 0.0
    for _ in range(ITERATIONS):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -60, 60)))
        w -= LEARNING_RATE * (z.T @ (p - y) / len(y) + L2 * w / len(y))
        b -= LEARNING_RATE * float((p - y).mean())
    return [*w.tolist(), b], mean.tolist(), dev.tolist()


def predict_gate(rows: DataFrame, features: list[str], fitted: tuple[list[float], list[float], list[float]]) -> DataFrame:
    """``rows`` with the fitted probability ``p``, in column arithmetic."""
    w, mean, dev = fitted
    z = sum(((F.coalesce(F.col(f), F.lit(0.0)) - mean[i]) / dev[i] * w[i] for i, f in enumerate(features)), F.lit(w[-1]))
    return rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0)))))


def family_hop(questions: DataFrame) -> DataFrame:
    """(qid, family): variant_of, else paraphrase_of, else the question itself; one hop."""
    return questions.where("qid is not null").groupBy("qid").agg(F.min(F.struct("variant_of", "paraphrase_of")).alias("x")).select("qid", F.coalesce(filled("x.variant_of"), filled("x.paraphrase_of"), "qid").alias("family"))


def family_root(questions: DataFrame, loaded_only: bool = False) -> DataFrame:
    """(qid, root): the end of the chain of family hops; with ``loaded_only`` the last question that exists, else the last id named.

    Chains are followed by doubling, so rounds grow with the logarithm of their length; chains that run
    into a ring get the ring's smallest id.
    """
    hop = family_hop(questions).where("qid <> family").select(F.col("qid").alias("a"), F.col("family").alias("b"))
    if loaded_only:
        hop = hop.join(questions.select(F.col("qid").alias("b")).distinct(), "b", "left_semi")
    hop = materialize(hop.select("a", "b"), "hops")
    inner = hop.select(F.col("a").alias("b"))
    at = hop
    for _ in range(max(1, hop.count()).bit_length() + 1):
        if at.join(inner, "b", "left_semi").isEmpty():
            break
        far = at.select(F.col("a").alias("b"), F.col("b").alias("c"))
        at = materialize(at.join(far, "b", "left").select("a", F.coalesce("c", "b").alias("b")), "hops")
    open_ = at.join(inner, "b", "left_semi")
    if not open_.isEmpty():
        ring = connected_components(hop, "a", "b").select(F.col("node").alias("a"), "component")
        at = at.join(inner, "b", "left_anti").select("a", "b").union(open_.join(ring, "a").select("a", F.col("component").alias("b")))
    return questions.where("qid is not null").select("qid").distinct().join(at.select(F.col("a").alias("qid"), F.col("b").alias("root")), "qid", "left").select("qid", F.coalesce("root", "qid").alias("root"))


def largest_remainder(counts: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """(group, quota): ``total`` places in proportion to ``size``; the largest remainders, then the smaller group, get one more. Groups are few."""
    share = F.lit(total) * F.col(size) / F.sum(size).over(W.partitionBy())
    c = counts.withColumn("_s", share).withColumn("_f", F.floor("_s"))
    rest = F.lit(total) - F.sum("_f").over(W.partitionBy())
    c = c.withColumn("_k", F.row_number().over(W.orderBy(F.desc(F.round(F.col("_s") - F.col("_f"), 12)), group))).withColumn("_rest", rest)
    return c.select(group, (F.col("_f") + (F.col("_k") <= F.col("_rest")).cast("int")).cast("long").alias("quota"))


def judge_items(control: DataFrame, arm: DataFrame, controls_in_100: int = 10) -> DataFrame:
    """(item, key, side, answer, hidden): answers to judge where the runs differ, both sides, unless they abstain; and some of the others as hidden controls.

    Items with one key and answer are one; their opaque id is a hash.
    """
    c = control.select("key", F.col("answer").alias("ac"), F.col("abstained").alias("bc"), F.col("correct").alias("cc"))
    a = arm.select("key", F.col("answer").alias("aa"), F.col("abstained").alias("ba"), F.col("correct").alias("ca"))
    j = c.join(a, "key")
    differ = F.col("cc") != F.col("ca")
    hidden = ~differ & (hash_mod("key", 100) < controls_in_100)
    sides = F.explode(F.array(F.struct(F.lit("control").alias("side"), F.col("ac").alias("answer"), F.col("bc").alias("out")), F.struct(F.lit("arm").alias("side"), F.col("aa").alias("answer"), F.col("ba").alias("out"))))
    rows = j.where(differ | hidden).select("key", hidden.alias("hidden"), sides.alias("x")).where("not x.out and x.answer is not null").select("key", "x.side", "x.answer", "hidden")
    one = rows.groupBy("key", "answer").agg(F.array_join(F.array_sort(F.collect_set("side")), "+").alias("side"), F.max("hidden").alias("hidden"))
    return one.select(F.substring(F.sha2(F.concat("key", F.lit("\x00"), "answer"), 256), 1, 12).alias("item"), "key", "side", "answer", "hidden")


def judge_pairs(items: DataFrame, labels: DataFrame) -> DataFrame:
    """(verdict, n) of judged pairs: lost, gained, same or unclear. labels: (item, seq, label right or wrong); the last label of an item counts, a side that is missing is wrong, an item without label unclear."""
    last = labels.groupBy("item").agg(F.max_by("label", "seq").alias("label"))
    x = items.where("not hidden").join(last, "item", "left").select("key", F.explode(F.split("side", r"\+")).alias("side"), F.coalesce("label", F.lit("unclear")).alias("label"))
    p = x.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("side") == "control", F.col("label"))), F.lit("wrong")).alias("c"), F.coalesce(F.max(F.when(F.col("side") == "arm", F.col("label"))), F.lit("wrong")).alias("a"))
    verdict = F.when((F.col("c") == "unclear") | (F.col("a") == "unclear"), "unclear").when((F.col("c") == "right") & (F.col("a") == "wrong"), "lost").when((F.col("c") == "wrong") & (F.col("a") == "right"), "gained").otherwise("same")
    return p.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def exact_p(gained: int, lost: int) -> float:
    """The exact sign test in whole numbers, for the driver."""
    from math import comb

    total, top = gained + lost, max(gained, lost)
    return 1.0 if not total else min(1.0, 2 * sum(comb(total, k) for k in range(top, total + 1)) / 2**total)


def by_tag(run: DataFrame) -> DataFrame:
    """One row for each tag of each row."""
    return run.select(F.explode("tags").alias("tag"), *[c for c in run.columns if c != "tags"]).where("tag is not null")


def threshold_at_target(scored: DataFrame, target: int) -> DataFrame:
    """(threshold, refusals): just above the lowest score at which at least ``target`` rows are refused, else above the largest; null without rows.

    Rows (score) are refused below the threshold. Counts come from running totals over distinct scores.
    """
    s = scored.where("score is not null").groupBy("score").agg(F.count("*").alias("_n"))
    tot = materialize(running_totals(s, [F.col("score")], {"refusals": F.col("_n")}), "targets")
    enough = F.col("refusals") >= target
    got = tot.agg(F.min_by(F.struct("score", "refusals"), F.when(enough, F.col("score"))).alias("x"), F.max_by(F.struct("score", "refusals"), "score").alias("y"))
    best = F.coalesce("x", "y")
    return got.select((best["score"] + JUST_ABOVE).alias("threshold"), best["refusals"].alias("refusals"))


def held_report(scored: DataFrame, target_share: float) -> DataFrame:
    """(part, threshold, n, refused, refused_unanswerable, correct): a threshold that refuses ``target_share`` of the rows marked ``fit``, frozen and replayed on both parts.

    scored: (score, answerable, correct, fit); a row without a score is never refused.
    """
    s = materialize(scored, "scored")
    fit = s.where("fit")
    n_fit = fit.where("score is not null").count()
    frozen = threshold_at_target(fit, int(n_fit * target_share)).select("threshold")
    j = s.join(F.broadcast(frozen))
    refused = F.coalesce(F.col("score") < F.col("threshold"), F.lit(False))
    return j.groupBy(F.when(F.col("fit"), "fit").otherwise("held").alias("part"), "threshold").agg(
        F.count("*").alias("n"), n(refused).alias("refused"), n(refused & ~F.col("answerable")).alias("refused_unanswerable"), n(~refused & F.col("answerable") & F.col("correct")).alias("correct"),
    )
