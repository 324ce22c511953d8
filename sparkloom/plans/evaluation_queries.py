"""Evaluation over the recorded answers: each question's first answer is the control run, its last the arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.functions.text import filled
from sparkloom.operators import evaluate as E
from sparkloom.operators import gold as G
from sparkloom.operators import spelling as SP
from sparkloom.operators.prefix import quantiles
from sparkloom.plans.corpus_queries import _TRIM
from sparkloom.plans.spec import Registry
from sparkloom.runtime import materialize, table

reg = Registry()
QUERIES, SQL, query = reg.QUERIES, reg.SQL, reg.query


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, q = table(spark, d, "p9probe_ctx4b_answers"), table(spark, d, "emacs_questions")
    return E.arms(a, q, False), E.arms(a, q, True)


def _run_sql(name: str, f: str) -> str:
    # only groups of answers with the same id are repeats, and these are equal
    return f"""{name} AS (SELECT qid AS key, coalesce(x.kind, '') = 'answerable' AS answerable, coalesce(x.correct, false) AS correct, coalesce(x.correct_strict, false) AS correct_strict,
coalesce(x.abstained, false) AS abstained, coalesce(x.gated, false) AS gated, x.top_score AS score, coalesce(x.cite_supported, false) AS supported, coalesce(x.evidence_retrieved, false) AS evidence,
x.tags AS tags, x.variant_kind AS variant_kind, x.kind AS kind, x.retrieved_docs AS docs, coalesce(x.uncited, false) AS uncited
FROM (SELECT qid, {f}({{'kind': kind, 'tags': tags, 'variant_kind': variant_kind, 'abstained': abstained, 'gated': gated, 'top_score': top_score, 'correct': correct, 'correct_strict': correct_strict, 'evidence_retrieved': evidence_retrieved, 'cite_supported': cite_supported, 'retrieved_docs': retrieved_docs, 'uncited': uncited}}, answer_id) AS x
FROM p9probe_ctx4b_answers WHERE qid IS NOT NULL GROUP BY qid))"""


_RUNS = _run_sql("c", "arg_min") + ",\n" + _run_sql("r", "arg_max")
_PAIR = "j AS (SELECT c.key, c.answerable AS a, c.correct AND NOT c.abstained AS x, r.correct AND NOT r.abstained AS y, c.abstained AS xa, r.abstained AS ya, c.variant_kind, c.kind FROM c JOIN r USING (key))"
_COUNTS = """count(*) FILTER (a AND x AND y) AS kept, count(*) FILTER (a AND x AND NOT y) AS lost, count(*) FILTER (a AND NOT x AND y) AS gained, count(*) FILTER (a AND NOT x AND NOT y) AS both_wrong,
count(*) FILTER (NOT a AND ya) - count(*) FILTER (NOT a AND xa) AS abstention"""
_TAIL = """*, gained - lost AS net, CASE WHEN gained + lost = 0 THEN 1.0 ELSE round(least(1.0, 2 * coalesce((SELECT sum(exp(lgamma(gained + lost + 1) - lgamma(k + 1) - lgamma(gained + lost - k + 1) - (gained + lost) * ln(2.0::DOUBLE)))
FROM generate_series(greatest(gained, lost), gained + lost) AS g(k)), 0)) + 1e-11, 6) END AS p, gained - lost >= 4 AND lost <= 1 AND abstention >= 0 AS passed"""


@query(f"WITH {_RUNS}, {_PAIR}, s AS (SELECT {_COUNTS} FROM j) SELECT {_TAIL} FROM s")
def screen_compare(spark, d):
    """Control against arm: paired counts, exact sign test, verdict."""
    return E.compare(*_runs(spark, d))


@query(f"WITH {_RUNS}, {_PAIR}, s AS (SELECT coalesce(variant_kind, 'none') AS grp, {_COUNTS} FROM j GROUP BY ALL) SELECT {_TAIL} FROM s")
def group_compare(spark, d):
    """The same by kind of variant."""
    c, r = _runs(spark, d)
    return E.compare(c.withColumn("grp", F.coalesce("variant_kind", F.lit("none"))), r, ["grp"])


def _rate(part: str, whole: str) -> str:
    return f"round(count(*) FILTER ({part})::DOUBLE / greatest(count(*) FILTER ({whole}), 1), 6)"


@query(f"""WITH {_RUNS}, t AS (SELECT DISTINCT score AS t FROM r WHERE score IS NOT NULL), p AS (SELECT t + 1e-9::DOUBLE AS threshold, t FROM t UNION ALL SELECT min(t) - 1e-6::DOUBLE, -1e9 FROM t HAVING min(t) IS NOT NULL),
g AS (SELECT threshold, answerable, correct AND NOT (abstained OR coalesce(score <= t, false)) AS correct, abstained OR coalesce(score <= t, false) AS abstained, supported, evidence, coalesce(score <= t, false) AS hit FROM p, r)
SELECT threshold, count(*) FILTER (hit) AS fired, {_rate('answerable AND correct', 'answerable')} AS accuracy, {_rate('NOT answerable AND abstained', 'NOT answerable')} AS abstention_recall,
{_rate('answerable AND abstained', 'answerable')} AS false_abstention, {_rate('NOT abstained AND NOT supported', 'true')} AS unsupported, {_rate('NOT abstained AND answerable AND NOT evidence', 'answerable')} AS spoke_blind FROM g GROUP BY threshold""")
def gate_operating_points(spark, d):
    """Every threshold of the gate replayed on the arm."""
    return E.sweep(_runs(spark, d)[1])


_CHOICE = "WITH p AS (" + SQL["gate_operating_points"] + ") SELECT threshold, accuracy, abstention_recall, unsupported FROM p WHERE accuracy >= (SELECT max(accuracy) FROM p) - 0.02 ORDER BY unsupported, -abstention_recall, threshold LIMIT 1"


@query(_CHOICE)
def choose_gate(spark, d):
    """The threshold of least unsupported answers at an accuracy loss of 0.02 at most."""
    return E.choose(materialize(E.sweep(_runs(spark, d)[1]), "points"))


@query(f"""WITH {_RUNS}, x AS (SELECT (SELECT count(*) FROM c WHERE NOT answerable AND abstained) AS target, (SELECT count(*) FROM r WHERE NOT answerable AND abstained) AS base),
t AS (SELECT score AS s, sum(sum((NOT answerable AND NOT abstained)::INT)) OVER (ORDER BY score) AS more FROM r WHERE score IS NOT NULL GROUP BY score)
SELECT CASE WHEN base >= target THEN 0.0 ELSE (SELECT min(s) FROM t WHERE base + more >= target) + 1e-9::DOUBLE END AS threshold, target, base FROM x""")
def matched_abstention(spark, d):
    """The gate at which the arm abstains as often as the control."""
    return E.matched_threshold(*_runs(spark, d))


_REPORT = f"""count(*) AS n, {_rate('answerable AND correct AND NOT abstained', 'answerable')} AS accuracy, {_rate('answerable AND correct AND NOT abstained AND evidence', 'answerable AND evidence')} AS accuracy_with_evidence,
{_rate('answerable AND abstained', 'answerable')} AS false_abstention, {_rate('NOT answerable AND abstained', 'NOT answerable')} AS abstention_recall, {_rate('answerable AND NOT abstained AND NOT evidence', 'answerable')} AS spoke_blind,
{_rate('NOT abstained AND NOT supported', 'NOT abstained')} AS unsupported, {_rate('NOT abstained AND uncited', 'NOT abstained')} AS uncited"""


@query(f"WITH {_RUNS} SELECT {_REPORT} FROM c")
def answer_report(spark, d):
    """Rates of the control run."""
    return E.answer_report(_runs(spark, d)[0])


@query(f"WITH {_RUNS}, t AS (SELECT unnest(tags) AS tag, answerable, correct, abstained FROM c) SELECT tag, count(*) AS n, count(*) FILTER (answerable AND correct AND NOT abstained) AS n_right, count(*) FILTER (NOT answerable AND abstained) AS declined FROM t WHERE tag IS NOT NULL GROUP BY tag")
def report_by_tag(spark, d):
    """Right and declined answers by tag; a question counts under each of its tags."""
    t = E.by_tag(_runs(spark, d)[0])
    a = F.col("answerable")
    return t.groupBy("tag").agg(F.count("*").alias("n"), E.n(a & F.col("correct") & ~F.col("abstained")).alias("n_right"), E.n(~a & F.col("abstained")).alias("declined"))


@query(f"WITH {_RUNS}, q AS (SELECT qid AS key, min(unanswerable_reason) AS reason FROM emacs_questions GROUP BY qid) SELECT coalesce(reason, 'none') AS reason, count(*) AS n, count(*) FILTER (abstained) AS abstained FROM c JOIN q USING (key) WHERE NOT answerable GROUP BY ALL")
def abstention_by_reason(spark, d):
    """Abstention on unanswerable questions by the reason they are."""
    q = table(spark, d, "emacs_questions").groupBy(F.col("qid").alias("key")).agg(F.min("unanswerable_reason").alias("reason"))
    return _runs(spark, d)[0].where("not answerable").join(q, "key").groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), E.n(F.col("abstained")).alias("abstained"))


@query(f"""WITH {_RUNS}, j AS (SELECT coalesce(c.variant_kind, 'clean') AS grp, q.domain, c.correct AND NOT c.abstained AS x, r.correct AND NOT r.abstained AS y FROM c JOIN r USING (key) JOIN (SELECT qid AS key, coalesce(min(domain), 'linux') AS domain FROM emacs_questions GROUP BY qid) q USING (key) WHERE c.answerable)
SELECT grp, domain, grouping(domain)::INT AS overall, count(*) AS n, count(*) FILTER (x AND y) AS kept, count(*) FILTER (x AND NOT y) AS lost, count(*) FILTER (NOT x AND y) AS gained FROM j GROUP BY GROUPING SETS ((grp), (grp, domain))""")
def robustness_cube(spark, d):
    """Paired counts by kind of variant, and by kind and domain."""
    c, r = _runs(spark, d)
    q = table(spark, d, "emacs_questions").groupBy(F.col("qid").alias("key")).agg(F.coalesce(F.min("domain"), F.lit("linux")).alias("domain"))
    return E.robustness(c.withColumn("grp", F.coalesce("variant_kind", F.lit("clean"))).join(q, "key"), r, ["grp", "domain"])


_HIT = f"""g AS (SELECT qid AS key, {_TRIM.format('min(doc)')} AS doc FROM emacs_questions GROUP BY qid),
h AS (SELECT c.key, c.tags, CASE WHEN list_position(docs, doc) > 0 THEN list_position(docs, doc) END AS hit FROM c JOIN g USING (key) WHERE answerable AND doc IS NOT NULL AND doc <> '')"""
_METRICS = "count(*) AS n, " + ", ".join(f"round(avg((coalesce(hit, 1000000) <= {k})::INT), 6) AS recall_{k}" for k in E.DEPTHS) + ", round(avg(CASE WHEN hit <= 10 THEN 1.0::DOUBLE / hit ELSE 0 END), 6) AS mrr_10"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "emacs_questions").groupBy(F.col("qid").alias("key")).agg(filled(F.min("doc")).alias("doc")).where("doc is not null")
    h = _runs(spark, d)[0].where("answerable").join(g, "key")
    return h.select("key", "tags", F.expr("nullif(coalesce(array_position(retrieved_docs, doc), 0), 0)").alias("hit"))


@query(f"WITH {_RUNS}, {_HIT} SELECT {_METRICS} FROM h")
def retrieval_metrics(spark, d):
    """Recall and reciprocal rank of each question's document among the retrieved ones."""
    return E.retrieval_metrics(_ranks(spark, d))


@query(f"WITH {_RUNS}, {_HIT}, t AS (SELECT unnest(tags) AS tag, hit FROM h) SELECT tag, {_METRICS} FROM t WHERE tag IS NOT NULL GROUP BY tag")
def metrics_by_tag(spark, d):
    return E.retrieval_metrics(E.by_tag(_ranks(spark, d)), ["tag"])


@query(f"""WITH {_RUNS}, g AS (SELECT qid AS key, {_TRIM.format('min(doc)')} AS doc FROM emacs_questions GROUP BY qid), h AS (SELECT key, coalesce(list_position(c.docs, doc), 0) BETWEEN 1 AND 5 AS x, coalesce(list_position(r.docs, doc), 0) BETWEEN 1 AND 5 AS y FROM c JOIN r USING (key) JOIN g USING (key) WHERE c.answerable AND doc <> '')
SELECT count(*) AS n, count(*) FILTER (NOT x AND y) AS fixed, count(*) FILTER (x AND NOT y) AS broken, round(avg(y::INT) - avg(x::INT), 6) AS delta FROM h""")
def run_compare(spark, d):
    """Questions whose document came into or fell out of the first five, from control to arm."""
    g = table(spark, d, "emacs_questions").groupBy(F.col("qid").alias("key")).agg(filled(F.min("doc")).alias("doc")).where("doc is not null")
    c, r = _runs(spark, d)
    j = c.where("answerable").select("key", F.col("retrieved_docs").alias("a")).join(r.select("key", F.col("retrieved_docs").alias("b")), "key").join(g, "key")
    top = lambda x: F.expr(f"coalesce(array_position({x}, doc), 0) between 1 and 5")
    j = j.select(top("a").alias("x"), top("b").alias("y"))
    return j.agg(F.count("*").alias("n"), E.n(~F.col("x") & F.col("y")).alias("fixed"), E.n(F.col("x") & ~F.col("y")).alias("broken"), F.round(F.avg(F.col("y").cast("int")) - F.avg(F.col("x").cast("int")), 6).alias("delta"))


@query(f"WITH {_RUNS} SELECT kind, count(*) AS n, count(*) FILTER (correct_strict) AS n_strict, count(*) FILTER (correct) AS aliased, count(*) FILTER (correct AND NOT correct_strict) AS to_right, count(*) FILTER (correct_strict AND NOT correct) AS to_wrong FROM c WHERE answerable GROUP BY kind")
def rescore_alias(spark, d):
    """Strict against aliased labels: counts and flips."""
    c, s = F.col("correct"), F.col("correct_strict")
    return _runs(spark, d)[0].where("answerable").groupBy("kind").agg(F.count("*").alias("n"), E.n(s).alias("n_strict"), E.n(c).alias("aliased"), E.n(c & ~s).alias("to_right"), E.n(s & ~c).alias("to_wrong"))


@query(f"""WITH {_RUNS}, m AS (SELECT c.key, c.answerable, coalesce(c.abstained AND NOT c.gated AND c.score >= 0.5 AND r.abstained IS NOT NULL, false) AS replaced, c.correct, c.abstained, r.correct AS rc, r.abstained AS ra FROM c LEFT JOIN r USING (key))
SELECT key, answerable, CASE WHEN replaced THEN rc ELSE correct END AS correct, CASE WHEN replaced THEN ra ELSE abstained END AS abstained, replaced FROM m""")
def combine_answers(spark, d):
    """The control with the arm's answers where it abstained at a good score."""
    return E.combine(*_runs(spark, d), 0.5)


@query()
def verifier_folds(spark, d):
    """A threshold chosen on one half of the answers, applied to the other, both ways; all variants of a question lie in one half."""
    return held_out(_runs(spark, d)[1].where("answerable and not abstained and score is not null").select("key", "score", F.col("correct").alias("good")))


def held_out(scored):
    """(fold, threshold, gain, removed_good, removed_bad) of (key, score, good): the fold is whether the CRC-32 of the key before its first dot is odd."""
    r = materialize(scored.withColumn("fold", F.crc32(F.substring_index("key", ".", 1)) % 2 == 1), "folds")
    out = None
    for fold in (True, False):
        best = E.choose_verifier(E.verifier_points(r.where(F.col("fold") == fold)))
        rest = r.where(F.col("fold") != fold).join(F.broadcast(best), F.col("score") < F.col("threshold"))
        hit = rest.agg(E.n(F.col("good")).alias("removed_good"), E.n(~F.col("good")).alias("removed_bad"))
        one = best.join(hit).withColumn("fold", F.lit(fold))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def gate_logistic(spark, d):
    """A calibrated gate: fitted on answers of seven buckets of ten, predicted for all."""
    r = _runs(spark, d)[1].select("key", "answerable", "score", F.size(F.coalesce("retrieved_docs", F.array().cast("array<string>"))).cast("double").alias("docs"), F.col("evidence").cast("double").alias("evidence"))
    r = r.withColumn("label", F.when(S.hash_mod("key", 10) <= 6, F.col("answerable").cast("double")))
    fitted = E.fit_gate(r, ["score", "docs", "evidence"], "label")
    return E.predict_gate(r, ["score", "docs", "evidence"], fitted).select("key", F.round("p", 9).alias("p"))


@query(f"""WITH RECURSIVE h AS (SELECT qid, coalesce(nullif({_TRIM.format('min(x.v)')}, ''), nullif({_TRIM.format('min(x.p)')}, ''), qid) AS family FROM (SELECT qid, {{'v': variant_of, 'p': paraphrase_of}} AS x FROM emacs_questions WHERE qid IS NOT NULL) GROUP BY qid),
w AS (SELECT qid, family AS pos, 1 AS k FROM h UNION ALL SELECT w.qid, h.family, k + 1 FROM w JOIN h ON w.pos = h.qid WHERE h.family <> h.qid AND k < 200)
SELECT qid, arg_max(pos, k) AS root FROM w GROUP BY qid HAVING max(k) < 200""")
def family_root(spark, d):
    """The end of each question's chain of references; chains into rings are left out."""
    q = table(spark, d, "emacs_questions")
    got = E.family_root(q)
    hop = E.family_hop(q).where("qid <> family")
    inner = hop.select(F.col("qid").alias("root"))
    return got.join(inner, "root", "left_anti").select("qid", "root")


@query("""WITH c AS (SELECT coalesce(domain, 'linux') AS domain, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY ALL), s AS (SELECT domain, 100 * n::DOUBLE / sum(n) OVER () AS s FROM c),
f AS (SELECT domain, floor(s) AS f, row_number() OVER (ORDER BY round(s - floor(s), 12) DESC, domain) AS k, 100 - sum(floor(s)) OVER () AS rest FROM s) SELECT domain, (f + (k <= rest)::INT)::BIGINT AS quota FROM f""")
def quotas_largest_remainder(spark, d):
    """100 places shared by the domains in proportion to their chunks."""
    c = table(spark, d, "chunks").groupBy(F.coalesce("domain", F.lit("linux")).alias("domain")).agg(F.countDistinct("chunk_id").alias("n"))
    return E.largest_remainder(c, "domain", "n", 100)


_ITEMS = """f AS (SELECT qid AS key, arg_min({'a': answer, 'c': coalesce(correct, false), 'b': coalesce(abstained, false), 's': coalesce(correct_strict, false)}, answer_id) AS c, arg_max({'a': answer, 'c': coalesce(correct, false), 'b': coalesce(abstained, false)}, answer_id) AS r FROM p9probe_ctx4b_answers WHERE qid IS NOT NULL GROUP BY qid),
d AS (SELECT *, c.c <> r.c AS differ, list_reduce(list_transform(string_split(sha256(key), ''), lambda x: instr('0123456789abcdef', x) - 1), lambda x, y: (x * 16 + y) % 100) < 10 AS drawn FROM f),
s AS (SELECT key, NOT differ AS hidden, unnest(['control', 'arm']) AS side, unnest([c.a, r.a]) AS answer, unnest([c.b, r.b]) AS skipped FROM d WHERE differ OR drawn),
items AS (SELECT substr(sha256(key || chr(0) || answer), 1, 12) AS item, key, CASE count(*) WHEN 2 THEN 'arm+control' ELSE min(side) END AS side, bool_or(hidden) AS hidden FROM s WHERE NOT skipped AND answer IS NOT NULL GROUP BY key, answer)"""


@query(f"WITH {_ITEMS} SELECT item, key, side, hidden FROM items")
def judge_pack_diff(spark, d):
    """Answers to be judged where control and arm differ, with hidden controls."""
    return E.judge_items(*_runs(spark, d)).select("item", "key", "side", "hidden")


@query(f"""WITH {_ITEMS}, l AS (SELECT i.key, side, CASE WHEN f.c.s THEN 'right' ELSE 'wrong' END AS label FROM items i JOIN f USING (key) WHERE NOT hidden),
p AS (SELECT key, coalesce(max(label) FILTER (side IN ('control', 'arm+control')), 'wrong') AS x, coalesce(max(label) FILTER (side IN ('arm', 'arm+control')), 'wrong') AS y FROM l GROUP BY key)
SELECT CASE WHEN x = 'right' AND y = 'wrong' THEN 'lost' WHEN x = 'wrong' AND y = 'right' THEN 'gained' ELSE 'same' END AS verdict, count(*) AS n FROM p GROUP BY ALL""")
def judge_verdicts(spark, d):
    """Verdicts over the pack, judged by the strict label of the first answer."""
    c, a = _runs(spark, d)
    items = materialize(E.judge_items(c, a), "items")
    strict = c.select("key", F.when(F.col("correct_strict"), "right").otherwise("wrong").alias("label"))
    labels = items.join(strict, "key").select("item", F.lit(1).alias("seq"), "label")
    return E.judge_pairs(items, labels)


@query(f"""WITH {_RUNS} SELECT count(*) AS n, count(*) FILTER (r.abstained AND r.answerable) AS wrong_refusals, round(count(*) FILTER (r.abstained AND NOT r.answerable)::DOUBLE / nullif(count(*) FILTER (r.abstained), 0), 6) AS "precision",
round(count(*) FILTER (r.abstained AND NOT r.answerable)::DOUBLE / nullif(count(*) FILTER (NOT r.answerable), 0), 6) AS recall FROM r""")
def refusal_metrics(spark, d):
    """Precision and recall of refusals; null without any."""
    a, u = F.col("abstained"), ~F.col("answerable")
    return _runs(spark, d)[1].agg(F.count("*").alias("n"), E.n(a & ~u).alias("wrong_refusals"), F.round(F.try_divide(E.n(a & u), E.n(a)), 6).alias("precision"), F.round(F.try_divide(E.n(a & u), E.n(u)), 6).alias("recall"))


_G = f"""g AS (SELECT qid, list_distinct(list_filter(list_transform(coalesce(gold_sec_ids, []), lambda s: nullif({_TRIM.format('s')}, '')), lambda s: s IS NOT NULL)) AS gold, list_filter(coalesce(answer_contains, []), lambda t: t IS NOT NULL) AS toks, question
FROM (SELECT DISTINCT ON (qid) * FROM emacs_questions) WHERE kind = 'answerable'),
s AS (SELECT sec_id, min(coalesce(heading, '') || chr(10) || coalesce(text, '')) AS body FROM sections GROUP BY sec_id)"""


@query(f"""WITH {_G}, e AS (SELECT qid, toks, unnest(gold) AS sec_id FROM g)
SELECT qid, e.sec_id, CASE WHEN body IS NULL THEN 'missing section' ELSE 'token not in section' END AS problem FROM e LEFT JOIN s USING (sec_id) WHERE body IS NULL OR len(list_filter(toks, lambda t: NOT contains(body, t))) > 0
UNION ALL SELECT qid, NULL, 'many sections' FROM g WHERE len(gold) > 5 UNION ALL SELECT qid, NULL, 'token in question' FROM g WHERE len(list_filter(toks, lambda t: length(t) > 3 AND contains(coalesce(question, ''), t))) > 0""")
def gold_violations(spark, d):
    """Faults of the gold sections and answers."""
    return G.gold_violations(table(spark, d, "emacs_questions"), table(spark, d, "sections"))


@query()
def alias_derive(spark, d):
    """Aliases that the gold sections document, with those that variants take over."""
    q = table(spark, d, "emacs_questions")
    return G.propagate(materialize(G.derive_aliases(q, table(spark, d, "sections")), "aliases"), q)


@query()
def alias_check(spark, d):
    """Faults of derived aliases."""
    q = table(spark, d, "emacs_questions")
    return G.alias_violations(materialize(G.derive_aliases(q, table(spark, d, "sections")), "aliases"), q)


@query(f"""WITH a AS (SELECT DISTINCT ON (answer_id) answer_id, qid, coalesce(answer, '') AS answer FROM p9probe_ctx4b_answers), q AS (SELECT DISTINCT ON (qid) qid, list_filter(coalesce(answer_contains, []), lambda t: t IS NOT NULL) AS toks FROM emacs_questions)
SELECT answer_id, len(list_filter(toks, lambda t: NOT contains(answer, t))) = 0 AS strict FROM a JOIN q USING (qid)""")
def answer_correctness(spark, d):
    """Answers that hold all tokens of their question."""
    a = table(spark, d, "p9probe_ctx4b_answers").dropDuplicates(["answer_id"])
    q = table(spark, d, "emacs_questions")
    return G.correctness(a, q, spark.createDataFrame([], G.ALIASES)).select("answer_id", "strict")


@query()
def typo_recovery(spark, d):
    """How many mistyped variants the vocabulary puts right, and what it spoils."""
    q = table(spark, d, "emacs_questions").select("qid", "question", "variant_of", "variant_kind").dropDuplicates(["qid"])
    base = q.select(F.col("qid").alias("_b"), F.col("question").alias("base"))
    typos = q.where("variant_kind in ('typo1', 'typo3')").join(base, filled("variant_of") == F.col("_b")).select("qid", "variant_kind", "base", "question")
    v = materialize(SP.vocabulary(table(spark, d, "chunks")), "vocabulary")
    return SP.recovery(typos, SP.normalize(typos.select("qid", "question"), "spell", v))


@query(f"""WITH {_RUNS}, s AS (SELECT list(score ORDER BY score) FILTER (answerable) AS l FROM c WHERE score IS NOT NULL), p AS (SELECT l[least(floor(len(l) * 0.1::DOUBLE)::BIGINT, len(l) - 1) + 1] AS p10 FROM s)
SELECT round(p10, 9) AS p10, round((SELECT avg((score >= p10)::INT) FROM c WHERE NOT answerable AND score IS NOT NULL), 6) AS overlap FROM p""")
def score_overlap(spark, d):
    """Share of unanswerable questions whose score reaches the lowest tenth of the answerable ones'."""
    c = materialize(_runs(spark, d)[0].where("score is not null").select("key", "answerable", "score"), "scores")
    p10 = quantiles(c.where("answerable"), "score", "key", [0.1]).where("convention = 'floor'").select(F.col("value").alias("p10"))
    return c.where("not answerable").join(F.broadcast(p10)).agg(F.round(F.max("p10"), 9).alias("p10"), F.round(F.avg((F.col("score") >= F.col("p10")).cast("int")), 6).alias("overlap"))
