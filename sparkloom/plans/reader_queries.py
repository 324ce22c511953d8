"""Answer modes, evidence, refusal targets, training plans and checks of places over the test tables."""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import modes
from sparkloom.functions import scalars as S
from sparkloom.functions.text import filled
from sparkloom.operators import answers as A
from sparkloom.operators import chunking as C
from sparkloom.operators import evaluate as E
from sparkloom.operators import gold as G
from sparkloom.operators import lexical, spelling
from sparkloom.operators import training as TR
from sparkloom.operators.setjoin import similar
from sparkloom.plans import pipeline
from sparkloom.plans.corpus_queries import _TRIM
from sparkloom.plans.corpus_text_queries import ASKED, _asked, _chunks
from sparkloom.plans.evaluation_queries import _RUNS, _runs
from sparkloom.plans.spec import Registry
from sparkloom.plans.text_queries import _AS, _CITES, _HITS, _QS, _a, _q
from sparkloom.runtime import materialize, shared_dir, table
from sparkloom.sources.store import ChunkStore

reg = Registry()
QUERIES, SQL, query = reg.QUERIES, reg.SQL, reg.query

_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id, rowid)"
# An order that any hash of 64 hexadecimal digits gives, as a number below 10
_TENTH = "list_reduce(list_transform(string_split(sha256({}), ''), lambda x: instr('0123456789abcdef', x) - 1), lambda x, y: (x * 16 + y) % 10)"


@query(f"""WITH {_AS}, {_QS}, {_HITS}, t AS (SELECT a.answer_id, list_filter(coalesce(q.answer_contains, []), lambda t: t IS NOT NULL) AS toks FROM a JOIN q USING (qid)),
s AS (SELECT h.answer_id, bool_or(len(list_filter(toks, lambda t: NOT contains(h.text, t))) = 0) AS ok, bool_or(len(list_filter(toks, lambda t: NOT contains(h.text, t) AND NOT contains(h.text, lower(t)))) = 0) AS also FROM hits h JOIN t USING (answer_id) GROUP BY 1)
SELECT answer_id, coalesce(ok, false) AS strict, coalesce(also, false) AS aliased FROM a LEFT JOIN s USING (answer_id)""")
def evidence_hits(spark, d):
    """Whether a retrieved document holds all tokens of the question in one extract; with the small letters of a token as its alias."""
    q = _q(spark, d)
    aliases = q.select("qid", F.explode("answer_contains").alias("token")).where("token is not null").select("qid", "token", F.lower("token").alias("alias"))
    return A.evidence_in(_a(spark, d), q, aliases, A.whole_extracts(_a(spark, d), table(spark, d, "chunks")))


def _shape_sql(mode: str) -> str:
    return "'" + modes.claims_pattern(mode).replace("'", "''") + "'"


@query(f"""WITH {_AS} SELECT answer_id, coalesce(answer = 'I don''t know.' OR (regexp_matches(answer, {_shape_sql("cite")}) AND len(list_filter({_CITES}, lambda x: x > least(9, coalesce(len(retrieved_docs), 0)))) = 0), false) AS cite,
coalesce(answer = 'I don''t know.' OR (regexp_matches(answer, {_shape_sql("quote")}) AND len(list_filter({_CITES}, lambda x: x > least(9, coalesce(len(retrieved_docs), 0)))) = 0), false) AS quote FROM a""")
def answer_modes(spark, d):
    """Answers that the grammars of the citing and of the quoting mode admit."""
    a = _a(spark, d)
    extracts = F.coalesce("retrieved_docs", F.array().cast("array<string>"))
    return a.select("answer_id", *[modes.is_valid(m, F.col("answer"), extracts).alias(m) for m in ("cite", "quote")])


@query()
def line_answers(spark, d):
    """The stand-in reader's answer in line mode to each chunk's own question, with the grammar's digest and whether it admits the answer."""
    c = _chunks(spark, d).where("text is not null").select("chunk_id", F.array("text").alias("xs"))
    line = F.get(S.extract_lines(F.get("xs", F.lit(0))), F.lit(0))
    said = F.when(line.isNull(), S.REFUSAL).otherwise(F.concat(F.lit('"'), line, F.lit('" tells it [1]')))
    return c.select("chunk_id", F.md5(modes.line_grammar(F.col("xs"))).alias("grammar"), modes.is_valid("line", said, F.col("xs")).alias("line"), modes.is_valid("line-id", said, F.col("xs")).alias("line_id"))


@query(f"""WITH {_RUNS}, t AS (SELECT count(*) FILTER (NOT answerable) AS target FROM r), s AS (SELECT score, sum(count(*)) OVER (ORDER BY score) AS k FROM r WHERE score IS NOT NULL GROUP BY score)
SELECT round(coalesce(min(score) FILTER (k >= target), max(score)), 9) AS threshold, coalesce(min(k) FILTER (k >= target), max(k))::BIGINT AS refusals FROM s, t""")
def refusal_target(spark, d):
    """The threshold at which the arm refuses as many questions as are unanswerable."""
    r = materialize(_runs(spark, d)[1].select("score", "answerable"), "run")
    target = r.where("not answerable").count()
    return E.threshold_at_target(r, target).select(F.round("threshold", 9).alias("threshold"), "refusals")


@query(f"""WITH {_RUNS}, s AS (SELECT *, {_TENTH.format('key')} <= 6 AS fit FROM r), k AS (SELECT score, sum(count(*)) OVER (ORDER BY score) AS k FROM s WHERE fit AND score IS NOT NULL GROUP BY score),
t AS (SELECT coalesce(min(score) FILTER (k >= m), max(score)) AS top FROM k, (SELECT floor(count(*) * 0.3::DOUBLE) AS m FROM s WHERE fit AND score IS NOT NULL))
SELECT CASE WHEN fit THEN 'fit' ELSE 'held' END AS part, round(top, 9) AS threshold, count(*) AS n, count(*) FILTER (coalesce(score <= top, false)) AS refused, count(*) FILTER (coalesce(score <= top, false) AND NOT answerable) AS refused_unanswerable,
count(*) FILTER (NOT coalesce(score <= top, false) AND answerable AND correct) AS correct FROM s, t GROUP BY ALL""")
def gate_fit_held(spark, d):
    """A threshold that refuses three tenths of the fitted part, replayed on the held part."""
    r = _runs(spark, d)[1].select("score", "answerable", "correct", (S.hash_mod("key", 10) <= 6).alias("fit"))
    return E.held_report(r, 0.3).withColumn("threshold", F.round("threshold", 9))


@query(f"""WITH {_QS}, {_C}, x AS (SELECT qid, question, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS w, {_TENTH.format('qid')} = 0 AS exam, doc, gold_sec_ids FROM q WHERE question IS NOT NULL),
l AS (SELECT DISTINCT t.qid FROM x t JOIN x e ON NOT t.exam AND e.exam AND len(t.w) > 0 AND len(list_intersect(t.w, e.w)) * 10 >= 8 * len(list_distinct(list_concat(t.w, e.w)))),
g AS (SELECT qid, question, unnest(gold_sec_ids) AS s FROM x WHERE NOT exam),
p AS (SELECT g.qid, g.question, c.chunk_id FROM g JOIN c ON c.sec_id = {_TRIM.format('g.s')} WHERE trim(g.question) <> '' AND trim(c.text) <> '' AND c.doc_id NOT IN (SELECT trim(doc) FROM x WHERE exam AND trim(doc) <> '') AND g.qid NOT IN (SELECT qid FROM l))
SELECT qid, arg_min(question, chunk_id) AS question, min(chunk_id) AS chunk_id FROM p GROUP BY qid""")
def raft_eligible(spark, d):
    """Questions with a chunk of their evidence that may train: those of a tenth of all questions are examined, and neither their documents nor what is like them is used."""
    q = _q(spark, d).where("question is not null").withColumn("exam", S.hash_mod("qid", 10) == 0)
    sets = q.select("qid", "exam", S.token_set("question").alias("w"))
    side = lambda c, n: sets.where(c).select(F.col("qid").alias(n), "w")
    like = similar(side("not exam", "train"), "train", side("exam", "test"), "test", "w", Fraction(8, 10)).select(F.col("train").alias("qid"))
    pairs = q.where("not exam").select("qid", "question", F.explode("gold_sec_ids").alias("s")).withColumn("sec_id", filled("s")).join(_chunks(spark, d).select("sec_id", "chunk_id"), "sec_id")
    return TR.eligible_pairs(pairs.select("qid", "question", "chunk_id"), _chunks(spark, d), q.where("exam"), like)


@query("""WITH c AS (SELECT chunk_id, min(coalesce(domain, 'linux')) AS domain FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id), n AS (SELECT domain, count(*) AS n FROM c GROUP BY domain), s AS (SELECT domain, 200 * n::DOUBLE / sum(n) OVER () AS s FROM n),
f AS (SELECT domain, floor(s) + (row_number() OVER (ORDER BY round(s - floor(s), 12) DESC, domain) <= 200 - sum(floor(s)) OVER ())::INT AS quota FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sha256(chunk_id), chunk_id) AS k FROM c) SELECT chunk_id, domain FROM k JOIN f USING (domain) WHERE k <= quota""")
def raft_sample(spark, d):
    """200 chunks drawn from the domains in proportion to their size."""
    c = table(spark, d, "chunks").select("chunk_id", F.coalesce("domain", F.lit("linux")).alias("domain"))
    return TR.proportional_sample(c, "chunk_id", "domain", 200)


@query()
def raft_typo(spark, d):
    """Every question with one typing error in a plain word."""
    return TR.with_single_typo(_q(spark, d))


@query(f"""WITH {_QS}, {_C}, g AS (SELECT DISTINCT qid, question, {_TRIM.format('s')} AS sec_id FROM (SELECT qid, question, unnest(gold_sec_ids) AS s FROM q WHERE question IS NOT NULL)),
p AS (SELECT c.chunk_id, g.qid, g.question, lower(trim(g.question)) AS t FROM g JOIN c USING (sec_id) WHERE trim(g.question) <> '' AND c.chunk_id IS NOT NULL)
SELECT chunk_id, arg_min(question, qid) AS question, min(qid) AS qid FROM p GROUP BY chunk_id, t""")
def question_pairs(spark, d):
    """Chunk and question pairs to train an embedding on: each text of a question once a chunk."""
    g = _q(spark, d).select("qid", "question", F.explode("gold_sec_ids").alias("s")).withColumn("sec_id", filled("s")).join(_chunks(spark, d).select("sec_id", "chunk_id"), "sec_id")
    return TR.question_pairs(g.select("chunk_id", "question", "qid"), _chunks(spark, d))


@query("""WITH k AS (SELECT e.epoch, qid, row_number() OVER (PARTITION BY e.epoch ORDER BY sha256('7|' || e.epoch || '|' || qid), qid) - 1 AS k FROM (SELECT DISTINCT qid FROM emacs_questions WHERE qid IS NOT NULL), (SELECT unnest([0, 1, 2]) AS epoch) e)
SELECT epoch, (epoch * ceil(count(*) OVER (PARTITION BY epoch) / 32.0) + k // 32)::BIGINT AS step, qid FROM k""")
def step_plan(spark, d):
    """Three epochs over all questions, 32 a step, each in an order of its own."""
    return TR.step_plan(table(spark, d, "emacs_questions"), "qid", 3, 32, 7)


@query(f"""WITH {_C}, s AS (SELECT sec_id, min(text) AS whole FROM sections WHERE sec_id IS NOT NULL GROUP BY sec_id), j AS (SELECT c.sec_id, s.sec_id IS NULL AS missing,
coalesce(regexp_replace(substr(whole, char_start + 1, char_end - char_start), '^\\s+|\\s+$', '', 'g') = regexp_replace(c.text, '^\\s+|\\s+$', '', 'g'), false) AS same FROM c LEFT JOIN s USING (sec_id) WHERE c.text IS NOT NULL AND char_start IS NOT NULL AND char_end IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (NOT missing AND NOT same) AS mismatches, count(*) FILTER (missing) AS missing, count(*) FILTER (NOT missing AND NOT same) <= 0.01 * count(*) FILTER (NOT missing) AS ok FROM j""")
def location_verify(spark, d):
    """Chunks that do not stand where they say within their section."""
    c = table(spark, d, "chunks").select("chunk_id", "rowid", "sec_id", "char_start", "char_end", "text").groupBy("chunk_id").agg(F.min_by(F.struct("sec_id", "char_start", "char_end", "text"), "rowid").alias("x")).select("x.*")
    return C.location_report(c, table(spark, d, "sections").select("sec_id", "text"))


@query()
def alias_rules(spark, d):
    """Derived aliases by the rule that found them."""
    q = table(spark, d, "emacs_questions")
    return G.alias_statistics(G.derive_aliases(q, table(spark, d, "sections")))[0]


@query()
def widen_spell(spark, d):
    """The ten best chunks of each question, behind them those of the question as the vocabulary repairs it."""
    v = materialize(spelling.vocabulary(table(spark, d, "chunks")), "vocabulary")
    chunks = _chunks(spark, d)
    return pipeline.widen_spell(_asked(spark, d), v, lambda q: lexical.bm25(chunks, q).select("qid", "rank", "chunk_id"))[0]


@query()
def pipeline_answers(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: an index built of all sections and pages, and the stated questions answered by a cascade of dense, then hybrid retrieval."""
    pages = table(spark, d, "man_docs").select("doc_id", "name", "section", "summary", "domain")
    sections = table(spark, d, "sections").select("doc_id", "sec_id", "heading", "text")
    store = ChunkStore(spark, f"{shared_dir(spark)}/sparkloom-index-{uuid.uuid4().hex}")
    index = pipeline.build_index(pages, sections, store)
    q = table(spark, d, "emacs_questions").where(ASKED).select("qid", "question", "domain").dropDuplicates(["qid"])
    got = pipeline.answer_in_tiers(q, index, [{"mode": "dense"}, {"mode": "hybrid"}])
    return got.select("qid", "tier", "answer", "gated", "abstained", F.size("retrieved_docs").alias("docs"), F.round("top_score", 6).alias("top_score"))
