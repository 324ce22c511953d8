"""Text functions and answer checks over questions, answers, chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import answers as A
from sparkloom.operators.spelling import vocabulary
from sparkloom.plans.spec import Registry
from sparkloom.runtime import table

reg = Registry()
QUERIES, SQL, query = reg.QUERIES, reg.SQL, reg.query


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "emacs_questions").dropDuplicates(["qid"])


def _a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "p9probe_ctx4b_answers").dropDuplicates(["answer_id"])


# Statements that several queries share
_QS = "q AS (SELECT DISTINCT ON (qid) * FROM emacs_questions)"
_AS = "a AS (SELECT DISTINCT ON (answer_id) * FROM p9probe_ctx4b_answers)"
_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP) + "]"
_ABST = S.ABSTAIN.replace("'", "''")
_CITES = r"list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\[([1-9])\]', 1), lambda x: x::INT))"
# Every chunk of every document that an answer was given
_HITS = """hits AS (SELECT answer_id, n, h.doc_id, c.sec_id, c.ord, coalesce(c.prefix, '') || coalesce(c.text, '') AS body, coalesce(c.text, '') AS text
FROM (SELECT answer_id, unnest(retrieved_docs) AS doc_id, generate_subscripts(retrieved_docs, 1) AS n FROM a) h JOIN (SELECT DISTINCT doc_id, sec_id, ord, prefix, text FROM chunks) c USING (doc_id))"""


def _ids_sql(x: str) -> str:
    """Identifiers of ``x``, as :func:`sparkloom.functions.scalars.identifiers` without look-around: what stands before is matched too, and separators are doubled where what follows is."""
    before = r"(?:^|[^\w-])"
    q = "'"
    long, chord, command = (rf"regexp_extract_all({x}, '{before}({p})', 1)" for p in (S.LONG_FLAG, rf"(?:[CMs]-)+[^\s,;:){q}{q}" + r'"`]+', r"M-x\s+[a-z][a-z0-9-]*"))
    short = rf"regexp_extract_all(regexp_replace({x}, '([^\w-])', '\1\1', 'g'), '{before}(-[A-Za-z0-9])(?:$|[^\w-])', 1)"
    return f"list_distinct(list_concat(list_concat({long}, {short}), list_concat({chord}, {command})))"


_BARE = r"regexp_replace(coalesce(answer, ''), '\[([1-9])\]', '', 'g')"
_CLAIM = r"'([^\[\]]+?)\s*((?:\[\d+\])+)'"
_CLAIMS = rf"""x AS (SELECT answer_id, coalesce(len(retrieved_docs), 0) AS n_ext, generate_subscripts(regexp_extract_all(answer, {_CLAIM}, 1), 1) - 1 AS claim, trim(unnest(regexp_extract_all(answer, {_CLAIM}, 1))) AS t, unnest(regexp_extract_all(answer, {_CLAIM}, 2)) AS c
FROM a WHERE trim(answer) <> 'I don''t know.'),
y AS (SELECT answer_id, n_ext, claim, list_distinct(list_concat(regexp_extract_all(t, '`([^`]+)`', 1), regexp_extract_all(t, '(?:^|[^\w-])(--?[A-Za-z][\w-]*)', 1))) AS lits, unnest(list_transform(regexp_extract_all(c, '\d+'), lambda v: v::INT)) AS n FROM x),
z AS (SELECT y.answer_id, claim, y.n, n_ext, len(lits) AS k, max(len(list_filter(lits, lambda l: contains(h.body, l)))) AS held FROM y LEFT JOIN hits h ON h.answer_id = y.answer_id AND h.n = y.n GROUP BY ALL),
sc AS (SELECT answer_id, claim, max(CASE WHEN n < 1 OR n > n_ext THEN 0.0::DOUBLE WHEN k > 0 THEN coalesce(held, 0)::DOUBLE / k END) AS score FROM z GROUP BY ALL)"""


@query(rf"""WITH {_QS}, t AS (SELECT qid, list_filter(list_transform(regexp_extract_all(replace(question, '-', ' '), '[A-Za-z0-9_.%/=]+'),
lambda x: lower(trim(x, '._/=%'))), lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x)) AS l FROM q WHERE question IS NOT NULL)
SELECT qid, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS terms FROM t""")
def query_terms(spark, d):
    """Search terms of every question."""
    return _q(spark, d).where("question is not null").select("qid", F.array_join(S.query_terms("question"), " ").alias("terms"))


@query(rf"""WITH {_AS}, s AS (SELECT answer_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(answer, ''), '\s*\[\d\]\s*', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
lambda x: trim(x) <> '') AS l, gated FROM a)
SELECT answer_id, len(l) > 0 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '{_ABST}'))) = 0 AS abstained,
coalesce(gated, false) OR (len(l) > 0 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '{_ABST}'))) = 0) AS refused FROM s""")
def abstain_rule(spark, d):
    """Answers of which every sentence abstains, and refusals."""
    a = _a(spark, d).select("answer_id", "gated", S.abstained("answer").alias("abstained"))
    return a.select("answer_id", "abstained", (F.coalesce("gated", F.lit(False)) | F.col("abstained")).alias("refused"))


@query(rf"""WITH {_AS}, {_QS}, {_HITS}, c AS (SELECT a.answer_id, {_CITES} AS cites, coalesce(len(retrieved_docs), 0) AS n, coalesce(q.answer_contains, []) AS toks FROM a LEFT JOIN q USING (qid)),
s AS (SELECT c.answer_id, bool_or(len(list_filter(toks, lambda t: t IS NOT NULL AND NOT contains(h.body, t))) = 0) AS ok FROM (SELECT answer_id, toks, unnest(cites) AS n FROM c) c JOIN hits h ON h.answer_id = c.answer_id AND h.n = c.n GROUP BY 1)
SELECT answer_id, array_to_string(list_sort(cites), ',') AS cites, len(cites) AS n_citations, len(cites) = 0 AS uncited, len(list_filter(cites, lambda x: x > n)) AS out_of_range, coalesce(ok, false) AS cite_supported
FROM c LEFT JOIN s USING (answer_id)""")
def citations_verify(spark, d):
    """Citations of each answer: number, out of range, and whether an extract of a cited document holds all tokens of the question."""
    return A.verify_citations(_a(spark, d), _q(spark, d), A.whole_extracts(_a(spark, d), table(spark, d, "chunks")))


@query(rf"""WITH {_AS}, {_HITS}, p AS (SELECT answer_id, generate_subscripts(regexp_extract_all(coalesce(answer, ''), '[“"]([^”"\n]+)[”"][^\[\]\n]*\[([1-9])\]', 1), 1) AS k, unnest(regexp_extract_all(coalesce(answer, ''), '[“"]([^”"\n]+)[”"][^\[\]\n]*\[([1-9])\]', 1)) AS quote, unnest(regexp_extract_all(coalesce(answer, ''), '[“"]([^”"\n]+)[”"][^\[\]\n]*\[([1-9])\]', 2))::INT AS n FROM a),
o AS (SELECT p.answer_id, k, bool_or(coalesce(contains(trim(regexp_replace(body, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))), false)) AS ok FROM p LEFT JOIN hits h ON h.answer_id = p.answer_id AND h.n = p.n GROUP BY ALL),
v AS (SELECT answer_id, count(*) AS n_quotes, bool_and(ok) AS ok FROM o GROUP BY 1)
SELECT answer_id, coalesce(n_quotes, 0) AS n_quotes, coalesce(ok, false) AS verified FROM a LEFT JOIN v USING (answer_id)""")
def quote_verify(spark, d):
    """Whether every quotation of an answer stands in the document it cites."""
    return A.verify_quotes(_a(spark, d), A.whole_extracts(_a(spark, d), table(spark, d, "chunks")))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return A.score_claims(A.claims(_a(spark, d)), A.whole_extracts(_a(spark, d), table(spark, d, "chunks")), _a(spark, d))


@query(f"WITH {_AS}, {_HITS}, {_CLAIMS} SELECT answer_id, claim, round(score, 6) AS score FROM sc")
def lexical_support(spark, d):
    """Each claim's best support by the documents it cites: the share of its literals found there."""
    return _claims(spark, d).select("answer_id", "claim", F.round("score", 6).alias("score"))


@query(f"WITH {_AS}, {_HITS}, {_CLAIMS} SELECT answer_id, round(min(score), 6) AS score FROM sc GROUP BY answer_id")
def answer_min_max(spark, d):
    """Each answer's support: the least of its claims', of which each has its best extract."""
    return A.score_answers(_claims(spark, d)).withColumn("score", F.round("score", 6))


@query(rf"""WITH {_AS}, {_HITS}, i AS (SELECT answer_id, {_ids_sql(_BARE)} AS ids, unnest({_CITES}) AS n FROM a WHERE trim(answer) <> 'I don''t know.'),
l AS (SELECT i.answer_id, i.n, ids, h.doc_id, h.sec_id, h.ord, list_filter(list_transform(string_split(h.body, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND len(list_filter(ids, lambda d: contains(x, d) AND (NOT starts_with(d, '-') OR list_contains({_ids_sql('x')}, d)))) > 0) AS ls
  FROM i JOIN hits h ON h.answer_id = i.answer_id AND h.n = i.n WHERE len(ids) > 0 AND len(list_filter(ids, lambda d: contains(h.body, d))) > 0),
f AS (SELECT answer_id, n, doc_id, min({{'o': ord, 's': sec_id, 'l': substr(ls[1], 1, 200)}}) AS x FROM l WHERE len(ls) > 0 GROUP BY ALL)
SELECT answer_id, n, x.l AS line, CASE WHEN regexp_matches(doc_id, '^(.+)\.(\d[A-Za-z]*)$') THEN 'man ' || regexp_extract(doc_id, '^(.+)\.(\d[A-Za-z]*)$', 2) || ' ' || regexp_extract(doc_id, '^(.+)\.(\d[A-Za-z]*)$', 1)
ELSE 'Info manual ' || split_part(doc_id, '.', 1) || ', section ' || CASE WHEN contains(x.s, '#') THEN regexp_extract(x.s, '#(.*)$', 1) ELSE doc_id END END AS pointer FROM f""")
def evidence_line(spark, d):
    """For each citation the first line of its document that names an identifier of the answer, and where to read on."""
    return A.evidence_lines(_a(spark, d), A.whole_extracts(_a(spark, d), table(spark, d, "chunks")))


@query(rf"""WITH {_AS}, {_HITS}, i AS (SELECT answer_id, kind, {_ids_sql(_BARE)} AS ids FROM a), w AS (SELECT answer_id, unnest(ids) AS id FROM i),
k AS (SELECT w.answer_id, count(DISTINCT id) AS held FROM w JOIN hits h ON h.answer_id = w.answer_id AND contains(h.body, w.id) AND list_contains({_ids_sql('h.body')}, w.id) GROUP BY 1),
m AS (SELECT answer_id, bool_or(ord > 0 AND regexp_matches(substr(text, 1, 1), '[a-z0-9]')) AS mid FROM hits GROUP BY 1)
SELECT kind, count(*) AS answers, count(*) FILTER (len(ids) > 0) AS named, count(*) FILTER (len(ids) > coalesce(held, 0)) AS ungrounded, count(*) FILTER (mid) AS mid_fragment FROM i LEFT JOIN k USING (answer_id) LEFT JOIN m USING (answer_id) GROUP BY kind""")
def grounding_report(spark, d):
    """Answers that name options, keys or commands which no retrieved extract holds, by kind."""
    return A.grounding(_a(spark, d), A.whole_extracts(_a(spark, d), table(spark, d, "chunks")))


@query(rf"""WITH {_AS}, r AS (SELECT qid, arg_min(answer, answer_id) AS x, arg_max(answer, answer_id) AS y, count(*) AS n FROM a WHERE answer IS NOT NULL GROUP BY qid),
t AS (SELECT qid, x, y, trim(regexp_replace(regexp_replace(lower(regexp_replace(x, '\[([1-9])\]', '', 'g')), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS nx,
trim(regexp_replace(regexp_replace(lower(regexp_replace(y, '\[([1-9])\]', '', 'g')), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS ny FROM r WHERE n > 1)
SELECT count(*) AS n, count(*) FILTER (regexp_replace(nx, '\.+$', '') <> regexp_replace(ny, '\.+$', '')) AS differ FROM t""")
def order_disagreement(spark, d):
    """Questions answered several times whose first and last answer differ after normalisation."""
    a = _a(spark, d).where("answer is not null").groupBy("qid").agg(F.min_by("answer", "answer_id").alias("x"), F.max_by("answer", "answer_id").alias("y"), F.count("*").alias("n")).where("n > 1")
    return a.agg(F.count("*").alias("n"), F.count(F.when(S.normal_answer("x") != S.normal_answer("y"), 1)).alias("differ"))


@query(r"""SELECT doc_id, sec_id, chunk_id, ord FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) WHERE starts_with(doc_id, 'o') AND regexp_matches(text, '(?i)with a prefix argument') AND contains(coalesce(prefix, ''), 'editor')""")
def corpus_grep(spark, d):
    """Chunks by document prefix, text pattern and literal in the prefix."""
    c = table(spark, d, "chunks").select("doc_id", "sec_id", "chunk_id", "ord", "prefix", "text")
    return c.where(F.col("doc_id").startswith("o") & F.col("text").rlike("(?i)with a prefix argument") & F.contains(F.coalesce("prefix", F.lit("")), F.lit("editor"))).select("doc_id", "sec_id", "chunk_id", "ord").distinct()


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(prefix, '') || coalesce(text, '')), '[a-z]+')) AS word FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks))
SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 GROUP BY word HAVING count(*) >= 2""")
def vocab_counts(spark, d):
    """The corpus vocabulary: words of three letters or more that occur twice or more."""
    return vocabulary(table(spark, d, "chunks"))


@query("""SELECT coalesce(domain, 'linux') AS domain, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) GROUP BY ALL""")
def domain_listing(spark, d):
    """Chunks and documents of each domain; a null domain counts as linux."""
    c = table(spark, d, "chunks").select("chunk_id", "domain", "doc_id").dropDuplicates(["chunk_id"])
    return c.groupBy(F.coalesce("domain", F.lit("linux")).alias("domain")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^<>]*>|&[A-Za-z]+;', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ') AS stripped FROM documents WHERE text IS NOT NULL""")
def html_strip(spark, d):
    """Documents without tags and named entities."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.strip_markup("text").alias("stripped"))


@query("""SELECT doc_id, sha256(doc_id || chr(0) || coalesce(title, '') || chr(0) || coalesce(summary, '') || chr(0)) AS digest FROM (SELECT DISTINCT ON (doc_id) * FROM man_docs)""")
def page_digests(spark, d):
    """Digest of each page's identity, title and summary."""
    m = table(spark, d, "man_docs").dropDuplicates(["doc_id"])
    return m.select("doc_id", S.doc_digest(F.col("doc_id"), F.col("title"), F.col("summary")).alias("digest"))


@query(r"""WITH m AS (SELECT DISTINCT ON (doc_id) * FROM man_docs) SELECT doc_id, name || '(' || section || ')' || CASE WHEN coalesce(summary, '') <> '' THEN ' - ' || summary ELSE '' END || chr(10) AS prefix,
'man ' || section || ' ' || name AS pointer FROM m WHERE regexp_matches(doc_id, '^(.+)\.(\d[A-Za-z]*)$')""")
def page_prefixes(spark, d):
    """Prefix of every page's chunks and where to find the page."""
    m = table(spark, d, "man_docs").dropDuplicates(["doc_id"]).where(F.col("doc_id").rlike(r"^(.+)\.(\d[A-Za-z]*)$"))
    return m.select("doc_id", S.page_prefix(F.col("name"), F.col("section"), F.col("summary")).alias("prefix"), S.pointer("doc_id", F.lit("")).alias("pointer"))


@query("SELECT qid, (SELECT list_reduce(list_transform(string_split(sha256(qid), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda x, y: (x * 16 + y) % 10)) AS bucket, "
       "(SELECT list_reduce(list_transform(string_split(sha256(qid), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda x, y: (x * 16 + y) % 10000)) AS slot, "
       "(SELECT list_reduce(list_transform(string_split(sha256(qid)[1:15], ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT), lambda x, y: x * 16 + y)) / 1152921504606846976.0::DOUBLE < 0.1 AS held FROM (SELECT DISTINCT qid FROM emacs_questions)")
def hash_split(spark, d):
    """Splits by SHA-256: modulo 10, modulo 10,000, and a tenth held out by fraction."""
    return table(spark, d, "emacs_questions").select("qid").distinct().select("qid", S.hash_mod("qid", 10).alias("bucket"), S.hash_mod("qid", 10000).alias("slot"), (S.hash_fraction("qid") < 0.1).alias("held"))


@query(rf"""WITH {_QS}, t AS (SELECT CASE WHEN variant_kind IS NOT NULL THEN variant_kind WHEN paraphrase_of IS NOT NULL THEN 'paraphrase' ELSE 'clean' END AS grp,
len(list_filter(coalesce(answer_contains, []), lambda t: t IS NOT NULL AND length(t) > 3 AND contains(coalesce(question, ''), t))) > 0 AS echoed FROM q)
SELECT grp, count(*) AS n, count(*) FILTER (echoed) AS echoed FROM t GROUP BY grp""")
def gold_leak_check(spark, d):
    """Questions that give away an answer token of more than three letters, by kind of variant."""
    q = _q(spark, d)
    toks = F.coalesce("answer_contains", F.array().cast("array<string>"))
    echoed = F.exists(F.filter(toks, lambda t: t.isNotNull()), lambda t: (F.length(t) > 3) & F.contains(F.coalesce("question", F.lit("")), t))
    return q.select(S.variant_group(F.col("kind"), F.col("variant_kind"), F.col("paraphrase_of")).alias("grp"), echoed.alias("e")).groupBy("grp").agg(F.count("*").alias("n"), F.count(F.when(F.col("e"), 1)).alias("echoed"))

