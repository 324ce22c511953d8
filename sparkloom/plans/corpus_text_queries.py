"""Lexical search, chunking, spelling and corpus statistics over chunks, sections, documents and questions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import chunking as C
from sparkloom.operators import corpus, lexical, spelling
from sparkloom.operators import retrieval as R
from sparkloom.operators.asof import latest_before
from sparkloom.operators.prefix import quantiles
from sparkloom.operators.setjoin import similar
from sparkloom.plans.spec import Registry
from sparkloom.runtime import materialize, table

reg = Registry()
QUERIES, SQL, query = reg.QUERIES, reg.SQL, reg.query

#: Questions that search: those whose number is divisible by 50.
ASKED = "try_cast(regexp_extract(qid, '([0-9]+)', 1) as bigint) % 50 = 0"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "emacs_questions").select("qid", "question").dropDuplicates(["qid"]).where(ASKED)


_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP) + "]"


@query(rf"""WITH {_C}, q AS (SELECT DISTINCT ON (qid) qid, question FROM emacs_questions WHERE try_cast(regexp_extract(qid, '([0-9]+)', 1) AS BIGINT) % 50 = 0),
t AS (SELECT qid, unnest(list_distinct(flatten(list_transform(list_filter(list_transform(regexp_extract_all(replace(question, '-', ' '), '[A-Za-z0-9_.%/=]+'), lambda x: lower(trim(x, '._/=%'))),
   lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x)), lambda x: regexp_extract_all(x, '[a-z0-9]+'))))) AS w FROM q WHERE question IS NOT NULL),
p AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(prefix, '')), '[a-z0-9]+') AS a, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS b FROM c),
k AS (SELECT count(*) AS n, sum(len(a) + len(b)) / count(*) AS mean FROM p),
x AS (SELECT chunk_id, w, sum(f) AS f, any_value(dl) AS dl FROM (SELECT chunk_id, unnest(a) AS w, 0.5::DOUBLE AS f, len(a) + len(b) AS dl FROM p UNION ALL SELECT chunk_id, unnest(b), 1.0, len(a) + len(b) FROM p) WHERE w IN (SELECT w FROM t) GROUP BY ALL),
i AS (SELECT w, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM x, k GROUP BY w, n),
s AS (SELECT qid, chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM t JOIN x USING (w) JOIN i USING (w), k GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT qid, rank, chunk_id, round(score, 4) AS score FROM o WHERE rank <= 10""")
def bm25_search(spark, d):
    """The ten best chunks of each question with their scores."""
    return lexical.bm25(_chunks(spark, d), _asked(spark, d)).select("qid", "rank", "chunk_id", F.round("score", 4).alias("score"))


@query()
def bm25_porter(spark, d):
    """The ten best chunks of each question by stems."""
    return lexical.bm25(_chunks(spark, d), _asked(spark, d), stemmed=True)


# The end of the window from ``a`` whose hard end is ``h``: after the last line end of its second half, if there is one
_END = r"CASE WHEN {h} < length(text) AND contains(substr(text, {a} + 501, {h} - {a} - 500), chr(10)) THEN {h} - length(regexp_extract(substr(text, {a} + 501, {h} - {a} - 500), '[^\n]*$')) ELSE {h} END"
_NEXT = "greatest(b - 150, a + 1)"
_WINDOWS = f"""w AS (SELECT doc_id, text, 0::BIGINT AS k, 0::BIGINT AS a, least(1000, length(text))::BIGINT AS h FROM documents WHERE length(text) > 0),
v AS (SELECT doc_id, text, k, a, {_END.format(a='a', h='h')} AS b FROM w
  UNION ALL SELECT doc_id, text, k + 1, {_NEXT}, {_END.format(a=_NEXT, h=f'least({_NEXT} + 1000, length(text))')} FROM v WHERE b < length(text))"""


@query(f"WITH RECURSIVE {_WINDOWS} SELECT doc_id, k, a AS char_start, b AS char_end, md5(substr(text, a + 1, b - a)) AS digest FROM v WHERE regexp_matches(substr(text, a + 1, b - a), '[!-~]')")
def chunk_windows(spark, d):
    """Overlapping windows of every document, with the digest of each span."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    w = C.chunk_windows(docs, "doc_id", "text").drop("text").join(docs, "doc_id")
    span = F.expr("substring(text, char_start + 1, char_end - char_start)")
    return w.where(span.rlike("[!-~]")).select("doc_id", "k", "char_start", "char_end", F.md5(span).alias("digest"))


@query("""WITH n AS (SELECT DISTINCT ON (chunk_id) rowid AS r, length(text) AS v FROM chunks WHERE text IS NOT NULL), s AS (SELECT list(v::DOUBLE ORDER BY v) AS l FROM n)
SELECT 'linear' AS convention, 0.5::DOUBLE AS fraction, quantile_cont(v, 0.5)::DOUBLE AS value FROM n UNION ALL SELECT 'linear', 0.95, quantile_cont(v, 0.95)::DOUBLE FROM n UNION ALL
SELECT 'floor', 0.5, l[least((len(l) * 0.5::DOUBLE)::BIGINT, len(l) - 1) + 1] FROM s UNION ALL SELECT 'floor', 0.95, l[least(floor(len(l) * 0.95::DOUBLE)::BIGINT, len(l) - 1) + 1] FROM s UNION ALL SELECT 'median', 0.5, median(v)::DOUBLE FROM n"""
       .replace("(len(l) * 0.5::DOUBLE)::BIGINT", "floor(len(l) * 0.5::DOUBLE)::BIGINT"))
def percentile_conventions(spark, d):
    """Chunk lengths by three conventions of percentiles."""
    c = _chunks(spark, d).where("text is not null").select("chunk_id", F.length("text").alias("v"))
    return quantiles(c, "v", "chunk_id", [0.5, 0.95]).withColumn("value", F.round("value", 6))


@query()
def structured_chunks(spark, d):
    """Chunks of all sections by their structure."""
    return C.structured_chunks(table(spark, d, "sections")).withColumn("text", F.md5("text"))


@query()
def ingest_documents(spark, d):
    """Sections of all documents with ids and headings."""
    return C.ingest(table(spark, d, "documents"), "doc_id", "text").withColumn("text", F.md5("text"))


@query("""WITH s AS (SELECT doc_id, coalesce(source, 'none') || '.' || coalesce(lang, 'xx') AS ident FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY doc_id) AS k FROM s), n AS (SELECT unnest([4, 8, 16, 64]) AS n),
t AS (SELECT doc_id, n, regexp_replace(ident, '\\.([^.]*)$', '-' || substr(sha256(doc_id::VARCHAR), 1, n) || '.\\1') AS id FROM f, n WHERE k > 1),
o AS (SELECT id FROM (SELECT id FROM t UNION ALL SELECT ident FROM f WHERE k = 1) GROUP BY id HAVING count(*) = 1),
u AS (SELECT doc_id, arg_min(id, n) AS id FROM t WHERE id IN (SELECT id FROM o) GROUP BY doc_id)
SELECT doc_id, coalesce(u.id, ident) AS unique_id FROM f LEFT JOIN u USING (doc_id)""")
def dedupe_ids(spark, d):
    """Unique ids where many documents share one."""
    s = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("."), F.coalesce("lang", F.lit("xx"))).alias("ident"))
    return C.unique_ids(s, "ident", "doc_id", "doc_id").select("doc_id", "unique_id")


_DIG = """g AS (SELECT sec_id AS key, min({'digest': sha256(sec_id || chr(0) || coalesce(heading, '') || chr(0) || coalesce(text, '') || chr(0)), 'n': coalesce(length(heading), 0) + coalesce(length(text), 0)}) AS x FROM sections WHERE sec_id IS NOT NULL GROUP BY sec_id)"""


_SUMS = ", ".join(f"sum(list_reduce(list_transform(string_split(x.digest[{1 + 15 * k}:{15 + 15 * k}], ''), lambda c: (instr('0123456789abcdef', c) - 1)::HUGEINT), lambda a, b: a * 16 + b))::VARCHAR" for k in range(4))


@query(f"WITH {_DIG} SELECT count(*) AS n_docs, sum(x.n) AS n_chars, sha256(concat_ws(',', count(*)::VARCHAR, {_SUMS})) AS digest FROM g")
def corpus_fingerprint(spark, d):
    """Number of sections and characters of the corpus, and the digest of the sections' digests."""
    return corpus.fingerprint(corpus.digests(table(spark, d, "sections"), "sec_id", "heading", "text"))


@query(f"""WITH {_DIG}, old AS (SELECT key, x.digest AS a FROM g WHERE ascii(right(key, 1)) % 7 <> 0), new AS (SELECT key, CASE WHEN ascii(right(key, 1)) % 5 = 0 THEN 'x' ELSE x.digest END AS b FROM g WHERE ascii(right(key, 1)) % 3 <> 0)
SELECT key, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old FULL JOIN new USING (key) WHERE a IS DISTINCT FROM b""")
def corpus_diff(spark, d):
    """Added, removed and changed sections between two editions made by the last letter of the id."""
    g = corpus.digests(table(spark, d, "sections"), "sec_id", "heading", "text")
    last = F.ascii(F.substring("key", -1, 1))
    return corpus.difference(g.where(last % 7 != 0), g.where(last % 3 != 0).withColumn("digest", F.when(last % 5 == 0, "x").otherwise(F.col("digest"))))


@query("""WITH s AS (SELECT DISTINCT sec_id, heading FROM sections), h AS (SELECT heading, count(*) AS n FROM s GROUP BY heading)
SELECT heading, n FROM h ORDER BY n DESC, heading LIMIT 25""")
def corpus_stats(spark, d):
    """The 25 most frequent headings."""
    s = table(spark, d, "sections").select("sec_id", "heading").distinct()
    return s.groupBy("heading").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("heading")).limit(25)


_OFFSETS = """s AS (SELECT doc_id, sec_id, min({'heading': heading, 'text': text}) AS x FROM sections WHERE sec_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL),
z AS (SELECT doc_id, sec_id, length(coalesce(x.heading, '')) + 1 + CASE WHEN coalesce(x.text, '') <> '' THEN length(x.text) + 1 ELSE 0 END AS size FROM s),
off AS (SELECT doc_id, sec_id, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY sec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM z)"""


@query(f'WITH {_OFFSETS} SELECT doc_id, sec_id, "offset" FROM off')
def heading_offsets(spark, d):
    """Where each heading starts in its flattened document."""
    return C.heading_offsets(table(spark, d, "sections"))


@query(f"""WITH {_OFFSETS}, {_C} SELECT c.chunk_id, arg_max(off.sec_id, {{'o': off."offset", 's': off.sec_id}}) AS heading_sec FROM c JOIN off ON c.doc_id = off.doc_id AND off."offset" <= c.char_start GROUP BY c.chunk_id""")
def heading_asof(spark, d):
    """The last heading at or before each chunk's start, by an as-of scan of both in order of place."""
    off = materialize(C.heading_offsets(table(spark, d, "sections")), "off")
    c = _chunks(spark, d).where("doc_id is not null and char_start is not null").select("chunk_id", "doc_id", F.col("char_start").cast("long").alias("at"))
    return latest_before(c, off.select("doc_id", F.col("offset").alias("at"), F.col("sec_id").alias("heading_sec")), "doc_id", "at", "chunk_id", "heading_sec").where("heading_sec is not null")


@query(f"""WITH {_OFFSETS}, {_C}, x AS (SELECT doc_id, chunk_id, char_start AS a, char_end AS b FROM c WHERE char_start IS NOT NULL AND char_end IS NOT NULL),
hit AS (SELECT off.doc_id, sec_id, "offset", arg_max(chunk_id, {{'a': a, 'c': chunk_id}}) AS chunk_id FROM off JOIN x ON off.doc_id = x.doc_id AND a <= "offset" AND "offset" < b GROUP BY ALL),
nxt AS (SELECT off.doc_id, sec_id, "offset", arg_min(chunk_id, {{'a': a, 'c': chunk_id}}) AS chunk_id FROM off JOIN x ON off.doc_id = x.doc_id AND a >= "offset" WHERE (off.doc_id, sec_id) NOT IN (SELECT doc_id, sec_id FROM hit) GROUP BY ALL)
SELECT doc_id, sec_id, "offset", chunk_id FROM hit UNION ALL SELECT doc_id, sec_id, "offset", chunk_id FROM nxt""")
def interval_chunk_for(spark, d):
    """The chunk that holds each heading's offset, else the next one."""
    off = materialize(C.heading_offsets(table(spark, d, "sections")), "off")
    c = _chunks(spark, d).where("char_start is not null and char_end is not null").select("doc_id", "chunk_id", "char_start", "char_end")
    return C.containing_chunk(off, c)


def _hits(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """The k best chunks of each question with their places."""
    got = lexical.bm25(_chunks(spark, d), _asked(spark, d), k=k).select(F.col("qid").alias("query_id"), "rank", "chunk_id")
    return materialize(got.join(_chunks(spark, d).select("chunk_id", "doc_id", "sec_id", "ord", "prefix", "text"), "chunk_id"), "bm25")


@query(f"""WITH {_C} SELECT a.chunk_id, b.chunk_id AS near_id, b.ord - a.ord AS away FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.sec_id = b.sec_id AND b.ord BETWEEN a.ord - 1 AND a.ord + 1 WHERE a.rowid % 50 = 0""".replace("SELECT DISTINCT ON (chunk_id) * FROM chunks", "SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id, rowid"))
def neighbours_expand(spark, d):
    """Chunks of the same section at most one place away, of every chunk whose number is divisible by 50."""
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "sec_id", "ord", "text", "rowid").groupBy("chunk_id").agg(F.min_by(F.struct("doc_id", "sec_id", "ord", "text", "rowid"), "rowid").alias("x")).select("chunk_id", "x.*")
    asked = c.where("rowid % 50 = 0").select(F.col("rowid").alias("query_id"), "chunk_id", "doc_id", "sec_id", "ord")
    return R.neighbours(asked, c, 1).select("chunk_id", "near_id", (F.col("near_ord") - F.col("ord")).alias("away"))


@query()
def expand_budget(spark, d):
    """Hits widened within a budget of characters."""
    hits = _hits(spark, d)
    return R.expand(R.neighbours(hits.drop("text", "prefix"), _chunks(spark, d), 1)).withColumn("text", F.md5("text"))


@query()
def merge_consecutive(spark, d):
    """Hits that follow each other in a document, joined."""
    return C.merged(_hits(spark, d)).withColumn("text", F.md5("text"))


@query()
def prev_window_repair(spark, d):
    """Chunks opened on a whole line by the window before."""
    c = _chunks(spark, d).select("chunk_id", "doc_id", "ord", "text")
    return C.repaired(c).withColumn("text", F.md5("text"))


@query()
def read_prompts(spark, d):
    """The reader's prompt of each question."""
    return R.prompt(_hits(spark, d), "query_id").withColumn("prompt", F.md5("prompt"))


_V = r"""v AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(prefix, '') || coalesce(text, '')), '[a-z]+')) AS word FROM c) WHERE length(word) >= 3 GROUP BY word HAVING count(*) >= 2)"""


@query(rf"""WITH {_C}, {_V}, q AS (SELECT DISTINCT qid, question FROM emacs_questions WHERE question IS NOT NULL), t AS (SELECT DISTINCT lower(w) AS core FROM (SELECT unnest(regexp_extract_all(question, '[A-Za-z]{{4,}}')) AS w FROM q) WHERE lower(w) NOT IN (SELECT word FROM v))
SELECT core, count(*) AS n FROM t JOIN v ON abs(length(core) - length(word)) <= 1 AND levenshtein(core, word) = 1 GROUP BY core""")
def spell_candidates_lev(spark, d):
    """Words of the questions outside the vocabulary, with the number of vocabulary words one letter away."""
    v = materialize(spelling.vocabulary(table(spark, d, "chunks")), "vocabulary")
    q = table(spark, d, "emacs_questions").where("question is not null").select("question").distinct()
    t = q.select(F.explode(S.found("question", "[A-Za-z]{4,}")).alias("core")).select(F.lower("core").alias("core")).distinct().join(v.select(F.col("word").alias("core")), "core", "left_anti")
    left = t.select("core", F.explode(spelling._shortened("core", F.lit(1))).alias("short"))
    right = v.select("word", F.explode(spelling._shortened("word", F.lit(1))).alias("short"))
    near = left.join(right, "short").select("core", "word").distinct().where(F.levenshtein("core", "word") == 1)
    return near.groupBy("core").agg(F.count("*").alias("n"))


@query()
def spell_repair_osa(spark, d):
    """Questions repaired by the corpus vocabulary."""
    v = materialize(spelling.vocabulary(table(spark, d, "chunks")), "vocabulary")
    return spelling.repair(table(spark, d, "emacs_questions").select("qid", "question").dropDuplicates(["qid"]), v)


@query(rf"""WITH {_C}, {_V}, q AS (SELECT DISTINCT ON (qid) qid, question FROM emacs_questions WHERE question IS NOT NULL),
t AS (SELECT qid, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z]{{3,}}'))) AS w FROM q)
SELECT qid, round(avg((w NOT IN (SELECT word FROM v))::INT), 6) AS unknown_share FROM t GROUP BY qid""")
def unknown_share(spark, d):
    """Share of each question's words that the corpus lacks."""
    v = spelling.vocabulary(table(spark, d, "chunks")).select(F.col("word").alias("w"), F.lit(0).alias("u"))
    q = table(spark, d, "emacs_questions").where("question is not null").select("qid", "question").dropDuplicates(["qid"])
    t = q.select("qid", F.explode(F.array_distinct(S.found(F.lower("question"), "[a-z]{3,}"))).alias("w"))
    return t.join(v, "w", "left").groupBy("qid").agg(F.round(F.avg(F.coalesce("u", F.lit(1))), 6).alias("unknown_share"))


@query()
def local_targets(spark, d):
    """Repairs of each question by the words of its own hits."""
    v = materialize(spelling.vocabulary(table(spark, d, "chunks")), "vocabulary")
    words = S.found(F.lower(F.concat("doc_id", F.lit("\n"), F.coalesce("prefix", F.lit("")), F.coalesce("text", F.lit("")))), "[a-z]{3,}")
    targets = _hits(spark, d).select(F.col("query_id").alias("qid"), F.explode(words).alias("word")).groupBy("qid", "word").agg(F.count("*").alias("n"))
    return spelling.local_repair(_asked(spark, d), targets, v)


_SETS = r"""q AS (SELECT DISTINCT ON (qid) qid, variant_of IS NULL AND paraphrase_of IS NULL AS base, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS w FROM emacs_questions WHERE question IS NOT NULL),
p AS (SELECT t.qid AS train, e.qid AS eval, len(list_intersect(t.w, e.w)) AS shared, len(list_distinct(list_concat(t.w, e.w))) AS either FROM q t JOIN q e ON NOT t.base AND e.base AND len(t.w) > 0 AND len(e.w) > 0 AND len(t.w) * 10 >= 8 * len(e.w) AND len(e.w) * 10 >= 8 * len(t.w))"""


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    """Variants (as training rows) and base questions (as evaluation rows) whose words have a similarity of 0.8 or more."""
    q = table(spark, d, "emacs_questions").where("question is not null").select("qid", "question", (F.col("variant_of").isNull() & F.col("paraphrase_of").isNull()).alias("base")).dropDuplicates(["qid"])
    q = q.select("qid", "base", S.token_set("question").alias("w"))
    side = lambda c, n: q.where(c).select(F.col("qid").alias(n), "w")
    return similar(side("not base", "train"), "train", side("base", "eval"), "eval", "w", Fraction(8, 10))


@query(f"WITH {_SETS} SELECT train, eval, round(shared / either, 6) AS jaccard FROM p WHERE shared * 10 >= 8 * either")
def leakage_jaccard(spark, d):
    """Training and evaluation questions that are alike, with their similarity."""
    return _leaks(spark, d).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {_SETS} SELECT qid FROM q WHERE NOT base AND qid NOT IN (SELECT train FROM p WHERE shared * 10 >= 8 * either)")
def leak_filter(spark, d):
    """Training questions that are like no evaluation question."""
    q = table(spark, d, "emacs_questions").where("question is not null and (variant_of is not null or paraphrase_of is not null)").select("qid").distinct()
    return q.join(_leaks(spark, d).select(F.col("train").alias("qid")).distinct(), "qid", "left_anti")


@query("SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND doc_id NOT IN (SELECT doc FROM emacs_questions WHERE doc IS NOT NULL)")
def decontam_antijoin(spark, d):
    """Chunks of documents that no evaluation question is about."""
    docs = table(spark, d, "emacs_questions").select(F.col("doc").alias("doc_id")).where("doc_id is not null").distinct()
    return table(spark, d, "chunks").where("chunk_id is not null and doc_id is not null").select("chunk_id", "doc_id").join(docs, "doc_id", "left_anti").select("chunk_id").distinct()


@query(r"""WITH p AS (SELECT doc_id, count(*) AS windows FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL) WHERE trim(x) <> '' AND regexp_matches(x, '^[ ]{0,7}-') GROUP BY doc_id)
SELECT windows AS entries, count(*) AS docs FROM p GROUP BY windows""")
def option_like_lines(spark, d):
    """Documents by their number of lines that open like an option."""
    x = table(spark, d, "documents").where("text is not null").select(F.size(F.filter(F.split("text", "\n"), lambda v: (F.trim(v) != "") & v.rlike("^[ ]{0,7}-"))).cast("long").alias("entries")).where("entries > 0")
    return x.groupBy("entries").agg(F.count("*").alias("docs"))
