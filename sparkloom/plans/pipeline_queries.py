"""Tools, training data, model stand-ins, stores and streams over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import models as M
from sparkloom.functions.text import trimmed
from sparkloom.operators import retrieval as R
from sparkloom.operators import tools as TL
from sparkloom.operators import training as TR
from sparkloom.operators.hierarchy import hierarchy
from sparkloom.plans.corpus_queries import _TRIM
from sparkloom.plans.spec import Registry
from sparkloom.runtime import materialize, shared_dir, table
from sparkloom.sources import manpages, manuals
from sparkloom.sources.store import ChunkStore
from sparkloom.streaming import ingest as ST

reg = Registry()
QUERIES, SQL, query = reg.QUERIES, reg.SQL, reg.query


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "man_docs").dropDuplicates(["doc_id"])


def _commands(spark: SparkSession, d: str) -> DataFrame:
    """A command for each page, made of its name by the last digit of its section's name."""
    m = _pages(spark, d)
    verb = F.element_at(F.array(*[F.lit(x) for x in ("ls -l", "sudo", "rm", "cat", "systemctl restart", "systemctl status", "grep x |", "foo")]), F.pmod(F.length("name"), F.lit(8)) + 1)
    return m.select("doc_id", "name", "section", F.concat(verb, F.lit(" "), F.col("name")).alias("command"))


@query("""WITH m AS (SELECT DISTINCT ON (doc_id) doc_id, name, section FROM man_docs) SELECT doc_id, ['read-only', 'destructive', 'destructive', 'read-only', 'destructive', 'read-only', 'destructive', 'unknown'][length(name) % 8 + 1] AS risk FROM m""")
def tool_classify(spark, d):
    """Risk of a command for each page."""
    return _commands(spark, d).select("doc_id", TL.risk(F.col("command")).alias("risk"))


@query("""WITH m AS (SELECT DISTINCT ON (doc_id) doc_id, name FROM man_docs), c AS (SELECT doc_id, ['ls -l', 'sudo', 'rm', 'cat', 'systemctl restart', 'systemctl status', 'grep x |', 'foo'][length(name) % 8 + 1] || ' ' || name AS c, name FROM m)
SELECT doc_id, (contains(c, 'ls') OR contains(c, 'cat') OR contains(c, 'systemctl')) AND contains(c, name) AS ok FROM c""")
def tool_command_ok(spark, d):
    """Commands that hold a spelling of every group."""
    groups = F.array(F.array(F.lit("ls"), F.lit("cat"), F.lit("systemctl")), F.array(F.col("name")))
    return _commands(spark, d).select("doc_id", TL.command_ok(F.col("command"), groups).alias("ok"))


_CALLS = """m AS (SELECT DISTINCT ON (doc_id) doc_id, name, section FROM man_docs), k AS (SELECT *, CASE length(name) % 3 WHEN 0 THEN 'propose_command' WHEN 1 THEN 'show_manpage' ELSE '' END AS tool,
['read-only', 'destructive', 'destructive', 'read-only', 'destructive', 'read-only', 'destructive', 'unknown'][length(name) % 8 + 1] AS r, CASE WHEN ends_with(doc_id, '.' || section) THEN left(doc_id, length(doc_id) - length(section) - 1) ELSE doc_id END AS base FROM m),
v AS (SELECT *, coalesce(section IN ('1', '5', '7', '8'), false) AND regexp_matches(base, '^[A-Za-z0-9][A-Za-z0-9_.+-]*$') AS sound FROM k),
t AS (SELECT doc_id, tool, CASE WHEN tool = 'propose_command' THEN r WHEN tool = 'show_manpage' AND sound THEN 'read-only' ELSE 'unknown' END AS risk,
tool = 'propose_command' OR (tool = 'show_manpage' AND sound AND base || '.' || section IN (SELECT doc_id FROM m)) AS valid FROM v)"""


@query(f"""WITH {_CALLS} SELECT doc_id, tool, risk, valid, NOT (valid AND tool = 'show_manpage') AS confirm, valid AND tool = 'show_manpage' AS ran,
CASE WHEN NOT valid THEN 'invalid' WHEN tool = 'show_manpage' THEN 'page view' ELSE 'needs confirmation' END AS reason FROM t""")
def tool_calls(spark, d):
    """Page views and commands as calls: validated, and what may run unasked."""
    c = _commands(spark, d).select("doc_id", "command", "name", "section")
    view = F.to_json(F.struct(F.lit("show_manpage").alias("tool"), F.col("doc_id").alias("page"), F.col("section")))
    do = F.to_json(F.struct(F.lit("propose_command").alias("tool"), F.col("command"), F.lit("does it").alias("explanation"), F.lit(1).alias("cite")))
    text = F.when(F.length("name") % 3 == 0, do).when(F.length("name") % 3 == 1, view).otherwise("{}")
    calls = c.select("doc_id", TL.parse_call(text, F.lit(5)).alias("call"))
    return TL.decide(calls, _pages(spark, d)).select("doc_id", F.col("call.tool").alias("tool"), F.col("call.risk").alias("risk"), "valid", "confirm", "ran", "reason")


@query(f"""WITH {_CALLS}, s AS (SELECT *, list_reduce(list_transform(string_split(md5(doc_id)[1:4], ''), lambda c: instr('0123456789abcdef', c) - 1), lambda x, y: x * 16 + y) / 65536.0::DOUBLE AS score FROM t),
g AS (SELECT CASE WHEN score < 0.2 THEN 'refuse' ELSE tool END AS expected, CASE WHEN score < 0.1 THEN 'refuse' ELSE tool END AS tool, score >= 0.1 AND risk = 'read-only' AS good, score < 0.1 OR valid AS valid FROM s)
SELECT count(*) AS n, round(count(*) FILTER (valid)::DOUBLE / greatest(count(*), 1), 6) AS valid, round(count(*) FILTER (valid AND tool = expected)::DOUBLE / greatest(count(*), 1), 6) AS tool_accuracy,
round(count(*) FILTER (expected = 'propose_command' AND good)::DOUBLE / greatest(count(*) FILTER (expected = 'propose_command'), 1), 6) AS command_accuracy,
round(count(*) FILTER (expected = 'refuse' AND tool = 'refuse')::DOUBLE / greatest(count(*) FILTER (expected = 'refuse'), 1), 6) AS refusal,
round(count(*) FILTER (expected = 'refuse' AND tool IN ('propose_command', 'show_manpage'))::DOUBLE / greatest(count(*) FILTER (expected = 'refuse'), 1), 6) AS over_action FROM g""")
def tool_report(spark, d):
    """Metrics of those calls at a gate."""
    t = QUERIES["tool_calls"](spark, d).withColumn("score", F.conv(F.substring(F.md5("doc_id"), 1, 4), 16, 10).cast("double") / 65536)
    rows = t.select(F.when(F.col("score") < 0.2, "refuse").otherwise(F.col("tool")).alias("expected"), "tool", (F.col("risk") == "read-only").alias("command_right"), "valid", "score")
    return TL.tool_metrics(TL.gated_calls(rows, 0.1))


@query()
def typo_variants(spark, d):
    """Two mistyped variants of every base question."""
    q = table(spark, d, "emacs_questions").where("variant_of is null and paraphrase_of is null")
    return TR.typo_variants(q).select("qid", "variant_of", "variant_kind", "question", F.size("edits").alias("n_edits"))


@query(rf"""WITH q AS (SELECT DISTINCT ON (qid) * FROM emacs_questions), j AS (SELECT v.qid, v.variant_kind, v.question, v.edits, b.question AS base FROM q v LEFT JOIN q b ON b.qid = {_TRIM.format('v.variant_of')} WHERE v.variant_kind IN ('typo1', 'typo3'))
SELECT qid, unnest(list_filter([CASE WHEN base IS NULL THEN 'no base' END, CASE WHEN len(edits) <> CASE variant_kind WHEN 'typo1' THEN 1 ELSE 3 END THEN 'number of edits' END,
CASE WHEN len(list_distinct(list_transform(edits, lambda e: e.word_index))) <> len(edits) THEN 'word edited twice' END, CASE WHEN len(list_filter(edits, lambda e: substr(e.before, 1, 1) <> substr(e.after, 1, 1))) > 0 THEN 'first letter' END,
CASE WHEN len(list_filter(edits, lambda e: e.before = e.after)) > 0 OR question = base THEN 'no change' END], lambda x: x IS NOT NULL)) AS problem FROM j""")
def variants_check(spark, d):
    """Violations of the recorded mistyped variants."""
    q = table(spark, d, "emacs_questions").dropDuplicates(["qid"])
    return TR.variant_violations(q.where("variant_kind in ('typo1', 'typo3')").withColumn("variant_of", trimmed("variant_of")).select("qid", "variant_of", "variant_kind", "question", "edits"), q)


@query(rf"""WITH q AS (SELECT DISTINCT ON (qid) qid, question, variant_of FROM emacs_questions), v AS (SELECT qid, {_TRIM.format('variant_of')} AS base, question FROM q WHERE variant_of IS NOT NULL)
SELECT v.qid, b.qid IS NULL AS orphan, coalesce(v.question = b.question, false) AS same FROM v LEFT JOIN q b ON b.qid = v.base""")
def variant_bases(spark, d):
    """The recorded variants with their base: missing, or with the same words."""
    q = table(spark, d, "emacs_questions").select("qid", "question", "variant_of").dropDuplicates(["qid"])
    v = q.where("variant_of is not null").select("qid", trimmed("variant_of").alias("base"), "question")
    b = q.select(F.col("qid").alias("base"), F.col("question").alias("bq"), F.lit(True).alias("there"))
    return v.join(b, "base", "left").select("qid", F.col("there").isNull().alias("orphan"), F.coalesce(F.col("question") == F.col("bq"), F.lit(False)).alias("same"))


@query()
def raft_messages(spark, d):
    """Chat examples: each query's own record is the gold extract among its nearest of the same label; one in five has it removed."""
    e = table(spark, d, "embeddings")
    text = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("`record-"), F.col("vec_id"), F.lit("` of label "), F.col("label")).alias("text"))
    near = R.nearest(e, e.where("vec_id % 50 = 0"), 4, "vec_id", "embedding", by="label", exclude_self=True).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("own")), "query_id").where("label = own")
    plan = near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")).alias("distractors")).where("size(distractors) = 4")
    plan = plan.select(TR.pair_id(F.col("query_id").cast("string")).alias("id"), F.concat(F.lit("What is record "), F.col("query_id"), F.lit("?")).alias("question"), F.col("query_id").cast("string").alias("gold"), "distractors", (F.col("query_id") % 5).alias("gold_pos"), (F.col("query_id") % 250 == 0).alias("gold_removed"))
    plan = materialize(plan, "plan")
    said = plan.select("id", F.concat(F.lit("It is `record-"), F.col("gold"), F.lit("` [1]")).alias("answer"))
    return TR.assemble(plan, text, said).select("id", F.to_json("messages").alias("messages"), "gold_removed")


@query()
def embed_chunks(spark, d):
    """Stand-in vectors of all chunks: their number and the share that has words, by domain."""
    c = table(spark, d, "chunks").select("domain", M.embed(F.concat(F.coalesce("prefix", F.lit("")), F.coalesce("text", F.lit("")))).alias("v"))
    return c.groupBy(F.coalesce("domain", F.lit("linux")).alias("domain")).agg(F.count("*").alias("n"), F.round(F.avg(F.exists("v", lambda x: x != 0).cast("int")), 6).alias("with_words"))


@query()
def rerank_and_read(spark, d):
    """The whole pool of candidates of each question reranked, and the answer of the stand-in reader from the first."""
    from sparkloom.plans.corpus_text_queries import _asked, _hits

    h = _hits(spark, d, R.CANDIDATES).join(_asked(spark, d).select(F.col("qid").alias("query_id"), "question"), "query_id")
    h = h.withColumn("rerank_score", M.rerank_score("question", F.concat(F.coalesce("prefix", F.lit("")), F.coalesce("text", F.lit("")))))
    best = R.ranked(h.drop("rank"), ["query_id"], [F.desc("rerank_score"), F.col("chunk_id")], 1)
    return best.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("score"), M.read_answer("question", "text").alias("answer"))


@query("""SELECT chunk_id, coalesce(min(domain), 'linux') AS domain, CASE WHEN bool_or(rowid % 3 = 0) THEN 2 WHEN bool_or(rowid % 2 = 0) THEN 1 END AS vector FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id""")
def store_upsert(spark, d):
    """A store to which half of the chunks are added with vectors, and all of them again, a third with other vectors: each chunk once, with its latest vector."""
    store = ChunkStore(spark, f"{shared_dir(spark)}/sparkloom-store-{uuid.uuid4().hex}")
    c = table(spark, d, "chunks").where("chunk_id is not null")
    store.add(c.where("rowid % 2 = 0").withColumn("embedding", F.array(F.lit(1.0))))
    store.add(c.withColumn("embedding", F.when(F.col("rowid") % 3 == 0, F.array(F.lit(2.0)))))
    return store.chunks().select("chunk_id", F.coalesce("domain", F.lit("linux")).alias("domain"), F.get("embedding", F.lit(0)).cast("int").alias("vector"))


@query("""SELECT chunk_id FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)""")
def stream_ingest_dedupe(spark, d):
    """All chunks ingested as a stream of files, twice: each once."""
    base = f"{shared_dir(spark)}/sparkloom-stream-{uuid.uuid4().hex}"
    store = ChunkStore(spark, base + "/store")
    for k in range(2):
        ST.ingest_stream(ST.table_stream(spark, d, "chunks").where("chunk_id is not null"), store, f"{base}/check{k}").awaitTermination()
    return store.chunks().select("chunk_id")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 600 SECOND THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS "user", min(ts) AS begin, max(ts) + INTERVAL 600 SECOND AS stop, count(*) AS n FROM k GROUP BY user_id, k""")
def idle_sessions(spark, d):
    """Runs of a user's events at most ten minutes apart."""
    return ST.idle_sessions(table(spark, d, "events"), "user_id", "ts")


@query()
def idle_sessions_stream(spark, d):
    """The same on a stream: sessions that the watermark has closed."""
    out = f"{shared_dir(spark)}/sparkloom-sessions-{uuid.uuid4().hex}"
    got = ST.idle_sessions(ST.table_stream(spark, d, "events"), "user_id", "ts", delay="1 hour")
    got.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(out)


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a rendered page: running heads, its sections with their whole texts, NAME and SEE ALSO of its record.

    Sections follow their root: roots stand at the margin, all below them three blanks in, texts seven.
    A section without a heading is headed by its sec_id; one on a cycle is its own root.
    """
    s = table(spark, d, "sections").where("doc_id is not null and sec_id is not null").dropDuplicates(["sec_id"])
    tree = hierarchy(s, "sec_id", "parent").select(F.col("node").alias("sec_id"), F.when(F.col("depth") < 0, F.col("node")).otherwise(F.col("root")).alias("root"), F.greatest("depth", F.lit(0)).alias("depth"))
    title = F.concat(F.when(F.col("depth") > 0, " " * manpages.SUBSECTION).otherwise(""), F.coalesce("heading", "sec_id"))
    indent = "\n" + " " * manpages.BODY
    part = F.concat(title, F.lit(indent), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", indent), F.lit("\n"))
    placed = s.join(tree, "sec_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("root", "depth", "sec_id", part.alias("part")))).alias("parts"))
    placed = placed.select("doc_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("body"))
    m = _pages(spark, d).where("name is not null and section is not null").join(placed, "doc_id", "left")
    head = F.concat(F.upper("name"), F.lit("("), F.col("section"), F.lit(")"))
    refs = F.array_join(F.transform(F.filter(F.coalesce("see_also", F.array().cast("array<struct<name:string,section:string>>")), lambda r: r["name"].isNotNull() & r["section"].isNotNull()), lambda r: F.concat(F.trim(r["name"]), F.lit("("), F.trim(r["section"]), F.lit(")"))), ", ")
    body = F.concat(head, F.lit("   Manual   "), head, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("NAME\n       "), F.col("name"), F.lit(", "), F.col("name"), F.lit("x - "), F.coalesce("summary", F.lit("")), F.lit("\nSEE ALSO\n       "), refs, F.lit("\n"), head, F.lit("   end   "), head)
    return m.select("name", "section", body.alias("rendered"))


@query()
def man_parse(spark, d):
    """Rendered pages parsed: sections, aliases, references."""
    p = manpages.parse_pages(_rendered(spark, d))
    return p.select("doc_id", "title", "summary", F.array_join("aliases", ",").alias("aliases"), F.size("see_also").alias("refs"), F.array_join(F.transform("sections", lambda s: s["sec_id"]), ",").alias("sections"))


@query(r"""SELECT DISTINCT doc_id, regexp_extract(regexp_replace(string_split(path, '/')[-1], '(\.(gz|bz2|xz|lzma|Z|zst))+$', ''), '^(.+)\.(\d[^.]*)$', 1) AS name, regexp_extract(regexp_replace(string_split(path, '/')[-1], '(\.(gz|bz2|xz|lzma|Z|zst))+$', ''), '^(.+)\.(\d[^.]*)$', 2) AS section
FROM man_docs WHERE path IS NOT NULL AND regexp_matches(regexp_replace(string_split(path, '/')[-1], '(\.(gz|bz2|xz|lzma|Z|zst))+$', ''), '^(.+)\.(\d[^.]*)$')""")
def page_files(spark, d):
    """Name and section of each page by its file."""
    name, section = manpages.file_name_parts(F.col("path"))
    return table(spark, d, "man_docs").where("path is not null").select("doc_id", name.alias("name"), section.alias("section")).where("name is not null").distinct()


@query()
def option_lines(spark, d):
    """Options that sections describe at the margin of their entries, by flag."""
    s = table(spark, d, "sections").where("text is not null").select("sec_id", "text").dropDuplicates(["sec_id"])
    return s.select("sec_id", F.explode(manuals.flags("text")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


# Substrate: relational operators on the star schema

@query("""SELECT n.n_name, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) AS without_orders
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name""")
def z_join_types(spark, d):
    c, n, o = (table(spark, d, t) for t in ("customer", "nation", "orders"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey, "left")
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.sum(F.col("o_orderkey").isNull().cast("int")).alias("without_orders"))


@query("""SELECT 'without' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'with', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def z_setops(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    one = lambda df, p: df.agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
    return one(c.subtract(o), "without").unionByName(one(c.intersect(o), "with"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def z_rollup_cube(spark, d):
    g = lambda c: F.grouping(c).cast("int")
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(g("l_returnflag").alias("g1"), g("l_linestatus").alias("g2"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, k FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3""")
def z_windows(spark, d):
    return R.ranked(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3, "k").drop("l_extendedprice")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def z_topk(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= DATE '1995-01-01' GROUP BY ALL")
def z_dates(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("date")).groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL""")
def z_pricing(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))

