"""Queries of the llm subpackage over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import encode, leakage, neardup, pack, pairs, quality, splits, terms
from sparkloom.runtime import materialize, table

REFS = ["variant_of", "paraphrase_of"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each question in a family of two or more, with the smallest qid of the family."""
    return splits.families(table(spark, d, "emacs_questions"), "qid", REFS).where("members > 1").select(F.col("key").alias("qid"), "family")


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    """The split of each question."""
    return splits.question_splits(table(spark, d, "emacs_questions"), REFS).withColumnRenamed("key", "qid")


def _near(spark: SparkSession, d: str) -> DataFrame:
    chunks = neardup.near_duplicate_chunks(table(spark, d, "chunks")).withColumn("tab", F.lit("chunks"))
    pages = neardup.near_duplicate_aliases(table(spark, d, "man_docs")).withColumn("tab", F.lit("man_docs"))
    return chunks.unionByName(pages).select("tab", "key_a", "key_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate chunks and of pages with near-duplicate aliases."""
    return _near(spark, d)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each record with a near duplicate: its group and its number of links."""
    args = {"chunks": neardup.chunk_args, "man_docs": neardup.alias_args}
    one = [neardup.class_groups(*neardup.similar_classes(*f(table(spark, d, t)))).withColumn("tab", F.lit(t)) for t, f in args.items()]
    return one[0].unionByName(one[1]).select("tab", "key", "group", "links")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(terms.without_repeats(table(spark, d, "chunks"), "chunk_id", "rowid"), ["text", "prefix"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Words that too few or too many chunks hold: of the counts of all truncated suffixes, those of one word."""
    return _terms(spark, d).where((F.instr("term", " ") == 0) & F.col("mark").isNotNull()).select("field", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every word and every two successive words: occurrences, chunks and mark."""
    return _terms(spark, d)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "chunks"), table(spark, d, "emacs_questions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that repeat wording of a question without being its evidence."""
    return leakage.without_evidence(_leaks(spark, d), table(spark, d, "emacs_questions")).select("chunk_id", "qid").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked question with the number of chunks that hold it."""
    return p5_found(spark, d).groupBy("qid").agg(F.count("*").alias("n_chunks"))


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words to remove from each chunk."""
    return leakage.removal_spans(leakage.without_evidence(_leaks(spark, d), table(spark, d, "emacs_questions")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each answer that is no proper response, with its defect."""
    return pairs.defective_pairs(table(spark, d, "p9probe_ctx4b_answers"), table(spark, d, "documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document."""
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are not their text: none."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = encode.decode_corpus(p8_ids(spark, d), "doc_id", "ids")
    return docs.join(back, "doc_id", "full").where(~F.col("was").eqNullSafe(F.col("text"))).select("doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every container with its items and their texts."""
    return pack.pack_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers, the least possible, and the share of unused space."""
    return pack.container_fill(p9_containers(spark, d))


def p9_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every container of question and answer pairs, with its limit on the tokens of answers."""
    rows = table(spark, d, "p9probe_ctx4b_answers").where("answer_id is not null").groupBy("answer_id").agg(F.min(F.struct("question", "answer")).alias("r")).select("answer_id", "r.*")
    return pack.pack_pairs(rows, "answer_id", "question", "answer")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document that is not mainly prose, with its form."""
    return p10_stats(spark, d).where("form <> 'prose'").select("doc_id", "form").distinct()


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """Quality statistics and form of each document."""
    return quality.text_statistics(table(spark, d, "documents"), table(spark, d, "labels"))


def queries() -> dict:
    return {q.__name__: q for q in (p1_found, p1_split, p3_found, p3_groups, p4_found, p4_terms, p5_found, p5_report, p5_spans, p7_found, p8_ids, p8_roundtrip, p9_containers, p9_fill, p9_pairs, p10_found, p10_stats)}


#: White space of any kind, trimmed at both ends.
_TRIM = r"regexp_replace({}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"
SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE q AS (SELECT DISTINCT qid, nullif({_TRIM.format("variant_of")}, '') AS v, nullif({_TRIM.format("paraphrase_of")}, '') AS p FROM emacs_questions WHERE qid IS NOT NULL),
e AS (SELECT 'q:' || qid AS a, 'p:' || split_part(qid, '.', 1) AS b FROM q UNION SELECT 'q:' || qid, 'q:' || v FROM q WHERE v IS NOT NULL UNION SELECT 'q:' || qid, 'q:' || p FROM q WHERE p IS NOT NULL),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT 'q:' || qid AS node, 'q:' || qid AS at FROM q UNION SELECT r.node, u.b FROM r JOIN u ON r.at = u.a),
m AS (SELECT r.node, min(q.qid) AS family, count(*) AS n FROM r JOIN (SELECT DISTINCT qid FROM q) q ON r.at = 'q:' || q.qid GROUP BY r.node) SELECT substr(node, 3) AS qid, family FROM m WHERE n > 1""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
