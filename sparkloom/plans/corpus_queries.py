"""Queries of the hierarchy and reference operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.hierarchy import descendants, hierarchy
from sparkloom.operators.references import doc_references, orphan_references, orphan_report
from sparkloom.runtime import table


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "sections"), "sec_id", "parent", "heading", "level")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each section with a parent: its root, depth and fault."""
    return _tree(spark, d).where("has_parent").select(F.col("node").alias("sec_id"), "root", "depth", "fault")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each section's path of headings; null on and under cycles."""
    return _tree(spark, d).select(F.col("node").alias("sec_id"), "path", "depth", "root")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All sections below each section, with the number of steps down."""
    return descendants(table(spark, d, "sections"), "sec_id", "parent").select(F.col("ancestor").alias("sec_id"), F.col("node").alias("below"), "distance")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*doc_references(table(spark, d, "man_docs"), table(spark, d, "emacs_questions"), table(spark, d, "sections")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each orphan reference with its state and month."""
    return _orphans(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, state and month."""
    return orphan_report(_orphans(spark, d))


QUERIES = {q.__name__: q for q in (p2_found, p2_paths, p2_descendants, p6_found, p6_report)}

_TRIM = r"regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"

_UP = f"""
s AS (SELECT sec_id, min(parent) AS raw, {_TRIM.format('min(parent)')} AS parent, min(level) AS level, coalesce(min(heading), '') AS heading FROM sections GROUP BY sec_id),
top AS (SELECT s.* FROM s LEFT JOIN s p ON s.parent = p.sec_id WHERE p.sec_id IS NULL),
t AS (SELECT sec_id, sec_id AS root, 0 AS depth, heading AS path, raw IS NOT NULL AS broken FROM top
      UNION ALL SELECT s.sec_id, t.root, t.depth + 1, t.path || ' / ' || s.heading, t.broken FROM s JOIN t ON s.parent = t.sec_id)"""

_REFS = f"""
r AS (SELECT 'man_docs' AS src_table, doc_id AS src_key, 'see_also' AS ref_field, 'page' AS tab,
        nullif({_TRIM.format('x.name')}, '') || '.' || nullif({_TRIM.format('x.section')}, '') AS ref_key, loaded_at AS seen
      FROM (SELECT doc_id, loaded_at, unnest(see_also) AS x FROM man_docs)
      UNION SELECT 'emacs_questions', qid, 'gold_sec_ids', 'section', nullif({_TRIM.format('x')}, ''), loaded_at
      FROM (SELECT qid, loaded_at, unnest(gold_sec_ids) AS x FROM emacs_questions)
      UNION SELECT 'emacs_questions', qid, 'doc', 'page', nullif({_TRIM.format('doc')}, ''), loaded_at FROM emacs_questions),
p AS (SELECT 'page' AS tab, doc_id AS ref_key, bool_and(removed_at IS NOT NULL) AS removed, min(loaded_at) AS arrived FROM man_docs GROUP BY doc_id
      UNION ALL SELECT 'section', sec_id, false, min(loaded_at) FROM sections GROUP BY sec_id),
o AS (SELECT DISTINCT src_table, src_key, ref_field, r.ref_key,
        CASE WHEN p.ref_key IS NULL THEN 'missing' WHEN removed THEN 'deleted' WHEN arrived > seen THEN 'late' END AS state,
        strftime(seen, '%Y-%m') AS ref_month
      FROM r LEFT JOIN p ON r.tab = p.tab AND r.ref_key = p.ref_key WHERE r.ref_key IS NOT NULL)"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_UP}
SELECT s.sec_id, coalesce(t.root, 'cycle') AS root, coalesce(t.depth, -1) AS depth,
  CASE WHEN t.root IS NULL THEN 'cycle' WHEN t.broken THEN 'missing' WHEN s.level IS NOT NULL AND s.level <> t.depth + 1 THEN 'level' ELSE 'none' END AS fault
FROM s LEFT JOIN t ON s.sec_id = t.sec_id WHERE s.raw IS NOT NULL""",
    "p2_paths": f"""WITH RECURSIVE {_UP}
SELECT s.sec_id, t.path, coalesce(t.depth, -1) AS depth, coalesce(t.root, 'cycle') AS root FROM s LEFT JOIN t ON s.sec_id = t.sec_id""",
    "p2_descendants": f"""WITH RECURSIVE {_UP},
a AS (SELECT s.parent AS sec_id, s.sec_id AS below, 1 AS distance FROM s JOIN t ON s.sec_id = t.sec_id WHERE t.depth > 0
      UNION ALL SELECT s.parent, a.below, a.distance + 1 FROM a JOIN s ON a.sec_id = s.sec_id JOIN t ON s.sec_id = t.sec_id WHERE t.depth > 0)
SELECT * FROM a""",
    "p6_found": f"WITH {_REFS} SELECT * FROM o WHERE state IS NOT NULL",
    "p6_report": f"""WITH {_REFS} SELECT src_table, ref_field, state, ref_month, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys
FROM o WHERE state IS NOT NULL GROUP BY ALL""",
}
