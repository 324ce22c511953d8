"""The whole way: documents to an index, questions to answers, answers to records that can be evaluated.

A batch of questions is the unit; one question is a batch of one row. Model functions are columns
functions and can be replaced by those of a real service.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import models as M
from sparkloom.functions import scalars as S
from sparkloom.operators import retrieval as R
from sparkloom.operators.chunking import structured_chunks
from sparkloom.operators.lexical import bm25
from sparkloom.operators.spelling import repair
from sparkloom.runtime import materialize
from sparkloom.sources.store import ChunkStore

# Gates of answers and of acts, of a reranker's scores.
ANSWER_GATE, ACT_GATE = 0.65, 0.30
MODES = ("dense", "bm25", "hybrid")
ROUTES = (None, "quota", "floor", "vote", "oracle")


def build_index(pages: DataFrame, sections: DataFrame, store: ChunkStore, embed: Callable[[Column], Column] = M.embed) -> DataFrame:
    """Chunks of all sections with prefixes and vectors, added to a store; those that it has are not embedded again.

    pages: (doc_id, name, section, summary, domain); sections: (doc_id, sec_id, heading, text).
    """
    p = pages.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("name", "section", "summary", "domain")).alias("p")).select("doc_id", "p.*")
    prefix = S.page_prefix(F.coalesce("name", "doc_id"), F.coalesce("section", F.lit("")), F.col("summary"))
    c = structured_chunks(sections).join(p, "doc_id", "left").withColumn("prefix", F.concat(prefix, S.heading_path("sec_id"), F.lit("\n")))
    new = c.join(store.chunks().select("chunk_id"), "chunk_id", "left_anti").withColumn("rowid", F.xxhash64("chunk_id"))
    store.add(new.withColumn("embedding", embed(F.concat("prefix", "text"))).withColumn("domain", F.coalesce("domain", F.lit("linux"))))
    return store.chunks()


def candidates(questions: DataFrame, chunks: DataFrame, mode: str = "dense", route: str | None = None, n: int = R.CANDIDATES, floor: int = 2, embed: Callable[[Column], Column] = M.embed) -> DataFrame:
    """(query_id, chunk_id, rank): the pool of each question (qid, question[, domain]).

    Routes need dense mode: ``quota`` and ``floor`` share the pool among the domains, ``vote`` searches
    again in the domain of the first hits, ``oracle`` in the question's own.
    """
    if mode not in MODES or route not in ROUTES or (route and mode != "dense"):
        raise ValueError("mode and route don't agree")
    q = questions.where("qid is not null and question is not null").dropDuplicates(["qid"])
    lists = []
    if mode in ("bm25", "hybrid"):
        lists.append(bm25(chunks, q.select("qid", "question"), n).select(F.col("qid").alias("query_id"), "chunk_id", "rank", F.lit(1).alias("list_no")))
    if mode in ("dense", "hybrid"):
        v = materialize(q.select(F.col("qid").alias("chunk_id"), embed(M.query_text(F.col("question"))).alias("embedding"), F.lit(None).cast("string").alias("domain")), "questions")
        corpus = chunks.select("chunk_id", "embedding", F.coalesce("domain", F.lit("linux")).alias("domain"))
        whole = R.nearest(corpus, v, n, "chunk_id", "embedding")
        if route:
            by = materialize(R.nearest(corpus, v, n, "chunk_id", "embedding", by="domain"), "domains")
            own = corpus.select("chunk_id", "domain")
            if route == "quota":
                pool = R.quota(by, own, "query_id", "domain", n)
                whole = R.ranked(pool.drop("rank"), ["query_id"], [F.col("domain"), F.col("distance"), F.col("chunk_id")])
            elif route == "floor":
                d = own.select("domain").distinct().count()
                whole = R.floor_quota(by, whole.join(own, "chunk_id"), "query_id", "chunk_id", "domain", min(floor, n // max(d, 1)), n, d).withColumnRenamed("place", "rank")
            else:
                chosen = R.vote(whole.join(own, "chunk_id"), "query_id", "domain") if route == "vote" else q.select(F.col("qid").alias("query_id"), F.coalesce("domain", F.lit("linux")).alias("routed"))
                whole = by.join(chosen, "query_id").where(F.col("domain") == F.col("routed"))
        lists.append(whole.select("query_id", "chunk_id", "rank", F.lit(0).alias("list_no")))
    if len(lists) == 1:
        return lists[0].drop("list_no")
    return R.fuse(lists[0].unionByName(lists[1]), "query_id", "chunk_id").where(F.col("rank") <= n).select("query_id", "chunk_id", "rank")


def retrieve(questions: DataFrame, chunks: DataFrame, keep: int = R.KEEP, cap: int | None = None, score: Callable[[Column, Column], Column] = M.rerank_score, **how) -> DataFrame:
    """(query_id, rank, chunk_id, doc_id, sec_id, ord, prefix, text, score): the pool reranked and cut to ``keep``, at most ``cap`` chunks of one document first."""
    pool = candidates(questions, chunks, **how)
    text = F.concat(F.coalesce("prefix", F.lit("")), F.coalesce("text", F.lit("")))
    c = chunks.select("chunk_id", "doc_id", "sec_id", "ord", "prefix", "text")
    asked = questions.select(F.col("qid").alias("query_id"), "question").dropDuplicates(["query_id"])
    scored = pool.withColumnRenamed("rank", "place_in_pool").join(c, "chunk_id").join(asked, "query_id").withColumn("score", score("question", text))
    scored = materialize(scored, "reranked")
    hits = R.ranked(scored, ["query_id"], [F.desc("score"), F.col("place_in_pool"), F.col("chunk_id")], None if cap else keep)
    if cap:
        hits = R.cap_per_document(hits, "query_id", "doc_id", cap, keep).drop("rank").withColumnRenamed("place", "rank")
    return hits.select("query_id", "rank", "chunk_id", "doc_id", "sec_id", "ord", "prefix", "text", "score")


def answer(questions: DataFrame, hits: DataFrame, gate: float = ANSWER_GATE, read: Callable[[Column, Column], Column] = M.read_answer) -> DataFrame:
    """One record a question: answer, gated, abstained, retrieved_docs, top_score. Gated questions never reach the reader."""
    q = questions.where("qid is not null").dropDuplicates(["qid"]).select(F.col("qid").alias("query_id"), "question")
    gated = materialize(R.gate_scores(q, hits, "query_id", gate), "gated")
    docs = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved_docs"))
    top = hits.where("rank = 1").select("query_id", "text")
    # the plan is split before the model function: Catalyst does not promise to skip it inside a condition
    said = q.join(gated.where("not gated"), "query_id").join(top, "query_id", "left").select("query_id", read("question", "text").alias("answer"))
    silent = gated.where("gated").select("query_id", F.lit(S.REFUSAL).alias("answer"))
    out = said.unionByName(silent).join(gated, "query_id").join(docs, "query_id", "left")
    return out.select(F.col("query_id").alias("qid"), "answer", "gated", (F.col("gated") | S.abstained("answer")).alias("abstained"), "retrieved_docs", F.when(F.col("gate_score") > float("-inf"), F.col("gate_score")).alias("top_score"))


def answer_in_tiers(questions: DataFrame, chunks: DataFrame, tiers: list[dict], gate: float = ANSWER_GATE) -> DataFrame:
    """Answers of a cascade: each tier (options of :func:`retrieve`) gets the questions that all before it refused."""
    left, done = questions, None
    for k, how in enumerate(tiers):
        got = materialize(answer(left, retrieve(left, chunks, **how), gate).withColumn("tier", F.lit(k)), "tier")
        last = k == len(tiers) - 1
        part = got if last else got.where("not abstained")
        done = part if done is None else done.unionByName(part)
        if not last:
            left = left.join(got.where("abstained").select("qid"), "qid", "left_semi")
    return done


def widen_spell(questions: DataFrame, vocab: DataFrame, search: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pool, audit): the hits of each question, and where the vocabulary repairs it, behind them the hits of the repaired question that it lacks.

    ``search`` gives (qid, rank, chunk_id) of (qid, question). pool: (query_id, place, chunk_id); audit: (qid, question, repaired, n_edits) of the questions repaired. Repaired questions are searched with the others in one call.
    """
    q = questions.where("qid is not null and question is not null").select("qid", "question").dropDuplicates(["qid"])
    fixed = materialize(repair(q, vocab), "repaired")
    changed = fixed.where("n_edits > 0").join(q, "qid").select("qid", "question", "repaired", "n_edits")
    both = q.select(F.struct(F.lit(0).alias("list_no"), "qid").alias("k"), "question").unionByName(changed.select(F.struct(F.lit(1).alias("list_no"), "qid").alias("k"), F.col("repaired").alias("question")))
    name = F.concat(F.col("k.list_no").cast("string"), F.lit(":"), F.col("k.qid"))
    hits = search(both.select(name.alias("qid"), "question"))
    lists = hits.select(F.substring("qid", 3, 1 << 30).alias("query_id"), F.substring("qid", 1, 1).cast("int").alias("list_no"), "rank", "chunk_id")
    return R.pooled(lists, "query_id", "chunk_id"), changed
