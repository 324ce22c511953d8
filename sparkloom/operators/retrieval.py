"""Dense retrieval and the algebra of ranked lists.

A ranked list is a table with a query key, a rank from 1 and a record key. Every ranking has an explicit
tiebreak: the record key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Constants of the retrieval configuration.
RRF_K = 60
CANDIDATES = 50
KEEP = 5
VOTE = 5

#: Rows of the corpus and queries that one task compares at a time, at most; and bytes of the corpus as a matrix.
CORPUS_CELL, QUERY_CELL = 50_000, 2_000
CELL_BYTES = 32 << 20


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """``df`` with its rank within ``keys``; only the first ``k`` if given (cut on the map side as well)."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col(name) <= k) if k else out


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles."""
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks]).astype(np.float64)
    n = len(column)
    if len(flat) % n or any((np.diff(x.offsets.to_numpy()) != len(flat) // n).any() for x in column.chunks):
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, key: str, vector: str, by: str | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, key, distance, score[, by]): the k nearest rows of each query, by Euclidean distance.

    With ``by``, the k nearest in each of its groups. score is 1 - distance / 2. Both sides are cut into
    cells, each compared as one matrix product, so queries are never broadcast whole; a cell keeps k rows
    for each query and group. Rows with a null vector take no part; vectors of another length than the
    first of the cell are an error.
    """
    n, size = corpus.agg(F.count("*"), F.max(F.size(vector))).first()
    rows = min(CORPUS_CELL, max(256, CELL_BYTES // (8 * max(size or 1, 1))))
    nc, nq = max(1, -(-n // rows)), max(1, -(-queries.count() // QUERY_CELL))
    kind = dict(corpus.dtypes)
    cols = [F.col(key).alias("id"), F.col(vector).alias("vec"), (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("grp")]
    left = corpus.select(*cols).where("vec is not null").withColumn("i", F.pmod(F.xxhash64("id"), F.lit(nc)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = queries.select(*cols).where("vec is not null").withColumn("j", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    schema = f"query_id {kind[key]}, id {kind[key]}, distance double, grp string"

    def compare(c: pa.Table, q: pa.Table) -> pa.Table:
        types = [c.schema.field("id").type, c.schema.field("id").type, pa.float64(), pa.string()]
        names = ["query_id", "id", "distance", "grp"]
        if not c.num_rows or not q.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        a, b = matrix(c["vec"]), matrix(q["vec"])
        ids, groups = np.array(c["id"].to_pylist()), np.array([x or "" for x in c["grp"].to_pylist()])
        qids = np.array(q["id"].to_pylist())
        members = [np.flatnonzero(groups == g) for g in np.unique(groups)] if by else [np.arange(len(ids))]
        norms, out = (a**2).sum(1), []
        for x in range(0, len(b), 256):
            part = b[x : x + 256]
            d2 = (part**2).sum(1)[:, None] + norms[None, :] - 2 * part @ a.T
            for y in range(len(part)):
                for m in members:
                    row = d2[y, m]
                    # one more than k for the query itself; the slack covers rounding of the product
                    most = np.partition(row, k)[k] + 1e-6 if len(row) > k + 1 else np.inf
                    near = m[row <= most]
                    if exclude_self:
                        near = near[ids[near] != qids[x + y]]
                    exact = np.sqrt(((a[near] - part[y]) ** 2).sum(1))
                    order = np.lexsort((ids[near], exact))[:k]
                    out.append((np.repeat(qids[x + y], len(order)), ids[near][order], exact[order], groups[near][order]))
        cols = [np.concatenate(z) for z in zip(*out)]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, cols, types)})

    got = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(compare, schema)
    keys = ["query_id", "grp"] if by else ["query_id"]
    got = ranked(got, keys, [F.col("distance"), F.col("id")], k).withColumn("score", 1 - F.col("distance") / 2)
    got = got.withColumnRenamed("id", key)
    return got.withColumnRenamed("grp", by) if by else got.drop("grp")


def fuse(lists: DataFrame, query: str, key: str, rank: str = "rank", weight: str | None = None, order: str = "list_no") -> DataFrame:
    """Reciprocal rank fusion: rows (query, list_no, rank, key[, weight]) -> (query, key, rrf, rank).

    The score is the sum of weight / (60 + rank). Equal scores rank by the first list and rank in which
    the record was seen, then by its key.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    got = lists.groupBy(query, key).agg(F.sum(w / (RRF_K + F.col(rank))).alias("rrf"), F.min(F.struct(order, rank)).alias("_seen"))
    return ranked(got, [query], [F.desc(F.round("rrf", 12)), F.col("_seen"), F.col(key)]).drop("_seen")


def winner(lists: DataFrame, fused: DataFrame, query: str, key: str) -> DataFrame:
    """(query, list_no) of the list that ranks the fused top record highest; ties go to the earlier list."""
    top = fused.where("rank = 1").select(query, F.col(key).alias("_top"))
    return lists.join(top, query).where(F.col(key) == F.col("_top")).groupBy(query).agg(F.min(F.struct("rank", "list_no")).alias("x")).select(query, F.col("x.list_no").alias("list_no"))


def pooled(lists: DataFrame, query: str, key: str) -> DataFrame:
    """Union of pools in order without repeats: the first pool (list_no, rank) that holds a record wins."""
    one = ranked(lists, [query, key], [F.col("list_no"), F.col("rank")], 1, "_first").drop("_first")
    return ranked(one, [query], [F.col("list_no"), F.col("rank"), F.col(key)], name="place")


def quota(by_group: DataFrame, groups: DataFrame, query: str, group: str, n: int) -> DataFrame:
    """Equal quota: of D groups in order, each gets n // D places and the first n % D one more.

    by_group: lists ranked within each group. groups: one row a group, their number is small.
    """
    order = F.row_number().over(W.orderBy(group)) - 1
    d = F.count("*").over(W.partitionBy())
    share = groups.select(group).distinct().withColumn("_i", order).withColumn("_d", d).select(group, (F.floor(F.lit(n) / F.col("_d")) + (F.col("_i") < F.lit(n) % F.col("_d")).cast("int")).alias("share"))
    return by_group.join(F.broadcast(share), group).where(F.col("rank") <= F.col("share")).drop("share")


def floor_quota(by_group: DataFrame, open_list: DataFrame, query: str, key: str, group: str, floor: int, n: int, n_groups: int) -> DataFrame:
    """Each group is sure of its ``floor`` nearest; the other places go to the nearest of the rest.

    Order: guaranteed rows by group and rank, then the fill by distance and key.
    """
    if floor < 0 or n_groups * floor > n:
        raise ValueError("floors exceed the pool")
    sure = by_group.where(F.col("rank") <= floor).select(query, key, group, "distance", F.lit(0).alias("part"), F.col("rank").alias("_r"))
    taken = sure.select(query, key)
    left = open_list.join(taken, [query, key], "left_anti").select(query, key, group, "distance", F.lit(1).alias("part"), F.lit(0).alias("_r"))
    number = sure.groupBy(query).agg(F.count("*").alias("_n"))
    left = ranked(left, [query], [F.col("distance"), F.col(key)], n, "_k").join(number, query, "left").where(F.col("_k") <= n - F.coalesce("_n", F.lit(0))).drop("_k", "_n")
    both = sure.unionByName(left)
    return ranked(both, [query], [F.col("part"), F.when(F.col("part") == 0, F.col(group)), F.col("_r"), F.col("distance"), F.col(key)], name="place").drop("_r")


def vote(hits: DataFrame, query: str, group: str, first: int = VOTE) -> DataFrame:
    """(query, routed): the group of most of the first hits; a tie goes to the top hit's group, none to null."""
    head = hits.where(F.col("rank") <= first)
    n = head.groupBy(query, group).agg(F.count("*").alias("n"))
    best = n.groupBy(query).agg(F.max("n").alias("most"))
    tied = n.join(best, query).where("n = most").groupBy(query).agg(F.count("*").alias("ties"), F.min(group).alias("only"))
    top = head.where("rank = 1").select(query, F.col(group).alias("top"))
    return top.join(tied, query).select(query, F.when(F.col("ties") == 1, F.col("only")).otherwise(F.col("top")).alias("routed"))


def cap_per_document(hits: DataFrame, query: str, document: str, cap: int, k: int) -> DataFrame:
    """At most ``cap`` hits of one document among the first k; places left over go to the skipped hits in order."""
    w = W.partitionBy(query, document).orderBy("rank")
    extra = (F.row_number().over(w) > cap).cast("int")
    return ranked(hits.withColumn("_extra", extra), [query], [F.col("_extra"), F.col("rank")], k, "place").drop("_extra")


def gate_scores(queries: DataFrame, hits: DataFrame, query: str, threshold: float, score: str = "score") -> DataFrame:
    """(query, gate_score, gated): score of the top hit, minus infinity without hits; gated if it is under a threshold that is not 0."""
    top = hits.where("rank = 1").select(query, F.coalesce(F.col(score), F.lit(0.0)).alias("gate_score"))
    out = queries.select(query).join(top, query, "left").withColumn("gate_score", F.coalesce("gate_score", F.lit(float("-inf"))))
    return out.withColumn("gated", (F.lit(threshold) != 0) & (F.col("gate_score") < threshold))


def cascade(tiers: DataFrame, query: str) -> DataFrame:
    """Rows (query, tier, refused, ...) -> the first tier that does not refuse, else the last."""
    return ranked(tiers, [query], [F.col("refused").cast("int"), F.when(F.col("refused"), -F.col("tier")).otherwise(F.col("tier"))], 1, "_k").drop("_k")


def neighbours(hits: DataFrame, chunks: DataFrame, span: int, query: str = "query_id") -> DataFrame:
    """Hits (query, rank, doc_id, sec_id, ord) with the chunks of the same section at most ``span`` places away."""
    near = F.explode(F.expr(f"sequence(ord - {int(span)}, ord + {int(span)})"))
    asked = hits.withColumn("_ord", near)
    c = chunks.select(F.col("doc_id"), F.col("sec_id"), F.col("ord").alias("_ord"), F.col("chunk_id").alias("near_id"), F.col("text").alias("near_text"))
    return asked.join(c, ["doc_id", "sec_id", "_ord"]).withColumnRenamed("_ord", "near_ord")


def expand(near: DataFrame, query: str = "query_id", budget: int = 6000) -> DataFrame:
    """Hits widened by their neighbours within a budget of characters: (query, rank, chunk_id, text, expanded).

    In rank order each hit becomes its neighbours' texts in order, joined by a line end, while the
    running total stays in the budget, and itself otherwise; a chunk is used once. A query's list is short.
    """
    kind = dict(near.dtypes)[query]

    def run(pdf):
        used, total, out = set(), 0, []
        for rank, hit in pdf.sort_values(["rank", "near_ord"]).groupby("rank", sort=True):
            own = hit.loc[hit["near_id"] == hit["chunk_id"], "near_text"]
            fresh = hit.loc[~hit["near_id"].isin(used - {hit["chunk_id"].iloc[0]})]
            text = "\n".join(t for t in fresh["near_text"] if t)
            single = own.iloc[0] if len(own) else ""
            wide = total + len(text) <= budget and len(fresh) > 1
            text = text if wide else single or ""
            used |= set(fresh["near_id"]) if wide else {hit["chunk_id"].iloc[0]}
            total += len(text)
            out.append((hit[query].iloc[0], int(rank), hit["chunk_id"].iloc[0], text, bool(wide)))
        return type(pdf)(out, columns=[query, "rank", "chunk_id", "text", "expanded"])

    cols = near.select(query, "rank", "chunk_id", "near_id", "near_ord", "near_text")
    return cols.groupBy(query).applyInPandas(run, f"{query} {kind}, rank int, chunk_id string, text string, expanded boolean")


def prompt(hits: DataFrame, query: str, doc: str = "doc_id") -> DataFrame:
    """(query, prompt): numbered extracts in rank order, each with its document on the first line."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(doc), F.lit("\n"), F.coalesce("prefix", F.lit("")), F.coalesce("text", F.lit("")))
    got = hits.select(query, F.struct("rank", block.alias("b")).alias("x")).groupBy(query).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return got.select(query, F.array_join(F.transform("xs", lambda x: x["b"]), "\n\n").alias("prompt"))



def nearest_by_questions(index: DataFrame, queries: DataFrame, k: int, key: str = "question_id") -> DataFrame:
    """(query_id, rank, chunk_id, question, distance): chunks by their generated questions.

    index: (question_id, chunk_id, question, embedding); the k nearest questions count, and each chunk keeps its best.
    """
    hits = nearest(index.select(key, "embedding"), queries, k, key, "embedding").join(index.select(key, "chunk_id", "question"), key)
    best = ranked(hits.drop("rank"), ["query_id", "chunk_id"], [F.col("distance"), F.col(key)], 1, "_k").drop("_k")
    return ranked(best, ["query_id"], [F.col("distance"), F.col("chunk_id")]).select("query_id", "rank", "chunk_id", "question", "distance")


def with_question_route(pool: DataFrame, by_questions: DataFrame) -> DataFrame:
    """A pool (query_id, chunk_id, rank) and, behind it, the chunks that only their questions found, with the route of each."""
    a = pool.select("query_id", "chunk_id", "rank", F.lit(0).alias("list_no"))
    b = by_questions.select("query_id", "chunk_id", "rank", F.lit(1).alias("list_no"))
    return pooled(a.unionByName(b), "query_id", "chunk_id").select("query_id", "chunk_id", "place", F.when(F.col("list_no") == 1, "question").otherwise("chunk").alias("route"))


def fused_variants(lists: DataFrame, k: int = KEEP, first: int = 20) -> tuple[DataFrame, DataFrame]:
    """(hits, winners) of rewritten questions: lists (query_id, list_no, rank, chunk_id), number 0 the original's; each is cut to ``first``, they are fused, and the fused list is cut to ``k``."""
    cut = lists.where(F.col("rank") <= first)
    fused = fuse(cut, "query_id", "chunk_id")
    return fused.where(F.col("rank") <= k), winner(cut, fused, "query_id", "chunk_id")
