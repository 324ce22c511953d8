"""Dense retrieval and list algebra over ``embeddings``: every vec_id divisible by 50 is a query, its label its domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import retrieval as R
from sparkloom.plans.spec import Registry
from sparkloom.runtime import materialize, table

reg = Registry()
QUERIES, SQL, query = reg.QUERIES, reg.SQL, reg.query

THRESHOLD = 0.43
VARIANTS = 3


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 50 = 0")


def _open(spark: SparkSession, d: str, k: int = R.CANDIDATES) -> DataFrame:
    e, q = _tables(spark, d)
    hits = R.nearest(e, q, k, "vec_id", "embedding", exclude_self=True)
    return materialize(hits.join(e.select("vec_id", F.col("label").alias("domain")), "vec_id"), "hits")


def _by_domain(spark: SparkSession, d: str, k: int) -> DataFrame:
    e, q = _tables(spark, d)
    return materialize(R.nearest(e, q, k, "vec_id", "embedding", by="label", exclude_self=True).withColumn("domain", F.col("label").cast("int")).drop("label"), "domains")


def _out(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("query_id", *cols, "vec_id", F.round("distance", 6).alias("distance")) if "distance" in df.columns else df.select("query_id", *cols, "vec_id")


# All pairs of query and record with both ranks, for the SQL of this module
_PAIRS = """
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, c.label AS domain, q.label AS own,
            list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance
          FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank,
          row_number() OVER (PARTITION BY query_id, domain ORDER BY distance, vec_id) AS drank FROM pairs)"""


@query(f"WITH {_PAIRS} SELECT query_id, rank, vec_id, round(distance, 6) AS distance, round(1 - distance / 2, 6) AS score, (1 - distance / 2) < {THRESHOLD} AS below FROM knn WHERE rank <= 5")
def flagship_grounded_topk(spark, d):
    """Five nearest records of each query, and whether each is under the gate."""
    hits = _open(spark, d, R.KEEP)
    return _out(hits, "rank").join(hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), (F.col("score") < THRESHOLD).alias("below")), ["query_id", "vec_id"])


@query(f"WITH {_PAIRS} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM knn WHERE rank <= 50")
def knn_open(spark, d):
    return _out(_open(spark, d), "rank")


@query(f"WITH {_PAIRS} SELECT query_id, domain, drank AS rank, vec_id, round(distance, 6) AS distance FROM knn WHERE drank <= 5")
def knn_domain(spark, d):
    """The nearest in each domain."""
    return _out(_by_domain(spark, d, 5), "domain", "rank")


@query(f"WITH {_PAIRS} SELECT query_id, drank AS rank, vec_id, round(distance, 6) AS distance FROM knn WHERE domain = own AND drank <= 5")
def oracle_domain_route(spark, d):
    """The nearest in the query's own domain."""
    e, q = _tables(spark, d)
    own = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("domain"))
    return _out(_by_domain(spark, d, 5).join(own, ["query_id", "domain"]), "rank")


@query("""SELECT a.label, count(*) AS n, round(min(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS least,
round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label""")
def cosine_parity(spark, d):
    """Cosine of each vector with the next: number, least and mean by label."""
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    cos = dot("embedding", "other") / F.sqrt(dot("embedding", "embedding") * dot("other", "other"))
    return e.join(nxt, "vec_id").withColumn("c", cos).groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("c"), 6).alias("least"), F.round(F.avg("c"), 6).alias("mean"))


@query(f"WITH {_PAIRS}, d AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings)) "
       "SELECT query_id, domain, drank AS rank, vec_id, round(distance, 6) AS distance FROM knn JOIN d ON domain = label WHERE drank <= 25 // n + CASE WHEN i < 25 % n THEN 1 ELSE 0 END")
def domain_quota(spark, d):
    """25 places shared equally by the domains."""
    e, _ = _tables(spark, d)
    return _out(R.quota(_by_domain(spark, d, 25), e.select(F.col("label").alias("domain")), "query_id", "domain", 25), "domain", "rank")


_FLOOR = """
sure AS (SELECT query_id, vec_id, domain, distance, 0 AS part, drank AS r FROM knn WHERE drank <= {f}),
rest AS (SELECT query_id, vec_id, domain, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS k FROM knn WHERE drank > {f}),
number AS (SELECT query_id, count(*) AS n FROM sure GROUP BY query_id),
pool AS (SELECT * FROM sure UNION ALL SELECT query_id, vec_id, domain, distance, 1, 0 FROM rest LEFT JOIN number USING (query_id) WHERE k <= 50 - coalesce(n, 0))"""


@query(f"WITH {_PAIRS}, {_FLOOR.format(f=2)} SELECT query_id, vec_id, round(distance, 6) AS distance, domain, "
       "row_number() OVER (PARTITION BY query_id ORDER BY part, CASE WHEN part = 0 THEN domain END, r, distance, vec_id) AS place FROM pool")
def domain_floor(spark, d):
    """Each domain is sure of two of the 50 places."""
    e, _ = _tables(spark, d)
    n = e.select("label").distinct().count()
    return _out(R.floor_quota(_by_domain(spark, d, 2), _open(spark, d), "query_id", "vec_id", "domain", 2, 50, n), "domain", "place")


@query("WITH " + _PAIRS + " " + " UNION ALL ".join(
    f"(WITH {_FLOOR.format(f=f).strip()} SELECT {f} AS floor, count(*) AS n, count(DISTINCT domain) AS domains, round(sum(distance), 4) AS total FROM pool)" for f in (0, 1, 2, 3)))
def floor_sweep(spark, d):
    """One retrieval, many floors: size, domains and total distance of the pool at each."""
    e, _ = _tables(spark, d)
    n = e.select("label").distinct().count()
    by, whole = _by_domain(spark, d, 3), _open(spark, d)
    out = None
    for f in (0, 1, 2, 3):
        pool = R.floor_quota(by, whole, "query_id", "vec_id", "domain", f, 50, n)
        one = pool.agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"), F.round(F.sum("distance"), 4).alias("total")).withColumn("floor", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_PAIRS}, v AS (SELECT query_id, domain, count(*) AS n FROM knn WHERE rank <= 5 GROUP BY ALL),
m AS (SELECT query_id, max(n) AS most FROM v GROUP BY query_id),
t AS (SELECT query_id, count(*) AS ties, min(domain) AS sole FROM v JOIN m USING (query_id) WHERE n = most GROUP BY query_id),
w AS (SELECT query_id, CASE WHEN ties = 1 THEN sole ELSE domain END AS routed FROM t JOIN knn USING (query_id) WHERE rank = 1)
SELECT query_id, routed, drank AS rank, vec_id, round(distance, 6) AS distance FROM knn JOIN w USING (query_id) WHERE domain = routed AND drank <= 5""")
def dense_vote_route(spark, d):
    """The first five hits vote for a domain, in which the search is repeated."""
    routed = R.vote(_open(spark, d), "query_id", "domain")
    by = _by_domain(spark, d, 5).join(routed, "query_id").where(F.col("domain") == F.col("routed"))
    return _out(by, "routed", "rank")


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    """The open list and the list of the query's own domain, 20 each."""
    e, q = _tables(spark, d)
    own = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("domain"))
    a = _open(spark, d, 20).select("query_id", "vec_id", "rank", F.lit(0).alias("list_no"), F.lit(1.0).alias("weight"))
    b = _by_domain(spark, d, 20).join(own, ["query_id", "domain"]).select("query_id", "vec_id", "rank", F.lit(1).alias("list_no"), F.lit(0.5).alias("weight"))
    return materialize(a.unionByName(b), "lists")


_LISTS = """
lists AS (SELECT query_id, vec_id, rank, 0 AS list_no, 1.0::DOUBLE AS weight FROM knn WHERE rank <= 20
          UNION ALL SELECT query_id, vec_id, drank, 1, 0.5 FROM knn WHERE domain = own AND drank <= 20)"""


def _rrf_sql(weight: str) -> str:
    return f"""WITH {_PAIRS}, {_LISTS},
f AS (SELECT query_id, vec_id, sum({weight} / (60 + rank)) AS rrf, min({{'l': list_no, 'r': rank}}) AS seen FROM lists GROUP BY ALL)
SELECT query_id, vec_id, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen, vec_id) AS rank FROM f"""


@query(_rrf_sql("1.0::DOUBLE"))
def rrf_hybrid(spark, d):
    return R.fuse(_two_lists(spark, d), "query_id", "vec_id").withColumn("rrf", F.round("rrf", 9))


@query(_rrf_sql("weight"))
def rrf_weighted(spark, d):
    return R.fuse(_two_lists(spark, d), "query_id", "vec_id", weight="weight").withColumn("rrf", F.round("rrf", 9))


@query(f"""WITH {_PAIRS}, {_LISTS},
f AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min({{'l': list_no, 'r': rank}}) AS seen FROM lists GROUP BY ALL),
top AS (SELECT query_id, vec_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen, vec_id) = 1)
SELECT query_id, arg_min(list_no, rank * 10 + list_no) AS list_no FROM lists JOIN top USING (query_id, vec_id) GROUP BY query_id""")
def fuse_variants_winner(spark, d):
    """The list that ranks the fused top record highest."""
    lists = _two_lists(spark, d)
    return R.winner(lists, R.fuse(lists, "query_id", "vec_id"), "query_id", "vec_id")


@query(f"""WITH {_PAIRS}, {_LISTS}, one AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY list_no, rank) = 1)
SELECT query_id, vec_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, vec_id) AS place FROM one""")
def pool_widen(spark, d):
    """Union of pools without repeats, the first wins."""
    return R.pooled(_two_lists(spark, d), "query_id", "vec_id").select("query_id", "vec_id", "list_no", "place")


@query(f"""WITH {_PAIRS}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY rank) > 2 AS extra FROM knn WHERE rank <= 50),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY extra, rank) AS place FROM h)
SELECT query_id, domain, rank, place, vec_id FROM o WHERE place <= 10""")
def cap_per_doc(spark, d):
    """Ten hits, at most two of one label while others are left."""
    return R.cap_per_document(_open(spark, d), "query_id", "domain", 2, 10).select("query_id", "domain", "rank", "place", "vec_id")


@query(f"""WITH {_PAIRS}, best AS (SELECT c.label, q.query_id, q.vec_id, q.distance FROM knn q JOIN embeddings c ON c.vec_id = q.vec_id WHERE q.rank <= 20)
SELECT query_id, label AS chunk, min(vec_id) FILTER (distance = m) AS question, round(m, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY m, label) AS rank
FROM (SELECT *, min(distance) OVER (PARTITION BY query_id, label) AS m FROM best) GROUP BY query_id, label, m""")
def question_route(spark, d):
    """Question vectors stand for their chunk (here the label): the best question of each chunk in the first 20."""
    hits = _open(spark, d, 20)
    best = R.ranked(hits, ["query_id", "domain"], [F.col("distance"), F.col("vec_id")], 1, "_b")
    return R.ranked(best.drop("rank"), ["query_id"], [F.col("distance"), F.col("domain")]).select("query_id", F.col("domain").alias("chunk"), F.col("vec_id").alias("question"), F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {_PAIRS}, t AS (SELECT query_id, 1 - distance / 2 AS s, vec_id, domain, own FROM knn WHERE rank <= 5),
a AS (SELECT query_id, 0 AS tier, max(s) AS score FROM t GROUP BY query_id UNION ALL
      SELECT query_id, 1, max(s) + 0.005 FROM t GROUP BY query_id UNION ALL SELECT query_id, 2, max(s) + 0.01 FROM t GROUP BY query_id),
r AS (SELECT *, score < 0.45 AS refused FROM a)
SELECT query_id, tier, round(score, 6) AS score, refused FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY refused, CASE WHEN refused THEN -tier ELSE tier END) = 1""")
def cascade_tiers(spark, d):
    """Each refused query goes to the next tier; the first tier that answers counts, else the last."""
    top = _open(spark, d, R.KEEP).where("rank = 1").select("query_id", "score")
    tiers = None
    for t, gain in ((0, 0.0), (1, 0.005), (2, 0.01)):
        asked = top if tiers is None else top.join(tiers.where("refused").select("query_id").distinct(), "query_id")
        one = asked.select("query_id", F.lit(t).alias("tier"), (F.col("score") + gain).alias("score"))
        one = one.withColumn("refused", F.col("score") < 0.45)
        tiers = one if tiers is None else tiers.unionByName(one)
    return R.cascade(tiers, "query_id").withColumn("score", F.round("score", 6))


@query(f"""WITH {_PAIRS}, e AS (SELECT query_id, list(vec_id ORDER BY rank) AS a FROM knn WHERE rank <= 5 GROUP BY query_id),
o AS (SELECT query_id, list(vec_id ORDER BY drank) AS b, 1 - min(distance) / 2 AS s FROM knn WHERE domain = own AND drank <= 5 GROUP BY query_id),
g AS (SELECT query_id, 1 - min(distance) / 2 AS t FROM knn WHERE rank <= 5 GROUP BY query_id)
SELECT count(*) AS n, count(*) FILTER (a <> b) AS lists_differ, count(*) FILTER ((s < {THRESHOLD}) <> (t < {THRESHOLD})) AS gates_flip,
count(*) FILTER (a <> b OR (s < {THRESHOLD}) <> (t < {THRESHOLD})) AS drifted, round(max(abs(s - t)), 6) AS largest FROM e JOIN o USING (query_id) JOIN g USING (query_id)""")
def drift_compare(spark, d):
    """Two retrievals of the same queries: lists that differ, gates that flip, largest change of the gate score."""
    e, q = _tables(spark, d)
    own = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("domain"))
    listed = lambda h, n: h.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias(n), F.max("score").alias("s" + n))
    a = listed(_open(spark, d, 5), "a")
    b = listed(_by_domain(spark, d, 5).join(own, ["query_id", "domain"]), "b")
    differ, flip = F.col("a") != F.col("b"), (F.col("sa") < THRESHOLD) != (F.col("sb") < THRESHOLD)
    n = lambda c: F.count(F.when(c, 1))
    return a.join(b, "query_id").agg(F.count("*").alias("n"), n(differ).alias("lists_differ"), n(flip).alias("gates_flip"), n(differ | flip).alias("drifted"), F.round(F.max(F.abs(F.col("sa") - F.col("sb"))), 6).alias("largest"))


@query(f"""WITH {_PAIRS} SELECT query_id, round(max(1 - distance / 2) FILTER (rank = 1), 6) AS top1,
round(max(1 - distance / 2) FILTER (rank = 1) - max(1 - distance / 2) FILTER (rank = 2), 6) AS gap,
count(*) FILTER (domain = top) AS same_doc, round(min(distance), 6) AS dist1, round(avg(1 - distance / 2), 6) AS mean5
FROM (SELECT *, first_value(domain) OVER (PARTITION BY query_id ORDER BY rank) AS top FROM knn WHERE rank <= 5) GROUP BY query_id""")
def gate_features(spark, d):
    """Features of the first five hits: top score, gap to the second, hits of the top document, least distance, mean score."""
    hits = _open(spark, d, 5)
    top = hits.where("rank = 1").select("query_id", F.col("domain").alias("top"))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return hits.join(top, "query_id").groupBy("query_id").agg(
        F.round(at(1), 6).alias("top1"), F.round(at(1) - at(2), 6).alias("gap"), F.count(F.when(F.col("domain") == F.col("top"), 1)).alias("same_doc"),
        F.round(F.min("distance"), 6).alias("dist1"), F.round(F.avg("score"), 6).alias("mean5"),
    )


@query(f"""WITH {_PAIRS}, s AS (SELECT query_id, 1 - min(distance) / 2 AS top1, avg(distance) AS mean FROM knn WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, round((top1 - avg(top1) OVER ()) / CASE WHEN stddev_pop(top1) OVER () = 0 THEN 1 ELSE stddev_pop(top1) OVER () END, 5) AS z_top1,
round((mean - avg(mean) OVER ()) / CASE WHEN stddev_pop(mean) OVER () = 0 THEN 1 ELSE stddev_pop(mean) OVER () END, 5) AS z_mean FROM s""")
def zscore_features(spark, d):
    """Features standardised by mean and population deviation; a deviation of 0 counts as 1."""
    f = _open(spark, d, 5).groupBy("query_id").agg(F.max("score").alias("top1"), F.avg("distance").alias("mean"))
    m = f.agg(*[g(c).alias(p + c) for c in ("top1", "mean") for p, g in (("a_", F.avg), ("s_", F.stddev_pop))])
    z = lambda c: F.round((F.col(c) - F.col("a_" + c)) / F.when(F.col("s_" + c) == 0, 1.0).otherwise(F.col("s_" + c)), 5)
    return f.join(F.broadcast(m)).select("query_id", z("top1").alias("z_top1"), z("mean").alias("z_mean"))


@query(f"""WITH {_PAIRS}, near AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS k FROM knn WHERE domain = own)
SELECT query_id, list(vec_id ORDER BY k) AS distractors, query_id % 5 AS gold_pos FROM near WHERE k <= 4 GROUP BY query_id HAVING count(*) = 4""")
def raft_plan(spark, d):
    """Training rows: four nearest distractors of the own domain, dropped with fewer, and the place of the gold extract."""
    e, q = _tables(spark, d)
    own = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("domain"))
    near = _by_domain(spark, d, 4).join(own, ["query_id", "domain"])
    got = near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("distractors"))
    return got.where(F.size("distractors") == 4).withColumn("gold_pos", F.col("query_id") % 5)


@query(f"WITH {_PAIRS}, t AS (SELECT query_id, 1 - min(distance) / 2 AS s FROM pairs GROUP BY query_id) SELECT query_id, round(s, 6) AS gate_score, s < {THRESHOLD} AS gated FROM t")
def gate_replay(spark, d):
    """The gate on the top hit of each query."""
    e, q = _tables(spark, d)
    return R.gate_scores(q.select(F.col("vec_id").alias("query_id")), _open(spark, d, 1), "query_id", THRESHOLD).withColumn("gate_score", F.round("gate_score", 6))


@query(f"WITH {_PAIRS} SELECT own AS label, domain AS routed, count(*) AS n FROM knn WHERE rank = 1 GROUP BY ALL")
def route_confusion(spark, d):
    """True against routed domain of the queries."""
    e, q = _tables(spark, d)
    own = q.select(F.col("vec_id").alias("query_id"), "label")
    return _open(spark, d, 1).join(own, "query_id").groupBy("label", F.col("domain").alias("routed")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PAIRS}, s AS (SELECT query_id, min(rank) FILTER (domain = own) AS hit FROM knn WHERE rank <= 50 GROUP BY query_id)
SELECT count(*) AS n, round(avg((hit <= 1)::INT), 6) AS recall_1, round(avg((coalesce(hit, 99) <= 5)::INT), 6) AS recall_5,
round(avg((coalesce(hit, 99) <= 10)::INT), 6) AS recall_10, round(avg(CASE WHEN hit <= 10 THEN 1.0 / hit ELSE 0 END), 6) AS mrr_10 FROM s""".replace("(hit <= 1)", "(coalesce(hit, 99) <= 1)"))
def dev_recall(spark, d):
    """Recall and mean reciprocal rank of the first record of the query's own label."""
    e, q = _tables(spark, d)
    own = q.select(F.col("vec_id").alias("query_id"), "label")
    hit = _open(spark, d).join(own, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("domain") == F.col("label"), F.col("rank"))).alias("hit"))
    share = lambda k: F.round(F.avg(F.coalesce((F.col("hit") <= k).cast("int"), F.lit(0))), 6).alias(f"recall_{k}")
    return hit.agg(F.count("*").alias("n"), share(1), share(5), share(10), F.round(F.avg(F.when(F.col("hit") <= 10, 1 / F.col("hit")).otherwise(0)), 6).alias("mrr_10"))
