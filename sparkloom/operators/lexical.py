"""BM25 over chunks for blocks of questions, without a pair for every match of a term."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import query_terms
from sparkloom.operators.prefix import positions
from sparkloom.operators.retrieval import ranked
from sparkloom.runtime import materialize

# Saturation and length normalisation of the ranking function, column weights.
K1, B = 1.2, 0.75
PREFIX_WEIGHT, TEXT_WEIGHT = 0.5, 1.0
#: Questions whose terms are held by every task at a time; more questions make more blocks.
QUERY_BLOCK = 5_000

_word = re.compile(r"[a-z0-9]+").findall
_VOWEL = "aeiou"


def tokens(text: str | None) -> list[str]:
    return _word(text.lower()) if text else []


def stem(w: str) -> str:
    """Porter's stemmer (1980), by its published rules."""
    if len(w) <= 2:
        return w

    def cons(i: int) -> bool:
        return w[i] not in _VOWEL and not (w[i] == "y" and i and cons(i - 1))

    def shape(x: str) -> str:
        out = ""
        for i, c in enumerate(x):
            v = c in _VOWEL or (c == "y" and i and out[-1] == "c")
            out += "v" if v else "c"
        return out

    def m(x: str) -> int:
        return len(re.findall("v+c+", shape(x)))

    def cvc(x: str) -> bool:
        return len(x) >= 3 and shape(x)[-3:] == "cvc" and x[-1] not in "wxy"

    def swap(x: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, new in rules:
            if x.endswith(end):
                return x[: len(x) - len(end)] + new if m(x[: len(x) - len(end)]) > least else x
        return x

    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) >= 2 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    if w.endswith("ion") and len(w) > 3 and w[-4] in "st":
        w = w[:-3] if m(w[:-3]) > 1 else w
    else:
        w = swap(w, [(e, "") for e in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")], 1)
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return w


stem = lru_cache(maxsize=200_000)(stem)


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 10, stemmed: bool = False) -> DataFrame:
    """(qid, rank, chunk_id, score): the k best chunks of each question.

    chunks: (chunk_id, prefix, text), one row a chunk; questions: (qid, question). Terms are OR'd; a term
    counts 0.5 for each occurrence in the prefix and 1 in the text; idf is at least 1e-6. Each task
    scores its chunks against a block of questions and keeps k for each; only those are shuffled. Ties
    go to the smaller chunk_id. Questions without a term and chunks without one of them have no row.
    """
    terms = questions.where("qid is not null and question is not null").select("qid", query_terms("question").alias("ts")).where(F.size("ts") > 0)
    terms = materialize(terms, "terms")
    blocks = max(1, -(-terms.count() // QUERY_BLOCK))
    # blocks by place: none holds more than QUERY_BLOCK questions, and none is left out
    terms = terms.withColumn("block", F.lit(0)) if blocks == 1 else positions(terms, [F.col("qid")]).withColumn("block", F.floor((F.col("position") - 1) / QUERY_BLOCK))
    out = None
    for block in range(blocks):
        mine = terms.where(F.col("block") == block).collect()
        one = _block(chunks, {r["qid"]: [stem(t) if stemmed else t for t in r["ts"]] for r in mine}, k, stemmed)
        out = one if out is None else out.unionByName(one)
    return out


def _block(chunks: DataFrame, asked: dict[str, list[str]], k: int, stemmed: bool) -> DataFrame:
    by_term: dict[str, list[str]] = {}
    for q, ts in asked.items():
        for t in dict.fromkeys(x for t in ts for x in tokens(t)):
            by_term.setdefault(t, []).append(q)
    cut = (lambda s: [stem(t) for t in tokens(s)]) if stemmed else tokens
    shared = chunks.sparkSession.sparkContext.broadcast(by_term)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words, df = 0, 0, Counter()
        known = shared.value
        for b in batches:
            for p, t in zip(b["prefix"].to_pylist(), b["text"].to_pylist()):
                ws = cut(p) + cut(t)
                n += 1
                words += len(ws)
                df.update(w for w in set(ws) if w in known)
        rows = [("", n, words), *((t, c, 0) for t, c in df.items())]
        yield pa.RecordBatch.from_pydict({"term": pa.array([r[0] for r in rows]), "n": pa.array([r[1] for r in rows], pa.int64()), "words": pa.array([r[2] for r in rows], pa.int64())})

    docs = chunks.select("chunk_id", "prefix", "text")
    stats = {r["term"]: (r["n"], r["words"]) for r in docs.mapInArrow(count, "term string, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()}
    total, words = stats.pop("", (0, 0))
    mean = words / total if total else 1.0
    idf = {t: max(math.log((total - n + 0.5) / (n + 0.5)), 1e-6) for t, (n, _) in stats.items()}

    qids = sorted(asked)
    number = {q: i for i, q in enumerate(qids)}
    index = chunks.sparkSession.sparkContext.broadcast({t: np.array(sorted(number[q] for q in qs), np.int64) for t, qs in by_term.items() if t in idf})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        best: list[list[tuple[float, tuple, str]]] = [[] for _ in qids]
        sums, least = np.zeros(len(qids)), np.full(len(qids), -1.0)
        for b in batches:
            for c, p, t in zip(b["chunk_id"].to_pylist(), b["prefix"].to_pylist(), b["text"].to_pylist()):
                ps, ts = cut(p), cut(t)
                f: dict[str, float] = {}
                for w in ps:
                    if w in at:
                        f[w] = f.get(w, 0.0) + PREFIX_WEIGHT
                for w in ts:
                    if w in at:
                        f[w] = f.get(w, 0.0) + TEXT_WEIGHT
                if not f:
                    continue
                norm = K1 * (1 - B + B * (len(ps) + len(ts)) / mean)
                sums[:] = 0.0
                for w in sorted(f):
                    sums[at[w]] += idf[w] * f[w] * (K1 + 1) / (f[w] + norm)
                s = np.round(sums, 9)
                for q in np.flatnonzero((s >= least) & (s > 0)).tolist():
                    item, heap = (float(s[q]), tuple(-ord(x) for x in c), c), best[q]
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                    if len(heap) == k:
                        least[q] = heap[0][0]
        rows = [(qids[q], c, s) for q, heap in enumerate(best) for s, _, c in heap]
        yield pa.RecordBatch.from_pydict({"qid": pa.array([r[0] for r in rows], pa.string()), "chunk_id": pa.array([r[1] for r in rows], pa.string()), "score": pa.array([r[2] for r in rows], pa.float64())})

    got = docs.where("chunk_id is not null").mapInArrow(score, "qid string, chunk_id string, score double")
    return ranked(got, ["qid"], [F.desc("score"), F.col("chunk_id")], k).select("qid", "rank", "chunk_id", "score")


def postings(chunks: DataFrame, stemmed: bool = False) -> DataFrame:
    """(term, chunk_id, in_prefix, in_text): the inverted index of (chunk_id, prefix, text), to be written in place of an older one."""
    cut = (lambda s: [stem(t) for t in tokens(s)]) if stemmed else tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, p, t in zip(b["chunk_id"].to_pylist(), b["prefix"].to_pylist(), b["text"].to_pylist()):
                x, y = Counter(cut(p)), Counter(cut(t))
                rows += [(w, c, x[w], y[w]) for w in sorted(x.keys() | y.keys())]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_pydict({n: pa.array(list(v), k) for n, v, k in zip(("term", "chunk_id", "in_prefix", "in_text"), cols, (pa.string(), pa.string(), pa.int32(), pa.int32()))})

    one = chunks.where("chunk_id is not null").select("chunk_id", "prefix", "text").dropDuplicates(["chunk_id"])
    return one.mapInArrow(run, "term string, chunk_id string, in_prefix int, in_text int")
