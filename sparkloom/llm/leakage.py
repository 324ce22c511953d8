"""Evaluation texts in training text: an FM-index per training shard, searched backwards for test phrases.

Shards are made by content: each window of eight words is routed by the least hash of its runs of four
words, on the training and on the test side alike, so that a phrase is searched in the one shard that can
hold it and work grows with the input, not with shards times phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import WordHashes, mix, trimmed
from sparkloom.runtime import fixed_broadcast, materialize, parts

PHRASE = 8
SEED = 4
#: Bits of the table of test seeds, by which training windows that no test phrase can match stay where they are. Fixed size.
SEED_BITS_LOG2 = 24
_SLICES = 64
#: Words of training text and phrases of one shard; a shard with more is split into a grid.
SHARD_WORDS = 400_000
SHARD_PHRASES = 100_000
#: Every so many text positions the suffix array is kept.
SAMPLE = 8


class FMIndex:
    """Full-text index of an integer sequence: BWT in a wavelet matrix, sampled suffix array, vectorised search."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        """text: integers from 1 on; a sentinel 0 is added."""
        t = np.append(np.asarray(text, np.int64), 0)
        n = self.n = len(t)
        sa = self._suffixes(t)
        bwt = t[sa - 1]
        top = int(t.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=top))])
        self.levels = []
        seq = bwt
        for shift in range(max(1, int(top - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((shift, ones, n - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.bwt = bwt
        self.kept = sa % sample == 0
        self.kept_rank = np.concatenate([[0], np.cumsum(self.kept)])
        self.samples = sa[self.kept]

    @staticmethod
    def _suffixes(t: np.ndarray) -> np.ndarray:
        rank, k, n = np.unique(t, return_inverse=True)[1].astype(np.int64), 1, len(t)
        while True:
            nxt = np.full(n, -1, np.int64)
            nxt[: n - k] = rank[k:] if k < n else rank[:0]
            key = rank * (n + 1) + nxt + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = new
            if rank[order[-1]] == n - 1 or k >= n:
                return order
            k *= 2

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the first i places of the BWT."""
        low = np.zeros_like(i)
        for shift, ones, zeros in self.levels:
            one = ((c >> shift) & 1).astype(bool)
            a, b = ones[i], ones[low]
            i = np.where(one, zeros + a, i - a)
            low = np.where(one, zeros + b, low - b)
        return i - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of ``phrases``; symbols that the text lacks are -1."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero((phrases >= 0).all(1))
        hi[(phrases < 0).any(1)] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            lo[alive] = self.before[c] + self.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to a kept one."""
        out, at, steps = np.full(len(rows), -1, np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.kept[at[todo]]
            done = todo[hit]
            out[done] = self.samples[self.kept_rank[at[done]]] + steps
            todo = todo[~hit]
            c = self.bwt[at[todo]]
            at[todo] = self.before[c] + self.rank(c, at[todo])
            steps += 1
        return out


def _windows(flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (in ``flat``) of each window of eight words within a text, and the window's seed."""
    m = len(flat) - PHRASE + 1
    if m < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(len(flat) - SEED + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(h)])
    least = h[:m].copy()
    for k in range(1, PHRASE - SEED + 1):
        np.minimum(least, h[k : k + m], out=least)
    text = np.repeat(np.arange(len(lens)), lens)
    at = np.flatnonzero(text[:m] == text[PHRASE - 1 :])
    return at, least[at]


def _segments(flat: np.ndarray, lens: np.ndarray, bits: np.ndarray | None, shards: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(shard, text, first word, word hashes, windows) of the runs of successive windows of one text with one seed."""
    at, seed = _windows(flat, lens)
    if bits is not None and len(at):
        k = (seed >> np.uint64(64 - SEED_BITS_LOG2)).astype(np.int64)
        ok = (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
        at, seed = at[ok], seed[ok]
    if not len(at):
        return
    start = np.cumsum(lens) - lens
    text = np.searchsorted(start, at, "right") - 1
    # texts without words share a start; the last of them is the one that has the word
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])])
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
        i, j = int(at[a]), int(at[b - 1]) + PHRASE
        yield int(seed[a] % np.uint64(shards)), int(text[a]), i - int(start[text[a]]), flat[i:j].tobytes(), b - a


def _seed_table(questions: DataFrame, column: str) -> np.ndarray:
    """A bit for each seed of a test window, in 2 MB, put together in slices before it comes to the driver."""
    size = (1 << SEED_BITS_LOG2) // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), np.zeros(1 << SEED_BITS_LOG2, np.uint8)
        for b in batches:
            _, seed = _windows(*hashes.flat(b[column].to_pylist()))
            bits[(seed >> np.uint64(64 - SEED_BITS_LOG2)).astype(np.int64)] = 1
        blobs = np.packbits(bits, bitorder="little").reshape(_SLICES, -1)
        some = np.flatnonzero(blobs.any(1))
        yield pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "blob": pa.array([zlib.compress(blobs[i].tobytes(), 1) for i in some], pa.binary())})

    def unite(pdf):
        whole = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(b), np.uint8) for b in pdf["blob"]])
        return pdf.iloc[:1].assign(blob=[whole.tobytes()])

    out = np.zeros((_SLICES, size // _SLICES), np.uint8)
    for r in questions.select(column).mapInArrow(mark, "slice int, blob binary").groupBy("slice").applyInPandas(unite, "slice int, blob binary").collect():
        out[r["slice"]] = np.frombuffer(r["blob"], np.uint8)
    return out.reshape(-1)


def _search_shard(group: pa.Table) -> pa.Table:
    """Occurrences of the phrases of one shard's test segments in its training segments."""
    train = group.filter(pa.compute.is_valid(group["chunk_id"]))
    test = group.filter(pa.compute.is_valid(group["qid"]))
    empty = pa.table({"chunk_id": pa.array([], pa.string()), "sec_id": pa.array([], pa.string()), "qid": pa.array([], pa.string()), "word": pa.array([], pa.int32())})
    if not len(train) or not len(test):
        return empty
    pieces = [np.frombuffer(b, np.uint64) for b in train["words"].to_pylist()]
    lens = np.array([len(p) for p in pieces])
    flat = np.concatenate(pieces)
    alphabet, code = np.unique(flat, return_inverse=True)
    # symbol 1 ends a segment; words are 2 and up
    text = np.ones(len(flat) + len(lens), np.int64)
    begin = np.cumsum(lens + 1) - (lens + 1)
    text[np.repeat(begin, lens) + np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = code.reshape(-1) + 2
    index = FMIndex(text)
    wins, owner = [], []
    for k, b in enumerate(test["words"].to_pylist()):
        w = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, np.uint64), PHRASE)
        wins.append(w)
        owner.append(np.full(len(w), k))
    asked, owner = np.concatenate(wins), np.concatenate(owner)
    phrases, which = np.unique(asked, axis=0, return_inverse=True)
    place = np.minimum(np.searchsorted(alphabet, phrases), len(alphabet) - 1)
    symbols = np.where(alphabet[place] == phrases, place + 2, -1)
    lo, hi = index.search(symbols)
    found = hi - lo
    rows = np.repeat(lo, found) + np.arange(int(found.sum())) - np.repeat(np.cumsum(found) - found, found)
    spot = index.locate(rows)
    phrase = np.repeat(np.arange(len(phrases)), found)
    seg = np.searchsorted(begin, spot, "right") - 1
    # each occurrence goes to all questions with the phrase
    order = np.argsort(which.reshape(-1), kind="stable")
    askers, n_askers = owner[order], np.bincount(which.reshape(-1), minlength=len(phrases))
    first = np.cumsum(n_askers) - n_askers
    rep = n_askers[phrase]
    occ = np.repeat(np.arange(len(spot)), rep)
    who = askers[np.repeat(first[phrase], rep) + np.arange(int(rep.sum())) - np.repeat(np.cumsum(rep) - rep, rep)]
    word = train["start"].to_numpy()[seg] + spot - begin[seg]
    return pa.table({
        "chunk_id": train["chunk_id"].combine_chunks().take(pa.array(seg[occ])), "sec_id": train["sec_id"].combine_chunks().take(pa.array(seg[occ])),
        "qid": test["qid"].combine_chunks().take(pa.array(who)), "word": pa.array(word[occ].astype(np.int32)),
    })


def leaks(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(chunk_id, sec_id, qid, word): each place where a chunk repeats eight successive words of a question.

    Null ids and null texts take no part; shorter texts can't match. Repeated rows count once; empty
    tables give an empty result. Shards that hold too much are split: training segments by chunk, test
    segments by question, each going to every cell of the other, so that nothing is dropped.
    """
    spark = chunks.sparkSession
    shards = 8 * max(parts(spark), 4)
    bits = spark.sparkContext.broadcast(_seed_table(questions.where("qid is not null"), "question"))

    def train_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            flat, lens = hashes.flat(b["text"].to_pylist())
            got = list(_segments(flat, lens, bits.value, shards))
            if got:
                shard, text, start, words, n = zip(*got)
                take = pa.array(text)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "chunk_id": b["chunk_id"].take(take), "sec_id": b["sec_id"].take(take), "start": pa.array(start, pa.int32()), "words": pa.array(words, pa.binary()), "n": pa.array(n, pa.int32())})

    def test_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            flat, lens = hashes.flat(b["question"].to_pylist())
            got = list(_segments(flat, lens, None, shards))
            if got:
                shard, text, start, words, n = zip(*got)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "qid": b["qid"].take(pa.array(text)), "start": pa.array(start, pa.int32()), "words": pa.array(words, pa.binary()), "n": pa.array(n, pa.int32())})

    train = chunks.select("chunk_id", "sec_id", "text").where("chunk_id is not null and text is not null").mapInArrow(train_segments, "shard int, chunk_id string, sec_id string, start int, words binary, n int")
    train = materialize(train, "train")
    test = questions.select("qid", "question").where("qid is not null and question is not null").distinct().mapInArrow(test_segments, "shard int, qid string, start int, words binary, n int")
    test = materialize(test, "test")
    rows = train.groupBy("shard").agg(F.sum(F.col("n") + PHRASE).alias("w")).join(test.groupBy("shard").agg(F.sum("n").alias("p")), "shard")
    cells = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    grid = fixed_broadcast(rows.select("shard", cells("w", SHARD_WORDS).alias("nt"), cells("p", SHARD_PHRASES).alias("nq")), shards)
    left = train.join(grid, "shard").withColumn("i", F.pmod(F.xxhash64("chunk_id"), F.col("nt"))).withColumn("j", F.explode(F.expr("sequence(0, nq - 1)")))
    right = test.join(grid, "shard").withColumn("j", F.pmod(F.xxhash64("qid"), F.col("nq"))).withColumn("i", F.explode(F.expr("sequence(0, nt - 1)")))
    none = F.lit(None).cast("string")
    both = left.select("shard", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "chunk_id", "sec_id", none.alias("qid"), "start", "words").union(
        right.select("shard", F.col("i").cast("long"), F.col("j").cast("long"), none, none, "qid", "start", "words")
    )

    def search(group: pa.Table) -> pa.Table:
        return _search_shard(group.combine_chunks())

    return both.groupBy("shard", "i", "j").applyInArrow(search, "chunk_id string, sec_id string, qid string, word int").distinct()


def without_evidence(found: DataFrame, questions: DataFrame) -> DataFrame:
    """Leaks but those in a section that the question names as its evidence; a null section is none."""
    gold = questions.select(F.col("qid"), F.explode("gold_sec_ids").alias("s")).select("qid", trimmed("s").alias("sec_id")).where("sec_id is not null").distinct()
    return found.join(gold, ["qid", "sec_id"], "left_anti")


def removal_spans(found: DataFrame) -> DataFrame:
    """(chunk_id, first_word, last_word): the leaked words of each chunk, overlapping and adjoining runs merged."""
    runs = found.select("chunk_id", "word").distinct()
    w = W.partitionBy("chunk_id").orderBy("word")
    runs = runs.withColumn("new", (F.col("word") > F.lag("word").over(w) + PHRASE).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(w))
    return runs.groupBy("chunk_id", "run").agg(F.min("word").alias("first_word"), (F.max("word") + PHRASE - 1).alias("last_word")).drop("run")
