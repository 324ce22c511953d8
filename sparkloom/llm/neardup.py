"""Records that share most of their content: exact set-similarity pairs by anchors, and their groups.

Each record is a set of 64-bit feature hashes (word shingles, or the entries of an array). Two sets with
Jaccard similarity of t or more differ in at most (1 - t) / (1 + t) of the sum of their sizes, so both
hold one of each other's first |x| - ceil(t |x|) + 1 features in any common order. Those features are a
record's anchors; it is replicated, as a fingerprint, to each of them, and fingerprints are compared per
anchor. Features are ordered by how common they are over the whole collection, rare ones first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import WordHashes, grams, mix
from sparkloom.operators.graph import connected_components
from sparkloom.runtime import materialize, maybe_broadcast, parts

#: Bins of the table of feature frequencies: at least 2^18, one for some 64 features, at most 2^24 (16 MB of ranks).
LEAST_BINS_LOG2, MOST_BINS_LOG2, BIN_FEATURES = 18, 24, 64
_SLICES = 64
#: Bits of a parity fingerprint, as words of 64.
FP_WORDS = 2
#: An anchor held by more records is split into a grid of cells of at most so many: before records are sent where its bin's count shows it, else where they arrive, by their true number.
CELL = 8192
#: Bytes of fingerprints that one part is made for.
PART_BYTES = 4 << 20
#: Copies: records of exactly equal raw content, if more than so many, are given as pairs with the first of them, which stands for all in pairs with other contents.
COPIES = 64
#: Members of a block of a class: pairs of members are made by pairs of blocks.
BLOCK = 256

ENTRY = np.dtype([("bucket", "<u4"), ("side", "u1"), ("size", "<u4"), ("id", "<u8"), ("fp", "<u8", (FP_WORDS,))])


class Features:
    """Distinct features of a batch: (feature hash, record index) sorted by record, and the records that count."""

    def __init__(self, shingle: int | None = None, least: int = 1):
        self.shingle, self.least, self.hashes, self.bins_log2 = shingle, least, WordHashes(), LEAST_BINS_LOG2

    def bin(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bins_log2)).astype(np.int64)

    def raw(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        if self.shingle:
            texts = column.to_pylist()
            flat, lens = self.hashes.flat(texts)
            h, rec, _ = grams(flat, lens, self.shingle)
            keep = lens[rec] >= self.least
            return h[keep], rec[keep], len(texts)
        get = self.hashes.__getitem__
        sets = [{get(x) for x in (p.strip().lower() for p in v or () if p) if x} for v in column.to_pylist()]
        sets = [s if len(s) >= self.least else () for s in sets]
        lens = np.fromiter(map(len, sets), np.int64, len(sets))
        h = np.fromiter((x for s in sets for x in s), np.uint64, int(lens.sum()))
        return mix(h), np.repeat(np.arange(len(sets)), lens), len(sets)

    def sets(self, column: pa.Array, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct features in order of rank and hash within each record, their records, and set sizes."""
        h, rec, n = self.raw(column)
        if rank is None:
            order = np.lexsort((h, rec))
        else:
            # rank in the top byte of the sort key, then the feature; equal features stay adjacent
            key = (rank[self.bin(h)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
            order = np.lexsort((h, key, rec))
        h, rec = h[order], rec[order]
        if len(h):
            new = np.r_[True, (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])]
            h, rec = h[new], rec[new]
        return h, rec, np.bincount(rec, minlength=n).astype(np.int64)


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """The batches, several at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def bins_for(df: DataFrame, column: str) -> int:
    """Binary logarithm of the number of bins that suits a table's features, by its characters or array entries."""
    size = F.length(column) / 6 if dict(df.dtypes)[column] == "string" else F.size(column)
    n = df.agg(F.sum(size.cast("double"))).first()[0] or 0
    return min(MOST_BINS_LOG2, max(LEAST_BINS_LOG2, math.ceil(math.log2(max(1.0, n / BIN_FEATURES)))))


def commonness(df: DataFrame, column: str, make: Callable[[], Features]) -> np.ndarray:
    """The number of occurrences in each bin of features.

    Counts all features of all records. Tasks send their bins compressed in 64 slices, which are
    added up before they come to the driver: 2 MB, for 2^24 bins 128 MB.
    """
    bins = 1 << make().bins_log2
    width = bins // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = make(), np.zeros(bins, np.int64)
        for t in _joined(batches):
            h, _, _ = features.raw(t[column].combine_chunks() if t[column].num_chunks != 1 else t[column].chunk(0))
            total += np.bincount(features.bin(h), minlength=bins)
        if total.any():
            blobs = [zlib.compress(x.tobytes(), 1) for x in total.reshape(_SLICES, width)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def add(pdf):
        total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in pdf["blob"])
        return pdf.iloc[:1].assign(blob=[zlib.compress(total.tobytes(), 1)])

    rows = df.select(column).mapInArrow(count, "slice int, blob binary").groupBy("slice").applyInPandas(add, "slice int, blob binary").toLocalIterator()
    total = np.zeros((_SLICES, width), np.int64)
    for r in rows:
        total[r["slice"]] = np.frombuffer(zlib.decompress(r["blob"]), np.int64)
    return total.reshape(-1)


def _rank(total: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(4 * np.log2(total + 1))).astype(np.uint8)


def _fingerprints(h: np.ndarray, rec: np.ndarray, n: int) -> np.ndarray:
    """Parity of the number of features in each of 128 cells: it differs in at most as many bits as the sets in features."""
    bit = (mix(h + np.uint64(1)) >> np.uint64(57)).astype(np.int64)
    odd = np.bincount(rec * 128 + bit, minlength=n * 128).reshape(n, 128) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view("<u8").reshape(n, FP_WORDS)


def _set_ids(h: np.ndarray, rec: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each set of features; equal sets agree."""
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, rec, mix(h ^ np.uint64(0x5DEECE66D)))
    return mix(out)


def _placed(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries by bucket and id, and where buckets start (and the end)."""
    if not len(entries):
        return entries, np.zeros(1, np.int64)
    entries = entries[np.lexsort((entries["id"], entries["side"], entries["bucket"]))]
    same = np.r_[False, (entries["bucket"][1:] == entries["bucket"][:-1]) & (entries["id"][1:] == entries["id"][:-1])]
    entries = entries[~same]
    return entries, np.flatnonzero(np.r_[True, entries["bucket"][1:] != entries["bucket"][:-1], True])


def split_hot(entries: np.ndarray, n_parts: int, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries of buckets of at most 2 ``cell``; the others again, each in all cells of its bucket's grid; their new parts)."""
    entries, bounds = _placed(entries)
    lens = np.diff(bounds)
    size = np.repeat(lens, lens)
    hot = entries[size > 2 * cell]
    if not len(hot):
        return entries, hot, np.empty(0, np.int64)
    cells = -(-size[size > 2 * cell] // cell)
    mine = (mix(hot["id"].astype(np.uint64) + np.uint64(3)) % cells.astype(np.uint64)).astype(np.int64)
    take = np.repeat(np.arange(len(hot)), cells)
    other = np.arange(len(take)) - np.repeat(np.cumsum(cells) - cells, cells)
    mine, side = mine[take], hot["side"][take].astype(np.int64)
    # one group: all pairs of cells; two groups: every cell of one with every cell of the other
    lo = np.where(side == 2, np.minimum(mine, other), np.where(side == 0, mine, other))
    hi = np.where(side == 2, np.maximum(mine, other), np.where(side == 0, other, mine))
    out = hot[take].copy()
    out["side"] = np.where(side != 2, side, np.where(lo == hi, 2, np.where(mine == lo, 0, 1)))
    with np.errstate(over="ignore"):
        where = mix((out["bucket"].astype(np.uint64) << np.uint64(20)) + (lo * 65536 + hi).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11))
    out["bucket"] = (where & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return entries[size <= 2 * cell], out, ((where >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)


def _blobs(part: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """(part, blob, cls, key, txt): the entries of each part as one blob; the rest is null."""
    order = np.argsort(part, kind="stable")
    part, entries = part[order], entries[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    blobs = [x.tobytes() for x in np.split(entries, cut[1:])] if len(cut) else []
    return pa.RecordBatch.from_pydict({
        "part": pa.array(part[cut], pa.int32()), "blob": pa.array(blobs, pa.binary()),
        "cls": pa.nulls(len(cut), pa.int64()), "key": pa.nulls(len(cut), pa.string()), "txt": pa.nulls(len(cut), pa.int64()),
    })


def _pairs_of_part(entries: np.ndarray, t: Fraction) -> np.ndarray:
    """Distinct pairs (smaller id, larger id) within the buckets whose sizes and fingerprints allow a similarity of t."""
    if not len(entries):
        return np.empty((0, 2), np.uint64)
    entries, bounds = _placed(entries)
    lens = np.diff(bounds)
    # position of each entry within its bucket; each is compared with those d places on
    first = np.repeat(bounds[:-1], lens)
    end = first + np.repeat(lens, lens)
    size, fp, ids, side = entries["size"].astype(np.int64), entries["fp"], entries["id"], entries["side"]
    found, at = [], np.arange(len(entries))
    a, b, d = t.numerator, t.denominator, 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            break
        for k in range(0, len(at), 1 << 20):
            i = at[k : k + (1 << 20)]
            j = i + d
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = (b * small >= a * large) & ((side[i] == 2) | (side[i] != side[j]))
            i, j, both = i[ok], j[ok], (small + large)[ok]
            most = both - 2 * -(-a * both // (a + b))
            differ = np.bitwise_count(fp[i] ^ fp[j]).sum(1)
            i, j = i[differ <= most], j[differ <= most]
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
        d += 1
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)


def similar_sets(df: DataFrame, key: str, column: str, make: Callable[[], Features], t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): candidate pairs (a, b) of set classes, a superset of the pairs of similarity t
    or more between different sets, and members (cls, key, txt), one row for each record with enough
    features; txt is a hash of the raw content (of the key, where it has several contents in a class).

    A class is a set of features; all its records are replicated as one. Buckets of common anchors are
    split into cells, so that no task compares more than two groups of records at a time.
    """
    spark = df.sparkSession
    plain, log2 = make, bins_for(df, column)

    def make() -> Features:
        out = plain()
        out.bins_log2 = log2
        return out

    total = commonness(df, column, make)
    beyond = np.maximum(total - 2 * int(np.median(total)), 0)
    shared = spark.sparkContext.broadcast((_rank(total), np.minimum(-(-beyond // CELL), 60_000).astype(np.uint16)))
    # some (1 - t) of a record's features are anchors, and one more; parts follow from their bytes
    sent_bytes = ENTRY.itemsize * (float(total.sum()) * float(1 - t) + df.count())
    n_parts = max(parts(spark), math.ceil(sent_bytes / PART_BYTES))
    cell = CELL

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make()
        rank, grid = shared.value
        sent: set[int] = set()
        for tab in _joined(batches):
            col = tab[column].combine_chunks() if tab[column].num_chunks != 1 else tab[column].chunk(0)
            h, rec, size = features.sets(col, rank)
            n = len(size)
            ids, fps = _set_ids(h, rec, n), _fingerprints(h, rec, n)
            has = np.flatnonzero(size)
            keys, txt = tab[key].to_pylist(), tab["txt"].to_numpy()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(ids[has] % np.uint64(n_parts), pa.int32()), "blob": pa.nulls(len(has), pa.binary()),
                "cls": pa.array(ids[has].view(np.int64), pa.int64()), "key": pa.array([keys[i] for i in has], pa.string()), "txt": pa.array(txt[has], pa.int64()),
            })
            if len(sent) > 2_000_000:
                sent.clear()
            fresh = np.zeros(n, bool)
            for i in has.tolist():
                c = int(ids[i])
                if c not in sent:
                    sent.add(c)
                    fresh[i] = True
            first = np.cumsum(size) - size
            place = np.arange(len(h)) - first[rec]
            many = size + 1 + (-size * t.numerator) // t.denominator  # |x| - ceil(t |x|) + 1
            keep = fresh[rec] & (place < many[rec])
            ah, ar = h[keep], rec[keep]
            cells = grid[features.bin(ah)].astype(np.int64)
            mine = (ids[ar] >> np.uint64(20)).astype(np.int64) % np.maximum(cells, 1)
            rep = np.maximum(cells, 1)
            take = np.repeat(np.arange(len(ah)), rep)
            other = np.arange(len(take)) - np.repeat(np.cumsum(rep) - rep, rep)
            lo, hi = np.minimum(mine[take], other), np.maximum(mine[take], other)
            side = np.where(lo == hi, 2, np.where(mine[take] == lo, 0, 1))
            with np.errstate(over="ignore"):
                where = mix(ah[take] + (lo * 65536 + hi).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            entries = np.zeros(len(take), ENTRY)
            entries["bucket"], entries["side"] = (where & np.uint64(0xFFFFFFFF)).astype(np.uint32), side
            entries["id"], entries["fp"], entries["size"] = ids[ar][take], fps[ar][take], size[ar][take]
            part = ((where >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
            yield _blobs(part, entries)

    def within(group: pa.Table, last: bool) -> pa.Table:
        blobs = [b for b in group["blob"].to_pylist() if b is not None]
        calm, hot, where = np.frombuffer(b"".join(blobs), ENTRY), np.empty(0, ENTRY), np.empty(0, np.int64)
        if not last:
            calm, hot, where = split_hot(calm, n_parts, cell)
        pairs = _pairs_of_part(calm, t).view(np.int64)
        kept = group.filter(pa.compute.is_valid(group["cls"]))
        more = _blobs(where, hot)
        none = lambda n, t: pa.nulls(n, t)
        n, m, k = len(pairs), len(kept), more.num_rows
        return pa.table({
            "a": pa.concat_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(kept["cls"].to_numpy(), pa.int64()), none(k, pa.int64())]), "b": pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), none(m + k, pa.int64())]),
            "key": pa.concat_arrays([none(n, pa.string()), pa.array(kept["key"].to_pylist(), pa.string()), none(k, pa.string())]), "txt": pa.concat_arrays([none(n, pa.int64()), pa.array(kept["txt"].to_numpy(), pa.int64()), none(k, pa.int64())]),
            "part": pa.concat_arrays([none(n + m, pa.int32()), more["part"]]), "blob": pa.concat_arrays([none(n + m, pa.binary()), more["blob"]]),
        })

    def compare(group: pa.Table) -> pa.Table:
        return within(group, False)

    def compare_cells(group: pa.Table) -> pa.Table:
        return within(group, True).select(["a", "b"])

    raw = F.xxhash64(F.col(column) if dict(df.dtypes)[column] == "string" else F.to_json(column))
    sent = df.select(key, column).where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("string").alias(key), column, raw.alias("txt"))
    got = sent.mapInArrow(route, "part int, blob binary, cls long, key string, txt long").repartition(n_parts, "part").groupBy("part").applyInArrow(compare, "a long, b long, key string, txt long, part int, blob binary")
    got = materialize(got, "similar")
    hot = got.where("blob is not null").select("part", "blob", F.lit(None).cast("long").alias("cls"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("txt"))
    found = got.where("b is not null").select("a", "b").union(hot.groupBy("part").applyInArrow(compare_cells, "a long, b long"))
    one = F.when(F.min("txt") == F.max("txt"), F.min("txt")).otherwise(F.xxhash64("key"))
    return found.distinct(), got.where("b is null and a is not null").groupBy(F.col("a").alias("cls"), "key").agg(one.alias("txt"))


def similar_classes(df: DataFrame, key: str, column: str, make: Callable[[], Features], t: Fraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members, classes): the pairs (a, b) of classes of similarity t or more, checked on the
    records themselves, the members (cls, key, txt) and the classes (cls, first, n)."""
    pairs, members = similar_sets(df, key, column, make, t)
    pairs = materialize(pairs, "candidates")
    classes = members.groupBy("cls").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    reps = materialize(asked.join(classes, "cls").select("cls", F.col("first").alias("key")), "reps")
    text = df.select(F.col(key).cast("string").alias("key"), F.col(column).alias("x")).join(maybe_broadcast(reps, 96), "key")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a key with several contents those that form the class."""
        features = make()
        for tab in _joined(batches, 4000):
            h, rec, size = features.sets(tab["x"].combine_chunks() if tab["x"].num_chunks != 1 else tab["x"].chunk(0))
            ok = _set_ids(h, rec, len(size)).view(np.int64) == tab["cls"].to_numpy()
            yield from tab.filter(pa.array(ok)).to_batches()

    text = text.select("cls", "x").mapInArrow(own, f"cls long, x {dict(df.dtypes)[column]}")
    text = materialize(text.dropDuplicates(["cls"]), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make()
        for tab in _joined(batches, 4000):
            one = [features.sets(tab[c].combine_chunks() if tab[c].num_chunks != 1 else tab[c].chunk(0)) for c in ("xa", "xb")]
            (ha, ra, na), (hb, rb, nb) = one
            h, r = np.concatenate([ha, hb]), np.concatenate([ra, rb])
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=len(na)) if len(h) else np.zeros(len(na), np.int64)
            ok = (both * t.denominator >= t.numerator * (na + nb - both)) & (both > 0)
            yield pa.RecordBatch.from_pydict({"a": tab["a"].combine_chunks().filter(pa.array(ok)), "b": tab["b"].combine_chunks().filter(pa.array(ok))})

    both = pairs.join(text.select(F.col("cls").alias("a"), F.col("x").alias("xa")), "a").join(text.select(F.col("cls").alias("b"), F.col("x").alias("xb")), "b")
    links = both.select("a", "b", "xa", "xb").mapInArrow(check, "a long, b long")
    return links, members, classes


def _blocks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, key, block, blocks): members in blocks of some BLOCK."""
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    return members.join(classes.select("cls", n.alias("blocks")), "cls").select("cls", "key", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "blocks")


def similar_pairs(df: DataFrame, key: str, column: str, make: Callable[[], Features], t: Fraction) -> DataFrame:
    """(key_a, key_b), key_a < key_b by code points: all pairs of records of Jaccard similarity t or more.

    Records of one class (equal sets) are pairs as well. More than 64 records of exactly equal content
    are given as pairs with the first of them, which stands for all in pairs with records of other
    content; of different contents all pairs come out, however large their class. Null keys and null or
    short records have no pair. Repeats of a record under one key count once; an empty table gives an
    empty result.
    """
    links, members, classes = similar_classes(df, key, column, make, t)
    # texts of many copies occur in large classes only
    large = members.join(classes.where(F.col("n") > COPIES).select("cls"), "cls")
    copies = large.groupBy("cls", "txt").agg(F.min("key").alias("first"), F.count("*").alias("c")).where(F.col("c") > COPIES)
    many = materialize(large.join(copies, ["cls", "txt"]).where("key <> first").select("cls", "first", "key"), "copies")
    stand = members.select("cls", "key").join(many.select("cls", "key"), ["cls", "key"], "left_anti")
    size = stand.groupBy("cls").agg(F.count("*").alias("n"))
    stand = materialize(_blocks(stand, size), "standing")
    blocks = stand.groupBy("cls").agg(F.max("blocks").alias("blocks"))
    # across classes: each link goes to all pairs of blocks
    sizes = [blocks.select(F.col("cls").alias(x), F.col("blocks").alias("n" + x)) for x in "ab"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = links.join(sizes[0], "a").join(sizes[1], "b").select("a", "b", every("na").alias("ba"), "nb").select("a", "b", "ba", every("nb").alias("bb"))
    sa, sb = (stand.select(F.col("cls").alias(x), F.col("block").alias("b" + x), F.col("key").alias("k" + x)) for x in "ab")
    across = grid.join(sa, ["a", "ba"]).join(sb, ["b", "bb"]).select("ka", "kb")
    # within a class: each member goes to all pairs of blocks that hold its own
    cell = stand.join(size.where("n > 1").select("cls"), "cls").select("cls", "key", "block", every("blocks").alias("other"))
    cell = cell.select("cls", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    sa, sb = (cell.select("cls", "lo", "hi", F.col("block").alias("b" + x), F.col("key").alias("k" + x)) for x in "ab")
    within = sa.join(sb, ["cls", "lo", "hi"]).where("ka < kb and (lo = hi or ba <> bb)").select("ka", "kb")
    out = across.union(within).union(many.select("first", "key"))
    return out.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).where("key_a <> key_b").distinct()


def class_groups(links: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, group, links) as :func:`groups` gives for all pairs, copies too, from classes and their links: no pair of records is made."""
    links, members = materialize(links, "links"), materialize(members.select("cls", "key"), "members")
    firsts = classes.select("cls", "first")
    stars = members.join(firsts, "cls").where("key <> first").select("first", "key")
    ends = links.join(firsts.select(F.col("cls").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("cls").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    found = connected_components(stars.union(ends), "first", "key")
    # a unit is a class, for keys of one class, or a key of several: it sees each class once
    several = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    lone = members.join(several, "key", "left_anti")
    both = members.join(several, "key")
    near = links.select(F.col("a").alias("cls"), F.col("b").alias("to")).union(links.select(F.col("b").alias("cls"), F.col("a").alias("to"))).union(classes.select("cls", F.col("cls").alias("to")))
    near = materialize(near.distinct(), "near_classes")
    one = lone.groupBy("cls").agg(F.count("*").alias("n"))

    def partners(seen: DataFrame, unit: str) -> DataFrame:
        alone = seen.join(one.withColumnRenamed("cls", "to"), "to").select(unit, "n")
        shared = seen.join(both.select(F.col("cls").alias("to"), F.col("key").alias("other")), "to").select(unit, "other").distinct().select(unit, F.lit(1).cast("long").alias("n"))
        return alone.union(shared).groupBy(unit).agg((F.sum("n") - 1).alias("links"))

    of_key = partners(both.join(near, "cls").select("key", "to").distinct(), "key")
    n = lone.join(partners(near, "cls"), "cls").select("key", "links").union(of_key.select("key", "links"))
    return found.join(n.withColumnRenamed("key", "node"), "node").select(F.col("node").alias("key"), F.col("component").alias("group"), "links")


def chunk_args(chunks: DataFrame, shingle: int = 3, least_words: int = 20, t: Fraction = Fraction(7, 10)) -> tuple:
    return chunks, "chunk_id", "text", lambda: Features(shingle, least_words), t


def alias_args(man_docs: DataFrame, least: int = 4, t: Fraction = Fraction(6, 10)) -> tuple:
    return man_docs, "doc_id", "aliases", lambda: Features(None, least), t


def near_duplicate_chunks(chunks: DataFrame, **how) -> DataFrame:
    return similar_pairs(*chunk_args(chunks, **how))


def near_duplicate_aliases(man_docs: DataFrame, **how) -> DataFrame:
    return similar_pairs(*alias_args(man_docs, **how))


def groups(pairs: DataFrame) -> DataFrame:
    """(key, group, links): each record with a partner, the smallest key it is linked to over any number of links, and its own number of links."""
    found = connected_components(pairs, "key_a", "key_b")
    ends = pairs.select(F.col("key_a").alias("node")).union(pairs.select(F.col("key_b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    return found.join(ends, "node").select(F.col("node").alias("key"), F.col("component").alias("group"), "links")
