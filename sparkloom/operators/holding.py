"""Which documents hold all needles of a set in one extract: the needles of a document are sought at once, in one pass over its text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import materialize, maybe_broadcast

#: Bytes of text in a part. A document's cell has as many at most for each of its sets, within these bounds, so that sets sent to every
#: cell are few beside the text; and sets in a cell, at most.
PART_BYTES, SET_BYTES, CELL_BYTES, CELL_SETS = 4 << 20, 64, (2 << 20, 16 << 20), 200_000
#: Positions of text, or candidates, looked up at a time.
BLOCK = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The first w of four bytes, behind a state.
_MASKS = {w: np.uint64(0xFFFFFFFF00000000 | ((1 << 8 * w) - 1)) for w in (1, 2, 3, 4)}


class _Table:
    """Values of distinct keys; most keys sought are not there, which a bitmap tells."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(10, (16 * len(keys)).bit_length())
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[self._slots(keys)] = True

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` of those that are there, and their values."""
        where = np.flatnonzero(self.seen[self._slots(keys)])
        if not len(self.keys) or not len(where):
            return where[:0], self.values[:0]
        some = keys[where]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        same = self.keys[at] == some
        return where[same], self.values[at[same]]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four bytes of a string column from each of its bytes on, as numbers, and the places where its values begin and the last ends."""
    _, offsets, data = column.buffers()
    place = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.zeros(place[-1] + 4, np.uint8)
    if data:
        raw[: place[-1]] = np.frombuffer(data, np.uint8)[: place[-1]]
    return np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,)), place


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each span of n, one span after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Needles:
    """Distinct strings of one or more bytes, each with its owner, as a trie in steps of four bytes.

    A depth has the needles that end there by the number of bytes that are left, and the states that go on.
    Every step compares the bytes themselves, so what it finds is exact.
    """

    def __init__(self, owner: np.ndarray, quads: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.depths: list[tuple[dict[int, _Table], _Table]] = []
        which = np.flatnonzero(size > 0)
        state, at = owner[which].astype(np.uint64), 0
        while len(which):
            key = state << np.uint64(32) | quads[first[which] + at].astype(np.uint64)
            rest = size[which] - at
            ends = {w: _Table(key[rest == w] & _MASKS[w], which[rest == w]) for w in _MASKS if (rest == w).any()}
            keys, state = np.unique(key[rest > 4], return_inverse=True)
            self.depths.append((ends, _Table(keys, np.arange(len(keys), dtype=np.uint64))))
            which, state, at = which[rest > 4], state.reshape(-1).astype(np.uint64), at + 4

    def held(self, owner: np.ndarray, quads: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, needle): texts, each with its owner, and the owner's needles that stand in them."""
        end, got = place[1:], [np.zeros((0, 2), np.int64)]
        for lo in range(int(place[0]), int(place[-1]), BLOCK):
            hi = min(lo + BLOCK, int(place[-1]))
            near = np.arange(np.searchsorted(end, lo, "right"), np.searchsorted(end, hi) + 1)
            text = np.repeat(near, np.minimum(end[near], hi) - np.maximum(place[near], lo))
            pos, met = np.arange(lo, hi), []
            key = owner[text].astype(np.uint64) << np.uint64(32) | quads[lo:hi].astype(np.uint64)
            for depth, (ends, on) in enumerate(self.depths):
                for w, table in ends.items():
                    where, needle = table.find(key & _MASKS[w])
                    whole = pos[where] + 4 * depth + w <= end[text[where]]
                    met.append(np.stack([text[where[whole]], needle[whole]], 1))
                where, state = on.find(key)
                inside = pos[where] + 4 * depth + 4 < end[text[where]]
                where, state = where[inside], state[inside]
                if not len(where):
                    break
                pos, text = pos[where], text[where]
                key = state << np.uint64(32) | quads[pos + 4 * depth + 4].astype(np.uint64)
            got.append(np.unique(np.concatenate(met), axis=0) if met and sum(map(len, met)) else got[0])
        both = np.unique(np.concatenate(got), axis=0)
        return both[:, 0], both[:, 1]


def _fulfilled(way: np.ndarray, n_ways: np.ndarray, there: np.ndarray, texts: int) -> np.ndarray:
    """Sets, each of n_ways > 0 ways, that have one text with all of them. ``there``: sorted way * texts + text of the ways that hold.

    The texts of the rarest way are tried, first some, then more for the sets that are still open.
    """
    n = np.bincount(there // texts, minlength=int(way.max(initial=-1)) + 1)
    begin = np.cumsum(n) - n
    base = np.cumsum(n_ways) - n_ways
    rarest = way[np.lexsort((n[way], np.repeat(np.arange(len(n_ways)), n_ways)))[base]]
    ok = (n_ways == 1) & (n[rarest] > 0)
    rows, tried, step = np.flatnonzero((n_ways > 1) & (n[rarest] > 0)), 0, 16
    while len(rows):
        take = np.minimum(n[rarest[rows]] - tried, step)
        cut = np.searchsorted(np.cumsum(take * n_ways[rows]) // BLOCK, np.arange(1, int((take * n_ways[rows]).sum()) // BLOCK + 1))
        for some, k in zip(np.split(rows, cut), np.split(take, cut)):
            if not len(some):
                continue
            row = np.repeat(some, k)
            text = there[_spans(begin[rarest[some]] + tried, k)] % texts
            asked = way[_spans(base[row], n_ways[row])] * texts + np.repeat(text, n_ways[row])
            has = there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked
            ok[row[np.logical_and.reduceat(has, np.cumsum(n_ways[row]) - n_ways[row])]] = True
        tried += step
        step *= 4
        rows = rows[~ok[rows] & (n[rarest[rows]] > tried)]
    return ok


def hold_all(sets: pa.Table, texts: pa.Table) -> pa.Table:
    """(doc_id, ways, found) of the sets (doc_id, ways) that a text (doc_id, text) of the document fulfils.

    found is 2 if one text holds the first needle of every way, else 1 if it holds any of each. A set without ways needs any text.
    """
    doc, ways = sets["doc_id"].combine_chunks().dictionary_encode(), sets["ways"].combine_chunks()
    texts = texts.filter(pc.is_in(texts["doc_id"], doc.dictionary))
    out = lambda rows, found: pa.table({"doc_id": sets["doc_id"].combine_chunks().take(pa.array(rows)), "ways": ways.take(pa.array(rows)), "found": pa.array(found, pa.int32())})
    if not len(texts):
        return out(np.zeros(0, np.int64), np.zeros(0, np.int32))
    owner = doc.indices.to_numpy().astype(np.int64)
    text_owner = pc.index_in(texts["doc_id"], doc.dictionary).combine_chunks().to_numpy().astype(np.int64)
    n_ways, inner = np.diff(ways.offsets.to_numpy()).astype(np.int64), ways.flatten()
    size = np.diff(inner.offsets.to_numpy()).astype(np.int64)
    words = inner.flatten().dictionary_encode()
    word_owner = np.repeat(np.repeat(owner, n_ways), size)
    known = max(1, len(words.dictionary))
    distinct, needle = np.unique(word_owner * known + words.indices.to_numpy(), return_inverse=True)
    quads, place = _bytes(words.dictionary)
    of, code = distinct // known, distinct % known
    lens = np.diff(place)[code]
    text, met = Needles(of, quads, place[code], lens).held(text_owner, *_bytes(texts["text"].combine_chunks()))
    # an empty needle stands in every text
    empty = np.full(len(doc.dictionary), -1)
    empty[of[lens == 0]] = np.flatnonzero(lens == 0)
    any_text = np.flatnonzero(empty[text_owner] >= 0)
    text, met = np.concatenate([text, any_text]), np.concatenate([met, empty[text_owner[any_text]]])
    # equal ways of a document are looked at once
    raw, stop = needle.reshape(-1).astype(np.int64).tobytes(), (8 * np.cumsum(size)).tolist()
    ids: dict[bytes, int] = {}
    way = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip([0, *stop], stop)], np.int64)
    each = [np.frombuffer(x, np.int64) for x in ids]
    alias = np.concatenate([np.zeros(0, np.int64), *each])
    alias_way = np.repeat(np.arange(len(each)), [len(x) for x in each])
    first = np.diff(alias_way, prepend=-1) > 0
    order = np.argsort(met, kind="stable")
    n = np.bincount(met, minlength=len(distinct))
    begin = np.cumsum(n) - n
    some, found = n_ways > 0, np.zeros(len(owner), np.int32)
    found[~some] = np.where(np.isin(owner[~some], text_owner), 2, 0)
    for value, k in ((1, np.arange(len(alias))), (2, np.flatnonzero(first))):
        count = n[alias[k]]
        there = np.unique(np.repeat(alias_way[k], count) * len(texts) + text[order[_spans(begin[alias[k]], count)]])
        if len(there):
            found[np.flatnonzero(some)[_fulfilled(way, n_ways[some], there, len(texts))]] = value
    rows = np.flatnonzero(found)
    return out(rows, found[rows])


def fulfilled(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, ways, found) for the distinct sets (doc_id, ways array<array<string>>) that one of the document's texts (doc_id, sec_id, ord, text) fulfils, as :func:`hold_all`.

    Work is in proportion to the text and to the sets. Documents share parts of text; a large one, or one with many sets, is cut into a
    grid of cells of text and of sets. Ways are not empty and nothing in them is null.
    """
    size = texts.groupBy("doc_id").agg(F.sum(F.octet_length("text") + 64).alias("bytes"))
    size = materialize(size.join(sets.groupBy("doc_id").agg(F.count("*").alias("sets")), "doc_id", "left").na.fill(0, ["sets"]), "size")
    parts = -(-(size.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES) or 1
    cell = F.greatest(F.least(F.col("sets") * SET_BYTES, F.lit(CELL_BYTES[1])), F.lit(CELL_BYTES[0]))
    grid = size.select("doc_id", F.ceil(F.col("bytes") / cell).cast("int").alias("ni"), F.greatest(F.ceil(F.col("sets") / CELL_SETS), F.lit(1)).cast("int").alias("nj"))
    grid = maybe_broadcast(materialize(grid.where("ni > 1 or nj > 1"), "grid"))
    pick = lambda n, *by: F.pmod(F.xxhash64(*by), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    part = F.pmod(F.xxhash64("doc_id", "i", "j"), F.lit(parts)).alias("part")
    left = sets.join(grid, "doc_id", "left").withColumn("j", pick("nj", "ways")).withColumn("i", every("ni")).select(part, "doc_id", "ways")
    right = texts.join(grid, "doc_id", "left").withColumn("i", pick("ni", "sec_id", "ord", "text")).withColumn("j", every("nj")).select(part, "doc_id", "text")
    got = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(hold_all, "doc_id string, ways array<array<string>>, found int")
    return got.groupBy("doc_id", "ways").agg(F.max("found").alias("found"))
