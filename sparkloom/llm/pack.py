"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic, block by block.

Containers have limits on tokens, segments and loss-bearing tokens: of an instruction pair the tokens of
its answer, of a plain document all but the first, which nothing predicts. A container is filled by taking, of the items that still fit, the one
with the largest dot product of its demands with the remaining capacities, each weighted by how scarce
the dimension is in the block; items of one size are alike. Blocks are packed where their texts are
encoded, so texts are not moved again; each block leaves at most its last containers partly empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import trimmed
from sparkloom.llm.encode import VOCABULARY, encoder, with_words, words_of

CAPACITY = 2048
#: Segments of one container at most.
SEGMENTS = 256
#: Characters of one block; about so many / 7000 containers.
PACK_CHARS = 4_000_000

SCHEMA = "container string, place int, {key} {kind}, piece int, first_token int, n_tokens int, text string"


def fill(sizes: list[int], capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, bearing: list[int] | None = None) -> list[list[int]]:
    """Containers as lists of item numbers. An item of ``n`` tokens, of which ``bearing`` (all but one if not given) bear loss, demands (n, 1, bearing) of (capacity, segments, loss).

    Without a limit ``loss`` it is the capacity, which plain documents always keep.
    """
    limit = np.array([capacity, segments, capacity if loss is None else loss], float)
    bearing = bearing or [max(n - 1, 0) for n in sizes]
    by_size: dict[tuple[int, int], list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        by_size.setdefault((sizes[i], bearing[i]), []).append(i)
    kinds = sorted(by_size, reverse=True)
    left = np.array([len(by_size[k]) for k in kinds])
    demand = np.array([(n, 1, b) for n, b in kinds], float).reshape(len(kinds), 3) / limit
    if (demand > 1).any():
        raise ValueError("an item exceeds a container")
    weight = (demand * left[:, None]).sum(0)
    out: list[list[int]] = []
    open_kinds = np.flatnonzero(left)
    while len(open_kinds):
        rest, mine = np.ones(3), []
        live = open_kinds
        while True:
            live = live[(demand[live] <= rest + 1e-12).all(1) & (left[live] > 0)]
            if not len(live):
                break
            k = live[np.argmax(demand[live] @ (weight * rest))]
            mine.append(by_size[kinds[k]].pop())
            left[k] -= 1
            rest -= demand[k]
        out.append(mine)
        open_kinds = open_kinds[left[open_kinds] > 0]
    return out


def pieces(ids: np.ndarray, token_bytes, capacity: int) -> list[tuple[int, int, str]]:
    """(first token, tokens, text) of the pieces of a long text, cut between characters."""
    raw = [token_bytes(int(i)) for i in ids]
    ends = np.cumsum([len(r) for r in raw])
    whole, out, a = b"".join(raw), [], 0
    while a < len(raw):
        b = min(a + capacity, len(raw))
        while b < len(raw) and b > a + 1 and whole[ends[b - 1]] & 0xC0 == 0x80:
            b -= 1
        start = int(ends[a - 1]) if a else 0
        out.append((a, b - a, whole[start : int(ends[b - 1])].decode("utf-8", "replace")))
        a = b
    return out


def pack_corpus(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, vocabulary: str = VOCABULARY, chars: int = PACK_CHARS) -> DataFrame:
    """One row for each item of each container: container, place, key, piece, first_token, n_tokens, text.

    Only a text of more tokens than ``capacity`` is split, into pieces of ``capacity`` tokens (a few less
    where a cut would fall inside a character) and a rest. Null and empty texts are items without
    tokens; they take a segment. Every row of ``df`` comes out, rows with equal keys each.
    """
    kind = dict(df.dtypes)[key]

    def run(docs: pa.Table, known: dict[str, bytes]) -> pa.Table:
        n_of = {w: len(b) // 4 for w, b in known.items()}
        token_bytes = None
        items: list[tuple] = []
        for row, t in enumerate(docs["text"].to_pylist()):
            ws = words_of(t) if t else []
            n = sum([n_of[w] for w in ws])
            if n <= capacity:
                items.append((row, 0, 0, n, t))
                continue
            if token_bytes is None:
                token_bytes = encoder(vocabulary).decode_single_token_bytes
            ids = np.frombuffer(b"".join([known[w] for w in ws]), np.int32)
            items += [(row, k, a, m, s) for k, (a, m, s) in enumerate(pieces(ids, token_bytes, capacity))]
        found = fill([x[3] for x in items], capacity, segments, loss)
        order = [i for c in found for i in c]
        block = docs["block"][0].as_py() if docs.num_rows else 0
        rows = [items[i] for i in order]
        return pa.table({
            "container": pa.array([f"{block}-{c}" for c, x in enumerate(found) for _ in x], pa.string()), "place": pa.array([p for x in found for p in range(len(x))], pa.int32()),
            key: docs["key"].combine_chunks().take(pa.array([r[0] for r in rows], pa.int64())), "piece": pa.array([r[1] for r in rows], pa.int32()),
            "first_token": pa.array([r[2] for r in rows], pa.int32()), "n_tokens": pa.array([r[3] for r in rows], pa.int32()), "text": pa.array([r[4] for r in rows], pa.string()),
        })

    return with_words(df, key, text, run, SCHEMA.format(key=key, kind=kind), vocabulary, chars)


def pack_pairs(df: DataFrame, key: str, prompt: str, answer: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = CAPACITY // 2, vocabulary: str = VOCABULARY, chars: int = PACK_CHARS) -> DataFrame:
    """One row for each prompt and answer pair: container, place, key, n_tokens, n_loss, text.

    text is the trimmed prompt, a line end and the trimmed answer; the tokens of the answer bear loss, and
    a container holds at most ``loss`` of them beside its limits on tokens and segments. A null part is
    empty. A pair beyond a limit can't be packed whole: it has a null container and place. Every row of
    ``df`` comes out.
    """
    kind = dict(df.dtypes)[key]
    side = lambda c: F.coalesce(trimmed(c), F.lit(""))
    pairs = df.select(F.col(key), F.concat(side(prompt), F.lit("\n"), side(answer)).alias("text"), (F.length(side(prompt)) + 1).alias("border"))

    def run(docs: pa.Table, known: dict[str, bytes]) -> pa.Table:
        n_of = {w: len(b) // 4 for w, b in known.items()}
        sizes, bearing = [], []
        for t, border in zip(docs["text"].to_pylist(), docs["border"].to_pylist()):
            n = b = at = 0
            for w in words_of(t):
                n += n_of[w]
                b += n_of[w] if at >= border else 0
                at += len(w)
            sizes.append(n)
            bearing.append(b)
        fit = [i for i in range(len(sizes)) if sizes[i] <= capacity and bearing[i] <= loss]
        place: list[tuple[str | None, int | None]] = [(None, None)] * len(sizes)
        block = docs["block"][0].as_py() if docs.num_rows else 0
        for c, items in enumerate(fill([sizes[i] for i in fit], capacity, segments, loss, [bearing[i] for i in fit])):
            for p, i in enumerate(items):
                place[fit[i]] = (f"{block}-{c}", p)
        return pa.table({
            "container": pa.array([c for c, _ in place], pa.string()), "place": pa.array([p for _, p in place], pa.int32()), key: docs["key"],
            "n_tokens": pa.array(sizes, pa.int32()), "n_loss": pa.array(bearing, pa.int32()), "text": docs["text"],
        })

    return with_words(pairs, key, "text", run, f"container string, place int, {key} {kind}, n_tokens int, n_loss int, text string", vocabulary, chars, ("border",))


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the least number of containers that could hold them, and the share of space unused."""
    one = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    return one.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused")
    )
