"""Encoding of a whole corpus with a public byte-level BPE vocabulary, each distinct word once.

A word is a run of characters that are not white space, with one blank before it, or a run of white
space: no pre-token of the vocabulary's pattern crosses such a border, so the ids of a text are those of
its words one after the other. Documents are dealt to blocks of a size in characters, each about one
partition; the distinct words of each block travel to the word's partition, are encoded there once, and
travel back to the block, which puts the ids together by position.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (ranks of byte strings). A parameter of every operator; never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in a block, about.
BLOCK_CHARS = 2_000_000

# White space as the pattern has it (the Unicode property White_Space)
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
words_of = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a vocabulary file, loaded once a worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def blocks(df: DataFrame, key: str, text: str, chars: int = BLOCK_CHARS, extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """((block, key, text), number of blocks): rows dealt by hash of their key to blocks of about ``chars`` characters, in as many partitions as blocks, so that tasks stay of one size on any input."""
    total = df.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-total // chars))
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *extra).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    return out.repartition(n, "block"), n


def encoded_words(dealt: DataFrame, n: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(block, word, ids): the distinct words of each block with their ids as packed 32-bit integers."""

    def distinct(group: pa.Table) -> pa.Table:
        seen: set[str] = set()
        for t in group["text"].to_pylist():
            if t:
                seen.update(words_of(t))
        return pa.table({"block": pa.repeat(group["block"][0], len(seen)), "word": pa.array(list(seen), pa.string())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary).encode_ordinary
        known: dict[str, bytes] = {}
        for b in batches:
            out = []
            for w in b["word"].to_pylist():
                ids = known.get(w)
                if ids is None:
                    if len(known) > 2_000_000:
                        known.clear()
                    ids = known[w] = array("i", enc(w)).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_pydict({"block": b["block"], "word": b["word"], "ids": pa.array(out, pa.binary())})

    words = dealt.groupBy("block").applyInArrow(distinct, "block int, word string")
    return words.repartition(n, "word").mapInArrow(encode, "block int, word string, ids binary")


def with_words(df: DataFrame, key: str, text: str, assemble: Callable[[pa.Table, dict[str, bytes]], pa.Table], schema: str, vocabulary: str = VOCABULARY, chars: int = BLOCK_CHARS, extra: tuple[str, ...] = ()) -> DataFrame:
    """``assemble(rows of a block, ids of its words)`` for each block. The shuffled documents are read twice, not shuffled twice."""
    dealt, n = blocks(df, key, text, chars, extra)

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        return assemble(docs, dict(zip(words["word"].to_pylist(), words["ids"].to_pylist())))

    return dealt.groupBy("block").cogroup(encoded_words(dealt, n, vocabulary).groupBy("block")).applyInArrow(run, schema)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of each row, without special tokens; a null or empty text has the empty list.

    Strings that look like special tokens are ordinary text. Rows with equal keys each come out.
    """
    kind = dict(df.dtypes)[key]

    def ids_of(docs: pa.Table, known: dict[str, bytes]) -> pa.Table:
        flat, lens = [], []
        for t in docs["text"].to_pylist():
            got = b"".join([known[w] for w in words_of(t)]) if t else b""
            flat.append(got)
            lens.append(len(got) // 4)
        values = pa.array(np.frombuffer(b"".join(flat), np.int32))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
        return pa.table({key: docs["key"], "ids": pa.ListArray.from_arrays(offsets, values)})

    return with_words(df, key, text, ids_of, f"{key} {kind}, ids array<int>", vocabulary)


def decode_corpus(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) by the table of token bytes, whose size is that of the vocabulary; null ids give null."""
    kind = dict(df.dtypes)[key]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        table = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)] if enc.n_vocab == len(enc._mergeable_ranks) else {v: k for k, v in enc._mergeable_ranks.items()}
        for b in batches:
            texts = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in b[ids].to_pylist()]
            yield pa.RecordBatch.from_pydict({key: b[key], "text": pa.array(texts, pa.string())})

    return df.select(key, ids).mapInArrow(decode, f"{key} {kind}, text string")
