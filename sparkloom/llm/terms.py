"""Frequency of every word or word sequence: truncated suffixes, sorted in reverse and added up with a stack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import words
from sparkloom.runtime import materialize, maybe_broadcast, parts

#: Words that a task holds before it sends the counts of their suffixes on.
HELD = 2_000_000
#: Words of a truncated suffix.
SIGMA = 2


def without_repeats(df: DataFrame, key: str, row: str) -> DataFrame:
    """``df`` with one row for each key, the one of the least ``row`` (unique, not null); rows with a null key stay."""
    low = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("_low"), F.count("*").alias("_n")).where("_n > 1")
    extra = df.select(key, row).join(low, key).where(F.col(row) > F.col("_low")).select(row)
    return df.join(maybe_broadcast(materialize(extra, "repeats"), 24), row, "left_anti")


class Held:
    """Words of some texts as numbers, until their truncated suffixes are counted."""

    def __init__(self, sigma: int):
        self.sigma, self.size, self.filled = sigma, 0, 0
        self.number: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []

    def add(self, texts: list[str | None]) -> None:
        lists = [words(t) for t in texts]
        self.filled += sum(bool(ws) or bool(t and t.strip()) for ws, t in zip(lists, texts))
        number = self.number
        self.flat.append(np.fromiter((number.setdefault(w, len(number)) for ws in lists for w in ws), np.int64))
        self.lens.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        self.size += len(self.flat[-1])

    def flush(self, field: str, names: list[str]) -> pa.RecordBatch:
        """(field, suffix, second, n, r1, ...): each distinct suffix, its number, and in how many texts it holds the first occurrence of each of its prefixes. The suffix '' counts the texts that are not blank."""
        empty = [np.empty(0, np.int64)]
        flat, lens = np.concatenate(self.flat or empty), np.concatenate(self.lens or empty)
        text = np.repeat(np.arange(len(lens)), lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(flat))  # words from here to the text's end
        # prefixes of each suffix as dense numbers, level by level; 0 stands for no further word
        levels, code = [], flat
        for k in range(self.sigma):
            there = left > k
            if k:
                word = np.where(there, np.concatenate([flat[k:], np.zeros(min(k, len(flat)), np.int64)]) + 1, 0)
                code = np.unique(code * (len(self.number) + 1) + word, return_inverse=True)[1].reshape(-1)
            levels.append((code, there))
        _, first, which, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        which = which.reshape(-1)
        counts = {"n": n}
        for x, (code, there) in zip(names, levels):
            at = np.flatnonzero(there)
            met = at[np.unique(text[at] * (int(code.max()) + 1 if len(code) else 1) + code[at], return_index=True)[1]]
            counts[x] = np.bincount(which[met], minlength=len(n))
        known = pa.array(list(self.number), pa.string())
        spelled = [known.take(pa.array(np.where(left[first] > k, flat[np.minimum(first + k, max(len(flat) - 1, 0))], 0), mask=left[first] <= k)) for k in range(self.sigma)] if len(first) else [pa.array([], pa.string())] * self.sigma
        suffix = pa.compute.binary_join_element_wise(*spelled, " ", null_handling="skip")
        second = pa.compute.fill_null(spelled[1], "") if self.sigma > 1 else pa.array([""] * len(first), pa.string())
        out = pa.table({"field": pa.array([field] * len(first), pa.string()), "suffix": suffix, "second": second} | {x: pa.array(v, pa.int64()) for x, v in counts.items()})
        whole = pa.table({"field": [field], "suffix": [""], "second": [""]} | {x: pa.array([self.filled], pa.int64()) for x in counts})
        out = pa.concat_tables([out, whole.cast(out.schema)] if self.filled else [out]).combine_chunks()
        self.__init__(self.sigma)
        return out.to_batches()[0] if len(out) else pa.RecordBatch.from_pydict({c: pa.array([], t) for c, t in zip(out.schema.names, out.schema.types)})


def suffix_counts(df: DataFrame, columns: list[str], sigma: int = SIGMA) -> DataFrame:
    """(field, ngram, n, records): how often each sequence of up to ``sigma`` words occurs in each column, and in how many rows.

    Every word starts a suffix, cut after sigma words. Tasks add up equal suffixes first; with each
    travel, for each of its prefixes, the number of rows in which the suffix holds the prefix's first
    occurrence, so that row sets are added as numbers. Suffixes are routed by their first term, and by a
    hash of the second over all partitions, so that a frequent first term is no single group; sorted in
    reverse, a prefix follows what extends it, and one stack of prefixes per partition yields all counts,
    which are added up over partitions. The n-gram '' counts the rows whose column is neither null nor blank. Null and
    blank texts have no words; an empty table gives an empty result.
    """
    names = [f"r{k}" for k in range(1, sigma + 1)]
    schema = "field string, suffix string, second string, n long, " + ", ".join(f"{x} long" for x in names)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: Held(sigma) for c in columns}
        for b in batches:
            for c in columns:
                held[c].add(b[c].to_pylist())
                if held[c].size > HELD:
                    yield held[c].flush(c, names)
        for c in columns:
            yield held[c].flush(c, names)

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, open_terms, sums, filled = None, [], [], [0, 0]
        out: list[tuple] = []

        def close(depth: int) -> None:
            while len(open_terms) > depth:
                n, r = sums.pop()
                out.append((field, " ".join(open_terms), n, r))
                open_terms.pop()

        def end() -> None:
            close(0)
            if filled[0]:
                out.append((field, "", *filled))
                filled[:] = [0, 0]

        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("field", "suffix", "n", *names))):
                terms = row[1].split(" ") if row[1] else []
                if row[0] != field:
                    end()
                    field = row[0]
                common = 0
                while common < min(len(terms), len(open_terms)) and terms[common] == open_terms[common]:
                    common += 1
                close(common)
                if not terms:
                    filled[0] += row[2]
                    filled[1] += row[3]
                for k, w in enumerate(terms):
                    if k >= common:
                        open_terms.append(w)
                        sums.append((0, 0))
                    sums[k] = (sums[k][0] + row[2], sums[k][1] + row[3 + k])
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
        end()
        if out:
            yield _rows(out)

    sent = df.select(*columns).mapInArrow(suffixes, schema)
    route = [F.col("field"), F.substring_index("suffix", " ", 1), F.pmod(F.xxhash64("second"), F.lit(parts(df.sparkSession)))]
    # equal suffixes of several tasks need not be added before: the stack adds them as they come
    ordered = sent.repartition(*route).sortWithinPartitions("field", F.desc("suffix"))
    got = ordered.mapInArrow(stack, "field string, ngram string, n long, records long")
    return got.groupBy("field", "ngram").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*out)
    return pa.RecordBatch.from_pydict({"field": pa.array(a, pa.string()), "ngram": pa.array(b, pa.string()), "n": pa.array(c, pa.int64()), "records": pa.array(d, pa.int64())})


def marked_terms(df: DataFrame, columns: list[str], sigma: int = SIGMA, rare: int = 2, common: tuple[int, int] = (1, 5)) -> DataFrame:
    """(field, term, n, records, mark): mark is ``rare`` for at most ``rare`` rows, else ``common`` for more
    than the given share of the rows that are not blank, else null."""
    got = materialize(suffix_counts(df, columns, sigma), "terms")
    whole = got.where("ngram = ''").select("field", F.col("records").alias("all_records"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common[1] > F.col("all_records") * common[0], "common")
    return got.where("ngram <> ''").join(F.broadcast(whole), "field").select("field", F.col("ngram").alias("term"), "n", "records", mark.alias("mark"))
