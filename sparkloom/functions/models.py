"""Stand-ins for the model services: deterministic, without a network, and independent of the batch a row comes in.

Each has the signature of the service it stands for; pass another function of the same shape to use a real one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import scalars as S
from sparkloom.functions.text import words

DIMENSION = 64
# Layout of a query for the embedder, by task.
TASKS = {"search": "Given a question about command-line tools, retrieve manual passages that answer it", "question": "Given a question, retrieve questions with the same answer"}


def query_text(c: Column, task: str = "search") -> Column:
    return F.concat(F.lit(f"Instruct: {TASKS[task]}\nQuery: "), c)


def embed_text(text: str | None, dimension: int = DIMENSION) -> np.ndarray:
    """Hashed bag of words, signed, of length 1; zero for a text without words."""
    v = np.zeros(dimension, np.float32)
    for w in words(text):
        h = xxhash.xxh3_64_intdigest(w)
        v[h % dimension] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(text: pd.Series) -> pd.Series:
    return pd.Series([embed_text(t).tolist() for t in text])


@F.pandas_udf(T.DoubleType())
def rerank_score(question: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the question's words that the text holds, weighted by their length."""
    out = []
    for q, t in zip(question, text):
        have, asked = set(words(t)), words(q)
        whole = sum(map(len, asked))
        out.append(sum(len(w) for w in asked if w in have) / whole if whole else 0.0)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def read_answer(question: pd.Series, extract: pd.Series) -> pd.Series:
    """The line of the first extract with most of the question's words, cited; the refusal if none shares two."""
    out = []
    for q, e in zip(question, extract):
        asked = set(words(q))
        lines = [x.strip() for x in (e or "").split("\n") if len(x.strip()) >= 4]
        best = max(lines, key=lambda x: len(asked & set(words(x))), default="")
        out.append(f"{best} [1]" if len(asked & set(words(best))) >= 2 else S.REFUSAL)
    return pd.Series(out)


def judge(support: Column) -> Column:
    """1 for a support of one half or more, else 0; null without support."""
    return F.when(support.isNotNull(), (support >= 0.5).cast("double"))


def rewrites(question: Column) -> Column:
    """The question's search terms as its rewrite."""
    return F.array_join(S.query_terms(question), " ")


def guarded_correction(original: Column, corrected: Column) -> Column:
    """The correction unless it is empty or more than twice as long plus 20."""
    return F.when((F.coalesce(F.trim(corrected), F.lit("")) == "") | (F.length(corrected) > 2 * F.length(original) + 20), original).otherwise(corrected)


def batch_scores(scores: Column, group: list[str]) -> Column:
    """Scores in which one that could not be computed is the least of its group minus 1, or 0 without any."""
    return F.coalesce(scores, F.min(scores).over(W.partitionBy(*group)) - 1, F.lit(0.0))


def grammar_cited(n: int) -> str:
    """A grammar that admits the refusal or claims with citations of up to nine extracts."""
    refs = " | ".join(f'"{i}"' for i in range(1, min(n, 9) + 1))
    body = f'root ::= refusal | claim+\nrefusal ::= "{S.REFUSAL}"\n'
    return body + (f'claim ::= text " [" ref "]" " "?\ntext ::= [^\\[\\]]+\nref ::= {refs}\n' if n else "")


def is_cited_answer(c: Column) -> Column:
    """The grammar as a validator: the refusal, or text runs that each end in citations."""
    return (F.trim(c) == S.REFUSAL) | c.rlike(r"^(?:[^\[\]]+(?:\s*\[[1-9]\])+\s*[.!?]?\s*)+$")
