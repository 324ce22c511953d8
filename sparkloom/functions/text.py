"""Text primitives: trimming, words, and hashed words for vectorised operators."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, as a character class of Java's and Python's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

_ascii_words = re.compile(r"[a-z0-9]+").findall
_any_words = regex.compile(r"[\p{L}\p{N}]+").findall
_format_chars = regex.compile(r"\p{Cf}+")


def trimmed(c: Column | str) -> Column:
    """``c`` without white space of any kind at both ends; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def filled(c: Column | str) -> Column:
    """``c`` trimmed, or null if nothing is left."""
    t = trimmed(c)
    return F.when(t != "", t)


def fold(text: str) -> str:
    """NFKC, without format characters (Cf), lower case."""
    if text.isascii():
        return text.lower()
    return _format_chars.sub("", unicodedata.normalize("NFKC", text)).lower()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the folded text; null has none."""
    if not text:
        return []
    if text.isascii():
        return _ascii_words(text.lower())
    return _any_words(fold(text))


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when it has grown to ``limit`` entries."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of ``texts`` one after the other, and the number of words of each text."""
        if len(self) > self.limit:
            self.clear()
        lists = [words(t) for t in texts]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        get = self.__getitem__
        return np.fromiter((get(w) for ws in lists for w in ws), np.uint64, int(lens.sum())), lens


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def grams(flat: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` successive words within a text, the text's index and the run's first word."""
    text = np.repeat(np.arange(len(lens)), lens)
    if len(flat) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m = len(flat) - n + 1
    keep = text[:m] == text[n - 1 :]
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + m])
    starts = np.arange(m) - np.repeat(np.cumsum(lens) - lens, lens)[:m]
    return h[keep], text[:m][keep], starts[keep]
