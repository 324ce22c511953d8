"""Scalar functions of questions, answers and extracts as column expressions, evaluated in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a question that are no search terms.
STOP = """a an the is are was were be been being do does did doing done
how what when where which who whom why can could should would will shall may might
must i me my you your it its this that these those there here of to in on at by for
with from into onto out up down over under again then than so such as and or but if
not no nor only own same too very s t just now want need way get got make made use
using used something anything thing please""".split()
# What a sentence that abstains says; citations; long and short options, key chords and commands.
ABSTAIN = r"(?i)\bi\s*(do\s*n[o']?t|don'?t)\s+know\b|\bnot\s+(in|contained\s+in|found\s+in|covered\s+by)\s+the\s+extracts?\b|\bthe\s+extracts?\s+do\s*(es)?\s*n[o']?t\s+contain\b|\bno\s+(relevant\s+)?information\b"
CITE = r"\[([1-9])\]"
LONG_FLAG = r"--[A-Za-z][A-Za-z0-9-]*"
FLAG = r"(?<![\w-])--?[A-Za-z][\w-]*"
SHORT_FLAG = r"(?<![\w-])-[A-Za-z0-9](?![\w-])"
CHORD = r"(?<![\w-])(?:[CMs]-)+[^\s,;:)'\"`]+"
COMMAND = r"(?<![\w-])M-x\s+[a-z][a-z0-9-]*"
REFUSAL = "I don't know."
HEX = "0123456789abcdef"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def found(c: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def query_terms(c: Column | str) -> Column:
    """Searchable terms of a question, in order, without repeats, stop words and single letters."""
    raw = found(F.replace(_c(c), F.lit("-"), F.lit(" ")), r"[A-Za-z0-9_.%/=]+")
    bare = F.transform(raw, lambda t: F.lower(F.regexp_replace(t, r"^[._/=%]+|[._/=%]+$", "")))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP)))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(found(F.lower(_c(c)), r"[a-z0-9]+"))


def abstained(c: Column | str) -> Column:
    """Every sentence abstains, and there is one; null is no abstention."""
    bare = F.regexp_replace(_c(c), r"\s*\[\d\]\s*", " ")
    sentences = F.filter(F.split(F.regexp_replace(bare, r"([.!?])\s+", "$1\x01"), "\x01"), lambda s: F.trim(s) != "")
    return F.coalesce((F.size(sentences) > 0) & F.forall(sentences, lambda s: s.rlike(ABSTAIN)), F.lit(False))


def citations(c: Column | str) -> Column:
    """Cited extract numbers from 1 to 9, in order, without repeats."""
    return F.array_distinct(F.transform(found(c, CITE, 1), lambda x: x.cast("int")))


def strip_citations(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), CITE, "")


def normal_answer(c: Column | str) -> Column:
    """Lower case, citations removed, blanks squeezed, dots at the end dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(strip_citations(c)), r"\s+", " ")), r"\.+$", "")


def identifiers(c: Column | str) -> Column:
    """Options, key chords and commands that a text names, sorted, without repeats."""
    c = _c(c)
    return F.array_sort(F.array_distinct(F.concat(found(c, r"(?<![\w-])" + LONG_FLAG), found(c, SHORT_FLAG), found(c, CHORD), found(c, COMMAND))))


def is_identifier_line(c: Column | str) -> Column:
    c = F.trim(_c(c))
    return c.rlike(r"(?<![\w-])" + LONG_FLAG) | c.rlike(SHORT_FLAG) | c.rlike(CHORD) | c.rlike(COMMAND)


def anchors(c: Column | str) -> Column:
    """Checkable literals of a claim: code spans and options, without repeats."""
    return F.array_distinct(F.concat(found(c, r"`([^`]+)`", 1), found(c, FLAG)))


def extract_lines(c: Column | str, most: int = 40, cut: int = 160, identifier_only: bool = False) -> Column:
    """Usable lines of an extract: trimmed, four characters or more, cut, first occurrences."""
    lines = F.transform(F.filter(F.transform(F.split(_c(c), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 4), lambda x: F.substring(x, 1, cut))
    if identifier_only:
        lines = F.filter(lines, is_identifier_line)
    return F.slice(F.array_distinct(lines), 1, most)


def holds_all(text: Column, tokens: Column) -> Column:
    """Every token is in the text; none is held always."""
    return F.coalesce(F.forall(tokens, lambda t: F.contains(text, t)), F.lit(False))


def hash_mod(column: str, m: int) -> Column:
    """The SHA-256 of a string column, as a number, modulo ``m``: folded over its hexadecimal digits."""
    return F.expr(f"aggregate(filter(split(sha2({column}, 256), ''), x -> x <> ''), 0L, (a, x) -> (a * 16 + instr('{HEX}', x) - 1) % {int(m)})")


def hash_fraction(c: Column | str) -> Column:
    """The first 60 bits of a string's SHA-256 as a share of 2^60."""
    return F.conv(F.substring(F.sha2(_c(c), 256), 1, 15), 16, 10).cast("double") / float(1 << 60)


def pointer(doc: Column | str, sec: Column | str) -> Column:
    """Where a reader finds a hit: a man page by section and name, or a manual's section."""
    doc, sec = _c(doc), _c(sec)
    man = r"^(.+)\.(\d[A-Za-z]*)$"
    part = F.when(F.contains(sec, F.lit("#")), F.regexp_extract(sec, r"#(.*)$", 1)).otherwise(doc)
    return F.when(doc.rlike(man), F.concat(F.lit("man "), F.regexp_extract(doc, man, 2), F.lit(" "), F.regexp_extract(doc, man, 1))).otherwise(
        F.concat(F.lit("Info manual "), F.substring_index(doc, ".", 1), F.lit(", section "), part)
    )


def page_prefix(name: Column, section: Column, summary: Column) -> Column:
    head = F.concat(name, F.lit("("), section, F.lit(")"))
    return F.concat(head, F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit(" - "), summary)).otherwise(""), F.lit("\n"))


@F.pandas_udf(T.StringType())
def ascii_form(text: pd.Series) -> pd.Series:
    """The ASCII characters of the Unicode form NFKD: letters without their accents."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slug(c: Column | str) -> Column:
    """ASCII letters (without their accents) and digits in lower case joined by dashes, 48 at most, else 'untitled'."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(ascii_form(_c(c))), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 48)
    return F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s)


def strip_markup(c: Column | str) -> Column:
    """Tags and named entities become blanks, blanks are squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"<[^<>]*>|&[A-Za-z]+;", " "), r"[ \t]+", " "))


def doc_digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each ended by a NUL; a null part is empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x00"))]), 256)


def variant_group(kind: Column, variant_kind: Column, paraphrase_of: Column) -> Column:
    """clean, paraphrase or the kind of variant."""
    return F.when(variant_kind.isNotNull(), variant_kind).when(paraphrase_of.isNotNull(), F.lit("paraphrase")).otherwise(F.lit("clean"))


def exact_sign_p(gained: Column, lost: Column) -> Column:
    """Two-sided exact sign test: 2 P[Bin(n, 1/2) >= max], at most 1, and 1 for n = 0.

    The binomial terms are added from logarithms of running products, so n may be large.
    """
    n, top = (gained + lost).cast("int"), F.greatest(gained, lost).cast("int")
    logs = F.transform(F.sequence(F.lit(0), n), lambda k: k)
    # log C(n, k) by a fold over k: keeps (k, log term, sum of exp) of k >= top
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.when(top == 0, F.exp(-n * F.log(F.lit(2.0)))).otherwise(F.lit(0.0)).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        t = acc["t"] + F.when(k > 0, F.log((n - k + 1).cast("double")) - F.log(k.cast("double"))).otherwise(0.0)
        return F.struct(t.alias("t"), (acc["s"] + F.when((k >= top) & (k > 0), F.exp(t)).otherwise(0.0)).alias("s"))

    tail = F.aggregate(logs, start, step)["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def heading_path(sec_id: Column | str) -> Column:
    """The headings that lead to a section, from its id."""
    return F.replace(F.regexp_replace(_c(sec_id), r"^[^#]*#", ""), F.lit("/"), F.lit(" / "))


def embed_input(prefix: Column, heading: Column, text: Column) -> Column:
    """What is embedded for a chunk: its prefix, its heading if known, its text."""
    line = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("Section: "), heading, F.lit("\n"))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), line, F.coalesce(text, F.lit("")))


def fold_questions(text: Column, questions: Column) -> Column:
    """A chunk's text with its questions below it."""
    return F.concat_ws("\n", text, F.array_join(questions, "\n"))


def parse_questions(c: Column | str, n: int) -> Column:
    """The first ``n`` generated questions: lines without bullets and numbers, blank ones left out."""
    bare = F.transform(F.split(_c(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.filter(bare, lambda x: x != ""), 1, n)


def swap_once(text: Column, old: str, new: str) -> Column:
    """``text`` with its one occurrence of ``old`` replaced; none or several are an error when computed."""
    times = F.size(F.split(text, f"\\Q{old}\\E", -1)) - 1
    return F.when(times == 1, F.replace(text, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.lit("not one occurrence")))
