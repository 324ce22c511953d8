"""Answer modes of the reader: what each asks for, which combinations make sense, and its grammar as a validator.

Modes: ``cite`` (claims that end in citations), ``quote`` (claims that open with a quotation), ``line`` (one
claim that opens with a line of the cited extract) and ``line-id`` (with a line that names an identifier).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S

MODES = ("cite", "quote", "line", "line-id")
VERSIONS = ("v1", "v2", "v3")
# Claims of an answer and extracts at most; headers of the extracts by version of the prompt.
CLAIMS, EXTRACTS = 4, 9
HEADERS = {"v1": "Extracts", "v2": "Documentation extracts", "v3": "Documentation extracts"}

# What a claim's text is made of: anything but a citation or a line end.
_TEXT = r"(?:[^\[\]\n]|\[+[^1-9\[\n]|\])+"
_SHAPES = {"cite": rf"{_TEXT} \[[1-9]\]", "quote": r'"[^"\n]+" [^\[\]\n]+ \[[1-9]\]'}


def check_mode(mode: str, version: str = "v1") -> None:
    """An error for an unknown mode or version, and for a later version in another mode than ``cite``."""
    if mode not in MODES or version not in VERSIONS:
        raise ValueError(f"unknown mode {mode!r} or version {version!r}")
    if version != "v1" and mode != "cite":
        raise ValueError(f"version {version} does not apply to mode {mode}")


def claims_pattern(mode: str) -> str:
    """The grammar of a ``cite`` or ``quote`` answer that is no refusal, as a regular expression of a whole text."""
    one = _SHAPES[mode]
    return rf"^{one}(?: {one}){{0,{CLAIMS - 1}}}\z"


def is_valid(mode: str, answer: Column, extracts: Column) -> Column:
    """The grammar of a mode as a validator: the refusal, or claims of its shape that cite extracts there are. ``extracts`` is the array of their texts.

    In ``line`` modes the claim opens with a usable line of the extract it cites. A null answer is not valid.
    """
    check_mode(mode)
    n = F.least(F.size(extracts), F.lit(EXTRACTS))
    refused = answer == S.REFUSAL
    if mode in _SHAPES:
        sound = answer.rlike(claims_pattern(mode)) & F.forall(S.citations(answer), lambda x: x <= n)
    else:
        shape = r'^"([^\n]+)" [^\[\]\n]+ \[([1-9])\]\z'
        cited = F.regexp_extract(answer, shape, 2).try_cast("int")
        lines = S.extract_lines(F.get(extracts, cited - 1), identifier_only=mode == "line-id")
        # a line may hold quotation marks itself, so each line is tried
        sound = answer.rlike(shape) & (cited <= n) & F.exists(lines, lambda x: answer.startswith(F.concat(F.lit('"'), x, F.lit('" '))) & F.substring(answer, F.length(x) + 4, F.length(answer)).rlike(r"^[^\[\]\n]+ \[[1-9]\]\z"))
    return F.coalesce(refused | sound, F.lit(False))


def literal(text: Column) -> Column:
    """A grammar's string literal: control characters are blanks, backslashes and quotation marks escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f]", " "), r'(["\\])', r"\\$1"), F.lit('"'))


def line_grammar(extracts: Column, identifier_only: bool = False) -> Column:
    """The grammar of a ``line`` answer: a rule for each extract that has usable lines, which are its literals."""
    first = F.slice(extracts, 1, EXTRACTS)
    rules = F.transform(first, lambda x, i: F.struct((i + 1).cast("string").alias("n"), F.array_join(F.transform(S.extract_lines(x, identifier_only=identifier_only), literal), " | ").alias("lines")))
    rules = F.filter(rules, lambda r: r["lines"] != "")
    each = F.transform(rules, lambda r: F.concat(F.lit('claim'), r["n"], F.lit(' ::= "\\"" line'), r["n"], F.lit(' "\\" " text " ['), r["n"], F.lit(']"\nline'), r["n"], F.lit(" ::= "), r["lines"], F.lit("\n")))
    names = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("claim"), r["n"])), " | ")
    refusal = f'refusal ::= "{S.REFUSAL}"\n'
    return F.when(F.size(rules) == 0, F.lit("root ::= refusal\n" + refusal)).otherwise(F.concat(F.lit("root ::= refusal | claim\n" + refusal + "claim ::= "), names, F.lit("\ntext ::= [^\\[\\]\\n]+\n"), F.array_join(each, "")))


def messages(question: Column, extracts: Column, mode: str = "cite", version: str = "v1") -> Column:
    """The system and the user message of a mode and version."""
    check_mode(mode, version)
    how = {
        "cite": "End every claim with the number of its extract in brackets.", "quote": "Open every claim with an exact quotation of its extract and end it with the extract's number.",
        "line": "Open with one line of an extract, say what it means, and end with the extract's number.", "line-id": "Open with a line of an extract that names an option, key or command, and end with the extract's number.",
    }[mode]
    system = F.lit(f"Answer from the extracts only. {how} If they do not tell, say: {S.REFUSAL}")
    numbered = F.array_join(F.transform(extracts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")
    user = F.concat(F.lit(HEADERS[version] + ":\n\n"), numbered, F.lit("\n\nQuestion: "), question)
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(msg("system", system), msg("user", user))
