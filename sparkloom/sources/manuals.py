"""Info manuals and downloaded texts: nodes, menus, indices and boilerplate."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEADER = r"(?m)^File: [^\n]*?Node: ([^,\n\t]+)"


def nodes(manuals: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node_no, node, body): segments between U+001F that have a File and Node header, without it."""
    seg = manuals.select(key, F.posexplode(F.split(text, "\x1f")).alias("node_no", "_s")).where(F.col("_s").rlike(_HEADER))
    return seg.select(key, "node_no", F.trim(F.regexp_extract("_s", _HEADER, 1)).alias("node"), F.regexp_replace("_s", r"(?s)^\s*File: [^\n]*\n", "").alias("body"))


def strip_menu(text: str) -> str:
    """A node's body without its menus: from ``* Menu:`` on, entries and what stands between them are dropped; prose after the last entry stays."""
    lines = text.split("\n")
    out, k = [], 0
    while k < len(lines):
        if lines[k].strip() == "* Menu:":
            later = [j for j in range(k + 1, len(lines)) if lines[j].startswith("* ")]
            k = later[-1] + 1 if later else k + 1
            while k < len(lines) and lines[k].startswith(" ") and lines[k].strip():
                k += 1  # the entry's description goes on
            continue
        out.append(lines[k])
        k += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


@F.pandas_udf(T.StringType())
def _without_menus(body: pd.Series) -> pd.Series:
    return body.map(lambda t: None if t is None else strip_menu(t))


def neutral_headings(c: Column) -> Column:
    """Lines that look like Markdown headings are indented by one blank."""
    return F.regexp_replace(c, r"(?m)^(#{1,6}\s)", " $1")


def convert(manuals: DataFrame, key: str, text: str) -> DataFrame:
    """(key, markdown): a manual's nodes under headings in order, without index nodes and menus; equal names get a number.

    One row a manual; a manual is one text.
    """
    n = nodes(manuals, key, text).where(~F.col("node").endswith("Index"))
    again = F.row_number().over(W.partitionBy(key, "node").orderBy("node_no"))
    name = F.when(again > 1, F.concat("node", F.lit(" ("), again.cast("string"), F.lit(")"))).otherwise(F.col("node"))
    part = F.concat(F.lit("# "), name, F.lit("\n\n"), neutral_headings(_without_menus("body")))
    got = n.select(key, "node_no", part.alias("_p")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("node_no", "_p"))).alias("_ps"))
    return got.select(key, F.array_join(F.transform("_ps", lambda x: x["_p"]), "\n\n").alias("markdown"))


def index_entries(c: Column) -> Column:
    """Entries ``* term: node. (line N)`` of an index node, wrapped lines joined, without repeats: array of (entry, node, line)."""
    joined = F.regexp_replace(c, r"\n\s+(?=\(line|\S[^*\n]*\(line)", " ")
    pattern = r"(?m)^\* (.+?):\s+([^\n]+?)\.\s*\(line\s+(\d+)\)"
    get = lambda k: F.regexp_extract_all(joined, F.lit(pattern), F.lit(k))
    return F.array_distinct(F.transform(F.arrays_zip(get(1).alias("a"), get(2).alias("b"), get(3).alias("c")), lambda x: F.struct(x["a"].alias("entry"), x["b"].alias("node"), x["c"].cast("int").alias("line"))))


def strip_boilerplate(c: Column, least: int = 20_000) -> tuple[Column, Column]:
    """(title, body) of a downloaded book: the text between its start and end marks; null if shorter than ``least``."""
    title = F.trim(F.regexp_extract(c, r"(?m)^Title:\s*(.+)$", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)^.*?\*\*\* ?START OF [^\n]*\*\*\*", ""), r"(?s)\*\*\* ?END OF .*$", ""))
    return title, F.when(F.length(body) >= least, body)


def option_units(line: str) -> list[tuple[str, str | None]]:
    """(flag, argument) of an option line: comma units ``flag=arg``, ``flag arg`` or ``flag``."""
    out = []
    for unit in line.strip().split(","):
        m = re.match(r"(-{1,2}[\w?-]+)(?:\[?=([^\]\s]+)\]?|\s+(\S+))?\s*$", unit.strip())
        if m:
            out.append((m[1], m[2] or m[3]))
    return out


def option_entries(text: str, indent: int = 7) -> list[tuple[str, str]]:
    """(option line, description): a line that starts with a dash at most ``indent`` deep, and the deeper lines below it."""
    out: list[tuple[str, list[str]]] = []
    depth = -1
    for line in text.split("\n"):
        deep = len(line) - len(line.lstrip())
        if line.strip().startswith("-") and deep <= indent:
            out.append((line.strip(), []))
            depth = deep
        elif out and depth >= 0 and (not line.strip() or deep > depth):
            out[-1][1].append(line.strip())
        elif line.strip():
            depth = -1
    return [(a, " ".join(x for x in b if x)) for a, b in out]


@F.pandas_udf(T.ArrayType(T.StringType()))
def flags(text: pd.Series) -> pd.Series:
    """The options that a text documents, in order."""
    return text.map(lambda t: [x for line, _ in option_entries(t or "") for x, _ in option_units(line)])


def definition_groups(text: str) -> list[tuple[str, str]]:
    """(key, first command): quoted headers that follow each other, and the first ``(command)`` of the indented block below."""
    out, heads = [], []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        m = re.match(r"\s{0,4}['‘`]([^'’`]+)['’`]\s*$", line)
        if m:
            heads.append(m[1])
            continue
        if heads and line.strip():
            block = []
            for x in lines[i:]:
                if x.strip() and not x.startswith((" ", "\t")):
                    break
                block.append(x)
            c = re.search(r"[(‘'`]([a-z][a-z0-9]*(?:-[a-z0-9]+)+)[)’'`]", " ".join(block))
            out += [(h, c[1]) for h in heads if c]
            heads = []
    return out


def inline_pairs(c: Column) -> Column:
    """(key, command) pairs of running text: a quoted key, at most four words, and a command in parentheses."""
    pattern = r"['‘`]((?:[CMs]-)+[^'’`\s]+)['’`](?:\s+\S+){0,4}?\s*\((?:['‘`])?([a-z][a-z0-9]*(?:-[a-z0-9]+)+)"
    get = lambda k: F.regexp_extract_all(c, F.lit(pattern), F.lit(k))
    return F.arrays_zip(get(1).alias("key"), get(2).alias("command"))


def unique_names(df: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """``df`` with a number after every repeated name within ``by``."""
    k = F.row_number().over(W.partitionBy(by, name).orderBy(order))
    return df.withColumn("unique_name", F.when(k > 1, F.concat(F.col(name), F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col(name)))


def find_section(entries: DataFrame, sections: DataFrame, node: str = "node") -> DataFrame:
    """``entries`` with the sec_id whose heading has the node's name, case and blanks aside; of several the smallest id."""
    squeezed = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    s = sections.where("heading is not null").groupBy(squeezed("heading").alias("_name")).agg(F.min("sec_id").alias("sec_id"))
    return entries.withColumn("_name", squeezed(node)).join(s, "_name", "left").drop("_name")
