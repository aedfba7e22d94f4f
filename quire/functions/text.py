"""Formatting of recognised content as column expressions, on code points.

White space is Unicode's; ``trim`` alone would only know the space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LF = "\n"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def trim_left(c: Column) -> Column:
    return _sub(c, r"(?U)\A\s+", "")


def trim_right(c: Column) -> Column:
    return _sub(c, r"(?U)\s+\z", "")


def trim(c: Column) -> Column:
    return trim_right(trim_left(c))


def clean(c: Column) -> Column:
    """Strips escaped tabs and white space at both ends, caps runs of . · _ and escaped _ at three."""
    out = trim_left(_sub(c, r"\A(?:\\t)+", ""))
    out = trim_right(_sub(out, r"(?:\\t)+\z", ""))
    for run, three in ((r"\.{4,}", "..."), ("·{4,}", "···"), ("_{4,}", "___"), (r"(?:\\_){4,}", r"\\_\\_\\_")):
        out = _sub(out, run, three)
    return trim(out)


def is_html_block(c: Column) -> Column:
    return trim(c).rlike(r"\A<(?:div|p|span)")


def drop_hashes(c: Column) -> Column:
    return _sub(c, r"(?U)\A#*\s*", "")


def algorithm(c: Column) -> Column:
    """An html fence around what isn't a page but has tags is an xml fence."""
    low = F.lower(c)
    has = lambda *x: F.lit(False) if not x else F.contains(low, F.lit(x[0])) | has(*x[1:])
    xml = F.startswith(c, F.lit("```html")) & ~has("<html", "<body", "<div") & has("</", "/>", "<weblogic", "<local-")
    return F.when(xml, F.concat(F.lit("```xml"), F.substr(c, F.lit(8)))).otherwise(c)


def formula(s: Column) -> Column:
    """One pair of display or inline marks goes, and display marks on lines of their own come. ``s`` is trimmed."""
    marked = F.lit(False)
    for left, right in (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)")):
        marked = marked | (F.startswith(s, F.lit(left)) & F.endswith(s, F.lit(right)))
    body = F.when(marked & (F.length(s) >= 4), trim(F.substr(s, F.lit(3), F.length(s) - 4))).otherwise(s)
    return F.concat(F.lit("$$\n"), body, F.lit("\n$$"))


def bullet(c: Column) -> Column:
    """A leading bullet becomes '- '."""
    return F.when(c.rlike(r"\A(?:[·•]|\* )"), F.concat(F.lit("- "), trim_left(F.substr(c, F.lit(2))))).otherwise(c)


def list_prefix(c: Column) -> Column:
    """'(a)', '（1）', '1.' and 'a)' are followed by one space."""
    paren = _sub(c, r"(?U)\A[(（]([0-9]+|[A-Za-z])[)）]\s*", "($1) ")
    number = F.regexp_replace(c, F.lit(r"(?U)\A([0-9]+|[A-Za-z])([.)]|）)\s*"), F.when(c.rlike(r"\A(?:[0-9]+|[A-Za-z])）"), "$1) ").otherwise("$1$2 "))
    return F.when(c.rlike(r"\A[(（]"), paren).otherwise(number)


def double_newlines(c: Column) -> Column:
    return _sub(c, r"(?<!\n)\n(?!\n)", "\n\n")


def formula_number(c: Column) -> Column:
    """Without one pair of parentheses."""
    s = trim(F.coalesce(c, F.lit("")))
    pair = s.rlike(r"(?s)\A\(.*\)\z") | s.rlike(r"(?s)\A（.*）\z")
    return F.when(pair, F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def format_column(df: DataFrame, content: str = "content", label: str = "native_label", kind: str = "kind") -> DataFrame:
    """All rules in their order; null stays null. One column a step, so that no expression is repeated."""
    c, name, k = F.col("_c"), F.col(label), F.col(kind)
    steps = [
        clean(F.col(content)),
        F.when(name == "paragraph_title", F.when(c.rlike(r"\A[-*] "), trim_left(F.substr(c, F.lit(3)))).otherwise(c)).otherwise(c),
        F.when(name.isin("doc_title", "paragraph_title") & ~is_html_block(c), F.concat(F.when(name == "doc_title", "# ").otherwise("## "), drop_hashes(c))).otherwise(c),
        F.when(name == "algorithm", algorithm(c)).otherwise(c),
        F.when(k == "formula", trim(c)).when(k == "text", bullet(c)).otherwise(c),
        F.when(k == "formula", formula(c)).when(k == "text", list_prefix(c)).otherwise(c),
        F.when(k == "text", double_newlines(c)).otherwise(c),
    ]
    for step in steps:
        df = df.withColumn("_c", step)
    return df.withColumn(content, c).drop("_c")


def image_placeholder(page: Column, b: Column) -> Column:
    return F.format_string("![](page=%d,bbox=[%d,%d,%d,%d])", page, b["x1"], b["y1"], b["x2"], b["y2"])


def normalise(c: Column) -> Column:
    """For comparing texts: line ends as one kind, no white space before line ends or at the ends."""
    return trim(_sub(_sub(c, "\r\n?", "\n"), r"(?U)[^\S\n]+(?=\n)", ""))
