"""The scored evaluation of documents: blocks aligned with the expected ones, text differences, rule checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import matching as M
from quire.functions import text

#: Scores are whole numbers of this part of 1 while they are added up, so sums don't depend on their order.
UNIT = 1_000_000
# The loss of a block without partner, the gain of equal kinds, and each expected kind's weight in a document's score.
GAP, KIND_BONUS = 0.4, 0.2
WEIGHTS = {"code": 1.25, "heading": 1.15, "formula": 1.1, "list_item": 1.0, "paragraph": 1.0}
STATUS = ["paired", "extra_actual", "missing_expected"]
STEPS = "array<struct<step: int, status: string, actual_index: int, expected_index: int, actual_kind: string, expected_kind: string, score: double>>"
_STEP = {"step": pa.int32(), "status": pa.string(), "actual_index": pa.int32(), "expected_index": pa.int32(), "actual_kind": pa.string(), "expected_kind": pa.string(), "score": pa.float64()}
ARROW_STEPS = pa.list_(pa.struct(list(_STEP.items())))
#: Documents that are Python objects at once in a worker; the rest of a batch stays in Arrow.
AT_ONCE = 32
# What a failed check of each severity weighs.
SEVERITY = {"critical": 3.0, "major": 2.0}


def _aligned(similarity: str, gap: float, bonus: float):
    def of(actual: list, expected: list) -> list[dict]:
        a, e = list(actual if actual is not None else ()), list(expected if expected is not None else ())
        texts = lambda blocks: [x["text"] or "" for x in blocks]
        if similarity == "words":
            alike = M.word_overlap([x.split() for x in texts(a)], [x.split() for x in texts(e)], UNIT)
        else:
            alike = np.array([[int(M.ratio(y, x) * UNIT) for y in texts(e)] for x in texts(a)], np.int64).reshape(len(a), len(e))
        same = np.array([[x["kind"] == y["kind"] for y in e] for x in a], bool).reshape(len(a), len(e))
        steps = []
        for k, (kind, i, j) in enumerate(M.align(alike + same * round(bonus * UNIT), round(gap * UNIT))):
            own, other = kind != M.MISSING, kind != M.EXTRA
            steps.append({"step": k, "status": STATUS[kind], "actual_index": i if own else None, "expected_index": j if other else None, "actual_kind": a[i]["kind"] if own else None, "expected_kind": e[j]["kind"] if other else None, "score": alike[i, j] / UNIT if kind == M.PAIR else 0.0})
        return steps

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for actual, expected in pairs:
            for at in range(0, len(actual), AT_ONCE):
                sides = (x.slice(at, AT_ONCE).to_pylist() for x in (actual, expected))
                yield pa.array([of(x, y) for x, y in zip(*sides, strict=True)], ARROW_STEPS)

    return F.arrow_udf(run, STEPS)


def align_blocks(docs: DataFrame, actual: str = "actual", expected: str = "expected", similarity: str = "words", gap: float = GAP, bonus: float = KIND_BONUS) -> DataFrame:
    """Adds ``steps``, the alignment of two arrays of struct<kind, text>, and ``aligned_score``.

    Blocks keep their order. A pair gains the likeness of its texts, and ``bonus`` if the kinds are
    equal; a block alone loses ``gap``; the alignment gains the most. Likeness: ``words``, the overlap of
    distinct words between white space, or ``ratio``, of longest matching blocks of characters. A
    step's score is the pair's likeness, 0 for a block alone. The document's score is the steps' mean, weighted
    by the expected kind (by the actual one where none is expected), null without steps. Null arrays count as
    empty, null texts as ''. A document's blocks are one row; its matrix takes a byte a cell.
    """
    out = docs.withColumn("steps", _aligned(similarity, gap, bonus)(F.col(actual), F.col(expected)))
    return out.withColumn("aligned_score", weighted_score(F.col("steps")))


def weighted_score(steps: Column) -> Column:
    def weight(s: Column) -> Column:
        kind = F.coalesce(s["expected_kind"], s["actual_kind"])
        return F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in WEIGHTS.items()], F.lit(1.0))

    total = lambda f: F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + f(s))
    return F.when(F.size(steps) > 0, total(lambda s: weight(s) * s["score"]) / total(weight))


def compare_texts(docs: DataFrame, expected: str = "expected", actual: str = "actual", context: int = 3) -> DataFrame:
    """Adds status (match, diff, missing), similarity and hunks (array<struct<header, lines>>) of two texts, normalised first.

    Similarity is the ratio of longest matching blocks of characters; hunks are those of the lines. Both are
    null for missing texts; a match has no hunks.
    """

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for e, a in pairs:
            rows = []
            for x, y in zip(e, a, strict=True):
                missing, same = x is None or y is None, x == y
                lines = [] if missing or same else M.hunks(x.splitlines(keepends=True), y.splitlines(keepends=True), context)
                rows.append((None if missing else 1.0 if same else M.ratio(x, y), None if missing else [{"header": h, "lines": z} for h, z in lines]))
            yield pd.DataFrame(rows, columns=["similarity", "hunks"])

    compared = F.pandas_udf(run, "similarity double, hunks array<struct<header: string, lines: array<string>>>")
    e, a = text.normalise(F.col(expected)), text.normalise(F.col(actual))
    status = F.when(e.isNull() | a.isNull(), "missing").when(e == a, "match").otherwise("diff")
    return docs.withColumns({"status": status, "_c": compared(e, a)}).select("*", "_c.*").drop("_c")


def diff_text(hunks: Column, old: Column, new: Column) -> Column:
    """The hunks as a unified diff from ``old`` to ``new``, empty without hunks."""
    body = F.array_join(F.transform(hunks, lambda h: F.concat(h["header"], F.lit("\n"), F.array_join(h["lines"], ""))), "")
    return F.when(F.size(hunks) > 0, F.concat(F.lit("--- "), old, F.lit("\n+++ "), new, F.lit("\n"), body)).otherwise("")


def squeezed(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"[ \t\n\x0B\f\r]+", " "))


def check_rules(pages: DataFrame, rules: DataFrame, key: str = "doc_id", edge: int = 400) -> DataFrame:
    """(key, check_id, check_type, severity, status, message) of each rule.

    pages: (key, page, text), pages from 1; rules: (key, check_id, check_type, severity, page, phrase,
    next_phrase). ``contains`` looks for the phrase in the document, pages joined by a space; ``page_start``
    and ``page_end`` in the first or last ``edge`` characters of the page; ``continuation`` for the phrase at
    the page's end and for the next phrase at the next page's start. White space is squeezed on all sides. A rule
    is an ``error`` without its document, page or phrase, or of another type. Documents are
    gathered once and rules joined by the key: one exchange a side.
    """
    whole = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", squeezed(F.coalesce("text", F.lit(""))).alias("text")))).alias("_pages"))
    page, phrase, after = F.col("page"), squeezed(F.col("phrase")), squeezed(F.col("next_phrase"))
    on = lambda n: F.get(F.filter("_pages", lambda p: p["page"] == n), F.lit(0))["text"]
    start, end = lambda n: F.left(on(n), F.lit(edge)), lambda n: F.right(on(n), F.lit(edge))
    told = lambda good, yes, no: F.when(good, F.struct(F.lit("pass").alias("status"), yes.alias("message"))).when(~good, F.struct(F.lit("fail").alias("status"), no.alias("message")))
    words = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = page.cast("string")
    to = words("Continuation across pages ", number, " -> ", (page + 1).cast("string"))
    kinds = {
        "contains": told(F.contains(F.array_join(F.transform("_pages", lambda p: p["text"]), " "), phrase), words("Found required phrase for ", F.col("check_id"), "."), words("Missing required phrase: '", phrase, "'.")),
        "page_start": told(F.contains(start(page), phrase), words("Page ", number, " start matched expected content."), words("Page ", number, " start doesn't hold '", phrase, "'.")),
        "page_end": told(F.contains(end(page), phrase), words("Page ", number, " end matched expected content."), words("Page ", number, " end doesn't hold '", phrase, "'.")),
        "continuation": told(F.contains(end(page), phrase) & F.contains(start(page + 1), after), words(to, " matched."), words(to, " broken.")),
    }
    kind = F.col("check_type")
    found = F.coalesce(*[F.when(kind == k, v) for k, v in kinds.items()])
    missing = F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "Unknown check type.").when(F.col("_pages").isNull(), "No document.").otherwise("No such page or phrase.")
    found = F.coalesce(found, F.struct(F.lit("error").alias("status"), missing.alias("message")))
    return rules.join(whole, key, "left").select(key, "check_id", "check_type", "severity", found["status"].alias("status"), found["message"].alias("message"))


def rule_totals(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_rules, n_failed, n_error, pass_rate): rates are weighted by severity (others weigh 1)."""
    weight = F.coalesce(*[F.when(F.col("severity") == k, F.lit(w)) for k, w in SEVERITY.items()], F.lit(1.0))
    of = lambda s: F.count_if(F.col("status") == s)
    rate = F.sum(F.when(F.col("status") == "pass", weight).otherwise(0.0)) / F.sum(weight)
    return checked.groupBy(key).agg(F.count("*").alias("n_rules"), of("fail").alias("n_failed"), of("error").alias("n_error"), rate.alias("pass_rate"))
