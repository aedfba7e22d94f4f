"""Page selection: specifications, ranges and page lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.values import bound

RANGES = "array<struct<lo: bigint, hi: bigint>>"


class PagesError(ValueError):
    """A page specification that can't be read; ``kind`` says why."""

    def __init__(self, kind: str, part: str = ""):
        super().__init__(f"{kind}: {part}" if part else kind)
        self.kind = kind


def parse_pages(spec: str | None) -> list[tuple[int, int]] | None:
    """'1, [3-5], 9' -> sorted disjoint 1-based ranges, adjacent ones merged; None, '' and 'all' -> None (all)."""
    if spec is None or not spec.strip():
        return None
    parts = [x.strip() for x in spec.split(",")]
    if all(p.lower() == "all" for p in parts):
        return None
    found = []
    for p in parts:
        if not p:
            raise PagesError("empty part", spec)
        if p.lower() == "all":
            continue
        body = p
        if p.startswith("[") != p.endswith("]"):
            raise PagesError("unbalanced brackets", p)
        if p.startswith("["):
            body = p[1:-1].strip()
        m = re.fullmatch(r"([+-]?\d+)(?:\s*-\s*([+-]?\d+))?", body)
        if not m:
            raise PagesError("unreadable", p)
        lo, hi = int(m[1]), int(m[2] or m[1])
        if lo < 1 or hi < 1:
            raise PagesError("below 1", p)
        if lo > hi:
            raise PagesError("start after end", p)
        found.append((lo, hi))
    if any(p.lower() == "all" for p in parts):
        raise PagesError("all can't be mixed", spec)
    out: list[list[int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def resolve_pages(spec: str | None, count: int) -> list[int]:
    """The 1-based pages of a document of ``count`` pages."""
    ranges = parse_pages(spec)
    if ranges is None:
        return list(range(1, count + 1))
    for lo, hi in ranges:
        if hi > count:
            raise PagesError("out of range", f"{hi} of {count}")
    return [p for lo, hi in ranges for p in range(lo, hi + 1)]


def read_specs(spec: Column) -> Column:
    """struct(all, ranges, error) of a column of page specifications such as '1, [3-5], 9'.

    ranges: sorted disjoint 1-based struct<lo, hi>, adjacent ones merged; null for all pages (a null, blank
    or 'all' specification) and where ``error`` says why the first wrong part can't be read.
    """
    # The messages.
    empty, mixed = "empty token", "cannot mix 'all' with explicit page selections"
    quoted = lambda what, t: F.concat(F.lit(what + " token '"), t, F.lit("'"))
    whole = lambda x: F.when(F.regexp_like(x, F.lit(r"^\+?[0-9]+$")), x.try_cast("long"))

    def part(raw: Column) -> Column:
        def ranged(t: Column) -> Column:
            opens, closes = F.startswith(t, F.lit("[")), F.endswith(t, F.lit("]"))
            body = F.when(opens | closes, F.when(opens & closes & (F.length(t) >= 2), t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)
            ends = F.split(F.regexp_replace(body, r"(?U)\s", ""), "-")
            lo = whole(F.get(ends, F.lit(0)))
            hi = F.when(F.size(ends) == 1, lo).when(F.size(ends) == 2, whole(F.get(ends, F.lit(1))))
            return F.struct(t.alias("t"), (F.lower(t) == "all").alias("all"), body.isNull().alias("odd"), lo.alias("lo"), hi.alias("hi"))

        return bound(text.trim(raw), ranged)

    def wrong(p: Column) -> Column:
        least = lambda v: F.when(v < 1, F.concat(F.lit("page must be >= 1 (got "), v.cast("string"), F.lit(")")))
        order = F.when(p["lo"] > p["hi"], F.concat(F.lit("range start must be <= end (got "), p["lo"].cast("string"), F.lit("-"), p["hi"].cast("string"), F.lit(")")))
        unread = F.when(p["lo"].isNull() | p["hi"].isNull(), quoted("could not parse", p["t"]))
        found = F.coalesce(F.when(p["t"] == "", empty), F.when(p["odd"], quoted("invalid brackets in", p["t"])), unread, least(p["lo"]), least(p["hi"]), order)
        return F.when(~p["all"], found)

    def judged(parts: Column) -> Column:
        some = F.exists(parts, lambda p: p["all"])
        error = F.coalesce(F.get(F.array_compact(F.transform(parts, wrong)), F.lit(0)), F.when(some & F.exists(parts, lambda p: ~p["all"]), mixed))
        ranges = merged(F.array_sort(F.transform(parts, lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi")))))
        return F.struct((some & error.isNull()).alias("all"), F.when(error.isNull() & ~some, ranges).alias("ranges"), error.alias("error"))

    all_pages = F.struct(F.lit(True).alias("all"), F.lit(None).cast(RANGES).alias("ranges"), F.lit(None).cast("string").alias("error"))
    blank = F.coalesce(text.trim(spec) == "", F.lit(True))
    return F.when(blank, all_pages).otherwise(bound(F.transform(F.split(text.trim(spec), ",", -1), part), judged))


def merged(ranges: Column) -> Column:
    """Sorted array<struct<lo, hi>> with overlapping and adjacent ranges as one."""

    def add(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))
        joins = F.coalesce(r["lo"] <= last["hi"] + 1, F.lit(False))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(ranges, F.array().cast(RANGES), add)


def resolve_specs(spec: Column, count: Column) -> Column:
    """struct(pages, error): the ascending pages that a specification (as ``read_specs`` gives it) means in a document of ``count`` pages."""
    past = F.get(F.filter(spec["ranges"], lambda r: r["hi"] > count), F.lit(0))["hi"]
    error = F.coalesce(
        spec["error"],
        F.when(count < 1, F.concat(F.lit("invalid PDF page count "), count.cast("string"))),
        F.when(past.isNotNull(), F.concat(F.lit("page "), past.cast("string"), F.lit(" is out of range (pageCount="), count.cast("string"), F.lit(")"))),
    )
    every = F.array(F.struct(F.lit(1).cast("long").alias("lo"), count.cast("long").alias("hi")))
    return F.struct(F.when(error.isNull(), page_list(F.when(spec["all"], every).otherwise(spec["ranges"]))).alias("pages"), error.alias("error"))


def page_list(ranges: Column) -> Column:
    """array<struct<lo, hi>> -> ascending distinct pages."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"])))))


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): overlapping and adjacent ranges of a key as one; a range without a start stays by itself."""
    w = Window.partitionBy(key).orderBy(F.col("lo").asc_nulls_last(), F.col("hi").asc_nulls_last())
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("_new", F.when(F.coalesce(F.col("lo") > before + 1, F.lit(True)), 1).otherwise(0))
    island = fresh.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_i")
