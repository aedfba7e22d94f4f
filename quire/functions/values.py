"""Values read from text or JSON, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text


def as_int(v: Column) -> Column:
    """Whole numbers from text: 3 and 3.0, not 3.5, true or anything else."""
    d = v.try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("long"))


def as_bool(v: Column) -> Column:
    s = F.lower(text.trim(v))
    return F.when(s.isin("1", "true", "yes", "on"), True).when(s.isin("0", "false", "no", "off"), False)


def safe_name(v: Column) -> Column:
    """Each character but letters, marks, digits, '-' and '_' becomes one '_'."""
    return F.regexp_replace(v, F.lit(r"[^\p{L}\p{M}\p{N}_-]"), F.lit("_"))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f mentions it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def number(v: Column) -> Column:
    """The double of a variant that holds a number or a boolean (1 and 0); null for anything else, text that looks like a number too."""
    kind = F.schema_of_variant(v)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(numeric, F.try_variant_get(v, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
