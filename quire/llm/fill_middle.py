"""Fill-in-the-middle transformation: a document's text reordered so that a model learns to infill.

A text is cut into units (a run of ASCII letters, or any other single character) at three
places drawn from a digest of the document's id. One scalar pandas UDF over Arrow batches does it
all: finditer of the ``regex`` library gives the units' ends, kept in a compact array, and two
lookups of it give the offsets at which the text is sliced. No shuffle, no state.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PARTS = "output string, n long, form string, prefix_chars long, middle_chars long"


def draws(doc_id: object, seed: int) -> list[int]:
    """Four numbers from the SHA-256 of seed and id; a null id gives those of the empty name."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None or doc_id is pd.NA else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str | None, doc_id: object, rate: int, spm_rate: int, seed: int) -> tuple:
    """(output, n, form, prefix_chars, middle_chars) of one document."""
    text = text or ""
    ends = array("q", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(m in text for m in MARKS):
        return text, n, "plain", None, None
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < spm_rate:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", n, "spm", a, b - a
    return f"{p}{prefix}{s}{suffix}{m}{middle}", n, "psm", a, b - a


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: int = 90, spm_rate: int = 20, seed: int = 1) -> DataFrame:
    """Adds output, n (units), form (plain, psm or spm), prefix_chars and middle_chars to each row of (id_col, text).

    ``rate`` is the percentage of texts to transform, ``spm_rate`` that of those which put the suffix
    first. Texts that are null (taken as empty), empty or hold a mark stay plain, with null
    prefix_chars and middle_chars. Rows are independent: rows with equal ids draw the same numbers, null
    ids those of the empty name. Other columns are ignored; an empty table gives an empty one.
    """

    @F.pandas_udf(PARTS)
    def parts(chunks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in PARTS.split(", ")]
        for texts, ids in chunks:
            rows = [transform(t, i, rate, spm_rate, seed) for t, i in zip(texts, ids, strict=True)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    names = list(dict.fromkeys((id_col, text)))
    done = docs.select(*names, parts(F.col(text), F.col(id_col).cast("string")).alias("_fim"))
    return done.select(*names, "_fim.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from, found by its marks alone.

    No text with a mark is transformed, and a mark can't arise where text and mark meet (each mark
    begins with the only ``<`` in it), so the first of each kind is the transformation's own.
    """
    p, s, m = MARKS
    at, end = F.when(form == "psm", F.instr(output, s)).otherwise(F.instr(output, p)), F.instr(output, m)
    first, last = output.substr(F.lit(4), at - 4), output.substr(at + 3, end - at - 3)
    middle = output.substr(end + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, last)).otherwise(F.concat(last, middle, first))


#: The same rows in DuckDB.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS x FROM documents),
h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS q FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""
