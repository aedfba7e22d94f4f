"""Benchmark decontamination by winnowing.

Both sides are fingerprinted alike: of the 5-word hashes in every run of 6 consecutive ones
the smallest is kept. Any 10 shared words hold 6 such hashes on both sides, hence the same
smallest one, so every shared window shares a fingerprint: candidates are found by joining
fingerprints, and nothing is missed. Each fingerprint hit is then extended to the 10-word
windows around it and those are compared in full (64-bit hashes of the ten words).

The benchmark's fingerprints are broadcast in blocks of at most ``block_bytes`` of its text.
One block, the usual case, is one map over the documents without a shuffle; each further block
is one more map over a scratch copy.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import ALNUM, grams, release, slices, words

WINDOW = 10
GRAM = 5
RUN = WINDOW - GRAM + 1


def _winnow(g: np.ndarray) -> np.ndarray:
    """True where a hash is the smallest of a run of RUN hashes that holds it (ties: all)."""
    m = len(g) - RUN + 1
    keep = np.zeros(len(g), bool)
    if m > 0:
        low = g[:m].copy()
        for d in range(1, RUN):
            np.minimum(low, g[d : d + m], out=low)
        for d in range(RUN):
            keep[d : d + m] |= g[d : d + m] == low
    return keep


class _Index:
    """A block of items: sorted fingerprints, and per window length sorted window hashes with their items."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        h, at = words(pa.array([x for _, x in rows], pa.large_string()), ALNUM)
        self.names = sorted({x for x, _ in rows if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        prints, windows = [], {}
        for (name, _), a, b in zip(rows, at[:-1].tolist(), at[1:].tolist(), strict=True):
            if n := min(WINDOW, b - a):
                if n == WINDOW:
                    g = grams(h[a:b], GRAM)
                    prints.append(g[_winnow(g)])
                w = np.unique(grams(h[a:b], n))
                windows.setdefault(n, []).append((w, np.full(len(w), number.get(name, -1))))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.prints >> np.uint64(48)).astype(np.int64)] = True
        self.windows = {}
        for n, parts in windows.items():
            w, item = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.lexsort((item, w))
            w, item = w[order], item[order]
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            self.windows[n] = (w[first], np.append(first, len(w)), item)

    def candidates(self, h: np.ndarray, row_end: np.ndarray) -> np.ndarray:
        """Starts of full windows that hold a fingerprint of the block. row_end: per word, where its row ends."""
        g = grams(h, GRAM)
        # Hashes that reach into the next row only add windows, and those are dropped below;
        # they can't displace a row's own smallest hash, as runs inside the row don't hold them.
        at = np.flatnonzero(self.coarse[(g >> np.uint64(48)).astype(np.int64)])
        if not len(at) or not len(self.prints):
            return at[:0]
        i = np.minimum(np.searchsorted(self.prints, g[at]), len(self.prints) - 1)
        at = at[self.prints[i] == g[at]]
        at = at[_winnow(g)[at]] if len(at) else at
        starts = np.unique((at[:, None] - np.arange(RUN)).ravel())
        starts = starts[starts >= 0]
        return starts[starts + WINDOW <= row_end[starts]]


_kept: dict[str, _Index] = {}


def _index_of(name: str, shared) -> _Index:
    """The index of a broadcast block, made once in each worker; a worker keeps the last one."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = _Index(shared.value)
    return _kept[name]


def _found(index: _Index, h: np.ndarray, rows: np.ndarray):
    """(row, first word, words, items) of all windows of the block that occur."""
    counts = np.diff(rows)
    row_of, row_end = np.repeat(np.arange(len(counts)), counts), np.repeat(rows[1:], counts)
    for n, (w, bounds, items) in index.windows.items():
        if n == WINDOW:
            starts = index.candidates(h, row_end)
        else:
            starts = np.arange(len(h))
            starts = starts[starts + n <= row_end]
        if not len(starts):
            continue
        g = grams(h, n) if len(starts) > len(h) // 4 else None
        g = g[starts] if g is not None else _at(h, starts, n)
        i = np.minimum(np.searchsorted(w, g), len(w) - 1)
        hit = w[i] == g
        for s, k in zip(starts[hit].tolist(), i[hit].tolist(), strict=True):
            yield int(row_of[s]), s, n, items[bounds[k] : bounds[k + 1]]


def _at(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n-word hashes at some positions only."""
    return grams(h[(starts[:, None] + np.arange(n)).ravel()], n)[::n]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Marks the words of each document that lie inside an occurrence of a benchmark window.

    Words are runs of letters, digits and non-ASCII characters of the lower-cased (A-Z) text.
    A window is 10 consecutive words of an item; an item of 1 to 9 words is one window, an item
    without words (null, empty) none. Returns ``id_col``, ``keep``, n_words, n_hit, n_items,
    items_sha256 (of the distinct item ids, sorted as strings, comma-joined), contaminated and
    ``spans`` (array of [first word, end word) of the hit stretches), one row per input row.
    Null texts have no words; rows with equal ids are judged each by its own text; an item
    without id marks words but isn't counted.
    """
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    id_type = docs.schema[id_col].dataType.simpleString()
    state = docs.select(id_col, text, *[c for c in keep if c not in (id_col, text)])
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in dict.fromkeys((id_col, *keep)))
    names = list(dict.fromkeys((id_col, *keep)))
    with_text = names + [text] * (text not in names)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = docs.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in part.collect()])
        last = b == blocks - 1
        state = state.mapInArrow(
            _marker(shared, text, names if last else with_text, b > 0, last),
            f"{kept}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>"
            if last
            else ", ".join([kept] + [f"`{text}` string"] * (text not in names)) + ", _spans array<int>, _items array<string>",
        )
        if not last:
            state = materialize(state, "marked")
    return state


def _marker(shared, text: str, names: list[str], has_state: bool, last: bool):
    block = uuid.uuid4().hex

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(block, shared)
        for batch in slices(batches, text, 1 << 20):
            h, rows = words(batch.column(text), ALNUM)
            m = batch.num_rows
            stretches: list[list[int]] = batch.column("_spans").to_pylist() if has_state else [[] for _ in range(m)]
            ids = [set(x) for x in batch.column("_items").to_pylist()] if has_state else [set() for _ in range(m)]
            begin = rows[:-1].tolist()
            for r, s, n, found in _found(index, h, rows):
                own = stretches[r]
                if own and own[-2] <= s - begin[r] <= own[-1]:
                    own[-1] = max(own[-1], s - begin[r] + n)
                else:
                    own += (s - begin[r], s - begin[r] + n)
                ids[r].update(index.names[k] for k in found.tolist() if k >= 0)
            out = [batch.column(c) for c in names]
            if not last:
                yield pa.RecordBatch.from_arrays([*out, pa.array(stretches, pa.list_(pa.int32())), pa.array([sorted(x) for x in ids], pa.list_(pa.string()))], [*names, "_spans", "_items"])
                continue
            merged = [_merge(x) for x in stretches]
            hits = [sum(b - a for a, b in x) for x in merged]
            yield pa.RecordBatch.from_arrays(
                [
                    *out,
                    pa.array(np.diff(rows), pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([x > 0 for x in hits], pa.bool_()),
                    pa.array(merged, pa.list_(pa.list_(pa.int32()))),
                ],
                [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )
        release()

    return mark


def _merge(flat: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


#: The same rows in DuckDB, from every window of every document.
SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
occ AS (
  SELECT d.doc_id, d.i, d.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.s = d.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""
