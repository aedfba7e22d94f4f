"""Removal of repeated word windows, with a count-min sketch as a prefilter.

First pass: every chunk of texts counts its windows' hashes in a sketch of its own (two rows of
slots; a slot counts 0, 1 or more), and the chunks' sketches are added up by blocks of slots. A
window's estimate, the smaller of its two counts, is never below its true count. Second pass:
windows estimated once are unique and go no further; all others are grouped exactly, by 96-bit
hashes of their words, and every occurrence but the first is removed. So nothing is lost by the
sketch; a full one only lets more windows through to the exact grouping.

The sketch grows with the texts (about 4 bits a window) up to ``most_bits``, the bound of what
is broadcast. A chunk sends each distinct window once, whatever stands behind it in the chunk,
so the group of a window that a third of all rows hold has one row a chunk at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sweep
from .words import buffers, lut, mix, release, slices, words

#: Words [^\x20\x09-\x0D]+ as they stand, capitals apart.
CASED = lut([(0x20, 0x20), (0x09, 0x0D)], lower=False)
#: Slots of a block; positions inside one are 16-bit numbers.
SLOTS = 1 << 16
#: Ranges of blocks that a chunk's sketch is dealt out by; their number doesn't grow, so a chunk sends as many rows at any size.
RANGES = 512
#: Bytes of text whose windows are counted, and later compared, together.
CHUNK = 8 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xA0761D6478BD642F)


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of the k values that start at each position, put together from runs of powers of two."""
    out, done = None, 0
    part, width = h, 1
    while width <= k and len(h) >= k:
        if k & width:
            out = part if out is None else out[: len(part) - done] + np.uint64(pow(base, done, 1 << 64)) * part[done:]
            done += width
        if 2 * width <= k:
            part = part[: len(part) - width] + np.uint64(pow(base, width, 1 << 64)) * part[width:]
        width *= 2
    return np.zeros(0, np.uint64) if out is None else mix(out[: len(h) - k + 1] + np.uint64(k))


def window_starts(rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of words at which k words of the same row begin."""
    n = int(rows[-1])
    ends = np.repeat(rows[1:], np.diff(rows))
    return np.flatnonzero(np.arange(n) + k <= ends)


def slots(g: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each window in the first and in the second row of the sketch, as one range of numbers."""
    second = mix(g ^ _SECOND)
    at = [(((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)) << np.uint64(16) | (x & np.uint64(0xFFFF)) for x in (g, second)]
    return at[0].astype(np.uint32), (at[1] + np.uint64(blocks * SLOTS)).astype(np.uint32)


def edges(blocks: int) -> np.ndarray:
    """Where each range of blocks begins, and the end; both rows of the sketch have ``blocks`` blocks."""
    ranges = min(RANGES, 2 * blocks)
    return np.arange(ranges + 1) * 2 * blocks // ranges


def count_slots(taken: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A chunk's sketch: for each range how many of its slots fall in each block, and these slots in order, twice where counted more than once."""
    taken = np.sort(taken)
    taken = taken[np.append(np.ones(min(2, len(taken)), bool), taken[2:] != taken[:-2])]
    per = np.bincount((taken >> np.uint32(16)).astype(np.int64), minlength=2 * blocks).astype("<u4")
    low, at = (taken & np.uint32(0xFFFF)).astype("<u2"), edges(blocks)
    ends = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])[at]
    counted = [per[a:b].tobytes() + low[i:j].tobytes() for a, b, i, j in zip(at[:-1].tolist(), at[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(counted), dtype=np.int32)), pa.array(counted, pa.binary())], ["range", "counted"])


def read_slots(counted: bytes | memoryview, n: int) -> np.ndarray:
    """The slots of a range of n blocks, from its first one, as ``count_slots`` wrote them."""
    per, low = np.frombuffer(counted, "<u4", n), np.frombuffer(counted, "<u2", offset=4 * n)
    return np.repeat(np.arange(n, dtype=np.int64) * SLOTS, per) + low


def merge(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Adds up chunks' sketches, each slot saturating at 2, and gives the slots counted more than once as bits."""
    sums: dict[int, np.ndarray] = {}
    size = np.diff(edges(blocks)).tolist()
    for batch in batches:
        for r, counted in zip(batch.column("range").to_pylist(), batch.column("counted"), strict=True):
            own = sums.setdefault(r, np.zeros(0, np.uint8))
            if not len(own):
                own = sums[r] = np.zeros(size[r] * SLOTS, np.uint8)
            at = read_slots(counted.as_buffer(), size[r])
            again = np.zeros(len(at), bool)
            again[1:] = at[1:] == at[:-1]
            for x in (at[~again], at[again]):
                own[x] = np.minimum(own[x] + 1, 2)
    for r, own in sums.items():
        yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "repeated": pa.array([np.packbits(own > 1, bitorder="little").tobytes()], pa.binary())})
    release()


def sketch(docs: DataFrame, text: str, window: int, most_bits: int) -> np.ndarray:
    """Bits of both rows of the merged sketch: which slots were counted more than once."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # 2 slots a row for each window, at 6 bytes a word.
    blocks = int(min(max(1, size // 3 // SLOTS + 1), most_bits // 2 // SLOTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, CHUNK):
            h, rows = words(batch.column(text), CASED)
            g = rolling(h, window, _BASES[0])
            if len(g):
                yield count_slots(np.concatenate(slots(g[window_starts(rows, window)], blocks)), blocks)
        release()

    merged = docs.select(text).mapInArrow(count, "range int, counted binary").repartition("range").mapInArrow(lambda x: merge(x, blocks), "range int, repeated binary")
    bits, at = np.zeros(2 * blocks * SLOTS // 8, np.uint8), edges(blocks) * (SLOTS // 8)
    for r in merged.collect():  # bounded by most_bits
        bits[at[r.range] : at[r.range + 1]] = np.frombuffer(r.repeated, np.uint8)
    return bits


def _ranks(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """The order of rows by (id, nulls last; text hash), equal for equal rows."""
    t = pa.table({"i": ids, "h": hashes})
    order = pc.sort_indices(t, sort_keys=[("i", "ascending"), ("h", "ascending")], null_placement="at_end").to_numpy()
    code = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[order]
    h = hashes.to_numpy(zero_copy_only=False)[order]
    new = np.append(False, (code[1:] != code[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new)
    return out


def joined(starts: np.ndarray, window: int) -> list[int]:
    """Flat [first word, end word, ...] of the stretches that windows at these ascending starts cover."""
    cut = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + window))
    return np.stack([starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + window], 1).ravel().tolist()


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text: str = "text", most_bits: int = 1 << 31) -> DataFrame:
    """Removes each word that a repeated window covers: one whose words also start earlier.

    Words stand between white space (space, tab to carriage return). Earlier is a smaller id (null
    ids last; rows with equal ids by a 64-bit hash of their text), or an earlier start in the same
    document. Rows that are equal in id and text count as one document and get the same result.
    Windows are judged on the input.

    Returns ``id_col``, n_words, n_removed, ``cuts`` (flat [first word, end word, ...] of the
    removed stretches, ascending, null if none) and ``kept`` (the kept words, joined by one space)
    for every row. Null and blank texts have no words and an empty ``kept``; texts shorter than
    a window lose nothing; an empty table gives an empty one. Other columns are ignored.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    # A text of fewer bytes can't hold a window: these rows need no passes and no join.
    enough = F.coalesce(F.octet_length("text"), F.lit(0)) >= 2 * window - 1
    long = docs.where(enough)
    shared = spark.sparkContext.broadcast(sketch(long, "text", window, most_bits))
    sweep(spark)  # the sketches' shuffle files

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        blocks = len(bits) * 4 // SLOTS
        for batch in slices(batches, "text", CHUNK):
            h, rows = words(batch.column("text"), CASED)
            g, at = rolling(h, window, _BASES[0]), window_starts(rows, window)
            for d in (0, 1):
                s = slots(g[at], blocks)[d]
                at = at[bits[s >> 3] >> (s & 7).astype(np.uint8) & 1 == 1]
            if not len(at):
                continue
            row = np.searchsorted(rows, at, side="right") - 1
            start, rank = at - rows[row], _ranks(batch.column("id"), batch.column("h"))[row]
            a, b = g[at], rolling(h, window, _BASES[1])[at]
            order = np.lexsort((start, rank, b, a))
            a, b, start, rank, row = a[order], b[order], start[order], rank[order], row[order]
            head = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            lost = (start != start[lead]) | (rank != rank[lead])
            first = np.flatnonzero(head)
            first = first[np.lexsort((start[first], row[first]))]  # in the texts' order, which compresses well
            yield _records(batch, row[first], a[first].view(np.int64), (b[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), start[first], None)
            gone = np.flatnonzero(lost)
            gone = gone[np.lexsort((start[gone], row[gone]))]
            if len(gone):
                edge = np.flatnonzero(np.append(True, row[gone][1:] != row[gone][:-1]))
                cuts = [joined(x, window) for x in np.split(start[gone], edge[1:])]
                # What is settled here goes the same way, dealt out by position (b is null for it alone).
                yield _records(batch, row[gone][edge], mix(row[gone][edge].astype(np.uint64)).view(np.int64), None, None, cuts)
        release()

    found = long.mapInArrow(suspects, f"id {id_type}, h long, start int, a long, b int, cuts array<int>")
    order = Window.partitionBy("a", "b").orderBy(F.col("id").asc_nulls_last(), "h", "start")
    later = found.withColumn("r", F.rank().over(order)).where("r > 1 or cuts is not null").select("id", "h", "start", "cuts")
    lost = later.repartition("id", "h").sortWithinPartitions("id", "h", "start").mapInArrow(lambda x: _per_document(x, window), f"id {id_type}, h long, cuts array<int>")
    lost = materialize(lost.groupBy("id", "h").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "cuts")  # a document's few rows
    shared.destroy()
    del found, later
    sweep(spark)  # the windows' shuffle files, before texts are shuffled
    marked = long.alias("l").join(lost.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.h") == F.col("r.h")), "left").select("l.id", "l.text", "r.cuts")
    rest = docs.where(~enough).select("id", "text", F.lit(None).cast("array<int>").alias("cuts"))
    out = marked.unionByName(rest).mapInArrow(_cut, f"id {id_type}, n_words long, n_removed long, cuts array<int>, kept string")
    return out.withColumnRenamed("id", id_col)


def _records(batch: pa.RecordBatch, row: np.ndarray, a: np.ndarray, b: np.ndarray | None, start: np.ndarray | None, cuts: list | None) -> pa.RecordBatch:
    n, take = len(row), pa.array(row)
    ints = lambda x: pa.nulls(n, pa.int32()) if x is None else pa.array(x.astype(np.int32, copy=False))
    columns = [batch.column("id").take(take), batch.column("h").take(take), ints(start), pa.array(a), ints(b), pa.nulls(n, pa.list_(pa.int32())) if cuts is None else pa.array(cuts, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["id", "h", "start", "a", "b", "cuts"])


def _per_document(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Stretches of each document from its removed windows, sorted by document; at a batch's end a document may go on in another row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = pc.fill_null(batch.column("id").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        h = batch.column("h").to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (h[1:] != h[:-1])))
        start, whole = batch.column("start"), batch.column("cuts")
        cuts = []
        for at, to in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
            own = pc.drop_null(start.slice(at, to - at)).to_numpy()
            cuts.append(joined(own, window) if len(own) else [])
            if start.slice(at, to - at).null_count:
                for x in pc.drop_null(whole.slice(at, to - at)).to_pylist():
                    cuts[-1] += x
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(edge)), batch.column("h").take(pa.array(edge)), pa.array(cuts, pa.list_(pa.int32()))], ["id", "h", "cuts"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", CHUNK):
        col = batch.column("text")
        h, rows, s, e = words(col, CASED, spans=True)
        data, off = buffers(col)
        gone, cuts = np.zeros(len(h) + 1, np.int64), []
        for base, x in zip(rows[:-1].tolist(), batch.column("cuts").to_pylist(), strict=True):
            if not x:
                cuts.append(None)
                continue
            pairs = np.asarray(x, np.int64).reshape(-1, 2)
            np.add.at(gone, base + pairs[:, 0], 1)
            np.add.at(gone, base + pairs[:, 1], -1)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            top = np.maximum.accumulate(pairs[:, 1])
            new = np.flatnonzero(np.append(True, pairs[1:, 0] > top[:-1]))
            cuts.append(np.stack([pairs[new, 0], top[np.append(new[1:], len(pairs)) - 1]], 1).ravel().tolist())
        keep = np.cumsum(gone[:-1]) == 0
        before = np.concatenate([[0], np.cumsum(keep)])
        n_kept = np.diff(before[rows])
        # Kept words are copied with the byte behind them, which becomes the space; the last has none.
        s, size = s[keep], (e - s)[keep]
        ends = np.cumsum(size + 1)
        source = np.append(data, np.uint8(0x20))
        out = source[np.minimum(np.arange(ends[-1] if len(ends) else 0) + np.repeat(s - (ends - size - 1), size + 1), len(data))]
        out[ends - 1] = 0x20
        at = np.append(0, ends)[before[rows]]
        last = at[1:][n_kept > 0] - 1
        body = np.delete(out, last)
        at -= np.concatenate([[0], np.cumsum(n_kept > 0)])
        kept = pa.Array.from_buffers(pa.large_string(), len(col), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.string())
        n = np.diff(rows)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(n - n_kept, pa.int64()), pa.array(cuts, pa.list_(pa.int32())), kept], ["id", "n_words", "n_removed", "cuts", "kept"])
    release()


#: The same rows in DuckDB, from every window of every document.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""
