"""Fuzzy line deduplication by MinHash, in numpy over Arrow batches.

A line's set are its character shingles: SHINGLE characters from each position on (all of the
line where it is shorter), lower-cased, repeats removed. Each shingle is hashed once, and a
signature holds the smallest hash of each of BINS bins (one-permutation MinHash); an empty bin
takes the value of another one, chosen by a fixed random sequence. BANDS bands of ROWS bins make
two lines of similarity 0.8 meet with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, 0.994.

Lines that share a band are compared in rounds; every comparison is an exact Jaccard similarity:
each line with the first line of its groups (the most alike one first), then what is still in
different components of a group: in one task for groups up to SMALL lines; larger ones are split by
TOGETHER further minima, SPLIT times (that all differ has a probability of 0.0008 at 0.8), DEPTH
times at most, and whatever is still mixed then is compared in pairs. Connected components come from
distributed union-find, and one line of each is kept.

Equal lines are collapsed first, inside a slice of text and then by a shuffle, and only lines that
are compared are read again. Pairs whose signatures agree in fewer than AGREE of BINS minima are
not read: at a similarity of 0.8 that happens with a probability of 0.001.

The form in DataFrame expressions only gave the same links but hashed shingles too slowly (see the
README), so lines are read and compared in Python workers here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, components, discard, materialize, sweep
from .words import buffers, lut, mix, slices, words

SHINGLE = 5
BANDS = 13
ROWS = 5
BINS = 65
AGREE = 42
SMALL = 2048
SPLIT = 10
TOGETHER = 3
DEPTH = 3
#: Shingles of a group's lines that a task keeps.
ROOM = 1 << 22
THRESHOLD = 80  # percent
#: Lines that are joined back are broadcast up to this many rows, else joined by a shuffle.
BROADCAST = 250_000
EMPTY = np.uint32(0xFFFFFFFF)
PRIME = np.uint64(0x100000001B3)
LINES = lut([(10, 10)], lower=False)
#: Where an empty bin looks for its value, turn by turn.
ELSEWHERE = (mix(np.arange(64 * BINS, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64).reshape(64, BINS)
#: Characters whose shingles are hashed at once.
STEP = 1 << 18


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the shingle at each position of each line, number of positions of each line)."""
    low = [x.lower() for x in lines]
    size = np.array([len(x) for x in low], np.int64)
    chars = np.frombuffer(("".join(low) + "\0" * SHINGLE).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = np.maximum(size - SHINGLE + 1, 1)
    ends = np.cumsum(n)
    at = np.arange(n.sum()) + np.repeat(np.cumsum(size) - size - ends + n, n)
    # All places of the text are hashed in passes over neighbours; those that cross a line's end are left out, and short lines hashed anew.
    rolled = np.zeros(len(chars) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        rolled *= PRIME
        rolled += chars[j : j + len(rolled)]
    h = rolled[at]
    short = np.flatnonzero(size < SHINGLE)
    if len(short):
        place = ends[short] - 1
        h[place] = 0
        for j in range(SHINGLE):
            h[place] = h[place] * PRIME + np.where(size[short] > j, chars[at[place] + j], np.uint64(0))
    return mix(h), n


def signatures(lines: list[str]) -> np.ndarray:
    """Each line's BINS minima, cut to 16 bits."""
    if not lines:
        return np.zeros((0, BINS), np.uint16)
    h, n = shingle_hashes(lines)
    m = len(lines)
    cell = np.repeat(np.arange(m) * BINS, n) + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    low = np.full(m * BINS, EMPTY, np.uint32)
    np.minimum.at(low, cell, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    low = low.reshape(m, BINS)
    r, c = np.nonzero(low == EMPTY)
    filled = low.copy()
    for turn in ELSEWHERE:
        if not len(r):
            break
        got = low[r, turn[c]]
        filled[r, c] = got
        r, c = r[got == EMPTY], c[got == EMPTY]
    if len(r):
        filled[r, c] = low[r].min(1)
    return (mix(filled.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _blocks(lines: list[str]) -> Iterator[list[str]]:
    """The lines in stretches of about STEP characters."""
    at = 0
    size = np.cumsum([len(x) for x in lines])
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP, side="right")))
        yield lines[at:to]
        at = to


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(line, band) -> key; a band's bins stand far apart."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            x = mix(x * PRIME + sig[:, b + r * bands].astype(np.uint64))
        out[:, b] = mix(x)
    return out.view(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each slice of rows (k, id, t): the batch, its bytes, and of each line that isn't blank its hash, row, place in the row, first and end byte."""
    for batch in slices(batches, "t", 1 << 20):
        col = batch.column("t")
        data, off = buffers(col)
        h, rows, first, end = words(col, LINES, spans=True)
        if not len(h):
            continue
        row = np.searchsorted(off, first, side="right") - 1
        breaks = np.append(0, np.cumsum(data == 10))
        solid = np.append(0, np.cumsum((data != 32) & (data != 10)))
        keep = solid[end] > solid[first]  # lines of spaces only are blank
        yield batch, data, h.view(np.int64)[keep], row[keep], (breaks[first] - breaks[off[row]])[keep], first[keep], end[keep]


def _distinct(docs: DataFrame) -> DataFrame:
    """(h, first (id, k, pos), copies, sig) of each distinct line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, h, row, pos, first, end in _read(batches):
            ids = np.array([(1 << 63) - 1 if x is None else x for x in batch.column("id").to_pylist()], np.int64)
            k = batch.column("k").to_numpy()
            order = np.lexsort((pos, k[row], ids[row], h))
            new = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, int)
            copies = np.diff(np.append(new, len(h)))
            i = order[new]
            lines = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(first[i].tolist(), end[i].tolist(), strict=True)]
            sig = [x.tobytes() for part in _blocks(lines) for x in signatures(part)]
            yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(ids[row[i]]), pa.array(k[row[i]]), pa.array(pos[i].astype(np.int32)), pa.array(copies), pa.array(sig, pa.binary())], ["h", "id", "k", "pos", "copies", "sig"])

    found = docs.mapInArrow(run, "h long, id long, k long, pos int, copies long, sig binary")
    return materialize(found.groupBy("h").agg(F.min(F.struct("id", "k", "pos")).alias("first"), F.sum("copies").alias("copies"), F.first("sig").alias("sig")), "lines")


def _occurring(docs: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """The lines that are wanted (and few others): (h, line) for "text", (h, id, k, pos) for "place"."""
    maybe = Bitmap(wanted, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, h, row, pos, first, end in _read(batches):
            i = np.flatnonzero(maybe.holds(h))
            if kind == "text":
                i = i[np.unique(h[i], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array([data[a:b].tobytes() for a, b in zip(first[i].tolist(), end[i].tolist(), strict=True)], pa.binary())], ["h", "line"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(h[i]), batch.column("id").take(pa.array(row[i])), batch.column("k").take(pa.array(row[i])), pa.array(pos[i].astype(np.int32))], ["h", "id", "k", "pos"])

    return docs.mapInArrow(run, "h long, line binary" if kind == "text" else "h long, id long, k long, pos int")


def _keys(signed: DataFrame, bands: int, rows: int, only: Bitmap | None = None) -> DataFrame:
    """(key, h): each line's bands; those that may be in ``only``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = band_keys(_minima(batch.column("sig")), bands, rows).ravel()
                h = np.repeat(batch.column("h").to_numpy(), bands)
                if only:
                    keep = only.holds(key)
                    key, h = key[keep], h[keep]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h)], ["key", "h"])

    return signed.select("h", "sig").mapInArrow(run, "key long, h long")


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


def _promising(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b, score): the pairs whose signatures agree in AGREE minima at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = (_minima(batch.column("sa")) == _minima(batch.column("sb"))).sum(1).astype(np.int32)
                keep = pa.array(score >= AGREE)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(score).filter(keep)], ["a", "b", "score"])

    sig = signed.select("h", "sig")
    return pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").mapInArrow(run, "a long, b long, score int")


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines have an exact similarity of the threshold at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            lines = [z.decode("utf-8", "replace") for pair in zip(x, y, strict=True) for z in pair]
            found, sets = [], []
            for part in _blocks(lines):
                h, n = shingle_hashes(part)
                sets += [np.unique(s) for s in np.split(h, np.cumsum(n)[:-1])]
                while len(sets) > 1:
                    a, b, *sets = sets
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    found.append(both * 100 >= THRESHOLD * (len(a) + len(b) - both))
            keep = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return materialize(both.mapInArrow(run, "a long, b long"), "alike")


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _mixed(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """The groups' rows (key, h), with the lines' component c and their number n, of groups that hold several components."""
    named = groups.join(comp.toDF("h", "c"), "h", "left").withColumn("c", F.coalesce("c", "h"))
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    return materialize(named.join(mixed, "key").select("key", "h", "c", "n"), "mixed")


def _across(mixed: DataFrame) -> DataFrame:
    """All pairs of lines of a group that are in different components."""
    x, y = mixed.select("key", F.col("h").alias("a"), F.col("c").alias("ca")), mixed.select("key", F.col("h").alias("b"), F.col("c").alias("cb"))
    return x.join(y, "key").where("a < b and ca <> cb").select("a", "b").distinct()


def _inside(mixed: DataFrame, signed: DataFrame, texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(a, b): links that join the components of each group up to SMALL lines, one fewer than its lines at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            t = rest if batch is None else pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if t is None or not t.num_rows:
                continue
            key = t.column("key").to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            to = len(key) if batch is None else int(starts[-1])  # the last group may go on in the next batch
            found = _linked(t.slice(0, to), starts[starts < to], bands, rows) if to else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
            rest = t.slice(to)

    full = mixed.select("key", "h", "c").join(signed.select("h", "sig"), "h").join(texts, "h")
    return materialize(full.repartition("key").sortWithinPartitions("key").select("key", "h", "c", "sig", "line").mapInArrow(run, "a long, b long"), "alike")


def _linked(t: pa.Table, starts: np.ndarray, bands: int, rows: int) -> list[tuple[int, int]]:
    """Exact links between the components of each of the groups (which begin at ``starts``); each link joins two that weren't joined before."""
    key, h, c = (t.column(x).to_numpy() for x in ("key", "h", "c"))
    sig, lines = _minima(t.column("sig")), t.column("line")
    size = pc.binary_length(lines).to_numpy()
    keys = band_keys(sig, bands, rows)
    found = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
        own = c[a:b].copy()  # each line's component, as joined so far
        band = np.flatnonzero(keys[a] == key[a])
        earlier = keys[a:b, : band[0]] if len(band) else keys[a:b, :0]  # a pair that shares an earlier band is compared there
        sets, kept = {}, 0
        for i, j in _candidates(sig[a:b], own, earlier):
            need = [k for k in dict.fromkeys(np.append(i, j).tolist()) if k not in sets]
            if size[[a + k for k in need]].sum() <= 4 * STEP:
                sets |= zip(need, _sets([lines[a + k].as_py() for k in need]), strict=True)
                kept += sum(len(sets[k]) for k in need)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if own[x] == own[y]:
                    continue
                for k in (x, y):
                    if k not in sets:
                        sets[k] = _sets([lines[a + k].as_py()])[0]
                        kept += len(sets[k])
                u, v = sets[x], sets[y]
                both = int(np.count_nonzero(v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u))
                if both * 100 >= THRESHOLD * (len(u) + len(v) - both):
                    own[own == own[y]] = own[x]
                    found.append((int(h[a + x]), int(h[a + y])))
                if kept > ROOM:
                    sets.clear()
                    kept = 0
    return found


def _candidates(sig: np.ndarray, own: np.ndarray, earlier: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's lines, some at a time: in different components, agreeing in AGREE minima, and in none of the earlier bands."""
    n = len(sig)
    step = max(1, ROOM // (n * BINS))
    for at in range(0, n, step):
        if (own == own[0]).all():
            return
        i, j = np.nonzero((sig[at : at + step, None] == sig[None, at:]).sum(2, dtype=np.uint8) >= AGREE)
        keep = (j > i) & (own[at + i] != own[at + j])
        i, j = at + i[keep], at + j[keep]
        keep = ~(earlier[i] == earlier[j]).any(1)
        if keep.any():
            yield i[keep], j[keep]


def _sets(lines: list[bytes]) -> list[np.ndarray]:
    """Each line's distinct shingles, sorted."""
    out = []
    for part in _blocks([x.decode("utf-8", "replace") for x in lines]):
        h, n = shingle_hashes(part)
        out += [np.unique(s) for s in np.split(h, np.cumsum(n)[:-1])]
    return out


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs, with their ends' components ca and cb, that are in different ones."""
    named = pairs.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    return named.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) with more links; only components are joined, not lines."""
    edges = materialize(_apart(links, comp).select("a", "b", "ca", "cb"), "edges")
    top = materialize(components(edges, "ca", "cb"), "top")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    every = comp.unionByName(ends.join(comp, "node", "left_anti").withColumn("comp", F.col("node")))
    out = materialize(every.join(top.toDF("comp", "c"), "comp", "left").select("node", F.coalesce("c", "comp").alias("comp")), "joined")
    discard(edges, top, comp, links)
    return out


def _parts(mixed: DataFrame, signed: DataFrame, depth: int) -> DataFrame:
    """(key, h): each line of a group SPLIT times, keyed by the group and TOGETHER further minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, h = batch.column("key").to_numpy().view(np.uint64), batch.column("h").to_numpy()
                j = ((key % np.uint64(BINS)).astype(np.int64)[:, None] + np.arange(SPLIT)[None, :] * 6 + depth) % BINS
                part, sig = mix(key[:, None] * PRIME + j.astype(np.uint64)), _minima(batch.column("sig"))
                for more in range(TOGETHER):
                    part = mix(part * PRIME + np.take_along_axis(sig, (j + 17 * more) % BINS, 1).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel().view(np.int64)), pa.array(np.repeat(h, SPLIT))], ["key", "h"])

    return mixed.join(signed.select("h", "sig"), "h").select("key", "h", "sig").mapInArrow(run, "key long, h long")


def similar_lines(docs: DataFrame, signed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, comp): the components of lines that have a similar line; all similar lines that share a band are joined."""
    spark = signed.sparkSession
    met = materialize(_keys(signed, bands, rows).groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi"), "met")
    sweep(spark)
    several = met.where("n > 2").select("key", "lo")
    groups = materialize(_keys(signed, bands, rows, Bitmap(several, "key")).join(several, "key").select("key", "h", "lo"), "groups")
    star = met.where("n = 2").select(*_pair("lo", "hi")).unionByName(groups.where("h <> lo").select(*_pair("h", "lo"))).distinct()
    star = materialize(_promising(star, signed), "pairs")
    wanted = star.select(F.col("a").alias("h")).unionByName(star.select(F.col("b").alias("h"))).unionByName(groups.select("h")).distinct()
    wanted = materialize(wanted, "wanted")
    texts = materialize(_occurring(docs, wanted, "text").distinct(), "texts")
    discard(met, wanted)
    sweep(spark)

    best = materialize(star.groupBy("b").agg(F.max_by("a", "score").alias("a")).select("a", "b"), "best")
    links = _alike(best, texts)
    comp = materialize(components(links), "joined")
    discard(links)
    comp = _joined(comp, _alike(_apart(star, comp).select("a", "b").join(best, ["a", "b"], "left_anti"), texts))
    discard(star, best)
    sweep(spark)
    for depth in range(DEPTH + 1):
        mixed = _mixed(groups.select("key", "h"), comp)
        discard(groups)
        if mixed.isEmpty():
            discard(mixed)
            break
        comp = _joined(comp, _inside(mixed.where(F.col("n") <= SMALL), signed, texts, bands, rows))
        large = materialize(mixed.where(F.col("n") > SMALL), "large")
        discard(mixed)
        if large.isEmpty():
            discard(large)
            break
        if depth == DEPTH:
            comp = _joined(comp, _alike(_promising(_across(large), signed).select("a", "b"), texts))
        else:
            # A large group's lines meet again in its parts, with the first line of each part and then in pairs.
            groups = materialize(_parts(large, signed, depth), "parts")
            first = groups.groupBy("key").agg(F.min("h").alias("lo"))
            near = groups.join(first, "key").where("h <> lo").select(*_pair("h", "lo")).distinct()
            comp = _joined(comp, _alike(_promising(_apart(near, comp).select("a", "b"), signed).select("a", "b"), texts))
        discard(large)
        sweep(spark)
    discard(texts)
    return comp


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_lines, n_kept, text), one row per input row: each text without its duplicate lines.

    Lines are split at newlines. Of each group of fuzzy duplicates the first line stays, by
    document id (null ids last) and position. Blank lines always stay and link with nothing.
    Null texts stay null with 0 lines; empty ones have one blank line. Rows that repeat an id and
    its text are one document: they keep the same lines. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    key = F.xxhash64("id", "t")
    read = docs.where(F.col("t").isNotNull()).select(key.alias("k"), F.col("id").cast("long").alias("id"), "t")
    signed = _distinct(read)
    sweep(spark)
    comp = similar_lines(read, signed, bands, rows)
    sweep(spark)

    grouped = signed.select("h", "first", "copies").join(comp.withColumnsRenamed({"node": "h"}), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    heads = grouped.groupBy("comp").agg(F.min("first").alias("keep"), F.sum("copies").alias("times")).where("times > 1")
    repeated = materialize(grouped.join(heads, "comp").select("h", "keep", "copies"), "repeated")
    total = signed.agg(F.sum("copies")).first()[0] or 0
    discard(signed)
    # Lines that occur once have no head: only lines of a repeated group can be dropped.
    places = _occurring(read, repeated, "place")
    if repeated.count() > BROADCAST:
        # Lines of more than a thousandth of all are a thousand at most; they don't go through the shuffle.
        hot = F.broadcast(repeated.where(F.col("copies") * 1000 > total))
        rest = places.join(hot.select("h"), "h", "left_anti").join(repeated.where(F.col("copies") * 1000 <= total), "h")
        places = places.join(hot, "h").unionByName(rest)
    else:
        places = places.join(F.broadcast(repeated), "h")
    place = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "k", "pos")
    drops = materialize(places.where(place != F.col("keep")).groupBy("k").agg(F.collect_set("pos").alias("drop")), "drops")
    discard(repeated)
    out = docs.select("id", "t", key.alias("k")).join(drops, "k", "left")
    parts = F.split(F.col("t"), "\n")
    kept = F.when(F.col("drop").isNull(), F.col("t")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("drop", i)), "\n"))
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size(parts))
    return out.select(F.col("id").alias(id_col), n.cast("long").alias("n_lines"), (n - F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))).cast("long").alias("n_kept"), kept.alias("text"))
