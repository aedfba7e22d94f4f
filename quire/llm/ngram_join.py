"""Exact Jaccard join of word n-gram sets, and its connected classes, with prefix trees.

Rows with equal sets are one class; classes are joined, never rows. N-grams have one global
order: rarer first, by a document-frequency sketch over the whole corpus, ties by hash. Any
order gives the same links; this one keeps passages that many documents share out of the
prefixes. Two sets with Jaccard >= 0.8 share an n-gram among the first n - ceil(0.8 n) + 1 of
each, so classes meet by joining prefixes (hash tables of (n-gram, class, size, position)).

Links are found in rounds, all exact on what they compare. Linear rounds compare each class with
one other: the hub that shares most n-grams with most classes, or the next smaller neighbour.
They join nearly all of a family of near copies. Then come all pairs that share a prefix n-gram,
keep the length and position bounds and aren't connected yet: first one of them for each pair of
components, then whatever is left apart. Pairs already connected can't change a class.

Comparing means a prefix tree: the sets that meet one probe set are stored in a trie, ordered
by an order global to the trie, and the probe walks it once. Partial overlaps are shared by
all sets below a node, and a subtree is cut as soon as its remaining length can't reach the
overlap that its smallest set needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, sweep
from .words import SPACED, mix, release, shingle_sets, slices, words

SKETCH_BITS = 20
SLICES = 256
#: Classes of more than 1 / HEAVY of all rows are at most HEAVY; these are known to every task.
HEAVY = 10_000
#: Bits of a class's parity sketch.
PARITY = 1024
#: Classes that a task remembers, to spare it repeats.
SEEN = 1 << 17
#: Elements of the sets that share a trie; more are split over several tries.
TRIE = 200_000


def needed(nx: int, ny: int) -> int:
    """The least overlap of two sets with 100 * intersection >= 80 * union."""
    return -(-80 * (nx + ny) // 180)


class Trie:
    """Ordered sets with path compression: each node is a stretch of one of its sets."""

    def __init__(self, sets: list[np.ndarray]):
        """sets: ascending ranks."""
        self.sets = sets
        keys = [x.astype(">u4").tobytes() for x in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        shared = [0] * len(sets)  # with the set before, in elements
        for i in range(1, len(sets)):
            a, b = sets[self.order[i - 1]], sets[self.order[i]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = int(differ[0]) if len(differ) else m
        self.shared = shared

    def walk(self, inside: np.ndarray, ny: int) -> Iterator[tuple[int, int]]:
        """(set, overlap) of those that reach the overlap they need with the probe.

        inside: for every rank, whether the probe has it; ny: the size of the probe's set.
        """
        after = np.append(np.cumsum(inside[::-1])[::-1], 0)  # of the probe, from a rank on
        stack = [(0, len(self.order), 0, 0)]  # sets from..to, depth, overlap so far
        while stack:
            lo, hi, depth, overlap = stack.pop()
            sizes = [len(self.sets[k]) for k in self.order[lo:hi]]
            first = self.sets[self.order[lo]]
            left = int(after[first[depth - 1] + 1]) if depth else int(after[0])
            if overlap + min(max(sizes) - depth, left) < needed(min(sizes), ny):
                continue
            end = min(self.shared[lo + 1 : hi], default=len(first))
            overlap += int(np.count_nonzero(inside[first[depth:end]]))
            i = lo
            while i < hi and len(self.sets[self.order[i]]) == end:
                if overlap >= needed(end, ny):
                    yield self.order[i], overlap
                i += 1
            while i < hi:
                j = i + 1
                while j < hi and self.shared[j] > end:
                    j += 1
                stack.append((i, j, end, overlap))
                i = j


def trie_links(sets: list[np.ndarray], probe: np.ndarray) -> list[int]:
    """Which of some sets have a Jaccard similarity of 0.8 or more with the probe."""
    if not sets:
        return []
    flat = np.concatenate(sets)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    by = np.lexsort((values, -counts))
    rank[by] = np.arange(len(values))
    inside = np.isin(values, probe)[by]
    ends = np.cumsum([len(x) for x in sets])[:-1]
    return sorted(k for k, _ in Trie([np.sort(x) for x in np.split(rank[inverse.ravel()], ends)]).walk(inside, len(probe)))


def _class(s: np.ndarray) -> int:
    """The id of a set, 64 bits."""
    m = mix(s)
    with np.errstate(over="ignore"):
        x = mix(np.array([m.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(m)], np.uint64))
        return int(mix(x[:1] * np.uint64(3) + x[1:]).view(np.int64)[0])


def _parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits, as longs: whether an odd number of the set's n-grams hashes to each.

    Bits that differ between two sets bound their symmetric difference from below, exactly.
    """
    odd = np.bincount((s >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _digests(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """Rows (id, n, cls) and, with part >= 0, each task's counts of the sketch's buckets, in SLICES parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        names = ["id", "h", "n", "cls", "parity", "part", "counts"]
        for batch in slices(batches, text, 1 << 20):
            sets = shingle_sets(*words(batch.column(text), SPACED), k)
            cls = [_class(s) if len(s) else 0 for s in sets]
            new = [s for s, c in zip(sets, cls, strict=True) if c not in seen and not seen.add(c)]
            if new:
                sketch += np.bincount((np.concatenate(new) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            if len(seen) > SEEN:
                seen.clear()
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.array([_parity(s) for s in sets], pa.list_(pa.int64())), pa.array(np.full(m, -1), pa.int32()), pa.nulls(m, pa.binary())], names)
        if sketch.any():
            parts = np.minimum(sketch, 65535).astype("<u2").reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names)
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text).mapInArrow(run, "id long, h long, n long, cls long, parity array<long>, part int, counts binary")


def _frequencies(digests: DataFrame) -> np.ndarray:
    """The sketch over all tasks; its size is fixed."""

    def add(kind: str):
        def run(t: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x, kind).astype(np.int64) for x in t.column("counts").to_pylist()], axis=0)
            return pa.table({"part": t.column("part")[:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

        return run

    rows = (
        digests.where("part >= 0")
        .select("part", "counts", (F.spark_partition_id() % 64).alias("salt"))
        .groupBy("part", "salt")
        .applyInArrow(add("<u2"), "part int, counts binary")
        .groupBy("part")
        .applyInArrow(add("<i8"), "part int, counts binary")
        .collect()
    )
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, "<i8")
    return np.minimum(out.ravel(), (1 << 24) - 1).astype(np.uint32)


def _prefixes(docs: DataFrame, id_col: str, text: str, k: int, frequency, heavy) -> DataFrame:
    """(h, cls, n, pos): the prefix of every class's set in the global order; at least once for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, skip, seen = frequency.value, heavy.value, set()
        for batch in slices(batches, text, 1 << 20):
            out = [[], [], [], []]
            ids = batch.column("id").to_pylist()
            for s, i in zip(shingle_sets(*words(batch.column(text), SPACED), k), ids, strict=True):
                n = len(s)
                if n < 4 or i is None:  # up to 3 n-grams, only equal sets link
                    continue
                c = _class(s)
                if c in seen or skip.get(c, i) != i:
                    continue
                seen.add(c)
                key = (f[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
                p = n - (-(-80 * n // 100)) + 1
                first = s[np.argsort(key, kind="stable")[:p]]
                out[0].append(first.view(np.int64))
                out[1].append(np.full(p, c))
                out[2].append(np.full(p, n, np.int32))
                out[3].append(np.arange(p, dtype=np.int32))
            if len(seen) > SEEN:
                seen.clear()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["h", "cls", "n", "pos"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, "h long, cls long, n int, pos int")


def _sets(docs: DataFrame, id_col: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(cls, ngrams): the sets of the wanted classes, from the rows whose id represents one.

    A bitmap of fixed size over hashes of the wanted ids spares most other rows the work; the
    join behind it decides.
    """
    bits = 1 << 26
    slot = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    maps = wanted.select(slot.alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m")).collect()
    shared = docs.sparkSession.sparkContext.broadcast({r.b: bytes(r.m) for r in maps})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            seen = set()
            for s, i in zip(shingle_sets(*words(batch.column(text), SPACED), k), batch.column("id").to_pylist(), strict=True):
                if len(s) and (c := _class(s)) not in seen:
                    seen.add(c)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([c], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["id", "cls", "ngrams"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            slots = batch.column("slot").to_numpy() - 1
            keep = np.fromiter((bool((x := m.get(s // 32768 + 1)) and x[s % 32768 // 8] >> s % 8 & 1) for s in slots.tolist()), bool, len(slots))
            yield batch.filter(pa.array(keep)).select(["id", text])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text).where("id is not null")
    found = rows.withColumn("slot", slot).mapInArrow(lambda it: run(kept(it)), "id long, cls long, ngrams binary")
    both = found.join(wanted.withColumnsRenamed({"id": "wanted_id"}), "cls").where("id = wanted_id")
    return both.groupBy("cls").agg(F.first("ngrams").alias("ngrams"))


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) that link. Each y is a probe; its x's make up tries of bounded size."""
    split = pairs.groupBy("y").agg(F.ceil(F.sum("nx") / TRIE).cast("int").alias("tries"))
    dealt = pairs.join(split, "y").select("x", "y", F.pmod(F.xxhash64("x"), "tries").alias("t"))
    left = dealt.join(sets.toDF("x", "g"), "x").select("y", "t", "x", "g").toDF("ly", "lt", "x", "ngrams")
    right = dealt.select("y", "t").distinct().join(sets.toDF("y", "g"), "y").select("y", "t", "g").toDF("ry", "rt", "ngrams")

    def run(members: pa.Table, probe: pa.Table) -> pa.Table:
        x = members.column("x").to_pylist()
        found = trie_links([np.frombuffer(b, np.uint64) for b in members.column("ngrams").to_pylist()], np.frombuffer(probe.column("ngrams")[0].as_py(), np.uint64)) if probe.num_rows else []
        y = probe.column("ry")[0].as_py() if probe.num_rows else None
        return pa.table({"a": pa.array([x[i] for i in found], pa.int64()), "b": pa.array([y] * len(found), pa.int64())})

    return left.groupBy("ly", "lt").cogroup(right.groupBy("ry", "rt")).applyInArrow(run, "a long, b long")


#: Whether sets a and b, of which this n-gram is the first shared one, may reach the overlap they need.
FITS = "100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) and 180 * least(a.n - a.pos, b.n - b.pos) >= 80 * (a.n + b.n)"


def _shared_prefixes(docs: DataFrame, id_col: str, text: str, k: int, frequency, heavy) -> DataFrame:
    """The rows of _prefixes whose n-gram more than one class has."""
    tokens = materialize(_prefixes(docs, id_col, text, k, frequency, heavy), "prefixes")
    shared = tokens.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("h")
    shared = materialize(shared, "keys")
    sweep(docs.sparkSession)
    live = materialize(tokens.join(shared, "h"), "shared")
    discard(tokens, shared)
    return live


def _apart(live: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows, with ``comp``, of n-grams that more than one component has."""
    if comp is None:
        return live.withColumn("comp", F.col("cls"))
    known = live.join(comp.withColumnsRenamed({"node": "cls"}), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    shared = known.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    return known.join(shared, "h")


def _hubs(rows: DataFrame) -> DataFrame:
    """(x, nx, y, times): each class and the class of its n-gram that shares most n-grams, with most others.

    The original of a family of copies shares its n-grams with all of them; each copy's own
    changes are shared with none.
    """
    width = rows.groupBy("h").agg(F.count("*").alias("width"))
    weight = materialize(rows.select("h", "cls").join(width, "h").groupBy("cls").agg(F.sum("width").alias("weight")), "weights")
    sweep(rows.sparkSession)
    hubs = rows.join(weight, "cls").groupBy("h").agg(F.max_by(F.struct("n", "cls", "pos", "comp"), F.struct("weight", "cls")).alias("b")).select("h", "b.*")
    hubs = materialize(hubs, "hubs")
    discard(weight)
    sweep(rows.sparkSession)
    return (
        rows.alias("a")
        .join(hubs.alias("b"), F.expr("a.h = b.h and a.comp <> b.comp and " + FITS))
        .groupBy(F.col("a.cls").alias("x"), F.col("a.n").cast("long").alias("nx"), F.col("b.cls").alias("y"))
        .agg(F.count("*").alias("times"))
    )


def _neighbours(rows: DataFrame) -> DataFrame:
    """(x, nx, y, times): each class and the next smaller one of its n-gram.

    Neighbours stand next to each other in the order of (n-gram, size, class), which is sorted
    by range, so that an n-gram of very many classes spreads over tasks. A neighbour beyond
    the edge of a task is left to the other rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, n, p, o = (batch.column(i).to_numpy() if last is None else np.concatenate([[last[i]], batch.column(i).to_numpy()]) for i in range(5))
            last = (h[-1], c[-1], n[-1], p[-1], o[-1])
            fits = (h[1:] == h[:-1]) & (o[1:] != o[:-1]) & (100 * n[:-1] >= 80 * n[1:]) & (180 * np.minimum(n[1:] - p[1:], n[:-1] - p[:-1]) >= 80 * (n[1:] + n[:-1]))
            i = np.flatnonzero(fits)
            yield pa.RecordBatch.from_arrays([pa.array(c[1:][i]), pa.array(n[1:][i]), pa.array(c[:-1][i])], ["x", "nx", "y"])

    columns = [F.col(c).cast("long").alias(c) for c in ("h", "cls", "n", "pos", "comp")]
    near = rows.select(*columns).repartitionByRange("h", "n", "cls").sortWithinPartitions("h", "n", "cls")
    return near.mapInArrow(run, "x long, nx long, y long").groupBy("x", "nx", "y").agg(F.count("*").alias("times"))


def _best(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, nx, y): each class with its partner at most n-grams, where the overlap it needs is possible."""
    best = found.groupBy("x", "nx").agg(F.max_by("y", F.struct("times", "y")).alias("y"))
    return materialize(_near(best, classes), "pairs")


def _unconnected(live: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, nx, y): pairs that share a prefix n-gram, may reach the overlap they need, and aren't connected yet."""
    rows = materialize(_apart(live, comp), "open")
    pairs = (
        rows.alias("a")
        .join(rows.alias("b"), F.expr("a.h = b.h and a.comp <> b.comp and (a.n > b.n or a.n = b.n and a.cls > b.cls) and " + FITS))
        .select(F.col("a.cls").alias("x"), F.col("a.n").alias("nx"), F.col("b.cls").alias("y"))
        .distinct()
    )
    out = materialize(_near(pairs, classes), "pairs")
    discard(rows)
    return out


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose parity sketches leave room for the overlap they need; none that links is lost."""
    x, y = classes.select("cls", "parity").toDF("x", "px"), classes.select("cls", "n", "parity").toDF("y", "ny", "py")
    differ = F.aggregate(F.zip_with("px", "py", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
    return pairs.join(x, "x").join(y, "y").where(F.col("nx") + F.col("ny") >= 9 * differ).select("x", "nx", "y")


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with those as cx < cy."""
    x = pairs.join(comp.toDF("x", "a"), "x", "left")
    both = x.join(comp.toDF("y", "b"), "y", "left").withColumns({"a": F.coalesce("a", "x"), "b": F.coalesce("b", "y")})
    return both.where("a <> b").select("x", "nx", "y", F.least("a", "b").alias("cx"), F.greatest("a", "b").alias("cy"))


def _classes_of(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, id) of all classes in pairs."""
    ends = pairs.select(F.col("x").alias("cls")).unionByName(pairs.select(F.col("y").alias("cls"))).distinct()
    return classes.select("cls", "id").join(ends, "cls", "left_semi")


def _rest(docs: DataFrame, id_col: str, text: str, k: int, live: DataFrame, comp: DataFrame, links: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, comp) after all pairs that may link and aren't connected yet: first one for each pair of components, then those left apart."""
    spark = docs.sparkSession
    rest = _unconnected(live, comp, classes)
    sweep(spark)
    if rest.isEmpty():
        discard(rest)
        return comp
    more = _classes_of(rest, classes).join(sets.select("cls"), "cls", "left_anti")
    sets2 = materialize(_sets(docs, id_col, text, k, more), "sets")
    sweep(spark)
    sets = sets.unionByName(sets2)
    one = materialize(_between(rest, comp).groupBy("cx", "cy").agg(F.min_by(F.struct("x", "nx", "y"), F.xxhash64("x", "y")).alias("p")).select("p.*"), "pairs")
    links2 = materialize(_compare(one, sets), "links")
    comp2 = materialize(components(links.unionByName(links2)), "joined")
    left = materialize(_between(rest, comp2).select("x", "nx", "y").join(one.select("x", "y"), ["x", "y"], "left_anti"), "pairs")
    links3 = materialize(_compare(left, sets), "links")
    discard(comp, comp2, rest, one, left, sets2)
    sweep(spark)
    return components(links.unionByName(links2).unionByName(links3))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, with_class: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per input row: the classes of the Jaccard >= 0.8 graph.

    Words are what stands between white space in the lower-cased (A-Z) text; a row's set are its
    distinct k-word shingles, or its whole sequence if it has fewer than k words. Null texts and
    texts without words have n_shingles 0, link with nothing and are their own component. Rows
    with a null id link with nothing and get a null component. Rows that repeat an id count by
    each of their texts. component_id is the smallest id reachable. Other columns are ignored. ``with_class`` adds
    text_hash (xxhash64 of the text) and class, the same for rows that are connected (else null).
    """
    digests = materialize(_digests(docs, id_col, text, k), "digests")
    rows = digests.where("part < 0").select("id", "h", "n", "cls", "parity")
    frequency = docs.sparkSession.sparkContext.broadcast(_frequencies(digests))
    classes = materialize(rows.where("id is not null and n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("parity").alias("parity")), "classes")
    total = rows.count()
    common = {r.cls: r.id for r in classes.where(F.col("copies") * HEAVY > total + HEAVY).select("cls", "id").collect()}
    heavy = docs.sparkSession.sparkContext.broadcast(common)

    live = _shared_prefixes(docs, id_col, text, k, frequency, heavy)
    sweep(docs.sparkSession)

    # Linear rounds: one partner for each class. They end as soon as no n-gram has two components.
    sets = links = comp = None
    settled = False
    for partners in (_hubs, _neighbours, _hubs):
        open_ = materialize(_apart(live, comp), "open")
        if settled := open_.isEmpty():
            discard(open_)
            break
        pairs = _best(partners(open_), classes)
        sweep(docs.sparkSession)
        needs = _classes_of(pairs, classes)
        found = materialize(_sets(docs, id_col, text, k, needs if sets is None else needs.join(sets.select("cls"), "cls", "left_anti")), "sets")
        sets = found if sets is None else sets.unionByName(found)
        more = materialize(_compare(pairs, sets), "links")
        links = more if links is None else links.unionByName(more)
        discard(open_, pairs, comp)
        comp = materialize(components(links), "joined")
        sweep(docs.sparkSession)
    if not settled:
        comp = _rest(docs, id_col, text, k, live, comp, links, sets, classes)
    elif comp is None:
        comp = docs.sparkSession.createDataFrame([], "node long, comp long")
    discard(live)
    least = comp.join(classes.select(F.col("cls").alias("node"), "id"), "node")
    root = least.groupBy("comp").agg(F.min("id").alias("root"))
    joined = comp.join(root, "comp").select(F.col("node").alias("cls"), "root", F.col("comp").alias("class"))
    named = materialize(classes.join(joined, "cls", "left").select("cls", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("class", "cls").alias("class")), "named")
    # Classes of many rows are at most HEAVY and joined by a broadcast, others by a shuffle; rows that link with nothing aren't joined.
    heavy_rows = F.col("copies") * HEAVY > total + HEAVY
    hot = F.broadcast(named.where(heavy_rows))
    alone = F.expr("id is null or n = 0")
    linked = rows.where(~alone).join(hot, "cls", "left")
    found = linked.where("root is not null").unionByName(linked.where("root is null").drop("copies", "root", "class").join(named.where(~heavy_rows), "cls"))
    out = found.select("id", "h", "n", "root", "class").unionByName(rows.where(alone).select("id", "h", "n", F.col("id").alias("root"), F.lit(None).cast("long").alias("class")))
    more = [F.col("h").alias("text_hash"), F.col("class")] if with_class else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.expr("if(id is null, null, root)").alias("component_id"), *more)


#: The rows of jaccard_classes in DuckDB, from every shared shingle.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS k FROM documents UNION SELECT l.v, r.k FROM r JOIN l ON l.u = r.d)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(k) FROM r WHERE r.d = w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
