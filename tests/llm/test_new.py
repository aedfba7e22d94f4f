"""Operators 11 to 13 against plain loops, on small tables with odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import centroids, fill_middle, queries, substring_dedup, words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_dedup(rows, window=20):
    """(id, n_words, n_removed, kept) of each row, from a dictionary of all windows."""
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for r in sorted(rows, key=key):
        w = split(r[1])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (key(r), i))
    out = []
    for r in rows:
        w = split(r[1])
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (key(r), i) for p in range(i, i + window)}
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.fixture
def repeats(spark):
    shared, base = prose(1, 45), prose(2, 200)
    rows = [(5, base), (2, prose(3, 30) + " \n" + shared + "\t" + prose(4, 10)), (3, shared + " " + prose(5, 25)), (9, prose(6, 7) + "  " + shared), (7, base), (4, None), (6, ""), (8, "  \n"), (1, "short text")]
    rows += [(10, prose(7, 20)), (11, prose(7, 20)), (12, prose(7, 19)), (13, "word " * 400), (14, ("a b c " * 30).strip()), (15, prose(8, 40) + "\u00a0" + prose(8, 40)), (16, prose(8, 40).upper())]
    rows += [(20, base), (20, base), (20, shared + " x"), (None, base), (None, base), (None, shared), (None, None)]
    rows += [(30, prose(9, 9000)), (31, "pre " + prose(9, 9000) + " post"), (32, "x" * 70000 + " " + prose(1, 45))]
    frame = spark.createDataFrame([(i, t, 0, "clash", [1]) for i, t in rows], "doc_id long, text string, start int, kept string, cuts array<int>")
    return frame.repartition(5)


def test_substrings(repeats):
    rows = [(r.doc_id, r.text, r.h) for r in repeats.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    got = substring_dedup.dedup_substrings(repeats)
    assert got.columns == ["doc_id", "n_words", "n_removed", "cuts", "kept"]
    found = got.collect()
    assert sorted(map(str, plain_dedup(rows))) == sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in found)
    for r in found:
        assert sum(b - a for a, b in zip((r.cuts or [])[::2], (r.cuts or [])[1::2], strict=True)) == r.n_removed
        assert (r.cuts or []) == sorted(r.cuts or [])


def test_substrings_with_a_full_sketch(repeats, monkeypatch):
    want = sorted(map(str, substring_dedup.dedup_substrings(repeats).collect()))
    assert want == sorted(map(str, substring_dedup.dedup_substrings(repeats, most_bits=2 * substring_dedup.SLOTS).collect()))
    monkeypatch.setattr(substring_dedup, "CHUNK", 500)  # each row or two a chunk
    assert want == sorted(map(str, substring_dedup.dedup_substrings(repeats).collect()))


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = substring_dedup.dedup_substrings(spark.createDataFrame([("a", "x y"), (None, None)], "name string, body string"), id_col="name", text="body")
    assert sorted(map(str, ((r.name, r.n_words, r.n_removed, r.cuts, r.kept) for r in one.collect()))) == ["('a', 2, 0, None, 'x y')", "(None, 0, 0, None, '')"]


def test_sketch_overestimates():
    r = np.random.default_rng(3)
    windows = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    taken = np.concatenate([windows, windows[:500], windows[:100]])
    blocks = 3
    at = substring_dedup.edges(blocks)
    sums, parts = np.zeros(2 * blocks * substring_dedup.SLOTS, int), []
    for part in np.array_split(taken, 7):
        parts.append(substring_dedup.count_slots(np.concatenate(substring_dedup.slots(part, blocks)), blocks))
        for r, counted in zip(parts[-1].column("range").to_pylist(), parts[-1].column("counted").to_pylist(), strict=True):
            own = substring_dedup.read_slots(counted, int(at[r + 1] - at[r]))
            assert (np.diff(own) >= 0).all()
            np.add.at(sums, at[r] * substring_dedup.SLOTS + own, 1)
    for r, bits in ((x["range"], x["repeated"]) for y in substring_dedup.merge(iter(parts), blocks) for x in y.to_pylist()):
        assert (np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little") == (sums[at[r] * substring_dedup.SLOTS : at[r + 1] * substring_dedup.SLOTS] > 1)).all()
    a, b = substring_dedup.slots(windows, blocks)
    repeated = np.minimum(sums[a], sums[b]) > 1
    assert repeated[:500].all()
    assert repeated[500:].mean() < 0.05


def test_rolling_hashes():
    h = np.random.default_rng(4).integers(0, 1 << 62, 50).astype(np.uint64)
    for k in (1, 2, 5, 20, 50):
        got = substring_dedup.rolling(h, k, 0x9E3779B97F4A7C15)
        want = [int(words.mix(np.array([sum(int(x) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, x in enumerate(h[i : i + k])) + k & (1 << 64) - 1], np.uint64))[0]) for i in range(51 - k)]
        assert got.tolist() == want
    assert len(substring_dedup.rolling(h, 51, 3)) == 0


def test_long_words_apart():
    import pyarrow as pa

    a, b = "x" * 65536, "y" * 65536
    h, _ = words.words(pa.array([a + b, b + a]), substring_dedup.CASED)
    assert h[0] != h[1]


def plain_fim(doc_id, text):
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not u or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text or ""
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    texts = [None, "", " ", "a", "word", "two words", "é😀 ü\r\n\tx", "has <P> in it", "ends <", "<S", "a<b>c< P>", prose(1, 300), "Z" * 100000, ("ab1 " * 40000).strip(), "日本語テキスト" * 50, "\x00\x01z"]
    rows = [(i, t) for i, t in enumerate(texts * 12)] + [(7, "two words"), (7, "two words"), (None, "no id here"), (-5, "minus five")]
    d = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = fill_middle.fill_in_middle(d)
    assert got.columns == ["doc_id", "text", "output", "n", "form", "prefix_chars", "middle_chars"]
    found = got.select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(d.limit(0)).collect() == []


def plain_lloyd(rows, k=16, rounds=3):
    fit = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(fit, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in fit:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else old for o, old in zip(own, c, strict=True)]
    out = [(i, *near(v)) for i, v in fit]
    per = {}
    for _, d, j in out:
        per[j] = per.get(j, 0) + d
    return [(i, j, d, per[j], sum(per.values()), sha(",".join(map(str, c[j])))) for i, d, j in out]


def vectors(n, seed=5):
    r = np.random.default_rng(seed)
    v = [(i, [float(np.float32(x)) for x in r.normal(size=64) * (0.01 if i % 7 == 0 else 1)]) for i in range(n)]
    v += [(500, v[3][1]), (500, v[4][1]), (3, v[3][1]), (None, v[5][1]), (601, None), (602, []), (603, [1.0] * 63), (604, [1.0] * 63 + [None]), (605, [float("nan")] + [0.0] * 63), (606, [float("inf")] + [0.0] * 63), (607, [0.0] * 64), (608, [0.0] * 64), (609, [-0.5 / 64] * 64)]
    return v


@pytest.mark.parametrize("n", [0, 5, 150])
def test_lloyd(spark, n):
    rows = vectors(n + 6)[:n] + (vectors(n + 6)[n + 6 :] if n else [])
    d = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, q int").repartition(4)
    got = centroids.cluster(d).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.centroid_digest(F.col("centroid")).alias("digest"))
    assert sorted(map(str, plain_lloyd(rows))) == sorted(str(tuple(r)) for r in got.collect())


def test_lloyd_in_another_shape(spark):
    rows = [(i, [float(i % 3), float(i)]) for i in range(20)]
    d = spark.createDataFrame(rows, "name long, v array<double>")
    got = centroids.cluster(d, k=2, rounds=0, dim=2, scale=1, id_col="name", vector="v").collect()
    assert len(got) == 20
    assert len({r.cluster for r in got}) == 2
    with pytest.raises(Exception, match="can't be clustered"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_fill_in_middle", "op13_centroid_clustering"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
