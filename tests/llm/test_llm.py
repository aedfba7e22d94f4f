"""The training-data operators against brute force, on small fixtures with odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from quire.llm import decontaminate, embedding_dedup, labelled, line_dedup, mixing, ngram_join, quality, sharding, token_counts, toxicity, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (str(i % 3) if i % 7 == 0 else "") for i in r.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, "  "), (5, None), (6, ""), (7, "one"), (8, "one"), (9, prose(2, 300)), (9, prose(2, 300)), (None, base), (10, prose(3, 4)), (11, prose(3, 4).upper())]
    rows += [(20 + i, prose(50 + i, 60) + "\n" + base[:300]) for i in range(6)]
    rows += [(40 + i, " ".join([*prose(99, 100).split()[: 100 - i], *(["changed"] * i)])) for i in range(0, 12, 2)]
    rows += [(70, ("word " * 30000).strip()), (71, "x" * 50000)]
    frame = [(i, t, "en", None if i is None else f"s{i % 3}", 0 if t is None else len(t), "clash") for i, t in rows]
    return spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long, size string")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = spark.createDataFrame([(100, "a<|endoftext|>b"), (101, "naïve ½ ² 日本語  \x1c x"), (102, "don't  stop\n\n\tnow' s's 12ab")], "doc_id long, text string")
    got = token_counts.count_tokens(docs.select("doc_id", "text").unionByName(extra), path).collect()
    t = Tokenizer.from_file(path)
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows_of(docs) + [(r.doc_id, r.text) for r in extra.collect()]]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def brute_windows(docs, items):
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    windows = {}
    for i, x in items:
        w = words(x)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, x in docs:
        w, hit, ids = words(x), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, docs, block):
    base = rows_of(docs)[0][1].split()
    items = [(1, " ".join(base[5:17])), (2, " ".join(base[30:45]).upper()), (3, "one"), (10, None), (11, "..."), (12, " ".join(base[50:54])), (13, prose(1234, 40)), (14, "word " * 40)]
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).drop("spans").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_windows(rows_of(docs), items)


def shingles(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(sets, links):
    par = {i: i for i in sets}

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_jaccard(docs):
    sets = {}
    for i, x in rows_of(docs):
        if i is not None:
            sets.setdefault(i, shingles(x))
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    got = ngram_join.jaccard_classes(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s), want[i]) for i, s in sets.items()}
    assert len(got) == docs.count()
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_trie():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - i], r.integers(0, 1 << 40, i).astype(np.uint64)])) for i in range(25)] + [np.unique(r.integers(0, 1 << 40, 50).astype(np.uint64))]
    probe = np.unique(base)
    want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 80 * len(np.union1d(s, probe))]
    assert ngram_join.trie_links(sets, probe) == want
    assert ngram_join.trie_links([], probe) == []


def test_mixing(docs):
    got = mixing.mix_report(docs).collect()
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    source = {}
    for r in docs.collect():
        source[r.source] = source.get(r.source, 0) + size(r.text)
    assert sorted(r.size for r in got) == sorted(size(x) for _, x in rows_of(docs))
    cap = {k: 2 * v for k, v in source.items()}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(source, key=lambda k: (k is None, k)))}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap[k], weight[k] * mid) for k in cap) < 1.5 * sum(source.values()) else (lo, mid)
    assert {round(r.target, 3) for r in got} == {round(min(cap[k], weight[k] * lo), 3) for k in cap}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    assert mixing.mix_documents(docs).columns == docs.columns


def test_mixing_near_target(spark):
    d = spark.createDataFrame([(i, prose(i, 20 + i % 30 + 3 * (i % 4)), f"s{i % 4 if i % 3 else 0}") for i in range(600)], "doc_id long, text string, source string")
    per = {}
    for r in mixing.mix_report(d).collect():
        per.setdefault((r.target, r.source_size), []).append(r.taken)
    assert all(abs(sum(t) - k) < 60 for (k, _), t in per.items())


def test_sharding(spark, docs):
    got = sharding.shard_report(docs).collect()
    want = sorted((zlib.crc32((x or "").encode()), len((x or "").encode()) + 1) for _, x in rows_of(docs))
    assert sorted((r.text_crc32, r.size) for r in got) == want
    many = spark.createDataFrame([(i, prose(i % 400 if i % 3 else 7, 10 + i % 40), "en", f"s{i % 5}") for i in range(3000)], "doc_id long, text string, lang string, source string")
    got = sharding.shard_report(many).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert len(sizes) == 8
    assert max(sizes) < 1.1 * min(sizes)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())


def test_lines(spark):
    a, b = "the quick brown fox jumps over the lazy dog near the old river bank today while seven gulls watch from a mast and then leave it all behind them again", "a completely different line of text that nobody wrote before this test"
    near = a.replace("again", "agaim")
    d = spark.createDataFrame([(1, f"{a}\n\n{b}"), (2, f"{near}\nonly here\n"), (3, None), (4, ""), (5, f"{b}\n{b}"), (2, f"{near}\nonly here\n"), (None, b)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_kept, r.text) for r in line_dedup.dedup_lines(d).collect())
    assert got == sorted([("1", 3, 3, f"{a}\n\n{b}"), ("2", 3, 2, "only here\n"), ("2", 3, 2, "only here\n"), ("3", 0, 0, None), ("4", 1, 1, ""), ("5", 2, 0, ""), ("None", 1, 0, "")])


def test_lines_without_spaces(spark):
    urls = ["https://example.org/en/1234", "https://example.org/es/9"]
    long = "one small brown dog ran over a lazy grey cat by the old red barn near this river"
    d = spark.createDataFrame([(1, "\n".join(urls)), (2, long), (3, long.replace("lazy", "lasy")), (4, "日本語の文章がここにあります東京都は首都です\n日本語の文章がここにあります大阪府は西側です")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.dedup_lines(d).collect()}
    assert got == {1: (2, 2), 2: (1, 1), 3: (1, 0), 4: (2, 2)}


def test_lines_of_one_band(spark):
    lines = [prose(700 + i, 30) for i in range(20)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(100 + i, x + ".") for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(d, bands=1, rows=0).collect()}  # all lines meet
    assert got == {i + at: int(at == 0) for i in range(20) for at in (0, 100)}


def test_quality(spark):
    good = [(i, prose(i, 40) + ".", 1, 0) for i in range(200)]
    bad = [(i, prose(i, 40).upper().replace(" ", "!! "), 0, 0) for i in range(200, 300)]
    d = spark.createDataFrame([(i, t) for i, t, *_ in good + bad] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in good + bad], "doc_id long, quality int, toxic int")
    got = quality.score_quality(d, labels).collect()
    assert len(got) == 303
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id < 200) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert all(r.held_out == labelled.is_held_out(r.doc_id) for r in got)
    none = quality.score_quality(d, labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}


def test_toxicity(spark):
    bad = ["stupidhead", "idiotface", "moronic"]
    rows = [(i, prose(i, 40) + (f" {bad[i % 3]} " + prose(i + 999, 30) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, prose(5, 20) + " stupidhaed " + prose(6, 20))], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].predicted == y for i, _, y in rows if got[i].held_out)
    assert got[902].score > max(got[i].score for i, _, y in rows if not y)  # a misspelling never seen
    assert 0 <= got[900].score == got[901].score <= 1


def test_urls(spark):
    cases = ["https://WWW.Example.org/es/1?q", "http://a.org", "http://a.org/x", "ftp://example.org/en/12#f", "x.com/fr/", "https://m.com/fr/1", "http://b.com/de/2", None, "http://notorg/x", "http://zz.net/path"]
    d = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(d).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][:3] == ("a.org", "", None)
    assert got[2] == ("a.org", "/x", "org/", "allow")
    assert got[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[4][:3] == ("", "", None)
    assert got[5][2:] == ("com/fr/", "allow")
    assert got[6][2:] == ("com/de/", "block")
    assert got[7] == ("", "", None, "allow") or got[7][:3] == ("", "", None)
    assert got[8][2] is None
    assert len(got) == len(cases)


def test_embeddings(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 16)).astype(np.float32)
    x[200:230] = x[:30] + r.normal(size=(30, 16)).astype(np.float32) * 0.02
    x[230:260] = x[5]
    x[260:300] = x[6] + r.normal(size=(40, 16)).astype(np.float32) * 0.02
    rows = [(i, x[i].tolist(), i % 2 if i < 100 else 0) for i in range(300)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, x[5].tolist(), None), (904, [], 0), (905, [1.0, None], 0)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    sim = unit @ unit.T >= 0.98
    lab = np.array([q[2] for q in rows])
    sim &= (lab[:, None] == lab[None, :]) & ~np.eye(300, dtype=bool)
    want = classes({i: 0 for i in range(300)}, [(i, j) for i, j in zip(*np.nonzero(sim), strict=True) if i < j])
    got = {q.vec_id: q for q in embedding_dedup.near_duplicates(d).collect()}
    assert [got[i].n_links for i in range(300)] == sim.sum(1).tolist()
    assert [got[i].component_id for i in range(300)] == [want[i] for i in range(300)]
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(900, 906))


def test_embeddings_of_dense_groups(spark):
    r = np.random.default_rng(3)
    a = np.eye(64)[0]
    b = a * 0.985 + np.eye(64)[1] * np.sqrt(1 - 0.985**2)
    x = np.concatenate([c + r.normal(size=(40, 64)) * 0.002 for c in (a, b)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    d = spark.createDataFrame([(i, [float(e) for e in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(d).collect()
    assert {r.component_id for r in got} == {0}
    assert all(r.n_links == links[r.vec_id] for r in got)


def test_embeddings_of_a_large_group(spark):
    r = np.random.default_rng(4)
    x = np.eye(64)[0] + r.normal(size=(300, 64)) * 0.01
    d = spark.createDataFrame([(i, [float(e) for e in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(d).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 299)}


def test_empty(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    import public_tokenizers

    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert ngram_join.jaccard_classes(none).count() == 0
    assert mixing.mix_report(none).count() == 0
    assert sharding.shard_report(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert quality.score_quality(none, labels).count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, d), "test")
        assert docs.columns == list(C.COLUMNS)
    assert C.run(spark, d).count() == docs.count()


def test_embeddings_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, comp string")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted([("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 1, "1"), ("None", 0, "None")])


def test_sharding_of_rows_without_ids(spark):
    hot = "a hot text " * 18
    d = spark.createDataFrame([(None, hot, "en", "s")] * 900 + [(i, prose(i, 30), "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    sizes = {}
    for r in sharding.shard_report(d).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(sizes) == 8
    assert max(sizes.values()) < 1.2 * min(sizes.values())


def test_lines_against_all_pairs(spark):
    r = np.random.default_rng(8)
    lines = []
    for i in range(120):
        x = prose(3000 + i, int(r.integers(2, 40)))
        lines.append(x)
        for _ in range(int(r.integers(0, 4))):
            y = list(x)
            for k in r.integers(0, len(y), int(r.integers(1, 1 + max(1, len(y) // 40)))):
                y[k] = "q"
            lines.append("".join(y))
    lines = sorted(set(lines))
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(dict(enumerate(sets)), links)
    d = spark.createDataFrame([(i, x, 0) for i, x in enumerate(lines)], "doc_id long, text string, h int")
    kept = {q.doc_id for q in line_dedup.dedup_lines(d).collect() if q.n_kept}
    right = sum(kept >= {want[i]} and (i in kept) == (want[i] == i) for i in want)
    print(f"lines as by all pairs: {right} of {len(lines)}")
    assert right >= 0.98 * len(lines)


def test_rules_compiled(spark, docs):
    from pyspark.sql import functions as F

    stats = quality.statistics(F.col("text"))
    rows = docs.select(F.array(*stats.values()).alias("x")).collect()
    x = np.array([q.x for q in rows])
    r = np.random.default_rng(2)
    rules = [tuple((int(j), bool(r.integers(0, 2)), float(r.choice(x[:, j]))) for j in r.integers(0, x.shape[1], 3)) for _ in range(20)]
    weights = r.normal(size=20)
    z = 0.3 + sum(w * quality.holds(rule, x) for rule, w in zip(rules, weights, strict=True))
    got = docs.select(quality.compiled(rules, weights, 0.3, list(stats.values())).alias("p")).collect()
    assert np.allclose([q.p for q in got], 1 / (1 + np.exp(-z)))


def test_toxicity_fit_is_the_same_in_blocks(monkeypatch):
    texts = [prose(i, 3 + i % 50) + (" idiot" if i % 3 == 0 else "") for i in range(60)]
    y = [int(i % 3 == 0) for i in range(60)]
    whole = toxicity.train(texts, y, epochs=5)
    blocks = toxicity._blocks
    monkeypatch.setattr(toxicity, "_blocks", lambda docs: blocks(docs, 100))
    parts = toxicity.train(texts, y, epochs=5)
    assert np.allclose(whole[0], parts[0], atol=1e-4)
    assert abs(whole[1] - parts[1]) < 1e-6


def test_links_of_a_group():
    import pyarrow as pa

    lines = [prose(900 + i // 3, 30) + "." * (i % 3) for i in range(60)]
    sig = line_dedup.signatures(lines)
    bands = line_dedup.band_keys(sig, 13, 5)

    def linked(key, component):
        t = pa.table({"key": np.full(60, key, np.int64), "h": np.arange(60), "c": np.asarray(component, np.int64), "sig": pa.array([s.tobytes() for s in sig], pa.binary()), "line": pa.array([x.encode() for x in lines], pa.binary())})
        return line_dedup._linked(t, np.zeros(1, np.int64), 13, 5)

    no_band = 5  # a key of no band: no pair is left to an earlier band
    assert sorted(linked(no_band, range(60))) == sorted((3 * i, 3 * i + k) for i in range(20) for k in (1, 2))  # each joins two components
    assert linked(no_band, np.arange(60) // 3) == []
    # Pairs that share one of the bands before the fourth are compared there and not here.
    r = np.random.default_rng(11)
    for i in range(60):
        x = list(prose(900 + i // 2, 30))
        for k in r.integers(0, len(x), 3 * (i % 2)):
            x[k] = "#"
        lines[i] = "".join(x)
    sig = line_dedup.signatures(lines)
    bands = line_dedup.band_keys(sig, 13, 5)
    found, every = linked(int(bands[0, 3]), range(60)), linked(no_band, range(60))
    assert sorted(found) == sorted(x for x in every if (bands[x[0], :3] != bands[x[1], :3]).all())
    assert 0 < len(found) < len(every)


def test_shingle_hashes_by_a_plain_loop():
    lines = ["", "a", "abcd", "abcde", "Abcdefg", "", "\u65e5\u672c", "\u0130x", "the quick brown fox", "xyz"]
    want, count = [], []
    for x in (y.lower() for y in lines):
        places = max(1, len(x) - 4)
        for i in range(places):
            h = 0
            for j in range(5):
                h = (h * 0x100000001B3 + (ord(x[i + j]) + 1 if i + j < len(x) else 0)) % 2**64
            want.append(h)
        count.append(places)
    h, n = line_dedup.shingle_hashes(lines)
    assert n.tolist() == count
    assert h.tolist() == line_dedup.mix(np.array(want, np.uint64)).tolist()
