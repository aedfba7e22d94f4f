"""Alignment of blocks against every alignment, text differences against the standard library, rules by literal cases."""

import difflib
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import matching as M
from quire.operators import evaluate
from quire.operators import scoring as O


def every_alignment(n, m):
    """All monotone ways to pair some rows with some columns."""
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.combinations(range(m), k):
                yield list(zip(rows, columns, strict=True))


def test_align_against_every_alignment():
    r = np.random.default_rng(1)
    for _ in range(150):
        n, m = int(r.integers(0, 5)), int(r.integers(0, 5))
        scores, gap = r.integers(-3, 8, (n, m)), int(r.integers(0, 4))
        worth = lambda pairs: sum(scores[i, j] for i, j in pairs) - gap * (n + m - 2 * len(pairs))  # noqa: B023, E731
        moves = M.align(scores, gap)
        assert [i for k, i, _ in moves if k != M.MISSING] == list(range(n))
        assert [j for k, _, j in moves if k != M.EXTRA] == list(range(m))
        assert worth([(i, j) for k, i, j in moves if k == M.PAIR]) == max(map(worth, every_alignment(n, m)))


BLOCKS = "array<struct<kind: string, text: string>>"


def test_alignment(spark):
    title, body, code = ("heading", "a title"), ("paragraph", "one two three four"), ("code", "x = 1")
    rows = [
        (1, [title, body, code], [title, body, code]),
        (2, [body, code], [title, body, code]),
        (3, [title, ("paragraph", "something else"), body], [title, body]),
        (4, None, [title]),
        (5, [], None),
        (6, [("paragraph", "one two"), ("paragraph", None)], [("code", "one two three"), ("paragraph", " ")]),
    ]
    t = spark.createDataFrame([(i, "clash", a, e) for i, a, e in rows], f"id int, status string, actual {BLOCKS}, expected {BLOCKS}")
    got = {r.id: r for r in O.align_blocks(t).collect()}
    steps = lambda i: [(s.status, s.actual_index, s.expected_index, round(s.score, 6)) for s in got[i].steps]
    assert steps(1) == [("paired", 0, 0, 1.0), ("paired", 1, 1, 1.0), ("paired", 2, 2, 1.0)]
    assert steps(2) == [("missing_expected", None, 0, 0.0), ("paired", 0, 1, 1.0), ("paired", 1, 2, 1.0)]
    assert got[2].aligned_score == pytest.approx((1.0 + 1.25) / (1.15 + 1.0 + 1.25))
    assert steps(3) == [("paired", 0, 0, 1.0), ("extra_actual", 1, None, 0.0), ("paired", 2, 1, 1.0)]
    assert got[3].aligned_score == pytest.approx((1.15 + 1.0) / (1.15 + 1.0 + 1.0))
    assert steps(4) == [("missing_expected", None, 0, 0.0)]
    assert (steps(5), got[5].aligned_score) == ([], None)
    assert steps(6) == [("paired", 0, 0, 0.8), ("paired", 1, 1, 1.0)]
    assert got[6].aligned_score == pytest.approx((1.25 * 0.8 + 1.0) / 2.25)
    by_ratio = {r.id: r for r in O.align_blocks(t, similarity="ratio").collect()}
    assert by_ratio[6].steps[0].score == pytest.approx(difflib.SequenceMatcher(None, "one two three", "one two").ratio(), abs=1e-6)
    assert O.align_blocks(t.limit(0)).collect() == []


def changed(r, items, k, fresh):
    out = list(items)
    for _ in range(k):
        if out and r.random() < 0.5:
            del out[r.randrange(len(out))]
        else:
            out.insert(r.randrange(len(out) + 1), r.choice(fresh))
    return out


def test_alignment_takes_a_batch_in_parts():
    blocks = pa.array([[{"kind": "paragraph", "text": f"w{i}"}] for i in range(3 * O.AT_ONCE + 1)])
    parts = list(O._aligned("words", O.GAP, O.KIND_BONUS).func(iter([(blocks, blocks)])))
    assert [len(x) for x in parts] == [O.AT_ONCE] * 3 + [1]
    assert all(x["status"] == "paired" and x["score"] == 1.0 for part in parts for steps in part.to_pylist() for x in steps)


def test_matching_against_difflib():
    r = random.Random(3)
    for _ in range(400):
        letters = "abcdefghijklmnopqrstuvwxyz \n"[: r.choice([2, 3, 6, 28])]
        a = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 9, 60, 230, 420])))
        b = "".join(changed(r, a, r.randrange(8), "xyz")) if r.random() < 0.7 else "".join(r.choice(letters) for _ in range(r.randrange(300)))
        want = difflib.SequenceMatcher(None, a, b)
        assert M.matching_blocks(a, b) == [tuple(x) for x in want.get_matching_blocks()][:-1]
        assert M.ratio(a, b) == want.ratio()


def test_matching_of_long_runs_against_difflib():
    r = random.Random(5)
    for letters in ("".join(map(chr, range(0x4E00, 0x4E00 + 400))), "etaoinshr dlu" * 4 + "XYZQJK0123456789.,"):
        for n in (150, 700, 1500):
            a = "".join(r.choice(letters) for _ in range(n))
            for b in ("".join(changed(r, a, 12, letters)), a[n // 2 :] + a[: n // 2], a[: n // 3] * 3, a):
                assert M.matching_blocks(a, b) == [tuple(x) for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks()][:-1]


def test_matching_time_of_a_long_text():
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshrdlucmfwypvbgkqjxz"[: r.choice([8, 14, 26])]) for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    lines = [" ".join(r.choice(words) for _ in range(12)) + "\n" for _ in range(500)]
    other = [x for i, line in enumerate(lines) if i % 11 != 3 for x in ([line, line] if i % 13 == 5 else [line])]
    begin = time.process_time()
    assert 0 < M.ratio("".join(lines), "".join(other)) < 1
    assert time.process_time() - begin < 1.5


def test_hunks_against_difflib():
    r = random.Random(4)
    for _ in range(400):
        a = [r.choice("abcdefg") + "\n" for _ in range(r.randrange(60))]
        b = changed(r, a, r.randrange(9), ["x\n", "a\n", "b\n"])
        for context in (0, 1, 3):
            want = list(difflib.unified_diff(a, b, "old", "new", n=context))
            assert [x for h, lines in M.hunks(a, b, context) for x in [h + "\n", *lines]] == want[2:]


def test_text_differences(spark):
    rows = [(1, "a\r\nb \nc\n", "a\nb\nc"), (2, "a\nb\nc", "a\nX\nc"), (3, None, "a"), (4, "a", None), (5, "", " \n")]
    t = spark.createDataFrame(rows, "id int, expected string, actual string")
    got = {r.id: r for r in O.compare_texts(t).withColumn("diff", O.diff_text(F.col("hunks"), F.lit("e.md"), F.lit("a.md"))).collect()}
    assert [(got[i].status, got[i].similarity) for i in range(1, 6)] == [("match", 1.0), ("diff", 0.8), ("missing", None), ("missing", None), ("match", 1.0)]
    assert got[2].diff == "".join(difflib.unified_diff(["a\n", "b\n", "c"], ["a\n", "X\n", "c"], "e.md", "a.md"))
    assert got[1].diff == ""
    both = [t.select("id", F.col(c).alias("markdown")) for c in ("actual", "expected")]
    assert {(r.id, r.status, r.similarity) for r in evaluate.compare_markdown(*both, "id").collect()} == {(i, got[i].status, got[i].similarity) for i in got}


def test_rules(spark):
    pages = spark.createDataFrame([(1, 1, "1  Introduction\nmany words " + "x " * 300 + "and so we"), (1, 2, "propose a thing.\n\nThe  end"), (2, 1, None)], "doc_id int, page int, text string")
    rules = [
        (1, "a", "contains", "critical", None, "so we propose", None), (1, "b", "contains", "major", None, "no such", None), (1, "c", "page_start", "warn", 1, "1 Introduction", None), (1, "d", "page_start", "critical", 1, "so we", None),
        (1, "e", "page_end", None, 2, "The end", None), (1, "f", "continuation", "major", 1, "and so we", "propose a"), (1, "g", "continuation", "major", 2, "The end", "x"), (1, "h", "page_end", "x", 3, "x", None), (1, "i", "color", "x", 1, "x", None),
        (1, "j", "contains", "x", 1, None, None), (2, "k", "contains", "critical", None, "x", None), (3, "l", "contains", "critical", None, "x", None), (1, "m", None, "warn", 1, "x", None),
    ]
    r = spark.createDataFrame(rules, "doc_id int, check_id string, check_type string, severity string, page int, phrase string, next_phrase string")
    checked = O.check_rules(pages, r)
    assert {x.check_id: (x.status, x.message) for x in checked.collect()} == {
        "a": ("pass", "Found required phrase for a."),
        "b": ("fail", "Missing required phrase: 'no such'."),
        "c": ("pass", "Page 1 start matched expected content."),
        "d": ("fail", "Page 1 start doesn't hold 'so we'."),
        "e": ("pass", "Page 2 end matched expected content."),
        "f": ("pass", "Continuation across pages 1 -> 2 matched."),
        "g": ("error", "No such page or phrase."),
        "h": ("error", "No such page or phrase."),
        "i": ("error", "Unknown check type."),
        "j": ("error", "No such page or phrase."),
        "k": ("fail", "Missing required phrase: 'x'."),
        "l": ("error", "No document."),
        "m": ("error", "Unknown check type."),
    }
    totals = {x.doc_id: (x.n_rules, x.n_failed, x.n_error, x.pass_rate) for x in O.rule_totals(checked).collect()}
    assert totals[1] == (11, 2, 5, pytest.approx((3 + 1 + 1 + 2) / (3 + 2 + 1 + 3 + 1 + 2 + 2 + 1 + 1 + 1 + 1)))
    assert totals[3] == (1, 0, 1, 0.0)
