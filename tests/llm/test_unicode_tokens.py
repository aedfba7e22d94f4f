"""Token counts of all scripts against the library."""

import json
import random
import unicodedata

import pytest

from quire.llm import token_counts as T

SCRIPTS = ["The quick brown fox", "Привет, мир 2024!", "日本語のテキスト、漢字かな交じり文。", "中文文本没有空格", "Ελληνικά κείμενα", "النص العربي ١٢٣", "हिन्दी पाठ", "한국어 문장", "ไทย ไม่มีช่องว่าง", "naïve café ½ x² Ⅷ", "emoji 😀👍🏽 done", "𝔸𝔹 astral 𝟘", "tab\t\tnew\n\nline 　wide sep", "zero​width \x1c\x1d", "it's we'll THEY'RE", "á combining", "᠎﻿", ""]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def counted(spark, texts, path):
    rows = T.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    return [r.n_tokens for r in sorted(rows, key=lambda r: r.doc_id)]


def library(texts, path):
    t, _ = T._tokenizer(path)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_scripts(spark, path):
    r = random.Random(1)
    texts = SCRIPTS + ["".join(r.choice(SCRIPTS)[i : i + r.randrange(1, 9)] for i in range(12)) for _ in range(400)]
    assert counted(spark, texts, path) == library(texts, path)
    _, plain = T.patterns()
    assert sum(plain.fullmatch(x) is not None for x in SCRIPTS) >= 14  # only the newest, astral letters and Python's own spaces are left to the library


def test_every_settled_character(path):
    piece, plain = T.patterns()
    settled = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))) if plain.fullmatch(c)]
    assert len(settled) > 50_000
    r = random.Random(2)
    r.shuffle(settled)
    t, _ = T._tokenizer(path)
    for i in range(0, len(settled), 40):
        text = "".join(c + r.choice(["", " ", "a", "1", "!", "\n"]) for c in settled[i : i + 40])
        whole = t.encode(text, add_special_tokens=False).ids
        assert whole == [k for x in piece.findall(text) for k in t.encode(x, add_special_tokens=False).ids], [unicodedata.name(c, hex(ord(c))) for c in settled[i : i + 40]]


def test_other_ways_to_cut(spark, path, tmp_path):
    with open(path, encoding="utf-8") as f:
        facts = json.load(f)
    for name, change in {"prefix": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, "whole": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}, "lower": {"normalizer": {"type": "Lowercase"}}}.items():
        other = tmp_path / f"{name}.json"
        other.write_text(json.dumps(facts | change), encoding="utf-8")
        assert counted(spark, SCRIPTS, str(other)) == library(SCRIPTS, str(other))
