"""Token counts by a two-tier lookup of pre-tokens, without shuffling any pre-token.

Tier 1 is a broadcast table from the corpus's frequent pre-tokens to their number of tokens;
tier 2 encodes whatever the table misses and keeps it in the Python worker's own cache. Both
only save encoding work: each count equals the library's for any content of table and cache.

The table comes from a bounded sample of about SAMPLE rows (of their whole texts): every task keeps
a bounded lossy count (at most ``64 * per_task`` pre-tokens and those of one slice) and emits its top
``per_task`` as one row; only these rows are merged. Its size is fixed by ``table_size``.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .words import slices

#: The pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(re.escape(chr(points[i])) + ("-" + re.escape(chr(points[j])) if j > i else ""))
        i = j + 1
    return "".join(out)


@functools.cache
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """PATTERN in the standard library's terms, and texts for which it means the same whatever the library's version of Unicode.

    Letters and digits are classes of the basic plane by ``unicodedata``. A character is settled if it is a
    letter, digit, space or anything else now as well as in Unicode 3.2 (where most emoji weren't assigned, which
    is anything else too). Letters and digits that are newer, of other planes or unassigned aren't settled,
    nor are the four separators that only Python takes for spaces.
    """
    white = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    sort = lambda x, kind: "S" if x in white else kind[0] if kind[0] in "LN" else "O"
    letters, digits, settled = [], [], []
    for x in (*range(0xD800), *range(0xE000, sys.maxunicode + 1)):
        now, before = unicodedata.category(chr(x)), unicodedata.ucd_3_2_0.category(chr(x))
        kind = sort(x, now)
        if x > 0xFFFF and kind != "O" or now == "Cn" or kind != sort(x, before) or before[0] == "Z" and kind != "S" or 0x1C <= x <= 0x1F:
            continue
        settled.append(x)
        if kind in "LN":
            (letters if kind == "L" else digits).append(x)
    letter, digit = _ranges(letters), _ranges(digits)
    piece = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^\s{letter}{digit}]+|\s+(?!\S)|\s+")
    # Astral characters are listed by range one by one, which is slow, so the common planes come first.
    return piece, re.compile(f"[{_ranges([x for x in settled if x <= 0xFFFF])}]*+(?:[{_ranges([x for x in settled if x > 0xFFFF])}]++[{_ranges([x for x in settled if x <= 0xFFFF])}]*+)*+")


SAMPLE = 50_000  # rows that the table of frequent pre-tokens comes from
LONGEST = 64  # characters of a pre-token that the table or a cache keeps
CACHE = 1 << 19  # pre-tokens in a worker's cache before it starts anew

_loaded: dict[str, tuple] = {}
_lengths: dict[str, "_Lengths"] = {}  # of this worker; kept from task to task


class _Lengths(dict):
    """Pre-token -> number of tokens; misses are encoded, and kept while there is room."""

    def __init__(self, tokenizer):
        super().__init__()
        self.known, self.tokenizer = {}, tokenizer

    def use(self, known: dict[str, int]) -> _Lengths:
        if self.known is not known:
            self.known = known
            self.update(known)
        return self

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.known) + CACHE:
                self.clear()
                self.update(self.known)
            self[piece] = n
        return n


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        with open(path, encoding="utf-8") as f:
            facts = json.load(f)
        special = [x["content"] for x in facts.get("added_tokens", [])]
        before = facts.get("pre_tokenizer") or {}
        # Pre-tokens are counted one by one only where the file cuts them by PATTERN and changes nothing before.
        alone = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not facts.get("normalizer")
        _loaded[path] = (t, re.compile("|".join(map(re.escape, special)) or "(?!)") if alone else re.compile(""))
    return _loaded[path]


def frequent_pieces(docs: DataFrame, path: str, text: str = "text", sample: int = SAMPLE, per_task: int = 4096, table_size: int = 32768) -> dict[str, int]:
    """The most frequent pre-tokens of about ``sample`` rows, at most ``table_size``, and their numbers of tokens."""

    def top(counts: Counter, n: int) -> pa.Table:
        best = heapq.nlargest(n, counts.items(), key=lambda x: (x[1], x[0]))
        return pa.table({"pieces": pa.array([[x for x, _ in best]], pa.list_(pa.string())), "n": pa.array([[k for _, k in best]], pa.list_(pa.int64()))})

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, text, 1 << 20):
            counts.update(x for x in patterns()[0].findall("\n".join(x for x in batch.column(text).to_pylist() if x)) if len(x) <= LONGEST)
            if len(counts) > 64 * per_task:  # lossy counting: drop the rarest
                counts = Counter(dict(heapq.nlargest(2 * per_task, counts.items(), key=lambda x: x[1])))
        if counts:
            part = TaskContext.get().partitionId() % 32
            yield from top(counts, per_task).add_column(0, "part", pa.array([part], pa.int32())).to_batches()

    def merged(t: pa.Table, most: int = table_size // 4) -> pa.Table:
        counts: Counter = Counter()
        for pieces, n in zip(t.column("pieces"), t.column("n"), strict=True):
            counts.update(dict(zip(pieces.as_py(), n.as_py(), strict=True)))
            if len(counts) > 4 * table_size:
                counts = Counter(dict(heapq.nlargest(2 * table_size, counts.items(), key=lambda x: x[1])))
        return top(counts, most)

    rows = docs.count()
    chosen = docs.select(text).sample(min(1.0, sample / max(rows, 1)), seed=1) if rows > sample else docs.select(text)
    # Each task's summary is one row; 32 groups of them are merged before the driver sees 32 rows of bounded size.
    parts = chosen.mapInArrow(summary, "part int, pieces array<string>, n array<long>").groupBy("part").applyInArrow(lambda t: merged(t), "pieces array<string>, n array<long>").toArrow()
    best = merged(parts, table_size).column("pieces")[0].as_py() if parts.num_rows else []
    tokenizer, _ = _tokenizer(path)
    return {x: len(e.ids) for x, e in zip(best, tokenizer.encode_batch(best, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row, as the ``tokenizers`` file at ``path`` gives them.

    No begin, end or added tokens are counted; a special string inside a text is one token.
    Null and empty texts have 0 bytes and 0 tokens. Rows, repeats and null ids are kept as they
    are; columns besides the two named are ignored. Texts that hold a special string or characters
    that aren't settled (see ``patterns``) go to the library whole, as do all texts if the file cuts
    pre-tokens in another way; the rest goes through the two tiers. No text is cut.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_pieces(docs, path, text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special = _tokenizer(path)
        if path not in _lengths:
            _lengths[path] = _Lengths(tokenizer)
        piece, plain = patterns()
        get, find = _lengths[path].use(known.value).__getitem__, piece.findall
        for batch in slices(batches, text):
            n = []
            for x in batch.column(text).to_pylist():
                if not x:
                    n.append(0)
                elif special.search(x) or plain.fullmatch(x) is None:
                    n.append(len(tokenizer.encode(x, add_special_tokens=False).ids))
                else:
                    n.append(sum(map(get, find(x))))
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column(text)), 0), pa.int64())
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), size, tokens, pc.greater(tokens, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
