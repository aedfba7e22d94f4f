"""Words of whole texts as 64-bit hashes, computed with numpy over Arrow buffers.

A word is a maximal run of bytes that aren't separators. Both classes of separators in use
are ASCII, so bytes of UTF-8 sequences always belong to words and texts needn't be decoded.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MUL = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW = np.multiply.accumulate(np.full(1 << 16, 0x100000001B3, dtype=np.uint64))


def release() -> None:
    """Gives a worker's freed memory back to the system at a task's end, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lut(separators: list[tuple[int, int]], lower: bool = True) -> np.ndarray:
    """Per byte: 0 for a separator, else the byte (with A-Z lower-cased), plus 1 (as 16 bits)."""
    t = np.arange(1, 257, dtype=np.uint16)
    t[65 : 65 + 26] += 32 * lower
    for lo, hi in separators:
        t[lo : hi + 1] = 0
    return t


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased texts: digits, letters, non-ASCII. (A-Z count, as they are lower-cased first.)
ALNUM = lut([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Words [^\x20\x09-\x0D]+ of lower-cased texts: whatever stands between white space.
SPACED = lut([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _MUL
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], col: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of ``col`` or a single row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words(col: pa.Array, table: np.ndarray, spans: bool = False):
    """(hash of every word, offsets of each row's words[, first byte, end byte of every word])."""
    data, off = buffers(col)
    n, step = len(data), 1 << 20
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    hashes, starts, ends = [], [], []
    at = 0
    while at < n:
        to = min(n, at + step)
        while to < n:  # never cut a word: move on to a separator or the next row
            stop = np.flatnonzero((table[data[to : to + 65536]] == 0) | first[to : to + 65536][: len(data[to : to + 65536])])
            if len(stop):
                to += int(stop[0])
                break
            to = min(n, to + 65536)
        b = table[data[at:to]]
        inside = b > 0
        head = inside.copy()
        head[1:] &= ~inside[:-1] | first[at + 1 : to]
        s = np.flatnonzero(head)
        if len(s):
            tail = inside.copy()
            tail[:-1] &= ~inside[1:] | first[at + 1 : to]
            e = np.flatnonzero(tail) + 1
            pos = np.arange(to - at) - np.repeat(s, np.diff(np.append(s, to - at)), axis=0) if s[0] == 0 else np.concatenate([np.zeros(s[0], np.int64), np.arange(s[0], to - at) - np.repeat(s, np.diff(np.append(s, to - at)))])
            v = b.astype(np.uint64) * _POW[pos & 0xFFFF]
            far = np.flatnonzero(pos > 0xFFFF)  # each further 64 KB of one word has multipliers of its own
            v[far] *= mix((pos[far] >> 16).astype(np.uint64)) | np.uint64(1)
            hashes.append(mix(np.add.reduceat(v, s) + (e - s).astype(np.uint64)))
            starts.append(s + at)
            if spans:
                ends.append(e + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    rows = np.searchsorted(s, off)
    if spans:
        return h, rows, s, np.concatenate(ends) if ends else s
    return h, rows


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position; the last k - 1 positions have none."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = (out + h[j : j + m]) * _POW[97 + j] if j else h[:m] * _POW[97]
    return mix(out + np.uint64(k))


def shingle_sets(h: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct k-word shingles, sorted; a row of fewer words has the whole as one, a row without words none."""
    g = grams(h, k)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
