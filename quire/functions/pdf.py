"""The page count of a PDF from its structure: cross-references, object streams, page tree. Small helpers for one file."""

from __future__ import annotations

import re
import zlib

_START = re.compile(rb"startxref\s+(\d+)")
_OBJECT = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
_REF = re.compile(rb"(\d+)\s+(\d+)\s+R\b")


def _value(dictionary: bytes, key: bytes) -> bytes | None:
    """What stands behind a key of a dictionary's own level, as bytes."""
    depth, i, n = 0, 0, len(dictionary)
    while i < n:
        c = dictionary[i : i + 2]
        if c == b"<<":
            depth, i = depth + 1, i + 2
        elif c == b">>":
            depth, i = depth - 1, i + 2
        elif c[:1] == b"(":  # strings hold anything; their brackets are balanced or escaped
            level, i = 1, i + 1
            while i < n and level:
                level += {b"(": 1, b")": -1}.get(dictionary[i : i + 1], 0)
                i += 2 if dictionary[i : i + 1] == b"\\" else 1
        elif depth == 1 and c[:1] == b"/" and (m := re.compile(rb"/" + key + rb"(?![A-Za-z0-9_.#-])\s*").match(dictionary, i)):
            return dictionary[m.end() :]
        else:
            i += 1
    return None


def _number(dictionary: bytes, key: bytes) -> int | None:
    found = _value(dictionary, key)
    m = re.match(rb"-?\d+(?!\s+\d+\s+R\b)", found) if found else None
    return int(m[0]) if m else None


def _dictionary(raw: bytes, at: int) -> bytes:
    """From the ``<<`` at or behind a position to its ``>>``."""
    begin = raw.find(b"<<", at)
    depth = 0
    for m in re.compile(rb"<<|>>|\((?:[^()\\]|\\.)*\)", re.S).finditer(raw, max(begin, 0)):
        depth += {b"<<": 1, b">>": -1}.get(m[0], 0)
        if depth == 0 and m[0] == b">>":
            return raw[begin : m.end()]
    raise ValueError("unclosed dictionary")


class Pdf:
    """Objects of a file, by the newest entry of its chain of cross-references."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.inside, self.root = raw, {}, {}, None
        starts = _START.findall(raw[-2048:]) or _START.findall(raw)
        todo, seen = [int(starts[-1])], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            trailer = self._table(at) if raw[at:].lstrip()[:4] == b"xref" else self._stream_table(at)
            self.root = self.root or _value(trailer, b"Root")
            for key in (b"Prev", b"XRefStm"):
                if (more := _number(trailer, key)) is not None:
                    todo.append(more)

    def _table(self, at: int) -> bytes:
        """A plain table; gives its trailer."""
        end = self.raw.index(b"trailer", at)
        words = self.raw[at:end].split()[1:]
        while len(words) >= 2:
            first, count = int(words[0]), int(words[1])
            for k in range(count):
                offset, _, kind = words[2 + 3 * k : 5 + 3 * k]
                if kind == b"n":
                    self.at.setdefault(first + k, int(offset))
            words = words[2 + 3 * count :]
        return _dictionary(self.raw, end)

    def _stream_table(self, at: int) -> bytes:
        """A table in a stream; gives the stream's dictionary."""
        trailer, data = self._stream(at)
        widths = [int(x) for x in _value(trailer, b"W").split(b"]")[0].strip(b"[ \r\n\t").split()]
        index = _value(trailer, b"Index")
        spans = [int(x) for x in index.split(b"]")[0].strip(b"[ \r\n\t").split()] if index else [0, _number(trailer, b"Size")]
        pos = 0
        for first, count in zip(spans[::2], spans[1::2], strict=True):
            for k in range(first, first + count):
                fields = []
                for w in widths:
                    fields.append(int.from_bytes(data[pos : pos + w], "big"))
                    pos += w
                kind = fields[0] if widths[0] else 1
                if kind == 1 and k not in self.inside:
                    self.at.setdefault(k, fields[1])
                elif kind == 2 and k not in self.at:
                    self.inside.setdefault(k, (fields[1], fields[2]))
        return trailer

    def _stream(self, at: int) -> tuple[bytes, bytes]:
        """Dictionary and inflated bytes of the stream object at an offset."""
        head = _dictionary(self.raw, at)
        begin = self.raw.index(b"stream", self.raw.index(head, at) + len(head)) + 6
        begin += 2 if self.raw[begin : begin + 2] == b"\r\n" else 1
        size = _number(head, b"Length")
        data = self.raw[begin : begin + size] if size is not None else self.raw[begin : self.raw.index(b"endstream", begin)]
        if b"FlateDecode" in (_value(head, b"Filter") or b"")[:40]:
            data = zlib.decompressobj().decompress(data)
        columns = _value(head, b"DecodeParms")
        if columns and (_number(columns[: columns.find(b">>") + 2], b"Predictor") or 1) >= 10:
            data = _unpredicted(data, _number(columns[: columns.find(b">>") + 2], b"Columns") or 1)
        return head, data

    def object(self, number: int) -> bytes:
        """The dictionary of an object, wherever it lies."""
        if number in self.at:
            if not (m := _OBJECT.match(self.raw, self.at[number])) or int(m[1]) != number:
                raise ValueError("cross-reference doesn't lead to its object")
            return _dictionary(self.raw, m.end())
        holder, k = self.inside[number]
        head, data = self._stream(self.at[holder])
        pairs = data[: _number(head, b"First")].split()
        return _dictionary(data, _number(head, b"First") + int(pairs[2 * k + 1]))

    def pages(self) -> int:
        """/Count of the page tree's root."""
        catalog = self.object(int(_REF.match(self.root)[1]))
        tree = _value(catalog, b"Pages")
        return _number(self.object(int(_REF.match(tree)[1])), b"Count")


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows stored as differences to the row above (the PNG predictors in use for cross-references: none, left, up)."""
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            row[i] = (row[i] + (above[i] if kind == 2 else row[i - 1] if kind == 1 and i else 0)) & 255
        out, above = out + row, bytes(row)
    return bytes(out)


def page_count(raw: bytes | None) -> int | None:
    """Pages of a PDF; null for other files and for those whose structure can't be followed."""
    if not raw or not raw[:1024].lstrip().startswith(b"%PDF-"):
        return None
    try:
        n = Pdf(raw).pages()
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error, RecursionError):
        return None
    return n if n is not None and n >= 0 else None
