"""Longest matching blocks of two sequences, their ratio and hunks; and the alignment of two lists of blocks.

Plain numpy helpers of the evaluation operators, each for one document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Sequence

import numpy as np

#: Fixed values of the ratio in use: elements of a second sequence of POPULAR_FROM or more that make up over a hundredth of it don't start a match.
POPULAR_FROM = 200


#: Runs from this length on are looked up as pairs of places, shorter ones by their length.
LONG = 16


def _numbered(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[str | tuple, str | tuple]:
    """Both sequences as strings, or as tuples of small integers that are equal for equal elements."""
    if isinstance(a, str) and isinstance(b, str):
        return a, b
    number: dict = {}
    return tuple(tuple(number.setdefault(x, len(number)) for x in s) for s in (a, b))


def _common(a: str | tuple, i: int, b: str | tuple, j: int, most: int) -> int:
    """How many elements from i and j on are equal, at most ``most``."""
    n, step = 0, 8
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, step * 2
        elif step == 1:
            break
        else:
            step = max(step // 4, 1)
    return n


def _stretched(a: str | tuple, b: str | tuple, i: int, j: int, n: int, within: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """A block with the equal elements next to it, popular ones too."""
    i0, i1, j0, j1 = within
    while i > i0 and j > j0 and a[i - 1] == b[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    return i, j, n + _common(a, i + n, b, j + n, min(i1 - i - n, j1 - j - n))


class _Runs:
    """What both sequences share without popular elements.

    ``levels[k - 1]`` has the places in a at which a run of k begins that b has too, and b's places by run,
    up to LONG; ``long`` has the (place in a, place in b, length) of the runs of LONG and more, as far as they go.
    """

    def __init__(self, a: str | tuple, b: str | tuple):
        counts = Counter(b)
        most = len(b) if len(b) < POPULAR_FROM else len(b) // 100 + 1
        rare = {x for x in counts.keys() & set(a) if counts[x] <= most}
        own, other = ([i for i, x in enumerate(s) if x in rare] for s in (a, b))
        left = self._left(own, len(a))
        lengths = self._left(other, len(b))
        self.levels: list[tuple[list[int], dict]] = []
        for k in range(1, LONG + 1):
            at: dict = {}
            for j in other:
                if lengths[j] >= k:
                    at.setdefault(b[j : j + k], []).append(j)
            own = [i for i in own if left[i] >= k and a[i : i + k] in at]
            if not own:
                break
            wanted = {a[i : i + k] for i in own}
            at = {x: places for x, places in at.items() if x in wanted}
            other = sorted(j for places in at.values() for j in places)
            self.levels.append((own, at))
        self.long = np.zeros((0, 3), np.int64)
        if len(self.levels) == LONG:
            begun = lambda i, j: i and j and a[i - 1] == b[j - 1] and a[i - 1] in rare
            found = [(i, j, _common(a, i, b, j, min(left[i], len(b) - j))) for i in own for j in at[a[i : i + LONG]] if not begun(i, j)]
            self.long = np.array(found, np.int64)

    @staticmethod
    def _left(places: list[int], size: int) -> list[int]:
        """How many places in a row begin at each one."""
        out = [0] * (size + 1)
        for i in reversed(places):
            out[i] = out[i + 1] + 1
        return out

    def longest(self, within: tuple[int, int, int, int]) -> tuple[int, int, int] | None:
        """The longest run of LONG and more, of equal ones the first in a, then in b."""
        i0, i1, j0, j1 = within
        i, j, n = self.long.T
        cut = np.maximum(np.maximum(i0 - i, j0 - j), 0)
        n = np.minimum(np.minimum(i1 - i, j1 - j), n) - cut
        best = n.max(initial=0)
        if best < LONG:
            return None
        at = np.flatnonzero(n == best)
        i, j = (i + cut)[at], (j + cut)[at]
        k = np.lexsort((j, i))[0]
        return int(i[k]), int(j[k]), int(best)


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the blocks that both share: the longest, then those before and behind it; touching ones are one.

    Runs without popular elements are looked for from long to short. What lies before the first run of a length has
    shorter ones only, so a length's places are passed once, however many blocks there are.
    """
    a, b = _numbered(a, b)
    runs, found = _Runs(a, b), []
    todo, parts = [(0, len(a), 0, len(b))], []
    while todo:
        within = todo.pop()
        run = runs.longest(within) if len(runs.long) else None
        if run is None:
            parts.append(within)
            continue
        i, j, n = _stretched(a, b, *run, within)
        found.append((i, j, n))
        todo += [part for part in ((within[0], i, within[2], j), (i + n, within[1], j + n, within[3])) if part[0] < part[1] and part[2] < part[3]]
    for k in range(min(len(runs.levels), LONG - 1), 0, -1):
        own, at = runs.levels[k - 1]
        shorter = []
        for i0, i1, j0, j1 in parts:
            p = bisect_left(own, i0)
            while p < len(own) and own[p] + k <= i1 and j0 + k <= j1:
                places = at[a[own[p] : own[p] + k]]
                q = bisect_left(places, j0)
                if q == len(places) or places[q] + k > j1:
                    p += 1
                    continue
                i, j, n = _stretched(a, b, own[p], places[q], k, (i0, i1, j0, j1))
                found.append((i, j, n))
                if i0 < i and j0 < j:
                    shorter.append((i0, i, j0, j))
                i0, j0 = i + n, j + n
                p = bisect_left(own, i0, p)
            if i0 < i1 and j0 < j1:
                shorter.append((i0, i1, j0, j1))
        parts = shorter
    found += [(i0, j0, _common(a, i0, b, j0, min(i1 - i0, j1 - j0))) for i0, i1, j0, j1 in parts]  # popular ones at the start
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(x for x in found if x[2]):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def ratio(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """Twice the matched elements over all elements of both; 1 if both are empty."""
    total = len(a) + len(b)
    return 2.0 * sum(n for _, _, n in matching_blocks(a, b)) / total if total else 1.0


def _span(start: int, n: int) -> str:
    return f"{start + 1}" if n == 1 else f"{start + (n > 0)},{n}"


def hunks(a: Sequence[str], b: Sequence[str], context: int = 3) -> list[tuple[str, list[str]]]:
    """Unified hunks that turn the lines of a into those of b: (header, lines marked by ' ', '-' or '+')."""
    ends = [*matching_blocks(a, b), (len(a), len(b), 0)]
    changes, i, j = [], 0, 0  # stretches [i, i2) of a that become [j, j2) of b
    for x, y, n in ends:
        if x > i or y > j:
            changes.append((i, x, j, y))
        i, j = x + n, y + n
    groups: list[list] = []
    for c in changes:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for g in groups:
        lead = min(context, g[0][0])
        trail = min(context, len(a) - g[-1][1])
        at, lines = g[0][0] - lead, []
        for i, i2, j, j2 in g:
            lines += [" " + x for x in a[at:i]] + ["-" + x for x in a[i:i2]] + ["+" + x for x in b[j:j2]]
            at = i2
        lines += [" " + x for x in a[at : at + trail]]
        of_a, of_b = g[-1][1] - g[0][0] + lead + trail, g[-1][3] - g[0][2] + lead + trail
        out.append((f"@@ -{_span(g[0][0] - lead, of_a)} +{_span(g[0][2] - lead, of_b)} @@", lines))
    return out


def word_overlap(actual: list[list[str]], expected: list[list[str]], unit: int) -> np.ndarray:
    """(actual, expected): twice the distinct words that two blocks share over those of both, in units, rounded down; 1 if both have none."""
    own, other = [set(x) for x in actual], [set(x) for x in expected]
    at: dict[str, list[int]] = {}
    for j, x in enumerate(other):
        for w in x:
            at.setdefault(w, []).append(j)
    sizes, out = np.array([len(x) for x in other], np.int64), np.zeros((len(own), len(other)), np.int64)
    for i, x in enumerate(own):
        hit = [j for w in x for j in at.get(w, ())]
        both = np.bincount(np.array(hit, np.int64), minlength=len(other)) if hit else np.zeros(len(other), np.int64)
        total = sizes + len(x)
        out[i] = np.where(total > 0, 2 * unit * both // np.maximum(total, 1), unit)
    return out


#: Moves of an alignment.
PAIR, EXTRA, MISSING = 0, 1, 2


def align(scores: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """Moves (kind, i, j) from start to end of the best alignment of rows with columns, by whole-number scores.

    Each pair gains its score, each row or column left alone loses ``gap``. From the end on, of equally
    good moves a pair goes before an extra row, and that before a missing column. A row of
    the matrix is the state of the fold over the rows; moves are kept in a byte a cell.
    """
    n, m = scores.shape
    steps = gap * np.arange(m + 1, dtype=np.int64)
    row = -steps
    moves = np.full((n + 1, m + 1), MISSING, np.int8)
    moves[1:, 0] = EXTRA
    for i in range(n):
        pair, extra = row[:-1] + scores[i], row[1:] - gap
        best = np.concatenate([row[:1] - gap, np.maximum(pair, extra)])
        row = np.maximum.accumulate(best + steps) - steps  # a run of missing columns costs a gap each
        moves[i + 1, 1:] = np.where(row[1:] == pair, PAIR, np.where(row[1:] == extra, EXTRA, MISSING))
    out, i, j = [], n, m
    while i or j:
        kind = int(moves[i, j])
        i, j = i - (kind != MISSING), j - (kind != EXTRA)
        out.append((kind, i, j))
    return out[::-1]
