"""Measures of two texts that Spark has no function for: helpers of Arrow batches, and the columns made of them."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


class _Automaton:
    """All substrings of a text: each state is a set of them that end at the same places, the first of which it knows."""

    def __init__(self, text: str):
        self.next, self.link, self.size, self.end = [{}], [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text):
            now = self._state({}, 0, self.size[last] + 1, at)
            while last >= 0 and c not in self.next[last]:
                self.next[last][c], last = now, self.link[last]
            if last >= 0:
                to = self.next[last][c]
                if self.size[to] > self.size[last] + 1:
                    copy = self._state(dict(self.next[to]), self.link[to], self.size[last] + 1, self.end[to])
                    while last >= 0 and self.next[last].get(c) == to:
                        self.next[last][c], last = copy, self.link[last]
                    self.link[to] = to = copy
                self.link[now] = to
            last = now

    def _state(self, moves: dict, link: int, size: int, end: int) -> int:
        for held, x in ((self.next, moves), (self.link, link), (self.size, size), (self.end, end)):
            held.append(x)
        return len(self.size) - 1

    def longest(self, text: str) -> tuple[int, int, int]:
        """(start in text, start in the automaton's text, length) of the longest common run: the first in text of the
        longest, and of those the first in the other."""
        best, state, length = (0, 0, 0), 0, 0
        for at, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
                if length > best[2]:
                    best = (at - length + 1, self.end[state] - length + 1, length)
        return best


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common run, then the same to the left and to the right of it."""
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        if a == b:
            total += len(a)
        elif a and b:
            i, j, n = _Automaton(b).longest(a)
            if n:
                total += n
                todo += [(a[:i], b[:j]), (a[i + n :], b[j + n :])]
    return total


def ratio(a: str, b: str, least: float = 0.0) -> float | None:
    """2 * matched / both lengths, 1 for two empty texts; None, where characters in common alone leave it below least."""
    both = len(a) + len(b)
    if not both:
        return 1.0
    if least and 2 * (Counter(a) & Counter(b)).total() * (1 + 1e-12) < least * both:
        return None
    return 2 * matched(a, b) / both


def _common(x: memoryview, y: memoryview, i: int, j: int, most: int) -> int:
    """How many of the next characters (4 bytes each) agree."""
    n, width = 0, 64
    while n < most:
        width = min(width, most - n)
        if x[4 * (i + n) : 4 * (i + n + width)] == y[4 * (j + n) : 4 * (j + n + width)]:
            n, width = n + width, 2 * width
        elif width == 1:
            break
        else:
            width = max(1, width // 2)
            most = min(most, n + 2 * width + 1)
    return n


def edit_distance(a: str, b: str, most: int | None = None) -> int | None:
    """Insertions, deletions and replacements that turn a into b, by furthest-reaching diagonals; None, if more than most.

    For each number of edits and each diagonal only the farthest place is kept, so the cost follows the square of
    the distance and the length, not the product of the lengths.
    """
    if len(a) > len(b):
        a, b = b, a
    raw_a, raw_b = a.encode("utf-32-le", "surrogatepass"), b.encode("utf-32-le", "surrogatepass")
    x, y, n, m = np.frombuffer(raw_a, np.uint32), np.frombuffer(raw_b, np.uint32), len(a), len(b)
    view_a, view_b = memoryview(raw_a), memoryview(raw_b)
    far = np.array([_common(view_a, view_b, 0, 0, min(n, m))])  # rows of a that diagonal 0 has behind it
    low, edits = 0, 0  # the first diagonal of far: column less row
    while not (low <= m - n < low + len(far) and far[m - n - low] >= n):
        if edits == most:
            return None
        edits += 1
        # A diagonal is reached by a replacement, from the one below by an insertion, from that above by a deletion.
        wide = np.full(len(far) + 4, -2, np.int64)
        wide[2:-2] = far
        far, low = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2]), wide[2:] + 1), low - 1
        diagonal = low + np.arange(len(far))
        far = np.minimum(far, np.minimum(n, m - diagonal))
        keep = (diagonal >= -n) & (diagonal <= m) & (far >= 0) & (far + diagonal >= 0)
        first, last = int(keep.argmax()), len(keep) - int(keep[::-1].argmax())
        far, diagonal, low = np.where(keep, far, -2)[first:last], diagonal[first:last], low + first
        going = np.flatnonzero((far >= 0) & (far < n) & (far + diagonal < m))
        for _ in range(8):
            going = going[x[far[going]] == y[far[going] + diagonal[going]]]
            if not len(going):
                break
            far[going] += 1
            going = going[(far[going] < n) & (far[going] + diagonal[going] < m)]
        for k in going.tolist():
            i, j = int(far[k]), int(far[k] + diagonal[k])
            far[k] += _common(view_a, view_b, i, j, min(n - i, m - j))
    return edits


def _subsequence(a: str, b: str) -> bool:
    """Whether b is a without some of its characters."""
    left = iter(a)
    return all(c in left for c in b)


#: Edits that are looked for along diagonals first.
FEW = 64


def bit_edit_distance(a: str, b: str) -> int:
    """The same as edit_distance, by columns of differences held as bits (Myers 1999, Hyyrö 2001): the cost follows the product
    of the lengths, but few edits are found before, and a step does a whole column, so that texts that are quite unlike each other stay cheap."""
    if len(a) < len(b):
        a, b = b, a
    if _subsequence(a, b):
        return len(a) - len(b)
    if (few := edit_distance(a, b, FEW)) is not None:
        return few
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - same], b[: len(b) - same]
    places: dict[str, list[int]] = {}
    for i, c in enumerate(b):
        places.setdefault(c, []).append(i)
    whole, ones = (1 << len(b)) - 1, {}
    for c, at in places.items():
        held = bytearray(len(b) // 8 + 1)
        for i in at:
            held[i >> 3] |= 1 << (i & 7)
        ones[c] = int.from_bytes(held, "little")
    up, down = whole, 0  # the rows of b where the column grows, and where it falls
    for c in a:
        equal = ones.get(c, 0)
        level = (((equal & up) + up) ^ up) | equal
        right = (down | (whole ^ (whole & (level | up)))) << 1 | 1
        left = (up & level) << 1
        steep = equal | down
        up = (left | ~(steep | right)) & whole
        down = right & steep & whole
    return len(a) + up.bit_count() - down.bit_count()


def bit_edits(a: Column, b: Column) -> Column:
    """See bit_edit_distance; null where a text is."""

    @F.pandas_udf("long")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else bit_edit_distance(p, q) for p, q in zip(a, b)], dtype="Int64")

    return of(a, b)


def sequence_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """See ratio; null where a text is, or where it's surely below least."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio(p, q, least) for p, q in zip(a, b)], dtype="float64")

    return of(a, b)


def diagonal_edits(a: Column, b: Column) -> Column:
    """See edit_distance; null where a text is."""

    @F.pandas_udf("long")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else edit_distance(p, q) for p, q in zip(a, b)], dtype="Int64")

    return of(a, b)
