"""The matching-block ratio of two texts: twice the length of their common blocks over the length of both.

The longest common block is taken (the first in a, then in b, if several are as long), then the longest ones before and behind
it, and so on. In a second text of 200 characters or more, characters that make up over a hundredth of it are too common to
begin a block; they only prolong one. An empty pair has ratio 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = 200  # characters from which the second text has characters that are too common
PAIRS = 1 << 20  # equal places of two texts that are held at a time
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, int]  # where they begin in a and b, by both, their lengths, and no less than the longest


def _places(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(a: np.ndarray, b: np.ndarray, box: tuple[int, int, int, int]) -> Runs:
    """The runs of equal characters along the diagonals of a box (0 equals nothing)."""
    alo, ahi, blo, bhi = box
    p, q = alo + np.flatnonzero(a[alo:ahi]), blo + np.flatnonzero(b[blo:bhi])
    q = q[np.argsort(b[q], kind="stable")]
    lo, hi = np.searchsorted(b[q], a[p], "left"), np.searchsorted(b[q], a[p], "right")
    n = hi - lo
    i = np.repeat(p, n)
    j = q[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    head = np.flatnonzero(np.concatenate([np.ones(len(i[:1]), bool), (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)]))
    n = np.diff(np.append(head, len(i)))
    by = np.lexsort((j[head], i[head]))
    return i[head][by], j[head][by], n[by], int(n.max(initial=0))


def _n_pairs(a: np.ndarray, b: np.ndarray, box: tuple[int, int, int, int]) -> int:
    values, n = np.unique(b[box[2] : box[3]], return_counts=True)
    own, m = np.unique(a[box[0] : box[1]], return_counts=True)
    at = np.searchsorted(values, own)
    hit = (at < len(values)) & (own > 0)
    hit[hit] = values[at[hit]] == own[hit]
    return int((m[hit].astype(np.int64) * n[at[hit]]).sum())


def _longest_run(runs: Runs, box: tuple[int, int, int, int]) -> tuple[tuple[int, int, int], Runs]:
    """(length, i, j) of the longest run inside a box, the first in i, then in j; and the runs that reach into it."""
    alo, ahi, blo, bhi = box
    i, j, n, most = runs
    lo, hi = i.searchsorted((alo - most + 1, ahi)) if most else (0, 0)
    i, j, n = i[lo:hi], j[lo:hi], n[lo:hi]
    if most > 1:
        off = np.maximum(np.maximum(alo - i, blo - j), 0)
        size = np.minimum(np.minimum(ahi - i, bhi - j), n) - off
        inside = size > 0
    else:
        inside = (j >= blo) & (j < bhi)
    i, j, n = i[inside], j[inside], n[inside]
    if not len(i):
        return (0, 0, 0), (i, j, n, 0)
    if most == 1:
        return (1, int(i[0]), int(j[0])), (i, j, n, 1)
    size, off = size[inside], off[inside]
    longest = int(size.max())
    at = np.flatnonzero(size == longest)
    p, q = i[at] + off[at], j[at] + off[at]
    first = np.lexsort((q, p))[0] if off[at].any() else 0  # what is cut begins in another order
    return (longest, int(p[first]), int(q[first])), (i, j, n, int(n.max()))


def _longest_by_hash(a: np.ndarray, b: np.ndarray, box: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """As _longest_run() of all runs of a box, without holding them: the length by bisection over hashed windows."""
    x, y = a[box[0] : box[1]], b[box[2] : box[3]]
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(x), len(y)), base)]))

    def windows(t, k):
        if len(t) < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        mixed = (t.astype(np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[::-1][: len(t)])])
        none = np.concatenate([np.zeros(1, np.int64), np.cumsum(t == 0)])
        at = np.flatnonzero(none[k:] == none[:-k])
        return at, (sums[at + k] - sums[at]) * powers[at]

    def common(k):
        (p, h), (q, g) = windows(x, k), windows(y, k)
        hit = p[np.isin(h, g)]
        if not len(hit):
            return None
        i = int(hit[0])
        j = next((int(c) for c in q[g == h[p == i][0]] if np.array_equal(x[i : i + k], y[c : c + k])), None)
        return None if j is None else (k, box[0] + i, box[2] + j)

    lo, hi, best = 0, min(len(x), len(y)), (0, 0, 0)
    while lo < hi:
        k = (lo + hi + 1) // 2
        found = common(k)
        if found:
            lo, best = k, found
        else:
            hi = k - 1
    return best


def matched(a: str, b: str) -> int:
    """How many characters the common blocks have."""
    x, y = _places(a) + np.uint32(1), _places(b) + np.uint32(1)
    most = len(y)
    if len(b) >= LONG and len(a):
        n = np.bincount(y, minlength=int(x.max()) + 1)
        most = len(b) // 100 + 1
        x, y = np.where(n[x] > most, 0, x), np.where(n[y] > most, 0, y)
    few = np.count_nonzero(x) * most <= PAIRS

    def look(box, runs):
        if runs is None and (few or _n_pairs(x, y, box) <= PAIRS):
            runs = _runs(x, y, box)
        return (box, _longest_by_hash(x, y, box), None) if runs is None else (box, *_longest_run(runs, box))

    # a box waits with its own runs alone: those of the box around it would add up
    total, stack = 0, [look((0, len(a), 0, len(b)), None)] if a and b else []
    while stack:
        (alo, ahi, blo, bhi), (size, i, j), runs = stack.pop()
        if not size:
            i, j = alo, blo
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if not size:
            continue
        total += size
        parts = (alo, i, blo, j), (i + size, ahi, j + size, bhi)
        stack += [look(part, runs) for part in parts if part[0] < part[1] and part[2] < part[3]]
    return total


def ratio(a: str, b: str) -> float:
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def block_ratio(a: Column, b: Column) -> Column:
    """ratio() of two columns, in Arrow batches; null where one of them is."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else ratio(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)
