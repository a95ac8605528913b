"""Sequence similarity of texts: the ratio of the standard library's matcher, by other means."""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs up to which a rectangle is searched without arrays.
FEW = 24
#: Equal pairs of letters of two texts beyond which they would take too much memory as arrays (about 0.7 GB).
MANY_PAIRS = 20_000_000
#: Runs and letters of the pairs that are matched together.
TOGETHER = 500_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def equal_runs(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(start in a, start in b, length) of all maximal equal runs of letters that aren't too frequent in b; None for MANY_PAIRS."""
    x, y = _codes(a), _codes(b)
    if len(x) and len(y) and max(x.max(), y.max()) >= 1 << 16:
        both = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        x, y = both[: len(x)], both[len(x) :]
    count = np.bincount(y, minlength=int(x.max(initial=0)) + 1)
    if len(y) >= 200:
        count[count > len(y) // 100 + 1] = 0
    times = count[x]
    ahead = np.flatnonzero(times)
    letter, times = x[ahead], times[ahead]
    if times.sum() > MANY_PAIRS:
        return None
    spots = np.flatnonzero(count[y])
    found = y[spots]
    spots = spots[np.argsort(found.astype(np.uint16) if len(count) <= 1 << 16 else found, kind="stable")]
    first = np.cumsum(count) - count
    i = np.repeat(ahead, times)
    j = spots[np.repeat(first[letter] - (np.cumsum(times) - times), times) + np.arange(len(i))]
    # pairs of one diagonal lie together, in order of i; neighbours differ by one
    width = len(x) + 1
    key = np.sort((j - i + len(x)) * width + i)
    begins = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    i = key[begins] % width
    runs = i, key[begins] // width - len(x) + i, np.diff(np.append(begins, len(key)))
    return tuple(v.astype(np.int32) for v in runs)


def matched(a: str, b: str, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """Letters in the matching blocks: the longest run of a rectangle (the first in a, then in b), extended by whatever letters are equal, then the rectangles before and behind it."""
    total, wait = 0, [(0, len(a), 0, len(b), runs)]
    while wait:
        alo, ahi, blo, bhi, runs = wait.pop()
        i, j, size = alo, blo, 0
        if isinstance(runs, list):
            held = []
            for p, q, n in runs:
                skip = max(0, alo - p, blo - q)
                n = min(n, ahi - p, bhi - q) - skip
                if n > 0:
                    held.append((p + skip, q + skip, n))
            if held:
                i, j, size = max(held, key=lambda r: (r[2], -r[0], -r[1]))
        else:
            p, q, n = runs
            skip = np.maximum(0, np.maximum(alo - p, blo - q))
            n = np.minimum(n, np.minimum(ahi - p, bhi - q)) - skip
            some = n > 0
            p, q, n = (p + skip)[some], (q + skip)[some], n[some]
            if len(n):
                size = int(n.max())
                longest = np.flatnonzero(n == size)
                at = longest[np.argmin(p[longest].astype(np.int64) * (len(b) + 1) + q[longest])]
                i, j = int(p[at]), int(q[at])
            held = p, q, n
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if not size:
            continue
        total += size
        if alo < i and blo < j:
            wait.append((alo, i, blo, j, _within(held, lambda p, q, n, i=i, j=j: (p < i) & (q < j))))
        if i + size < ahi and j + size < bhi:
            wait.append((i + size, ahi, j + size, bhi, _within(held, lambda p, q, n, i=i + size, j=j + size: (p + n > i) & (q + n > j))))
    return total


def _within(held, test):
    """The runs that meet a rectangle; a few as a list."""
    if isinstance(held, list):
        return [r for r in held if test(*r)]
    chosen = test(*held)
    p, q, n = (x[chosen] for x in held)
    return list(zip(p.tolist(), q.tolist(), n.tolist(), strict=True)) if len(n) <= FEW else (p, q, n)


def _equal_letters(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many letters are equal from x[i] and y[j] on, in the direction of step, at most `most`."""
    out, width = np.zeros(len(i), dtype=np.int32), 4
    wait = np.flatnonzero(most > 0)
    wait = wait[x[i[wait]] == y[j[wait]]]
    while len(wait):
        done = out[wait]
        ahead = np.arange(width)
        left = (most[wait] - done)[:, None]
        by = step * (done[:, None] + np.minimum(ahead, left - 1))
        unequal = (x[i[wait][:, None] + by] != y[j[wait][:, None] + by]) | (ahead >= left)
        whole = ~unequal.any(axis=1)
        out[wait] = done + np.where(whole, width, unequal.argmax(axis=1))
        wait = wait[whole]
        width = min(4096, 8 * width)
    return out


def matched_together(pairs: list[tuple[str, str]], runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """matched() of many pairs: their texts one after the other, and each step over all rectangles of a depth."""
    x, y = _codes("".join(a for a, _ in pairs)), _codes("".join(b for _, b in pairs))
    ahi, bhi = (np.cumsum([len(t[k]) for t in pairs], dtype=np.int32) for k in range(2))
    alo, blo = (np.append(np.int32(0), hi[:-1]) for hi in (ahi, bhi))
    pair = np.arange(len(pairs), dtype=np.int32)
    total = np.zeros(len(pairs))
    box = np.repeat(pair, [len(r[0]) for r in runs])  # of each run, ascending; a run lies within its rectangle
    p, q, n = (np.concatenate([r[k] for r in runs]) for k in range(3))
    p, q = p + alo[box], q + blo[box]
    while len(pair):
        i, j, size = alo.copy(), blo.copy(), np.zeros(len(pair), dtype=np.int32)
        if len(box):
            begins = np.flatnonzero(box[1:] != box[:-1]) + 1
            begins = np.append(0, begins)
            own = box[begins]
            size[own] = np.maximum.reduceat(n, begins)
            longest = np.flatnonzero(n == size[box])
            of = box[longest]
            first = np.minimum.reduceat(p[longest].astype(np.int64) << 32 | q[longest], np.append(0, np.flatnonzero(of[1:] != of[:-1]) + 1))
            i[own], j[own] = first >> 32, first & 0xFFFFFFFF
        back = _equal_letters(x, y, i - 1, j - 1, np.minimum(i - alo, j - blo), -1)
        i, j, size = i - back, j - back, size + back
        size = size + _equal_letters(x, y, i + size, j + size, np.minimum(ahi - i, bhi - j) - size, 1)
        total += np.bincount(pair, size, len(total))
        i_end, j_end = i + size, j + size
        before = np.flatnonzero((size > 0) & (alo < i) & (blo < j))
        behind = np.flatnonzero((size > 0) & (i_end < ahi) & (j_end < bhi))
        name = np.zeros((2, len(pair)), dtype=np.int32)
        name[0, before], name[1, behind] = np.arange(len(before)), np.arange(len(before), len(before) + len(behind))
        # no run is before an edge at the rectangle's start, or behind one at its end
        edge = [alo.copy(), blo.copy(), ahi.copy(), bhi.copy()]
        for e, v, chosen in zip(edge, (i, j, i_end, j_end), (before, before, behind, behind), strict=True):
            e[chosen] = v[chosen]
        room = np.minimum(edge[0][box] - p, edge[1][box] - q)
        head = np.flatnonzero(room > 0)
        skip = np.maximum(np.maximum(edge[2][box] - p, edge[3][box] - q), 0)
        tail = np.flatnonzero(n > skip)
        skip = skip[tail]
        box = np.concatenate([name[0][box[head]], name[1][box[tail]]])
        n = np.concatenate([np.minimum(n[head], room[head]), n[tail] - skip])
        p, q = (np.concatenate([v[head], v[tail] + skip]) for v in (p, q))
        alo, ahi = np.concatenate([alo[before], i_end[behind]]), np.concatenate([i[before], ahi[behind]])
        blo, bhi = np.concatenate([blo[before], j_end[behind]]), np.concatenate([j[before], bhi[behind]])
        pair = np.concatenate([pair[before], pair[behind]])
    return total.astype(np.int64)


def ratios(left: Iterable[str | None], right: Iterable[str | None]) -> list[float | None]:
    """Ratio of each pair; null for a null. Pairs are matched together until they have TOGETHER runs or letters; larger ones alone."""
    out: list[float | None] = []
    places, pairs, held, size = [], [], [], 0

    def settle():
        if pairs:
            for place, (a, b), found in zip(places, pairs, matched_together(pairs, held).tolist(), strict=True):
                out[place] = 2.0 * found / (len(a) + len(b))

    for a, b in zip(left, right, strict=True):
        out.append(None if a is None or b is None else 1.0)
        if a is None or b is None or a == b:
            continue
        runs = equal_runs(a, b)
        own = len(a) + len(b) + (0 if runs is None else len(runs[0]))
        if runs is None:
            out[-1] = SequenceMatcher(None, a, b).ratio()
        elif own > TOGETHER:
            out[-1] = 2.0 * matched(a, b, runs) / (len(a) + len(b))
        else:
            if size + own > TOGETHER:
                settle()
                places, pairs, held, size = [], [], [], 0
            places.append(len(out) - 1)
            pairs.append((a, b))
            held.append(runs)
            size += own
    settle()
    return out


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of the standard library's matcher; null for a null."""
    return pd.Series(ratios(a, b), dtype="float64")


def compare(a, b) -> dict:
    """exact, ignoring_space and similarity columns."""
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return {"exact": a == b, "ignoring_space": bare(a) == bare(b), "similarity": similarity(a, b)}
