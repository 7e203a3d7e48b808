"""Characters of a final text aligned to the characters a recogniser timed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a comparison that is made cell by cell; larger ones are searched by hashes of substrings.
CELLS = 1 << 12
OWN, AFTER, BEFORE, NONE = 0, 1, 2, 3
SOURCES = "array<struct<at: int, kind: int>>"


class Pair:
    """Two texts as code points, with prefix hashes from which any substring's hash is read."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        self.hashes: tuple[np.ndarray, ...] | None = None

    def substrings(self, side: int, lo: int, hi: int, n: int) -> np.ndarray:
        """Hashes of the substrings of ``n`` characters within lo:hi, by their start."""
        if self.hashes is None:
            size = max(len(self.a), len(self.b)) + 1
            base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]))
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
            spread = lambda x: (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(0x94D049BB133111EB)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(spread(x) * up[: len(x)], dtype=np.uint64)]) for x in (self.a, self.b)]
            self.hashes = (*sums, down)
        sums, down = self.hashes[side], self.hashes[2]
        return (sums[lo + n : hi + 1] - sums[lo : hi - n + 1]) * down[lo : hi - n + 1]

    def by_cells(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        best, run = (a0, b0, 0), np.zeros(b1 - b0 + 1, np.int64)
        right = self.b[b0:b1]
        for i in range(a0, a1):
            run[1:] = np.where(right == self.a[i], run[:-1] + 1, 0)
            j = int(run.argmax())
            if run[j] > best[2]:
                best = (i + 1 - int(run[j]), b0 + j - int(run[j]), int(run[j]))
        return best

    def by_hashes(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """The greatest length at which the sides share a substring, by halving."""
        low, high = 0, min(a1 - a0, b1 - b0)
        while low < high:
            n = (low + high + 1) // 2
            shared = np.isin(self.substrings(0, a0, a1, n), self.substrings(1, b0, b1, n), kind="sort").any()
            low, high = (n, high) if shared else (low, n - 1)
        if not low:
            return a0, b0, 0
        left, right = self.substrings(0, a0, a1, low), self.substrings(1, b0, b1, low)
        i = int(np.isin(left, right, kind="sort").argmax())
        j = int((right == left[i]).argmax())
        if (self.a[a0 + i : a0 + i + low] == self.b[b0 + j : b0 + j + low]).all():
            return a0 + i, b0 + j, low
        return self.by_cells(a0, a1, b0, b1)  # a collision of hashes

    def longest(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """(i, j, n) of the longest common substring; of several the first in a, then in b."""
        small = (a1 - a0) * (b1 - b0) <= CELLS
        return (self.by_cells if small else self.by_hashes)(a0, a1, b0, b1)

    def blocks(self) -> list[tuple[int, int, int]]:
        """Common substrings in order: the longest one, and so on at either side of it."""
        found, waiting = [], [(0, len(self.a), 0, len(self.b))]
        while waiting:
            a0, a1, b0, b1 = waiting.pop()
            if a0 < a1 and b0 < b1:
                i, j, n = self.longest(a0, a1, b0, b1)
                if n:
                    found.append((i, j, n))
                    waiting += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
        return sorted(found)


def sources_of(text: str, heard: str) -> list[dict]:
    """Per character of ``text`` the heard character that times it, and how.

    ``OWN``: aligned, or, in a stretch that was rewritten, at the same share of the heard stretch. ``AFTER``: an insertion,
    at the end of the last timed character before it. ``BEFORE``: nothing before it is timed, so at the start of the first
    one that is. ``NONE``: no character is.
    """
    pair = Pair(heard, text)
    at = np.full(len(pair.b), -1, np.int64)
    i1 = j1 = 0
    for i, j, n in [*pair.blocks(), (len(pair.a), len(pair.b), 0)]:
        span, gap = i - i1, j - j1
        if span and gap:
            at[j1:j] = i1 + np.minimum(span - 1, ((np.arange(gap) + 0.5) * span / gap).astype(np.int64))
        at[j : j + n] = np.arange(i, i + n)
        i1, j1 = i + n, j + n
    known = np.flatnonzero(at >= 0)
    if not len(known):
        return [{"at": None, "kind": NONE}] * len(at)
    kind = np.where(at >= 0, OWN, np.where(np.arange(len(at)) < known[0], BEFORE, AFTER))
    last = np.maximum.accumulate(np.where(at >= 0, np.arange(len(at)), known[0]))
    return [{"at": p, "kind": k} for p, k in zip(at[last].tolist(), kind.tolist(), strict=True)]


def _sources(text: pd.Series, heard: pd.Series) -> pd.Series:
    pairs = list(zip(text, heard, strict=True))
    # Pairs that repeat in a batch are aligned once.
    known = {(t, h): None if t is None or h is None else sources_of(t, h) for t, h in dict.fromkeys(pairs)}
    return pd.Series([known[pair] for pair in pairs], dtype=object)


def char_sources(text: Column, heard: Column) -> Column:
    """``sources_of`` by batches; a row's work grows with its length times the number of its rewritten stretches."""
    return F.pandas_udf(_sources, SOURCES)(text, heard)


def align_chars(text: Column, heard: Column, times: Column) -> Column:
    """(start, end) of each character of ``text``, from ``times``, those of each character of ``heard``.

    Null where either text is; a text of which nothing was heard has zeros.
    """
    def timed(s: Column) -> Column:
        t = F.get(times, s["at"])
        point = F.when(s["kind"] == AFTER, t["end"]).otherwise(t["start"])
        zero = F.lit(0).cast("bigint")
        return F.when(s["kind"] == OWN, t).when(s["kind"] == NONE, F.struct(zero.alias("start"), zero.alias("end"))).otherwise(
            F.struct(point.alias("start"), point.alias("end"))
        )

    return F.transform(char_sources(text, heard), timed)
