"""Edit distance of many text pairs at once.

The JVM's ``levenshtein`` fills one table cell at a time: about 25 ns per cell, so 400-character
texts take milliseconds. Here a column of a table is 64 cells per machine word (Myers' bit
vectors, in blocks for longer texts) and all pairs of an Arrow batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64
#: Pairs that advance together have at most so many characters, counting each partner as long as the longest.
MAX_CELLS = 1 << 19
#: A table of match words by text, letter and block has at most so many.
MAX_SLOTS = 1 << 22
#: Distances up to this are found within one word around the diagonal.
BAND = 31
#: So many pairs a block are measured one by one.
FEW = 16
#: Batches are measured together up to so many pairs: rare long texts then share their steps.
TOGETHER = 40_000
#: So many pairs of at most so many characters a task remembers, and those of one batch more.
MET, MET_CHARS = 100_000, 300
_ONE = np.uint64(1)
_TOP = np.uint64(WORD - 1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters in a row, the text each belongs to and its place in that text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    return chars, row, np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _shared(x: str, y: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _core(x: str, y: str) -> tuple[str, str]:
    """The pair without its common beginning and end, which cost no edits; shorter text first."""
    n = _shared(x, y)
    x, y = x[n:], y[n:]
    n = _shared(x[::-1], y[::-1])
    x, y = x[: len(x) - n], y[: len(y) - n]
    return (x, y) if len(x) <= len(y) else (y, x)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances in code points. Cores that occur again are measured once."""
    out = np.zeros(len(a), dtype=np.int64)
    cores: dict[tuple[str, str], int] = {}
    places, rows = [], []
    for i, (x, y) in enumerate(zip(a, b)):
        if x.startswith(y) or y.startswith(x):
            out[i] = abs(len(x) - len(y))
        else:
            rows.append(i)
            places.append(cores.setdefault(_core(x, y), len(cores)))
    if rows:
        out[rows] = _of_cores([c[0] for c in cores], [c[1] for c in cores])[places]
    return out


def _plain(x: str, y: str) -> int:
    """The distance where a lower bound meets it, else -1: letters only left out, or only replaced by others."""
    if len(x) < len(y):
        rest = iter(y)
        return len(y) - len(x) if all(c in rest for c in x) else -1
    changed = [(c, d) for c, d in zip(x, y) if c != d]
    # No letter is both lost and won, so each change differs in the counts of letters too.
    return len(changed) if {c for c, _ in changed}.isdisjoint(d for _, d in changed) else -1


def _of_cores(a: list[str], b: list[str]) -> np.ndarray:
    out = np.array([_plain(x, y) for x, y in zip(a, b)], dtype=np.int64)
    blocks = np.array([-(-len(x) // WORD) for x in a], dtype=np.int64)
    blocks[out >= 0] = -1
    near = [i for i in np.flatnonzero(blocks > 1) if len(b[i]) - len(a[i]) <= BAND]
    for some in _parts(near, [len(x) for x in a]):
        found = _advance_band([a[i] for i in some], [b[i] for i in some])
        out[some] = np.where(found <= BAND, found, -1)
    blocks[out >= 0] = -1
    for w in np.unique(blocks[blocks >= 0]):
        for some in _parts(np.flatnonzero(blocks == w), [len(y) for y in b]):
            left, right = [a[i] for i in some], [b[i] for i in some]
            if w == 0:
                out[some] = [len(y) for y in right]
            elif len(some) <= FEW * w:
                out[some] = [_alone(x, y) for x, y in zip(left, right)]
            else:
                out[some] = _advance(left, right, int(w))
    return out


def _parts(rows: Iterable[int], steps: list[int]) -> Iterator[list[int]]:
    """Rows of bounded size together, most steps first: the pairs still running are always a prefix."""
    rows, lo = sorted(rows, key=lambda i: -steps[i]), 0
    while lo < len(rows):
        some = rows[lo : lo + max(1, MAX_CELLS // max(1, steps[rows[lo]]))]
        yield some
        lo += len(some)


def _matches(a: list[str], b: list[str], blocks: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """match[k][s]: where the character of slot s stands in block k of its text, which begins at bit ``first``;
    seen[j][i]: slot of b[i]'s character j."""
    chars, row, place = _codes(a)
    others, other_row, other_place = _codes(b)
    # A small alphabet gives every text a slot a letter; a large one slots for its own characters only, and one for none.
    letter = np.zeros(0x110000, dtype=np.int64)
    letter[chars] = letter[others] = 1
    size = int(letter.sum())
    if len(a) * size * blocks <= MAX_SLOTS:
        letter[letter == 1] = np.arange(size)
        n, slot, wanted = len(a) * size, row * size + letter[chars], other_row * size + letter[others]
    else:
        keys, slot = np.unique(row * 0x110000 + chars, return_inverse=True)
        at = other_row * 0x110000 + others
        found = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        n, wanted = len(keys) + 1, np.where(keys[found] == at, found, len(keys))
    place += first
    match = np.zeros(blocks * n, dtype=np.uint64)
    np.bitwise_or.at(match, (place // WORD) * n + slot, _ONE << (place % WORD).astype(np.uint64))
    seen = np.zeros((int(other_place.max()) + 1, len(b)), dtype=np.int64)
    seen[other_place, other_row] = wanted
    return match.reshape(blocks, n), seen


def beginnings(a: list[str], b: list[str]) -> np.ndarray:
    """Least edit distance of each text of ``a``, none of them empty, to any beginning of its partner."""
    out = np.zeros(len(a), dtype=np.int64)
    blocks = np.array([-(-len(x) // WORD) for x in a], dtype=np.int64)
    for w in np.unique(blocks):
        for some in _parts(np.flatnonzero(blocks == w), [len(y) for y in b]):
            left, right = [a[i] for i in some], [b[i] for i in some]
            if len(some) <= FEW * w:
                out[some] = [_alone(x, y, True) for x, y in zip(left, right)]
            else:
                out[some] = _advance(left, right, int(w), True)
    return out


def _advance(a: list[str], b: list[str], blocks: int, least: bool = False) -> np.ndarray:
    """Distances; with ``least``, those to the nearest beginning of the partner."""
    n = len(a)
    match, seen = _matches(a, b, blocks)
    steps = len(seen)
    length = np.array([len(x) for x in a], dtype=np.int64)
    partner = np.array([len(x) for x in b], dtype=np.int64)
    last = ((length - 1) % WORD).astype(np.uint64)
    score, best = length.copy(), length.copy()
    up = np.full((blocks, n), ~np.uint64(0))  # cells one above the cell over them
    down = np.zeros((blocks, n), dtype=np.uint64)  # cells one below it
    running = np.searchsorted(-partner, -np.arange(steps), side="left")
    for j in range(steps):
        k = running[j]
        carry_up, carry_down = np.full(k, _ONE), np.zeros(k, dtype=np.uint64)
        for block in range(blocks):
            eq, vp, vn = match[block][seen[j, :k]], up[block, :k], down[block, :k]
            xv = eq | vn
            eq |= carry_down
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp, hn = vn | ~(xh | vp), vp & xh
            if block == blocks - 1:
                score[:k] += ((hp >> last[:k]) & _ONE).astype(np.int64)
                score[:k] -= ((hn >> last[:k]) & _ONE).astype(np.int64)
            out_up, out_down = hp >> _TOP, hn >> _TOP
            hp, hn = (hp << _ONE) | carry_up, (hn << _ONE) | carry_down
            up[block, :k], down[block, :k] = hn | ~(xv | hp), hp & xv
            carry_up, carry_down = out_up, out_down
        if least:
            np.minimum(best[:k], score[:k], out=best[:k])
    return best if least else score


def _alone(a: str, b: str, least: bool = False) -> int:
    """The same with one integer as wide as the text: cheaper for few pairs than a step of arrays."""
    match: dict[str, int] = {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << i
    every, top, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down, best = every, 0, score
    for c in b:
        eq = match.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        hp, hn = down | (every & ~(xh | up)), up & xh
        score += (hp >> top & 1) - (hn >> top & 1)
        best = min(best, score)
        hp, hn = (hp << 1 | 1) & every, (hn << 1) & every
        up, down = hn | (every & ~(xv | hp)), hp & xv
    return best if least else score


def _advance_band(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of at most BAND, else some number above it: one word a text follows the diagonal (Hyyrö's band).

    Texts of ``a`` are longer than BAND and their partners at most BAND longer than they.
    """
    # Bit j of the padded texts opens the window of step j: one shift for all pairs.
    first = WORD - BAND - 1
    blocks = -(-(max(len(y) for y in b) + first) // WORD) + 1
    match, seen = _matches(b, a, blocks, first)
    steps, n = seen.shape
    shorter = np.array([len(x) for x in a], dtype=np.int64)
    diagonal = np.array([len(y) for y in b], dtype=np.int64) - BAND  # steps whose score lies on the lowest diagonal
    up, down = np.full(n, ~np.uint64(0) << np.uint64(first)), np.zeros(n, dtype=np.uint64)
    score = np.full(n, BAND, dtype=np.int64)
    running = np.searchsorted(-shorter, -np.arange(steps), side="left")
    lowest = diagonal.min()
    for j in range(steps):
        k, word, bit = running[j], j // WORD, np.uint64(j % WORD)
        slot, vp, vn = seen[j, :k], up[:k], down[:k]
        eq = match[word][slot] >> bit
        if bit and word + 1 < blocks:
            eq |= match[word + 1][slot] << (np.uint64(WORD) - bit)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        if j < lowest:
            score[:k] += (d0 >> _TOP == 0)
        else:
            past = j - diagonal[:k]
            at = np.clip(BAND * 2 - past, 0, BAND * 2).astype(np.uint64)
            along = ((hp >> at) & _ONE).astype(np.int64) - ((hn >> at) & _ONE).astype(np.int64)
            score[:k] += np.where(past < 0, d0 >> _TOP == 0, along)
        d0 >>= _ONE
        up[:k], down[:k] = hn | ~(d0 | hp), d0 & hp
    return score


def _together(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[list[tuple[pd.Series, pd.Series]]]:
    some, rows = [], 0
    for pair in batches:
        some.append(pair)
        rows += len(pair[0])
        if rows >= TOGETHER:
            yield some
            some, rows = [], 0
    if some:
        yield some


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance of two text columns; NULL if either is NULL.

    Equal texts are not sent to Python. Marked as not deterministic, which keeps Spark from evaluating it again below a filter on its result.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for some in _together(batches):
            x, y = (pd.concat(side, ignore_index=True) for side in zip(*some))
            known = (x.notna() & y.notna()).to_numpy()
            out = np.full(len(x), np.nan)
            out[known] = distances(list(x[known]), list(y[known]))
            ends = np.cumsum([len(left) for left, _ in some])
            for part in np.split(out, ends[:-1]):
                yield pd.Series(part).astype("Int64")

    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    measured = F.pandas_udf(run, "bigint").asNondeterministic()(F.when(a != b, a), F.when(a != b, b))
    return F.when(a == b, F.lit(0).cast("bigint")).otherwise(measured)


def edit_distances(a: Column | str, others: Column | str) -> Column:
    """Edit distances of a text to each text of an array; NULL where either is NULL.

    The text is sent once for all of them, and pairs that a task has met lately are not measured again.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        met: dict[tuple[str, str], int] = {}
        for left, lists in batches:
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            new: dict[tuple[str, str], int] = {}
            found, later = [], []
            y = iter(lists.flatten().to_pylist())
            for x, n in zip(left.to_pylist(), counts.tolist()):
                for _ in range(n):
                    pair = (x, next(y))
                    if x == pair[1]:
                        found.append(None if x is None else 0)
                    elif None in pair:
                        found.append(None)
                    elif (d := met.get(pair)) is not None:
                        found.append(d)
                    else:
                        later.append((len(found), new.setdefault(pair, len(new))))
                        found.append(None)
            if new:
                measured = distances([x for x, _ in new], [y for _, y in new]).tolist()
                for at, k in later:
                    found[at] = measured[k]
                if len(met) > MET:
                    met.clear()
                met.update((pair, measured[k]) for pair, k in new.items() if len(pair[0]) + len(pair[1]) <= MET_CHARS)
            ends = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.int64()), mask=lists.is_null() if lists.null_count else None)

    a, others = (F.col(c) if isinstance(c, str) else c for c in (a, others))
    return F.arrow_udf(run, "array<bigint>").asNondeterministic()(a, others)
