"""Words, lines and 64-bit hashes of many texts at once, in numpy, inside a task.

A hash of a byte span is polynomial over random byte values, taken from prefix sums, so the hash of any word, line or
word prefix costs a few vector operations. Two different spans collide with a chance of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Everything but digits, ASCII letters and non-ASCII bytes separates words; A-Z become a-z.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM_LOWER = bytes(32 if c in NOT_ALNUM else LOWER[c] for c in range(256))

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_values() -> np.ndarray:
    return np.random.default_rng(20_240_117).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.values = byte_values()

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * CHUNK_BYTES)
            with np.errstate(over="ignore"):
                up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of ``texts``: byte spans ``start``/``end`` in ``buf`` and, per text, the range ``lo[i]:lo[i+1]``."""

    def __init__(self, texts: list[bytes], separators: bytes, powers: Powers | None = None) -> None:
        self.n = len(texts)
        self.data = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.data, np.uint8)
        self.first = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 1, out=self.first[1:])
        table = np.ones(256, bool)
        table[list(separators)] = False
        self.inside = table[self.buf]
        edges = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edges[0::2], edges[1::2]
        self.lo = np.searchsorted(self.start, self.first)
        self.count = np.diff(self.lo)
        self.doc = np.repeat(np.arange(self.n), self.count)
        self.powers, self._sums = powers, None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sums is None:
            self.powers.reach(len(self.buf) + 1)
            self._sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(self.powers.values[self.buf] * self.powers.up[: len(self.buf)], out=self._sums[1:])
        raw = (self._sums[end] - self._sums[start]) * self.powers.down[start]
        return mix(raw + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes; shorter by ``n - 1``."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + size]
    return mix(out)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text has no bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, so that memory follows the longest text, not the batch."""
    lo = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield lo, i
            lo, total = i, 0
        total += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


def sums_by(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n).astype(np.int64)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns replaced or appended."""
    kept = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
    return pa.RecordBatch.from_pydict(kept | new)
