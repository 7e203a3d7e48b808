"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items are written in one form: lower-cased words, one space before and after each. A pattern is a window of
ten item words in that form, so it can match only at word borders. Patterns are searched in groups of similar length.
Within a group, with ``m`` the shortest pattern:

* the shift table says, for the hash of the last eight bytes under the search window, how far the window may move
  without passing an occurrence; most positions are never looked at;
* where the shift is zero, the suffix bucket holds the patterns whose first ``m`` bytes end in those eight bytes, and
  a comparison of their first bytes and then of the whole pattern confirms the occurrence.

A task moves thousands of search windows at once, each over its own stretch of the text. Patterns travel with the task
in blocks of bounded size; a larger benchmark takes several passes, each reading what the last one wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import textops as X
from lectern.session import materialise

WINDOW = 10
#: Most bytes of item text that travel with a task in one pass.
BLOCK_BYTES = 8 << 20
TABLE_BITS = 20
#: Text positions per moving search window.
STRETCH = 512


def words_of(text: bytes) -> list[bytes]:
    return text.translate(X.ALNUM_LOWER).split()


def spaced(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


class Group:
    """Shift table and suffix buckets of patterns whose lengths differ by less than a factor of two."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.b = b = min(8, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m).astype(np.uint64)
        self.shift = np.full(1 << TABLE_BITS, min(m - b + 1, 255), np.uint8)
        block = lambda j: sum(heads[:, j + k] << np.uint64(8 * k) for k in range(b))
        for j in range(m - b + 1):
            np.minimum.at(self.shift, self.slot(block(j)), min(m - b - j, 255))
        suffix, prefix = block(m - b), block(0)
        order = np.lexsort((prefix, suffix))
        self.order, self.prefix = order, prefix[order]
        self.suffixes, self.at = np.unique(suffix[order], return_index=True)
        self.upto = np.append(self.at[1:], len(order))

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, data: bytes) -> list[tuple[int, int]]:
        """(position, pattern number) of every occurrence in ``data``."""
        last = len(data) - self.m
        if last < 0:
            return []
        padded = data + bytes(8)
        words = np.ndarray(len(data), "<u8", padded, strides=(1,))
        found: list[tuple[int, int]] = []
        at = np.arange(0, last + 1, STRETCH)
        stop = np.minimum(at + STRETCH, last + 1)
        while len(at):
            block = words[at + self.m - self.b] & self.mask
            step = self.shift[self.slot(block)].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero):
                found += self.confirm(data, words, at[zero], block[zero])
                step[zero] = 1
            at = at + step
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return found

    def confirm(self, data: bytes, words: np.ndarray, at: np.ndarray, suffix: np.ndarray) -> list[tuple[int, int]]:
        k = np.minimum(np.searchsorted(self.suffixes, suffix), len(self.suffixes) - 1)
        hit = self.suffixes[k] == suffix
        at, k = at[hit], k[hit]
        head = words[at] & self.mask
        row, stop = self.at[k], self.upto[k]
        found = []
        while len(at):
            for i in np.flatnonzero(self.prefix[row] == head):
                number = int(self.order[row[i]])
                if data.startswith(self.patterns[number], int(at[i])):
                    found.append((int(at[i]), number))
            row = row + 1
            live = row < stop
            at, head, row, stop = at[live], head[live], row[live], stop[live]
        return found


class Searcher:
    """Windows of the items' words, grouped by length for the search."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW) -> None:
        owners: dict[bytes, set[int | None]] = {}
        for item_id, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(spaced(words[i : i + window]), set()).add(item_id)
        by_size: dict[int, list[bytes]] = {}
        for pattern in sorted(owners):
            by_size.setdefault(len(pattern).bit_length(), []).append(pattern)
        self.owners = owners
        self.groups = [Group(patterns) for _, patterns in sorted(by_size.items())]

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[list[int]]], list[set[int | None]]]:
        """Per text: its number of words, the word ranges hit by occurrences, the items that occur."""
        forms = [words_of(t) for t in texts]
        count = np.fromiter(map(len, forms), np.int64, len(forms))
        data = b"".join(map(spaced, forms))
        first_word = np.concatenate([[0], np.cumsum(count)])
        spans: list[list[list[int]]] = [[] for _ in texts]
        items: list[set[int | None]] = [set() for _ in texts]
        hits = [(at, p) for g in self.groups for at, k in g.find(data) for p in (g.patterns[k],)]
        if hits:
            buf = np.frombuffer(data, np.uint8)
            starts = np.flatnonzero((buf[1:] != 32) & (buf[:-1] == 32)) + 1
            hits.sort()
            first = np.searchsorted(starts, np.array([at for at, _ in hits]) + 1)
            doc = np.searchsorted(first_word, first, "right") - 1
            for (_, pattern), i, d in zip(hits, first.tolist(), doc.tolist(), strict=True):
                i -= int(first_word[d])
                join(spans[d], i, i + pattern.count(b" ") - 1)
                items[d] |= self.owners[pattern]
        return count, spans, items


def join(spans: list[list[int]], start: int, stop: int) -> None:
    """Add a range to ranges sorted by start, merging it with the last one where they touch."""
    if spans and start <= spans[-1][1]:
        spans[-1][1] = max(spans[-1][1], stop)
    else:
        spans.append([start, stop])


FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])
LONGS = T.ArrayType(T.LongType())
FOUND_TYPE = T.StructType().add("n_words", T.LongType()).add("spans", T.ArrayType(LONGS)).add("items", LONGS)


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of ``docs`` with ``found``: n_words, the hit word ranges and the ids of occurring items.

    ``items`` needs item_id and text. Null texts have no words. An item without words has no window; one with fewer
    than ``window`` words is one window. Rows of the same item_id count as one item; a null item_id is listed as
    null. Ids are ascending, nulls last. An empty ``items`` hits nothing. A column of ``docs`` named ``found`` is
    replaced. Repeated rows are searched each on its own.
    """
    # Copies of a row would all be dealt into one block.
    items = items.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs.drop("found")
    for block in range(blocks):
        # At most about block_bytes of text: the benchmark is dealt evenly into blocks of checked size.
        rows = items.filter(part == block).select("item_id", F.col("text").cast("binary").alias("text")).collect()
        pairs = [(r.item_id, bytes(r.text)) for r in rows if r.text is not None]
        out = search_block(out if block == 0 else materialise(out, "decontaminate"), pairs, window)
    return out


def search_block(docs: DataFrame, pairs: list[tuple[int | None, bytes]], window: int) -> DataFrame:
    at, before = docs.columns.index("text"), "found" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(pairs, window)
        for batch in batches:
            texts, found = X.texts_of(batch.column(at)), []
            for lo, hi in X.chunks(texts, 2 * X.CHUNK_BYTES):
                count, spans, items = searcher.search(texts[lo:hi])
                found += [
                    {"n_words": int(n), "spans": s, "items": sorted(i, key=lambda x: (x is None, x or 0))}
                    for n, s, i in zip(count, spans, items, strict=True)
                ]
            if before:
                found = [merged(a, b) for a, b in zip(batch.column("found").to_pylist(), found, strict=True)]
            yield X.with_columns(batch, {"found": pa.array(found, FOUND)})

    schema = docs.drop("found").schema.add("found", FOUND_TYPE)
    return docs.mapInArrow(run, schema)


def merged(a: dict, b: dict) -> dict:
    spans: list[list[int]] = []
    for start, stop in sorted(a["spans"] + b["spans"]):
        join(spans, start, stop)
    ids = sorted(set(a["items"]) | set(b["items"]), key=lambda x: (x is None, x or 0))
    return {"n_words": a["n_words"], "spans": spans, "items": ids}


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the result of ``find_items``."""
    names = F.array_sort(F.transform("found.items", lambda x: F.coalesce(x.cast("string"), F.lit("null"))))
    n_hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
