"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A shingle takes a place in a ring of 2^20 by a first permutation. Coordinate k of the signature is the smallest value
that a second permutation, shifted circularly by k, gives to the document's places; so two permutations make all
coordinates, and the values a shingle contributes to them are one contiguous stretch of the second permutation.

Documents with equal shingle sets form a class and only its smallest doc_id goes on. Bands of coordinates put classes
into buckets. A bucket is not expanded into pairs: its members are compared with one of them, links are joined into
components, and so on with other centres; only members that are then still apart are compared with each other. A group
of thousands of near copies so costs a few comparisons each. Every link is confirmed on the full shingle sets.

With six rows in each of fifty bands a pair at similarity 0.8 is missed with probability 3e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops as X
from lectern.llm.grouping import link_buckets
from lectern.session import materialise

SHINGLE_WORDS = 2
PERCENT = 80
ROWS, BANDS = 6, 50
RING = 1 << 20


class Circulant:
    """The two permutations and the views that read signatures out of them."""

    def __init__(self, size: int = ROWS * BANDS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.place = rng.permutation(RING).astype(np.int32)
        second = rng.permutation(RING).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:size]]), size)
        self.size = size

    def signature(self, shingles: np.ndarray, step: int = 1024) -> np.ndarray:
        at = self.place[(shingles & np.uint64(RING - 1)).astype(np.int64)]
        best = self.shifted[at[:step]].min(axis=0)
        for lo in range(step, len(at), step):
            best = np.minimum(best, self.shifted[at[lo : lo + step]].min(axis=0))
        return best


def shingle_sets(texts: list[bytes], n: int, powers: X.Powers) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; fewer words make one shingle, none an empty set."""
    w = X.Words([t.translate(X.LOWER) for t in texts], X.SPACE, powers)
    words = w.word_hash()
    grams = X.gram_hash(words, n)
    out = []
    for lo, hi in zip(w.lo[:-1], w.lo[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        else:
            out.append(X.gram_hash(words[lo:hi], int(hi - lo)) if hi > lo else words[:0])
    return out


def signatures(docs: DataFrame, n: int = SHINGLE_WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit print of the set (two longs) and one long per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, ring = X.Powers(), Circulant(rows * bands)
        salt = X.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts = X.texts_of(batch.column(2))
            size, prints, keys = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)), np.uint64), []
            for lo, hi in X.chunks(texts):
                for i, s in enumerate(shingle_sets(texts[lo:hi], n, powers), lo):
                    size[i] = len(s)
                    prints[0, i] = X.mix(s).sum(dtype=np.uint64)
                    prints[1, i] = X.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    if len(s):
                        parts = ring.signature(s).reshape(bands, rows).astype(np.uint64)
                        folded = salt
                        for r in range(rows):
                            folded = X.mix(folded ^ parts[:, r])
                        keys.append(folded)
            ends = np.concatenate([[0], np.cumsum(size > 0)]) * bands
            values = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(size), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)),
                ],
                ["doc_id", "text_key", "n_shingles", "print_a", "print_b", "bands"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id bigint, text_key bigint, n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>"
    )


def verify(pairs: DataFrame, texts: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, last = X.Powers(), (None, None)
        for batch in batches:
            left, right = X.texts_of(batch.column(2)), X.texts_of(batch.column(3))
            keep = np.zeros(len(left), bool)
            for lo, hi in X.chunks(right):
                for i, other in enumerate(shingle_sets(right[lo:hi], n, powers), lo):
                    if left[i] != last[0]:
                        last = left[i], shingle_sets([left[i]], n, powers)[0]
                    both = np.concatenate([last[1], other])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * common >= percent * (len(both) - common)
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in (0, 1)], ["a", "b"])

    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))
    # Joined on b first: the rows then arrive sorted by a, whose set is made once for its whole run.
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(run, "a bigint, b bigint")


def link_blocks(blocks: DataFrame, texts: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the two sides of each (family, i, j); one for each member and component is enough."""

    def run(table: pa.Table) -> pa.Table:
        powers = X.Powers()
        ids, side = table["x"].to_numpy(), table["side"].to_numpy()
        _, c = np.unique(table["c"].to_numpy(), return_inverse=True)
        sets = shingle_sets(X.texts_of(table["text"].combine_chunks()), n, powers)
        size = np.array([len(s) for s in sets])
        usual = np.bincount(c).argmax()
        found: set[tuple[int, int]] = set()
        for probes, targets in ((0, 1), (1, 0)):
            others = np.flatnonzero(side == targets)
            values = np.concatenate([sets[k] for k in others] or [np.zeros(0, np.uint64)])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(others)), size[others])[order]
            # Pairs of different components have a member outside the largest component: those are the probes.
            for k in np.flatnonzero((side == probes) & (c != usual)):
                lo, hi = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
                count = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                common = np.bincount(owner[at], minlength=len(others))
                linked = 100 * common >= percent * (size[k] + size[others] - common)
                near = others[linked & (c[others] != c[k])]
                for t in near[np.unique(c[near], return_index=True)[1]]:
                    found.add((int(min(ids[k], ids[t])), int(max(ids[k], ids[t]))))
        pairs = sorted(found)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    full = blocks.join(texts.withColumnRenamed("doc_id", "x"), "x")
    return full.groupBy("family", "i", "j").applyInArrow(run, "a bigint, b bigint")


def group_documents(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and no links. A row without doc_id is linked with nothing, has no component
    and is kept. Rows that repeat a doc_id and its text are one document; when the texts differ, each row has the
    component of its own text. An empty table gives no rows.
    """
    signed = materialise(signatures(docs, n), "signatures")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = materialise(
        named.groupBy("print_a", "print_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes"
    )
    # The join has dealt the rows by class, so dropping repeated rows of a representative shuffles nothing.
    single = (
        named.join(classes, ["print_a", "print_b", "n_shingles"])
        .filter("doc_id = rep")
        .dropDuplicates(["print_a", "print_b", "n_shingles"])
    )
    # One doc_id with several texts stands for several classes: it has all their bands and the range of their sizes.
    members = single.groupBy(F.col("doc_id").alias("x")).agg(
        F.array_distinct(F.flatten(F.collect_list("bands"))).alias("keys"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")
    )
    members = materialise(members, "bands")

    def possible(p: str, q: str) -> Column:
        return (100 * F.col(f"{p}high") >= percent * F.col(f"{q}low")) & (100 * F.col(f"{q}high") >= percent * F.col(f"{p}low"))

    texts: list[DataFrame] = []

    def confirmer(ids: DataFrame) -> Callable[[DataFrame], DataFrame]:
        wanted = docs.select("doc_id", "text").join(ids.withColumnRenamed("x", "doc_id"), "doc_id", "left_semi")
        texts.append(materialise(wanted.distinct(), "texts"))
        return lambda pairs: verify(pairs, texts[0], n, percent)

    labels = link_buckets(members, possible, confirmer, lambda blocks: link_blocks(blocks, texts[0], n, percent))
    final = classes.join(labels, F.col("rep") == F.col("id"), "left").select(
        "print_a", "print_b", "n_shingles", F.coalesce("component", "rep").alias("component")
    )
    joined = signed.join(final, ["print_a", "print_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    out = joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of ``docs`` less near-duplicates: of each group the document with the smallest doc_id stays.

    Rows without doc_id stay. Of rows equal in doc_id and text one stays.
    """
    keys = ["doc_id", "text_key"]
    verdict = materialise(group_documents(docs, n, percent), "verdict").groupBy(*keys).agg(
        F.min("kept").alias("kept"), F.count("*").alias("n")
    )
    odd = verdict.filter("doc_id is not null and (not kept or n > 1)").withColumnsRenamed({k: f"odd_{k}" for k in keys})
    on = (F.col("row.doc_id") == F.col("odd_doc_id")) & (F.xxhash64("row.text") == F.col("odd_text_key"))
    marked = docs.select(F.struct(*docs.columns).alias("row")).join(odd, on, "left")
    back = [F.col(f"row.{c}").alias(c) for c in docs.columns]
    once = marked.filter("odd_doc_id is null").select(*back)
    again = marked.filter("kept and n > 1").dropDuplicates(["odd_doc_id", "odd_text_key"]).select(*back)
    return once.union(again)
