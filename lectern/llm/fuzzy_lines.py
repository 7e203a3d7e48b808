"""Fuzzy line deduplication over the whole corpus.

A line is normalised to its lower-cased words. Equal normal forms are one line. Every line has a 64-bit SimHash of its
words of four bytes or more (of all, where it has none): the short, frequent words say little and would make the
SimHashes of unrelated lines agree. Lines are compared when their SimHashes differ in at most three bits. With the bits cut into five blocks two
such lines agree on two whole blocks, so the ten pairs of blocks are keys of the join.

Few lines of edit similarity 80 % are that near, so lines are also compared when they share a run of bytes: every line
has a sample of the runs of its normal form as keys, longer runs in longer lines, and lines of up to 14 characters all
their forms with a fifth of the characters left out, which no similar pair of such lines can escape. A pair is linked
when its normal forms are similar in edit distance; of each connected group of lines one occurrence stays, the first
by document and line number.

Keys travel packed by part of the key space, and each part gives the pairs of its keys. A key of many lines, a run of a
common phrase, gives none: its lines take as many further runs as they have keys, and a line that then has a whole
sample of runs that are not common is found by those. Lines that have not, short lines and copies of one text, keep
their common keys and are linked bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import combinations
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lectern.functions.distance import WORD, beginnings, distances
from lectern.llm import textops as X
from lectern.llm.grouping import components, link_buckets
from lectern.session import materialise

RADIUS = 3
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Edit similarity, 1 - distance / longer length, in percent.
PERCENT = 80
#: Pairs of lines of at most so many characters always share a form with characters left out.
SHORT = 14
#: (characters of the longer line at most, bytes of a run): short runs of long lines would be shared by chance.
RUNS = [(24, 6), (40, 8), (64, 10), (1 << 62, 16)]
#: Runs of a line that are keys, about: those with the smallest hashes.
SAMPLED = 24
#: A key of more lines is common.
COMMON = 16
#: Keys in a part of the key space, and in a task before they are sent, about.
PART, HELD = 1 << 19, 1 << 21
#: Pairs that share so many keys are most likely similar.
LIKELY = 6
#: Characters of the shorter form from which quarters are measured first: they are then half a machine word at least.
LONG = 2 * WORD
#: Words skipped in both lines together in search of the next common word.
REACH = 24


def lines_of(texts: list[bytes], powers: X.Powers, with_sim: bool = True) -> list[tuple[np.ndarray, ...]]:
    """Per text: numbers, hashes, SimHashes (0 without ``with_sim``) and normal lengths of its lines with words."""
    w = X.Words([t.translate(X.LOWER) for t in texts], X.NOT_ALNUM, powers)
    if not len(w.start):
        return [(np.zeros(0, np.int64),) * 4 for _ in texts]
    breaks = np.flatnonzero(w.buf == 10)
    line = np.searchsorted(breaks, w.start)
    lines, at = np.unique(line, return_index=True)
    n = np.diff(np.append(at, len(line)))
    word = w.word_hash()
    powers.reach(len(word) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * powers.up[: len(word)])])
    hashes = X.mix((sums[at + n] - sums[at]) * powers.down[at] + n.astype(np.uint64))
    sim = np.zeros(len(at), np.uint64)
    if with_sim:
        sim = simhash(word, np.repeat(np.arange(len(at)), n), w.end - w.start > 3, len(at))
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)])
    length = ends[at + n] - ends[at] + n - 1
    first = np.searchsorted(breaks, w.first[:-1])
    doc = w.doc[at]
    number = lines - first[doc]
    cut = np.searchsorted(doc, np.arange(w.n + 1))
    return [
        (number[a:b], hashes[a:b].view(np.int64), sim[a:b].view(np.int64), length[a:b])
        for a, b in zip(cut[:-1], cut[1:], strict=True)
    ]


def simhash(word: np.ndarray, line: np.ndarray, long: np.ndarray, n_lines: int) -> np.ndarray:
    """64 bits per line: each is the majority of that bit over the hashes of the line's long words."""
    used = long | (np.bincount(line[long], minlength=n_lines) == 0)[line]
    word, line = word[used], line[used]
    at = np.searchsorted(line, np.arange(n_lines))
    n = np.diff(np.append(at, len(line)))
    ones, step = np.empty((n_lines, 64), np.int32), 2048
    for lo in range(0, n_lines, step):
        stop = at[lo + step] if lo + step < n_lines else len(word)
        bits = np.unpackbits(word[at[lo] : stop].view(np.uint8).reshape(-1, 8), axis=1)
        ones[lo : lo + step] = np.add.reduceat(bits, at[lo : lo + step] - at[lo], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1).view(np.uint64).ravel()


def normal_lines(text: bytes) -> list[tuple[int, bytes]]:
    """(number, normal form) of the lines with words."""
    forms = ((i, b" ".join(x.translate(X.ALNUM_LOWER).split())) for i, x in enumerate(text.split(b"\n")))
    return [(i, f) for i, f in forms if f]


def run_keys(forms: list[bytes], q: int, powers: X.Powers, more: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(form number, key) of the sampled runs of ``q`` bytes of forms that have one; with ``more``, of as many others.

    A run is taken when its hash is below a limit that falls with the length of the form, so of two forms the shorter
    takes every shared run that the longer one takes.
    """
    size = np.fromiter(map(len, forms), np.int64, len(forms))
    buf = np.frombuffer(b"".join(forms), np.uint8)
    powers.reach(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(powers.values[buf] * powers.up[: len(buf)], out=sums[1:])
    n = size - q + 1
    ends = np.cumsum(n)
    start = np.arange(ends[-1]) + np.repeat((q - 1) * np.arange(len(forms)), n)
    run = X.mix((sums[start + q] - sums[start]) * powers.down[start])
    limit, further = ((np.minimum(1, k * SAMPLED / n) * 2**53).astype(np.uint64) for k in (1, 2))
    form = np.repeat(np.arange(len(forms)), n)
    height = run >> np.uint64(11)
    if more:
        taken = np.flatnonzero((height < further[form]) & (height >= limit[form]))
        return form[taken], X.mix(run[taken] + np.uint64(q))
    taken = np.flatnonzero(height < limit[form])
    form, key = form[taken], run[taken]
    # Forms that repeat themselves have few different runs: the smallest of all.
    few = np.flatnonzero(np.bincount(form, minlength=len(forms)) < np.minimum(n, SAMPLED // 2))
    least = [np.unique(run[ends[i] - n[i] : ends[i]])[:SAMPLED] for i in few]
    form = np.concatenate([form, np.repeat(few, [len(x) for x in least])])
    return form, X.mix(np.concatenate([key, *least]) + np.uint64(q))


def left_out(form: str, n: int) -> set[str]:
    """``form`` with up to ``n`` characters left out."""
    found = last = {form}
    for _ in range(n):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        found = found | last
    return found


def shared_keys(forms: list[bytes], powers: X.Powers, percent: int = PERCENT) -> tuple[np.ndarray, list[np.ndarray]]:
    """Characters of each form, and its keys, all negative."""
    text = [f.decode("utf-8", "replace") for f in forms]
    chars = np.fromiter(map(len, text), np.int64, len(forms))
    owner, keys = [], []
    for i in np.flatnonzero(chars <= SHORT):
        variants = [x.encode() for x in left_out(text[i], int(chars[i]) * (100 - percent) // 100)]
        owner.append(np.full(len(variants), i))
        keys.append(np.array([int.from_bytes(blake2b(x, digest_size=8).digest(), "little") for x in variants], np.uint64))
    for here, q in by_length(forms, chars, percent):
        form, key = run_keys([forms[i] for i in here], q, powers)
        owner.append(here[form])
        keys.append(key)
    return chars, owned(owner, keys, len(forms))


def by_length(forms: list[bytes], chars: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """(forms, bytes of a run) for each entry of RUNS that some form has."""
    size, above = np.fromiter(map(len, forms), np.int64, len(forms)), SHORT
    for most, q in RUNS:
        # Every pair whose longer line has above + 1 to most characters has both lines here.
        here = np.flatnonzero((100 * chars >= percent * (above + 1)) & (chars <= most) & (size >= q))
        above = most
        if len(here):
            yield here, q


def owned(owner: list[np.ndarray], keys: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The different keys of each of ``n`` forms, made negative."""
    both = np.zeros(0, [("owner", np.int64), ("key", np.int64)])
    if owner:
        both = np.empty(sum(map(len, owner)), both.dtype)
        both["owner"], both["key"] = np.concatenate(owner), (np.concatenate(keys) | np.uint64(1 << 63)).view(np.int64)
    order = np.lexsort((both["key"], both["owner"]))
    both = both[order]
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return np.split(both["key"], np.searchsorted(both["owner"], np.arange(1, n)))


LINE = pa.struct([("no", pa.int32()), ("line", pa.int64())])


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and, per row of ``docs``, its lines with words (no, line hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = X.Powers()
        for batch in batches:
            texts = X.texts_of(batch.column(2))
            found = [x for lo, hi in X.chunks(texts) for x in lines_of(texts[lo:hi], powers, False)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32))
            columns = [np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in range(2)]
            parts = [pa.array(c).cast(f.type) for c, f in zip(columns, LINE, strict=True)]
            lines = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(LINE)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines], ["doc_id", "text_key", "lines"])

    given = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return given.mapInArrow(run, "doc_id bigint, text_key bigint, lines array<struct<no: int, line: bigint>>")


PARTS = "part int, near boolean, keys binary, lines binary, sizes binary, sims binary"
MET = "key bigint, a bigint, b bigint, n int, sim bigint"


def place(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each key, and its 32 bits inside the part: different keys are one by chance once in 2**32 times parts."""
    keys = keys.view(np.uint64)
    return (((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def whole(part: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    """A negative number for each key of ``place``."""
    return -1 - ((np.int64(part) if np.isscalar(part) else part) << 32 | key.astype(np.int64))


def packed(near: bool, parts: int, keys: np.ndarray, lines: np.ndarray, sizes: np.ndarray, sims: np.ndarray | None) -> pa.RecordBatch:
    """A row for each part that has keys: its keys with their lines, and the lines' characters (up to 65,535)."""
    if near:
        part, key = (keys % parts).astype(np.int64), keys.astype(np.uint32)
    else:
        part, key = place(keys, parts)
    order = np.argsort(part, kind="stable")
    some, at = np.unique(part[order], return_index=True)
    columns = [key[order], lines[order], np.minimum(sizes[order], 0xFFFF).astype(np.uint16), sims[order] if near else np.zeros(0, np.int64)]
    blobs = [[x.tobytes() for x in np.split(c, at[1:])] if len(c) else [b""] * len(some) for c in columns]
    rows = [pa.array(some.astype(np.int32)), pa.array([near] * len(some)), *[pa.array(x, pa.binary()) for x in blobs]]
    return pa.RecordBatch.from_arrays(rows, ["part", "near", "keys", "lines", "sizes", "sims"])


def key_parts(docs: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """The keys of all lines, from shared runs and from blocks of SimHashes, packed by part."""

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        line, sim, chars, n, keys = (np.concatenate(c) for c in zip(*held, strict=True))
        yield packed(False, parts, keys, np.repeat(line, n), np.repeat(chars, n), None)
        blocks = block_keys(sim.view(np.uint64))
        yield packed(True, parts, blocks.ravel(), *[np.tile(c, len(blocks)) for c in (line, chars, sim)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, total = X.Powers(), [], 0
        for batch in batches:
            texts = X.texts_of(batch.column(0))
            for lo, hi in X.chunks(texts):
                found = lines_of(texts[lo:hi], powers)
                hashes, sim = (np.concatenate([x[k] for x in found]) for k in (1, 2))
                forms = [f for t in texts[lo:hi] for _, f in normal_lines(t)]
                hashes, once = np.unique(hashes, return_index=True)
                if not len(once):
                    continue
                chars, keys = shared_keys([forms[i] for i in once], powers, percent)
                held.append((hashes, sim[once], chars, np.array([len(k) for k in keys]), np.concatenate(keys)))
                total += len(held[-1][4])
                if total >= HELD:
                    yield from send(held)
                    held, total = [], 0
        if held:
            yield from send(held)

    return docs.select("text").mapInArrow(run, PARTS)


def met(parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What the lines of a part have in common: rows (a, b, n) for pairs that share n keys of few lines, and rows
    (key, a, sim) for the lines of common keys, which are negative if from runs. Lines too different in length, or in
    SimHash for its keys, are no pair."""

    def run(table: pa.Table) -> pa.Table:
        part, out = table.column("part")[0].as_py(), []
        for near in (False, True):
            rows = table.filter(pc.equal(table.column("near"), near))
            kinds = [np.uint32, np.int64, np.uint16, np.int64]
            key, line, size, sim = (np.frombuffer(b"".join(rows.column(k + 2).to_pylist()), t) for k, t in enumerate(kinds))
            order = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
            same = np.diff(order >> np.uint64(32)) == 0
            order = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)[np.append(same, False) | np.append(False, same)] if len(order) else order.astype(np.int64)
            order = order[np.lexsort((line[order], key[order]))]
            # A line of several chunks comes several times.
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(key[order]) != 0) | (np.diff(line[order]) != 0)
            order = order[new]
            key, line, size = key[order], line[order], size[order].astype(np.int64)
            sim = sim[order] if near else np.zeros(len(key), np.int64)
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(key)))
            first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for c in np.unique(n[(n > 1) & (n <= COMMON)]):
                i, j = np.triu_indices(c, 1)
                group = at[n == c, None]
                first.append((group + i).ravel())
                second.append((group + j).ravel())
            first, second = np.concatenate(first), np.concatenate(second)
            short, long = np.minimum(size[first], size[second]), np.maximum(size[first], size[second])
            ok = (100 * short >= percent * long) | (long == 0xFFFF)
            if near:
                ok &= np.bitwise_count((sim[first] ^ sim[second]).view(np.uint64)) <= RADIUS
            ends = np.sort(np.stack([line[first[ok]], line[second[ok]]]), axis=0)
            if len(ends[0]):
                pairs, counts = np.unique(np.ascontiguousarray(ends.T).view("i8,i8").ravel(), return_counts=True)
                none = np.zeros(len(pairs), np.int64)
                out.append((none, pairs["f0"], pairs["f1"], counts, none))
            many = np.repeat(n > COMMON, n)
            crowd = key[many].astype(np.int64) if near else whole(part, key[many])
            out.append((crowd, line[many], np.zeros(len(crowd), np.int64), np.zeros(len(crowd), np.int64), sim[many]))
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        return pa.table([*columns[:3], columns[3].cast(pa.int32()), columns[4]], ["key", "a", "b", "n", "sim"])

    return parts.groupBy("part").applyInArrow(run, MET)


def further_keys(common: DataFrame, forms: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """line, size, rare and more of the lines with common keys from runs: the number of their other keys and their
    further keys, for each entry of RUNS; ``rare`` is null for lines that are always compared by their common keys."""
    kind = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = X.Powers()
        for batch in batches:
            texts = X.texts_of(batch.column(1))
            common = batch.column(2).to_pylist()
            chars = np.fromiter((len(t.decode()) for t in texts), np.int64, len(texts))
            rare, more = [[] if c > RUNS[0][0] else None for c in chars], [[] for _ in texts]
            for here, q in by_length(texts, chars, percent):
                some = [texts[i] for i in here]
                own, new = (owned([f], [k], len(some)) for f, k in (run_keys(some, q, powers, m) for m in (False, True)))
                for i, x, y in zip(here, own, new, strict=True):
                    if rare[i] is not None:
                        rare[i].append(len(x) - int(np.isin(whole(*place(x, parts)), common[i]).sum()))
                        more[i].append(y[~np.isin(y, x)])
            columns = [pa.array(chars.astype(np.int32)), pa.array(rare, kind[0]), pa.array(more, kind[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["line", "size", "rare", "more"])

    lists = common.groupBy(F.col("a").alias("line")).agg(F.collect_list("key").alias("keys"))
    given = forms.join(lists, "line").select("line", "form", "keys")
    return given.mapInArrow(run, "line bigint, size int, rare array<int>, more array<array<bigint>>")


def further_parts(further: DataFrame, parts: int) -> DataFrame:
    """The further keys packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, size, keys = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if len(keys):
                yield packed(False, parts, keys.astype(np.int64), line, size, None)

    return further.select("line", "size", F.explode(F.flatten("more")).alias("key")).mapInArrow(run, PARTS)


def line_texts(docs: DataFrame) -> DataFrame:
    """line (hash), form: the normal form of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = X.Powers()
        for batch in batches:
            texts = X.texts_of(batch.column(0))
            for lo, hi in X.chunks(texts):
                hashes = np.concatenate([x[1] for x in lines_of(texts[lo:hi], powers, False)])
                forms = [f for t in texts[lo:hi] for _, f in normal_lines(t)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(forms, pa.binary()).cast(pa.string())], ["line", "form"])

    return docs.select("text").mapInArrow(run, "line bigint, form string")


def block_keys(sim: np.ndarray) -> np.ndarray:
    """One key for each pair of blocks of a SimHash."""
    block = [sim >> np.uint64(start) & np.uint64((1 << size) - 1) for start, size in BLOCKS]
    pairs = combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)
    return np.stack([np.uint64(k << 26) | block[a] << np.uint64(13) | block[b] for k, (a, b) in enumerate(pairs)]).astype(np.int64)


def span_edits(a: str, b: str, most: int = 1 << 62) -> int:
    """At least the edit distance of two normal forms: the words are walked together, and where they differ the nearest
    common words within ``REACH`` end the differing spans, the longer of which is counted whole. Ends above ``most``."""
    x, y = a.split(" "), b.split(" ")
    i = j = edits = 0
    while i < len(x) and j < len(y) and edits <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        steps = ((s, d - s) for d in range(1, REACH) for s in range(d + 1))
        ahead = ((s, t) for s, t in steps if i + s < len(x) and j + t < len(y) and x[i + s] == y[j + t])
        s, t = next(ahead, (1, 1))
        edits += max(sum(map(len, x[i : i + s])) + s, sum(map(len, y[j : j + t])) + t)
        i, j = i + s, j + t
    return edits + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)


def edit_distance(a: str, b: str) -> int:
    """Edit distance in characters: a column of the table is two bit vectors, of rises and of falls, held in integers."""
    lead = len(commonprefix((a, b)))
    a, b = a[lead:], b[lead:]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    rise, fall, distance = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & rise) + rise) ^ rise) | same | fall
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
    return distance


def similar(a: str, b: str, percent: int = PERCENT) -> bool:
    """Whether two normal forms are similar in edit distance.

    Nearly all pairs that arrive here share most of their words, and the bound from aligned words settles them.
    """
    most = max(len(a), len(b)) * (100 - percent) // 100
    return span_edits(a, b) <= most or abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most


def all_similar(a: list[str], b: list[str], percent: int = PERCENT, likely: np.ndarray | None = None) -> np.ndarray:
    """``similar`` of many pairs; ``likely`` ones are tried by aligned words first.

    Few edits take the first and the last quarter of the shorter form to a beginning and an end of the other, so the
    least edits of the two quarters together are a bound that settles most pairs that only share a phrase.
    """
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    size = np.array([(len(x), len(y)) for x, y in pairs], np.int64).reshape(-1, 2)
    most = size[:, 1] * (100 - percent) // 100
    out = size[:, 1] - size[:, 0] <= most
    known = np.zeros(len(pairs), bool)
    if likely is not None:
        tried = np.flatnonzero(out & likely)
        known[tried] = [span_edits(*pairs[i], most[i]) <= most[i] for i in tried]
    long = np.flatnonzero(out & ~known & (size[:, 0] >= LONG))
    if len(long):
        edits = np.zeros(len(long), np.int64)
        for step in (1, -1):
            part = [(pairs[i][0][::step][: size[i, 0] // 4], pairs[i][1][::step], size[i, 0] // 4 + most[i]) for i in long]
            edits += beginnings([x for x, _, _ in part], [y[:n] for _, y, n in part])
        out[long[edits > most[long]]] = False
    left = np.flatnonzero(out & ~known)
    out[left] = distances([pairs[i][0] for i in left], [pairs[i][1] for i in left]) <= most[left]
    return out


def edit_similar(percent: int = PERCENT) -> Column:
    """Whether form_a and form_b, of lines that share n keys, are similar in edit distance."""

    def run(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(all_similar(list(a), list(b), percent, n.to_numpy() >= LIKELY), dtype=bool)

    return F.pandas_udf(run, BooleanType())("form_a", "form_b", "n")


def confirmed(pairs: DataFrame, forms: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, n) of similar lines."""
    side = lambda c: forms.select(F.col("line").alias(c), F.col("form").alias(f"form_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(edit_similar(percent)).select("a", "b")


def link_lines(docs: DataFrame, n_lines: int, percent: int = PERCENT) -> DataFrame:
    """(id, component) of the lines that are alike, by line hash. ``n_lines`` is the number of lines, about."""
    # A line has about 24 keys from runs and ten from blocks.
    parts = 1 + 34 * n_lines // PART
    first = materialise(met(key_parts(docs, parts, percent), percent), "met")
    ids = first.select(F.explode(F.array("a", F.when(F.col("n") > 0, F.col("b")))).alias("line")).filter("line is not null").distinct()
    forms = materialise(line_texts(docs).join(ids, "line", "left_semi").dropDuplicates(["line"]), "line-texts")
    crowd = first.filter("n = 0").select("key", "a", "sim")
    further = materialise(further_keys(crowd.filter("key < 0"), forms, parts, percent), "further-keys")
    second = materialise(met(further_parts(further, parts), percent), "met-further")
    pairs = first.union(second).filter("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    links = materialise(confirmed(pairs, forms, percent), "confirmed")
    labels = link_crowds(crowd, second, further, forms, parts, percent)
    if labels is not None:
        links = links.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return components(links)


def link_crowds(crowd: DataFrame, second: DataFrame, further: DataFrame, forms: DataFrame, parts: int, percent: int) -> DataFrame | None:
    """(id, component) of the lines of common keys that are alike: by SimHash, or where a line has not, for each entry of
    RUNS, a whole sample of runs that are not common."""
    again = second.filter("n = 0").groupBy(F.col("a").alias("line")).agg(F.collect_set("key").alias("again"))
    number = f"-1 - (pmod(shiftrightunsigned(k, 32), {parts}) * 4294967296L + (k & 4294967295L))"
    fresh = F.expr(f"transform(more, m -> size(filter(m, k -> not array_contains(coalesce(again, array()), {number}))))")
    enough = F.forall(F.zip_with("rare", fresh, lambda x, y: x + y), lambda n: n >= SAMPLED) & (F.size("rare") > 0)
    stays = further.join(again, "line", "left").select(F.col("line").alias("a"), (~F.coalesce(enough, F.lit(False))).alias("stays"))
    marked = crowd.join(stays, "a", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    used = marked.groupBy("key").agg(F.max("stays").alias("any")).filter("key >= 0 or any").select("key")
    lists = marked.join(used, "key").groupBy(F.col("a").alias("x")).agg(
        F.collect_list("key").alias("keys"), F.max(F.when(F.col("key") >= 0, F.col("sim"))).alias("sim"), F.max("stays").alias("stays")
    )
    members = lists.join(forms.select(F.col("line").alias("x"), F.length("form").cast("bigint").alias("size")), "x")
    members = materialise(members, "crowds")
    if members.isEmpty():
        return None
    few = materialise(forms.join(members.select(F.col("x").alias("line")), "line", "left_semi"), "crowd-texts")

    def possible(p: str, q: str) -> Column:
        # Only the keys from blocks of the SimHash, which are positive, ask for near SimHashes.
        near = F.bit_count(F.col(f"{p}sim").bitwiseXOR(F.col(f"{q}sim"))) <= RADIUS
        wanted = F.when(F.col("key") < 0, F.col(f"{p}stays") | F.col(f"{q}stays")).otherwise(near)
        return wanted & (100 * F.least(f"{p}size", f"{q}size") >= percent * F.greatest(f"{p}size", f"{q}size"))

    return link_buckets(members, possible, lambda ids: lambda pairs: confirmed(pairs.withColumn("n", F.lit(1)), few, percent))


def duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_lines, removed: per row of ``docs`` its number of lines with words and which of them go.

    Lines are numbered from 0 over all ``\\n``-split lines; lines without words are never removed. The occurrence that
    stays is the first by doc_id, null last, then text and line number. Null and empty texts have no lines. Rows equal
    in doc_id and text are one document: each keeps the same lines. An empty table gives no rows.
    """
    table = materialise(line_table(docs), "lines")
    each = table.select("doc_id", "text_key", F.explode("lines").alias("l")).select("doc_id", "text_key", "l.*")
    n_lines = table.agg(F.sum(F.size("lines"))).first()[0] or 0
    labels = link_lines(docs, n_lines, percent).select(F.col("id").alias("line"), "component")
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "no")
    grouped = each.join(labels, "line", "left").select("doc_id", "text_key", "no", where.alias("at"), F.coalesce("component", "line").alias("group"))
    first = grouped.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = grouped.join(first, "group").filter("at <> first").groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set("no")).alias("removed")
    )
    g = gone.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "removed")
    out = table.join(g, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "text_key", F.size("lines").cast("bigint").alias("n_lines"), removed.alias("removed"))


def clean_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of ``docs``, with the duplicate lines taken out of ``text``."""
    found = duplicate_lines(docs, percent).filter(F.size("removed") > 0).select(
        F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "removed"
    ).distinct()
    given = docs.select(F.struct(*docs.columns).alias("row"))
    on = F.col("row.doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("row.text") == F.col("g_key"))
    left = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return given.join(found, on, "left").select(*[text.alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])
