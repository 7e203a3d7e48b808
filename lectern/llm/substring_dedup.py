"""Removal of repeated word sequences by compacting a De Bruijn graph of the corpus.

An edge is a window of k words. Only edges in documents that can repeat are made: every window holds a minimizer, the least
hash of its shorter word runs, and equal windows have equal ones; minimizers found in two places set bits of a bitmap of
fixed size, and windows whose minimizer has no bit are out. A minimizer that only exact copies share sets none, since
copies are found by a print of all their words.

An edge seen twice is repeated; its first place in the corpus is its home. Windows that follow each other in a document and
at home make a span. Where no span begins or ends, in home coordinates, the path does not branch: between such points lie
pieces, with as many occurrences as spans cover them. Joins find the pieces that have one successor, whose one predecessor
they are, and by pointer doubling the paths. At last the words of every span are digested at its own place and at its
home; different digests, a collision of hashes, repeat the search with others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import textops as X
from lectern.llm.whitening import indexed
from lectern.session import materialise

WINDOW = 35
#: Words of the runs among which a window's minimizer is chosen.
RUN = 12
#: Bits of the filter, at any size of the corpus: 16 MB. Bits that are set by chance only add windows.
FILTER_BITS = 1 << 27
#: Home slices that are digested at once for one document.
SLICES = 4096


def hasher(attempt: int) -> X.Powers:
    powers = X.Powers()
    if attempt:
        powers.values = np.random.default_rng(attempt).integers(1, 1 << 63, 256, dtype=np.uint64)
    return powers


def sliding(fold: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """The least or greatest of each ``n`` neighbours; shorter by ``n - 1``."""
    if len(x) < n:
        return x[:0]
    size = 1
    while 2 * size <= n:
        x, size = fold(x[:-size], x[size:]), 2 * size
    rest = n - size
    return fold(x[: len(x) - rest], x[rest:]) if rest else x


def minimizers(words: X.Words, hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run hashes; per word the least one of the window that starts there, and whether that window is in one document."""
    runs = X.gram_hash(hashes, run)
    least = sliding(np.minimum, runs, window - run + 1)
    whole = words.doc[: len(least)] == words.doc[window - 1 : window - 1 + len(least)]
    return runs, least, whole


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the 128-bit print and the SHA-256 of the words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, hashes = [], [], []
            for text in X.texts_of(batch.column(1)):
                words = text.split()  # of bytes: at the six ASCII spaces
                joined = b" ".join(words)
                n.append(len(words))
                prints.append(hashlib.md5(joined, usedforsecurity=False).digest())
                hashes.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(hashes, pa.string())], ["doc_id", "n_words", "print", "sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, print binary, sha256 string")


def seeds(docs: DataFrame, window: int, run: int) -> DataFrame:
    """(seed, place): minimizers of each text, with a number that only equal texts share; two for one that comes twice in it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = X.Powers()
        for batch in batches:
            texts = X.texts_of(batch.column(0))
            for lo, hi in X.chunks(texts):
                words = X.Words(texts[lo:hi], X.SPACE, powers)
                hashes = words.word_hash()
                at = np.arange(len(hashes), dtype=np.uint64) - words.lo[words.doc].astype(np.uint64)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(X.mix(hashes + X.mix(at)), dtype=np.uint64)])
                name = sums[words.lo[1:]] - sums[words.lo[:-1]]
                runs, least, whole = minimizers(words, hashes, window, run)
                if not whole.any():
                    continue
                # A run is chosen if it is the least of some window that holds it.
                pad = np.zeros(window - run, np.uint64)
                most = sliding(np.maximum, np.concatenate([pad, np.where(whole, least, 0), pad]), window - run + 1)
                chosen = np.flatnonzero((most == runs) & (runs > 0))
                doc, seed = words.doc[chosen], runs[chosen]
                order = np.lexsort((seed, doc))
                doc, seed = doc[order], seed[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])])
                nth = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                keep = nth < 2
                place = name[doc] ^ nth.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(seed[keep].view(np.int64)), pa.array(place[keep].view(np.int64))], ["seed", "place"])

    return docs.select("text").mapInArrow(emit, "seed bigint, place bigint")


def repeated_seeds(found: DataFrame, bits: int) -> np.ndarray:
    """The filter: a bit for each seed with two places, of words of 64 bits; pre-aggregated, so a hot seed is one row a task."""
    twice = found.groupBy("seed").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low < high")
    place = F.col("seed").bitwiseAND(F.lit(bits - 1))
    words = twice.select(place.alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("v"))
    got = words.toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[got["k"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return out


def candidates(docs: DataFrame, bitmap: np.ndarray, window: int, run: int) -> DataFrame:
    """print, n_words, the packed words and the stretches (starts, counts) of windows whose minimizer may repeat."""
    shared, mask = docs.sparkSession.sparkContext.broadcast(bitmap), np.uint64(len(bitmap) * 64 - 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, pack = X.Powers(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = X.texts_of(batch.column(0))
            for lo, hi in X.chunks(texts):
                words = X.Words(texts[lo:hi], X.SPACE, powers)
                _, least, whole = minimizers(words, words.word_hash(), window, run)
                bit = least & mask
                hit = whole & ((shared.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0)
                edges = np.diff(hit.view(np.int8), prepend=np.int8(0), append=np.int8(0))
                first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                of = np.searchsorted(first, words.lo)
                out = []
                for i in np.flatnonzero(np.diff(of)):
                    joined = b" ".join(texts[lo + i].split())
                    span = slice(of[i], of[i + 1])
                    out.append({
                        "print": hashlib.md5(joined, usedforsecurity=False).digest(), "n_words": int(words.count[i]), "packed": pack.compress(joined),
                        "starts": (first[span] - words.lo[i]).tolist(), "counts": (last[span] - first[span]).tolist(),
                    })
                if out:
                    yield pa.RecordBatch.from_pylist(out, CANDIDATE)

    return docs.select("text").mapInArrow(emit, "print binary, n_words bigint, packed binary, starts array<int>, counts array<int>")


CANDIDATE = pa.schema([("print", pa.binary()), ("n_words", pa.int64()), ("packed", pa.binary()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def windows(found: DataFrame, shift: int, window: int, attempt: int) -> DataFrame:
    """(edge, at): the hash and the place, document number and word number in one, of each candidate window."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, unpack = hasher(attempt), zstandard.ZstdDecompressor()
        for batch in batches:
            number = batch.column(0).to_numpy()
            texts = [unpack.decompress(x) for x in batch.column(1).to_pylist()]
            starts, counts = (batch.column(k).to_pylist() for k in (2, 3))
            for lo, hi in X.chunks(texts):
                words = X.Words(texts[lo:hi], X.SPACE, powers)
                grams = X.gram_hash(words.word_hash(), window)
                first = np.concatenate([words.lo[i] + np.array(starts[lo + i], np.int64) for i in range(hi - lo)])
                count = np.concatenate([np.array(counts[lo + i], np.int64) for i in range(hi - lo)])
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                doc = words.doc[at]
                place = (number[lo + doc] << shift) + at - words.lo[doc]
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(place)], ["edge", "at"])

    return found.select("row", "packed", "starts", "counts").mapInArrow(emit, "edge bigint, at bigint")


def repeated_spans(edges: DataFrame, shift: int) -> DataFrame:
    """(start, n, home): n windows from ``start`` on that equal those from ``home`` on, each the first of its kind."""
    homes = edges.groupBy("edge").agg(F.count("*").alias("n"), F.min("at").alias("home")).filter("n > 1").select("edge", "home")
    each = edges.join(materialise(homes, "edges"), "edge").select("at", "home", (F.col("home") - F.col("at")).alias("ahead"))
    doc = F.shiftright("at", shift).alias("doc")
    nth = F.row_number().over(W.partitionBy("doc", "ahead").orderBy("at"))
    stretch = each.select(doc, "at", "home", "ahead").withColumn("stretch", F.col("at") - nth)
    return stretch.groupBy("doc", "ahead", "stretch").agg(
        F.min("at").alias("start"), F.count("*").alias("n"), F.min("home").alias("home")
    ).select("start", "n", "home")


def compact(spans: DataFrame, shift: int) -> DataFrame:
    """(piece, size, copies, path, offset): pieces of path between the ends of spans, by home, and their places on paths.

    Two pieces are joined where the one is the only repeated successor of the other, and that its only predecessor. A
    circle of pieces is a path that begins at its least one.
    """
    marks = spans.select(F.col("home").alias("at"), F.lit(1).alias("step")).union(spans.select(F.col("home") + F.col("n"), F.lit(-1)))
    points = marks.groupBy("at").agg(F.sum("step").alias("step"))
    ordered = W.partitionBy(F.shiftright("at", shift)).orderBy("at")
    pieces = points.select(
        F.col("at").alias("piece"), (F.lead("at").over(ordered) - F.col("at")).alias("size"),
        F.sum("step").over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("copies"),
    ).filter("copies > 0")
    pieces = materialise(pieces, "pieces")
    source = W.partitionBy(F.shiftright("start", shift)).orderBy("start")
    before = spans.select(
        F.col("home").alias("piece"), "start",
        F.lag(F.col("start") + F.col("n")).over(source).alias("end"), F.lag(F.col("home") + F.col("n")).over(source).alias("left"),
    )
    ends = pieces.select((F.col("piece") + F.col("size")).alias("left"), F.col("piece").alias("up"), F.col("size").alias("offset"))
    steps = before.filter("end = start").select("left", "piece").union(ends.join(pieces, F.col("left") == F.col("piece")).select("left", "piece")).distinct()
    steps = materialise(steps, "steps")
    single = lambda side, other: steps.groupBy(side).agg(F.count("*").alias("ways"), F.first(other).alias(other)).filter("ways = 1").select("left", "piece")
    links = single("left", "piece").join(single("piece", "left"), ["left", "piece"]).join(ends, "left").select("piece", "up", "offset")
    return pieces.join(path_heads(pieces.select("piece"), materialise(links, "steps")), "piece")


def path_heads(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """(piece, path, offset) by pointer doubling over ``links`` (piece, up, offset): the first piece, and the windows before."""
    first = pieces.join(links, "piece", "left")
    state = first.select("piece", F.coalesce("up", "piece").alias("up"), F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"), F.least("piece", "up").alias("low"), F.col("up").isNull().alias("done"))
    state, before = materialise(state, "paths"), None
    while True:
        # Rows that point at a first piece are done; on a circle the least piece seen comes round at last.
        above = state.select(F.col("piece").alias("up"), F.col("up").alias("top"), F.col("offset").alias("more"), F.col("low").alias("lower"), F.col("done").alias("ended"))
        state = materialise(state.join(above, "up").select(
            "piece", F.when(F.col("done"), F.col("up")).otherwise(F.col("top")).alias("up"),
            F.when(F.col("done"), F.col("offset")).otherwise(F.col("offset") + F.col("more")).alias("offset"),
            F.least("low", "lower").alias("low"), (F.col("done") | F.col("ended")).alias("done"),
        ), "paths")
        mark = tuple(state.filter("not done").agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first())
        if not mark[0]:
            return state.select("piece", F.col("up").alias("path"), "offset")
        if mark == before:
            break
        before = mark
    circle = materialise(state.filter("not done"), "paths")
    cut = links.join(circle.filter("piece <> low").select("piece"), "piece", "left_semi")
    rest = path_heads(circle.select("piece"), materialise(cut, "steps"))
    return state.filter("done").select("piece", F.col("up").alias("path"), "offset").union(rest)


def remove_spans(found: DataFrame, spans: DataFrame, shift: int, window: int) -> DataFrame:
    """Per document of ``found`` with spans: print, n_removed, sha256 of the words left; and digests of spans and homes."""
    doc = lambda c: F.shiftright(c, shift).alias("row")
    within = lambda c: F.col(c).bitwiseAND(F.lit((1 << shift) - 1))
    own = spans.groupBy(doc("start")).agg(F.collect_list(F.struct(within("start").alias("first"), "n", "home")).alias("spans"))
    wanted = spans.select("home", "n").distinct()
    load = wanted.groupBy(doc("home")).agg(F.ceil(F.count("*") / SLICES).alias("parts"))
    sliced = wanted.withColumn("row", doc("home")).join(load, "row").groupBy("row", F.pmod(F.xxhash64("home", "n"), "parts").alias("part")).agg(
        F.collect_list(F.struct(within("home").alias("first"), "n", "home")).alias("spans")
    )
    work = own.select("row", F.lit(True).alias("own"), "spans").union(sliced.select("row", F.lit(False), "spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for one in batch.to_pylist():
                words = unpack.decompress(one["packed"]).split()
                ends = np.cumsum([len(x) + 1 for x in words])
                begin, joined = np.concatenate([[0], ends]), b" ".join(words) + b" "
                digests, covered = [], np.zeros(len(words) + 1, np.int64)
                for s in one["spans"]:
                    lo, hi = s["first"], s["first"] + s["n"] + window - 1
                    covered[lo] += 1
                    covered[hi] -= 1
                    digest = hashlib.sha256(joined[begin[lo] : begin[hi]]).digest()
                    digests.append({"home": s["home"], "n": s["n"], "a": int.from_bytes(digest[:8], "big", signed=True), "b": int.from_bytes(digest[8:16], "big", signed=True)})
                gone = np.cumsum(covered)[:-1] > 0
                kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
                whole = one["own"]
                yield pa.RecordBatch.from_pylist([{
                    "print": one["print"] if whole else None, "n_removed": int(gone.sum()) if whole else None,
                    "kept_sha256": hashlib.sha256(kept).hexdigest() if whole else None, "digests": digests,
                }], REMOVED)

    joined = found.select("row", "print", "packed").join(work, "row").select("print", "packed", "own", "spans")
    return joined.mapInArrow(run, "print binary, n_removed bigint, kept_sha256 string, digests array<struct<home:bigint,n:bigint,a:bigint,b:bigint>>")


REMOVED = pa.schema([
    ("print", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ("digests", pa.list_(pa.struct([("home", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))),
])


def contradicted(removed: DataFrame) -> bool:
    """Whether some span has other words than its home."""
    each = removed.select(F.explode("digests").alias("d")).groupBy("d.home", "d.n")
    limits = each.agg(*[f(F.col(f"d.{c}")).alias(f"{name}_{c}") for c in ("a", "b") for name, f in (("low", F.min), ("high", F.max))])
    return not limits.filter("low_a <> high_a or low_b <> high_b").isEmpty()


def repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, filter_bits: int = FILTER_BITS, attempt: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Candidate documents (row, print, packed), their spans (start, n, home, path, offset) and the bits of a word number."""
    bitmap = repeated_seeds(seeds(docs, window, run), filter_bits)
    found, _ = indexed(candidates(docs, bitmap, window, run), "candidates", 1 << 62)
    longest = found.agg(F.max("n_words")).first()[0] or 0
    shift = int(longest + 1).bit_length()
    spans = materialise(repeated_spans(windows(found, shift, window, attempt), shift), "spans")
    # Every span begins at a branching point, so where a piece begins.
    paths = compact(spans, shift).select(F.col("piece").alias("home"), "path", "offset")
    return found, materialise(spans.join(paths, "home"), "spans"), shift


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs`` (doc_id, text).

    Words are runs of anything but the six ASCII spaces. A word goes if a window of ``window`` words that holds it starts
    elsewhere too, in the same row or another. Null and empty texts have no words; rows that repeat a text of at least
    ``window`` words lose all. Null and repeated doc_ids are documents like others, and other columns are ignored. An
    empty table gives no rows.
    """
    every = materialise(documents(docs), "prints")
    attempt = 0
    while True:
        found, spans, shift = repeats(docs, window, run, filter_bits, attempt)
        removed = materialise(remove_spans(found, spans, shift, window), "removed")
        if not contradicted(removed):
            break
        attempt += 1
    partly = removed.filter("print is not null").dropDuplicates(["print"]).select("print", "n_removed", "kept_sha256")
    copies = every.filter(F.col("n_words") >= window).groupBy("print").agg(F.count("*").alias("rows")).filter("rows > 1").select("print", F.lit(True).alias("copied"))
    verdict = partly.join(copies, "print", "full")
    out = every.join(verdict, "print", "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copied"), nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
