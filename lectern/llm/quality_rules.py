"""Quality rules with thresholds that follow the corpus.

Fixed rules remove what is junk in any language. The other limits are not fixed: every document that passes the fixed
rules adds its measures to a mergeable quantile sketch of its language and source, limits are read from the sketch, and
a join applies them.

The sketch is a table of counts per bucket. Buckets are exact up to 127 and then keep the seven leading bits of a value,
so a quantile is off by less than 1 % whatever the values; two sketches merge by adding counts, which is how a small
(language, source) group falls back to its language and then to everything. Counting is pre-aggregated before its
shuffle, so a source that holds a third of all rows costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textops as X
from lectern.session import materialise

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A group with fewer documents takes the limits of the next wider group.
MIN_GROUP = 100
#: Measure: (lower limit?, least spread). Values are hundredths per word or per line.
MEASURES = {"word_length": (True, 70), "symbol_rate": (False, 5), "dup_line_rate": (False, 17)}
#: A value is out when it lies this many spreads beyond the outer quantile.
SPREADS = 3


def count_text(texts: list[bytes], powers: X.Powers) -> dict[str, np.ndarray]:
    """The counts of each text."""
    w = X.Words(texts, X.SPACE, powers)
    letters = w.inside & ((w.buf & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    cumulated = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.first])

    line_end = np.flatnonzero(w.buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    worded = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_doc = np.searchsorted(w.first, line_start, "right") - 1
    line = w.span_hash(line_start, line_end) ^ X.mix(line_doc.astype(np.uint64))
    order = np.argsort(line)
    again = np.flatnonzero(line[order][1:] == line[order][:-1]) + 1
    dup_lines = X.sums_by(line_doc[order][again], w.n)

    size = max(0, len(w.start) - 4)
    same = w.doc[:size] == w.doc[4:] if size else np.zeros(0, bool)
    grams = X.gram_hash(w.word_hash(), 5) ^ X.mix(w.doc[:size].astype(np.uint64))
    at = np.flatnonzero(same)
    order = at[np.argsort(grams[at])]
    ordered = grams[order]
    equal = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    cover = np.zeros(len(w.start) + 1, np.int32)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + 5, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": w.count,
        "word_chars": cumulated(letters),
        "n_symbols": cumulated(symbol[w.buf]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": X.sums_by(w.doc[repeated], w.n),
        "n_lines": X.sums_by(line_doc, w.n),
    }


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text, one row per input row.

    A null or empty text has zero words; other columns of ``docs`` are not read.
    """
    names = [*COUNTS, "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = X.Powers()
        for batch in batches:
            texts = X.texts_of(batch.column(3))
            parts = [count_text(texts[lo:hi], powers) for lo, hi in X.chunks(texts)]
            columns = [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays(batch.columns[:3] + columns, ["doc_id", "lang", "source", *names])

    given = docs.select("doc_id", "lang", "source", "text")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema[:3])
    return given.mapInArrow(run, head + "".join(f", {n} bigint" for n in names))


def failed_base() -> Column:
    """Junk in any language: too short, or too many words inside repeated 5-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    per = lambda a, b: F.expr(f"100 * {a} div greatest({b}, 1)")
    return {
        "word_length": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
    }


def bucket_of(value: Column) -> Column:
    """The lower bound of the value's bucket: the value with all but its seven leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    step = F.pow(F.lit(2.0), drop).cast("bigint")
    return (value - value % step).cast("bigint")


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable quantile sketch per group and measure."""
    entries = [F.struct(F.lit(name).alias("measure"), bucket_of(v).alias("bucket")) for name, v in rates().items()]
    return (
        measured.filter(~failed_base())
        .select("lang", "source", F.explode(F.array(*entries)).alias("e"))
        .groupBy("lang", "source", "e.measure", "e.bucket")
        .agg(F.count("*").alias("n"))
    )


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, ``<measure>_low`` and ``<measure>_high`` from the quartiles of each sketch.

    The spread of a measure is its interquartile range, but at least the measure's least spread, so that a group in
    which nearly all values agree does not lose every document that differs.
    """
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merge_sketches(sketches, keys).select(
        *keys, "measure", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("total")
    )
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bucket")))
    quartiles = ranked.groupBy(*keys, "measure").agg(
        at(25).alias("q1"), at(75).alias("q3"), F.max("total").alias("n")
    )
    out = quartiles.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[
            F.max(F.when(F.col("measure") == name, bound)).alias(f"{name}_{side}")
            for name, (_, least) in MEASURES.items()
            for side, bound in (
                ("low", F.col("q1") - SPREADS * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))),
                ("high", F.col("q3") + SPREADS * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))),
            )
        ],
    )
    return out


def apply_limits(measured: DataFrame, sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``measured`` with base_failed and kept.

    Limits come from the narrowest group with at least ``min_group`` documents: (lang, source), lang, all. Null
    languages and sources are groups of their own. Where no document passes the fixed rules there are no limits.
    """
    def named(keys: list[str], prefix: str) -> DataFrame:
        found = limits(sketches, keys)
        found = found.filter(F.col("n") >= min_group) if keys else found
        return found.select(
            *[F.col(k).alias(f"{prefix}_{k}") for k in keys],
            *[F.col(f"{m}_{s}").alias(f"{prefix}_{m}_{s}") for m in MEASURES for s in ("low", "high")],
        )

    both, lang = named(["lang", "source"], "a"), named(["lang"], "b")
    whole = limits(sketches, []).first()  # one row of six numbers, none without documents
    # The group tables have a row per (lang, source); they are small beside the documents, and when they are not,
    # the join shuffles and splits hot groups.
    scope = (
        measured.join(both, F.col("lang").eqNullSafe(F.col("a_lang")) & F.col("source").eqNullSafe(F.col("a_source")), "left")
        .join(lang, F.col("lang").eqNullSafe(F.col("b_lang")), "left")
    )
    verdict = F.lit(True)
    for name, value in rates().items():
        bound = lambda side: F.coalesce(
            *[F.col(f"{p}_{name}_{side}") for p in "ab"], F.lit(whole[f"{name}_{side}"] if whole else None)  # noqa: B023
        )
        verdict = verdict & F.coalesce(value <= bound("high"), F.lit(True))
        if MEASURES[name][0]:
            verdict = verdict & F.coalesce(value >= bound("low"), F.lit(True))
    failed = failed_base()
    return scope.select(
        "doc_id", "lang", "source", *COUNTS, failed.alias("base_failed"), (~failed & verdict).alias("kept")
    )


def filter_quality(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, lang, source, counts, base_failed, kept: one row per row of ``docs``.

    Empty tables give no rows. Null and empty texts fail the fixed rules. Repeated rows are judged alike and each
    count in the sketch. Texts are read once; what follows works on the written counts.
    """
    measured = materialise(measure(docs), "quality")
    return apply_limits(measured, sketch(measured), min_group)
