"""Breaking text into subtitle lines and documents into chunks, as column expressions.

All loops of these jobs run inside one row (a segment or a section), so they are regular
expressions and array folds evaluated by the JVM: no Python worker and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import cues as C

# Marks that close a clause, light characters a cut may follow, places a line may
# break, and the sizes used by default.
CLOSING_MARKS = "。！？!?；;，,、：:"
SOFT_CUT_CHARS = "的了是这那个在与和或及就把对从被也都还能去会想很"
CUT_CHARS = T.SENTENCE_END_CHARS + T.CLAUSE_CHARS + "、“”‘’（）()《》〈〉【】—－-…~· "
LINE_MAX = 20
WIDE_FACTOR = 2.1
HARD_FACTOR = 1.4
GREEDY_MAX = 15
CHUNK_SIZE = 400
CHUNK_OVERLAP = 80
CHUNK_SENTENCE_MARKS = "。！？!?；;\n"

_EMPTY = "array<string>"


def _visible(parts: Column) -> Column:
    return F.filter(F.transform(parts, T.strip), lambda p: p != "")


def _no_lines() -> Column:
    return F.array().cast(_EMPTY)


def break_lines_greedy(text: Column | str, max_len: int = GREEDY_MAX) -> Column:
    """Lines of at most ``max_len``: whole clauses packed greedily, long clauses cut after a soft
    character in the second half of the window, else at the limit. Every character is kept."""
    t = T.strip(F.coalesce(T.col(text), F.lit("")))
    marks, others = T.char_class(CLOSING_MARKS), T.char_class(CLOSING_MARKS, negate=True)
    clauses = F.regexp_extract_all(t, F.lit(f"{others}*{marks}+|{others}+"), F.lit(0))
    cut_up = lambda c: F.when(F.length(c) <= max_len, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(piece), F.lit(0)))
    half = max_len // 2
    soft = T.char_class(SOFT_CUT_CHARS)
    # Longest first: the rest if it fits, else up to the last soft character, else a full line.
    piece = f"(?s).{{1,{max_len}}}\\z|.{{{half},{max_len - 1}}}{soft}|.{{{max_len}}}"

    def step(a: Column, clause: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(clause["whole"]) <= max_len
        cut = clause["cut"]
        flushed = F.concat(
            a["lines"],
            F.when(a["cur"] == "", _no_lines()).otherwise(F.array(a["cur"])),
            F.slice(cut, F.lit(1), F.size(cut) - 1),
        )
        return F.struct(
            F.when(fits, a["lines"]).otherwise(flushed).alias("lines"),
            F.when(fits, F.concat(a["cur"], clause["whole"])).otherwise(F.element_at(cut, -1)).alias("cur"),
        )

    start = F.struct(_no_lines().alias("lines"), F.lit("").alias("cur"))
    packed = F.aggregate(
        F.transform(clauses, lambda c: F.struct(c.alias("whole"), cut_up(c).alias("cut"))), start, step,
        lambda a: F.when(a["cur"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["cur"]))),
    )
    return F.when(t == "", _no_lines()).when(F.length(t) <= max_len, F.array(t)).otherwise(packed)


def _near_cut(limit: int) -> str:
    """Regex for one line of an over-long clause: the rest when short enough, else up to the cut
    character nearest the limit (the earlier one on a tie), else exactly the limit."""
    low, high = max(1, int(limit * 0.6)), int(limit * 1.15)
    cut = T.char_class(CUT_CHARS)
    nearest = sorted(range(low, high + 1), key=lambda i: (abs(i - limit), i))
    options = [f".{{1,{int(limit * HARD_FACTOR)}}}\\z"]
    options += [f".{{{i - 1}}}{cut}" for i in nearest]
    options += [f".{{{limit}}}"]
    return "(?s)\\s*+(" + "|".join(options) + ")"


def break_lines_punct(text: Column | str, max_len: int = LINE_MAX) -> Column:
    """Lines cut at sentence ends, then at clause marks, then near the limit.

    Text that is mostly not CJK gets 2.1 times the limit. Fragments of up to three characters
    that do not end a sentence join the line before.
    """
    # The tags go once: the rest reads the bound text.
    return F.element_at(F.transform(F.array(T.strip_tags(text)), lambda t: _lines_of(t, max_len)), 1)


def _lines_of(t: Column, max_len: int) -> Column:
    ends, inner = T.char_class(T.SENTENCE_END_CHARS), T.char_class(T.SENTENCE_END_CHARS, negate=True)
    clause, within = T.char_class(T.CLAUSE_CHARS), T.char_class(T.CLAUSE_CHARS, negate=True)

    def lines_for(limit: int) -> Column:
        sentences = F.flatten(
            F.transform(
                F.regexp_extract_all(t, F.lit(f"{inner}+{ends}*"), F.lit(0)),
                lambda s: _visible(F.split(s, "(?U)(?<=[.!?])\\s+")),
            )
        )
        clauses = F.flatten(
            F.transform(
                sentences,
                lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(
                    _visible(F.regexp_extract_all(s, F.lit(f"{within}+{clause}*"), F.lit(0)))
                ),
            )
        )
        pieces = F.flatten(
            F.transform(
                clauses,
                lambda c: F.when(F.length(c) <= limit * HARD_FACTOR, F.array(c)).otherwise(
                    _visible(F.regexp_extract_all(c, F.lit(_near_cut(limit)), F.lit(1)))
                ),
            )
        )
        return merge_short_lines(pieces)

    wide = int(max_len * WIDE_FACTOR)
    return F.when(t == "", _no_lines()).when(T.is_cjk_dominant(t), lines_for(max_len)).otherwise(
        lines_for(wide)
    )


def merge_short_lines(lines: Column, short: int = 3) -> Column:
    """Append fragments to the previous line, with a space between two ASCII letters or digits."""
    ends = T.char_class(T.SENTENCE_END_CHARS)

    def step(a: Column, line: Column) -> Column:
        prev = F.try_element_at(a, F.lit(-1))
        joins = (F.size(a) > 0) & (F.length(line) <= short) & ~line.rlike(ends + "\\z")
        spaced = prev.rlike("[A-Za-z0-9]\\z") & line.rlike("^[A-Za-z0-9]")
        glued = F.concat(prev, F.when(spaced, F.lit(" ")).otherwise(F.lit("")), line)
        return F.when(
            joins, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(glued))
        ).otherwise(F.concat(a, F.array(line)))

    return F.aggregate(lines, _no_lines(), step)


def sentence_units(text: Column | str, marks: str = CHUNK_SENTENCE_MARKS) -> Column:
    """Sentences with their closing mark, trimmed, blanks dropped."""
    return _visible(F.split(T.col(text), "(?<=" + T.char_class(marks).replace("\n", "\\n") + ")"))


def chunks_of(
    text: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    marks: str = CHUNK_SENTENCE_MARKS,
) -> Column:
    """Overlapping chunks of about ``size`` characters, as an array.

    Sections (headings) never mix; long paragraphs fall apart into sentences; units are packed
    greedily and a new chunk begins with the last ``overlap`` characters of the one before; a
    chunk over twice the size is cut every ``size``.
    """
    t = T.strip(F.replace(F.coalesce(T.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")))
    sections = _visible(F.split(t, "(?U)\\n(?=[^\\S\\n]*#{1,6}[^\\S\\n])"))

    def units(section: Column) -> Column:
        return F.flatten(
            F.transform(
                _visible(F.split(section, "\\n\\n")),
                lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(
                    sentence_units(p, marks)
                ),
            )
        )

    def step(a: Column, unit: Column) -> Column:
        cur = a["cur"]
        fits = F.length(cur) + F.length(unit) + 1 <= size
        tail = F.substring(cur, F.length(cur) - overlap + 1, F.lit(overlap))
        fresh = F.when(
            (F.lit(overlap) > 0) & (F.length(cur) > overlap), F.concat(tail, F.lit("\n"), unit)
        ).otherwise(unit)
        return F.struct(
            F.when((cur == "") | fits, a["done"]).otherwise(F.concat(a["done"], F.array(cur))).alias("done"),
            F.when(cur == "", unit).when(fits, F.concat(cur, F.lit("\n"), unit)).otherwise(fresh).alias("cur"),
        )

    start = F.struct(_no_lines().alias("done"), F.lit("").alias("cur"))
    packed = F.flatten(
        F.transform(
            sections,
            lambda s: F.aggregate(
                units(s), start, step,
                lambda a: F.when(a["cur"] == "", a["done"]).otherwise(
                    F.concat(a["done"], F.array(a["cur"]))
                ),
            ),
        )
    )

    def hard_cut(c: Column) -> Column:
        begins = F.sequence(F.lit(0), F.floor((F.length(c) - 1) / size).cast("int"))
        return F.transform(begins, lambda i: F.substring(c, i * size + 1, F.lit(size)))

    cut = F.flatten(
        F.transform(packed, lambda c: F.when(F.length(c) <= 2 * size, F.array(c)).otherwise(hard_cut(c)))
    )
    return F.when(t == "", _no_lines()).otherwise(_visible(cut))


def generate_cues(
    segments: DataFrame, offset_s: float = 0.0, max_len: int = GREEDY_MAX, shard: Column | None = None
) -> DataFrame:
    """Segments to display cues: time offset, greedy lines, character-exact times where known,
    lingering end times. ``seg_no`` is unique in a recording; ``shard`` follows it (1024 numbers a shard by default).
    Columns: rec_id, cue_no, start_ms, end_ms, text."""
    off = int(round(offset_s * 1000))
    max_len = max(5, max_len)
    segs = segments.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).filter("text <> ''")
    if "char_times" not in segs.columns:
        segs = segs.withColumn("char_times", F.lit(None).cast("array<struct<s:bigint,e:bigint>>"))
    segs = segs.withColumn("lines", break_lines_greedy("text", max_len)).withColumn(
        "_exact", F.coalesce(F.size("char_times") == F.length("text"), F.lit(False))
    )
    base = ["rec_id", "seg_no", "lines", "start_ms", "end_ms"]
    exact = C.lines_from_char_times(segs.filter("_exact").select(*base, "char_times"), off)
    start = T.shift_start("start_ms", off)
    spread = C.allocate_by_length(
        segs.filter("not _exact").select(
            "rec_id", "seg_no", "lines", start.alias("start_ms"),
            T.shift_end(start, "end_ms", off).alias("end_ms"),
        )
    )
    rows = exact.unionByName(spread).withColumnRenamed("line", "text")
    # Display order is segment order; the clamp looks at the next line in that order.
    ordered = C.running(
        rows, ["rec_id"], ["seg_no", "line_no"], F.floor(F.col("seg_no") / 1024).cast("bigint") if shard is None else shard,
        [
            C.Running("cue_no", "sum", F.lit(1).cast("bigint")),
            C.Running("_next", "lead", F.col("start_ms")),
        ],
    )
    return ordered.select("rec_id", "cue_no", "start_ms", C.shown_until().alias("end_ms"), "text")


def batch_subtitles(segments: DataFrame, durations: DataFrame | None = None, max_len: int = LINE_MAX) -> DataFrame:
    """Recogniser segments (rec_id, seg_no, text, start_ms, end_ms) to subtitle cues, ready for ``write_srt``.

    Tags go, blank segments too; a segment that does not advance gets a length by its text; the only segment of a
    recording, at 0..0, lasts as long as the recording where ``durations`` (rec_id, duration_ms) knows it. Lines share a
    segment's time by their visible characters, and cues follow each other in segment order without overlap. Times are
    fractional milliseconds. Columns: rec_id, cue_no, start_ms, end_ms, text.
    """
    zero = F.lit(0.0)
    times = [F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("start_ms", "end_ms")]
    segs = segments.select("rec_id", "seg_no", T.strip_tags("text").alias("text"), *times).filter("text <> ''")
    if durations is not None:
        alone = segs.groupBy("rec_id").agg(F.count("*").alias("_n")).filter("_n = 1")
        known = durations.select("rec_id", F.col("duration_ms").cast("double").alias("_duration")).join(alone, "rec_id", "left_semi")
        whole = (F.col("start_ms") == 0) & (F.col("end_ms") == 0)
        end = F.when(whole, F.coalesce("_duration", zero)).otherwise(F.col("end_ms"))
        segs = segs.join(known, "rec_id", "left").withColumn("end_ms", end).drop("_duration")
    segs = segs.withColumn("end_ms", T.repair_end("start_ms", "end_ms", "text")).select(
        "rec_id", "seg_no", "start_ms", "end_ms", break_lines_punct("text", max_len).alias("lines")
    )
    lines = C.allocate_by_weight(segs, T.effective_len)
    numbered = C.running(
        lines, ["rec_id"], ["seg_no", "line_no"], F.floor(F.col("seg_no") / 1024).cast("bigint"),
        [C.Running("cue_no", "sum", F.lit(1).cast("bigint"))],
    )
    placed = C.monotone_times(numbered, order=["cue_no"], shard=F.floor(F.col("cue_no") / 4096).cast("bigint"))
    text = numbered.select("rec_id", "cue_no", F.col("line").alias("text"))
    return placed.join(text, ["rec_id", "cue_no"])
