"""Readers of the text formats: one lazy job per corpus of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as T
from lectern.functions.alignment import align_chars
from lectern.operators.cues import text_segments
from lectern.operators.ordered import Running, numbered, running, time_shard
from lectern.operators.scoring import last_per_uid
from lectern.session import materialise

# Accepted extensions and own temporary names.
TEXT_EXTENSIONS = ["txt", "md", "markdown", "csv", "json", "log", "srt"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "flv", "wmv", "webm", "m4v", "ts"]
AUDIO_EXTENSIONS = ["wav", "mp3", "m4a", "flac", "aac", "ogg", "wma", "opus"]
OWN_TEMP_NAMES = "(^|/)batchsub_[^/]*$|\\.temp\\.wav$"
UNSUPPORTED, EMPTY = "unsupported format", "empty file"
BOM = "﻿"
BLOCK_MARK = "\uffff"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTERS = 256
#: Lines of a recording whose cues are numbered together, where they keep their order.
SHARD_LINES = 100_000
CUE_COLUMNS = ["rec_id", "cue_no", "start_ms", "end_ms", "lines"]


def read_text(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Text files, of which there may be many in as many folders: these are listed by ``LISTERS`` tasks, not one each."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), LISTERS)))
    try:
        return spark.read.options(**options).text(path)
    finally:
        spark.conf.set(LISTING, before)


def text_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines with the place they came from: ``value, file, block, ticket``.

    ``ticket`` grows along a split, and ``block`` is where the split starts in its file, so
    (file, block, ticket) is the file order although splits are read in parallel.
    """
    return read_text(spark, path, **options).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ticket"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``line_no`` from 0 over all files in path order.

    Inside a split the number is the ticket minus the split's first ticket; only one row per
    split (its size) meets in a window.
    """
    lines = text_lines(spark, path)
    splits = lines.groupBy("file", "block").agg(
        F.min("ticket").alias("_first"), F.count("*").alias("_n")
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return lines.join(offsets, ["file", "block"]).select(
        (F.col("ticket") - F.col("_first") + F.col("_offset")).alias("line_no"), "file", "value"
    )


def read_uid_text(spark: SparkSession, path: str, sep: str = "\t", name: str = "text") -> DataFrame:
    """``uid<sep>text`` lines: split once, trimmed, blank lines skipped, the last duplicate wins.

    The uids that occur again are found first, so the texts of all others are not shuffled.
    """
    lines = text_lines(spark, path).filter(F.length("value") > 0)
    parts = F.split("value", "\\Q" + sep + "\\E", 2)
    rows = lines.select(
        T.strip(parts[0]).alias("uid"),
        T.strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias(name),
        F.struct("file", "block", "ticket").alias("_at"),
    )
    again = materialise(rows.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1").select("uid"), "repeated-uids")
    once = rows.join(again, "uid", "left_anti").select("uid", name)
    return once.unionByName(last_per_uid(rows.join(again, "uid", "left_semi"), "uid", F.col("_at")).select("uid", name))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``uid path`` lines separated by any white space; other arities are skipped."""
    parts = F.split(T.strip("value"), "(?U)\\s+", 2)
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 2)
    return rows.select(F.col("p")[0].alias("uid"), F.col("p")[1].alias("path"))


def read_positions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(line_no, uid, <name>) for pairing by position; broken lines keep NULL fields."""
    parts = F.split(T.strip("value"), "(?U)\\s+", 2)
    return numbered_lines(spark, path).select(
        "line_no",
        F.when(F.size(parts) == 2, parts[0]).alias("uid"),
        F.when(F.size(parts) == 2, parts[1]).alias(name),
    )


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    body = F.decode("content", "UTF-8")
    return spark.read.format("binaryFile").load(path).select("path", body.alias("body"))


def rec_of(path: Column | str) -> Column:
    """File name without folder and extension."""
    base = F.regexp_extract(F.col(path) if isinstance(path, str) else path, "([^/]*)$", 1)
    return F.regexp_replace(base, "\\.[^.]*$", "")


def parse_subtitles(files: DataFrame, dialect: str = "tolerant") -> DataFrame:
    """files(rec_id, body) to cues(rec_id, cue_no, start_ms, end_ms, lines).

    ``tolerant``: BOM, any line ends, comma or dot millis, missing index lines; lines made only
    of digits are taken for index lines; a time line also ends the cue before it, whose text stays;
    sorted by start. ``strict``: blank-line blocks with the
    time in their first or second line; the text lines are joined by spaces, file order kept.
    A subtitle file is one row, so parsing is an array expression without a shuffle; ``read_subtitles`` reads long files.
    """
    body = F.regexp_replace(F.regexp_replace("body", "\\r\\n?", "\n"), BOM, "")
    if dialect == "tolerant":
        # A block runs from a time line to the next blank or time line. Both get a mark, a code point that no text has,
        # and the file is split at the marks: work grows with the file's length.
        tidy = F.regexp_replace(F.replace(body, F.lit(BLOCK_MARK), F.lit("")), "(?U)[^\\S\\n]+(?=\\n|\\z)", "")
        marked = F.regexp_replace(F.regexp_replace(tidy, f"(?md)^(?=.*{T.CUE_TIMES})", BLOCK_MARK), "(?md)^$", BLOCK_MARK)
        blocks = F.filter(F.split(marked, BLOCK_MARK), lambda x: F.get(F.split(x, "\n"), F.lit(0)).rlike(T.CUE_TIMES))
    else:
        blocks = F.split(T.strip(body), "\\n\\s*\\n")
    rows = files.select("rec_id", F.posexplode(blocks).alias("at", "b")).withColumn("ls", F.split("b", "\n"))
    cues = _cues_of_blocks(rows, dialect, "at")
    order = ["start_ms", "at"] if dialect == "tolerant" else ["at"]
    # One recording's cues come from one row of the file table, so this window is that small.
    w = Window.partitionBy("rec_id").orderBy(*order)
    return cues.withColumn("cue_no", F.row_number().over(w).cast("bigint")).select(*CUE_COLUMNS)


def _cues_of_blocks(blocks: DataFrame, dialect: str, *keep: str) -> DataFrame:
    """blocks(rec_id, ls) to their cues; blocks without a time or without text give none."""
    if dialect == "tolerant":
        rows = blocks.withColumn("time", F.get("ls", F.lit(0)))
        text = F.filter(F.slice("ls", F.lit(2), F.size("ls")), lambda t: (t != "") & ~t.rlike("(?U)^\\d+\\z"))
        rows = rows.withColumn("lines", text).filter(F.size("lines") > 0)
    else:
        rows = blocks.withColumn("ls", F.filter("ls", lambda x: ~T.is_blank(x)))
        first = F.get("ls", F.lit(0)).rlike(T.CUE_TIMES)
        second = F.get("ls", F.lit(1)).rlike(T.CUE_TIMES)
        at = F.when(first, 1).when(second, 2)
        rows = rows.withColumn("t", at).filter("t is not null and size(ls) >= 2").withColumn(
            "time", F.element_at("ls", F.col("t"))
        )
        text = F.array_join(F.transform(F.slice("ls", F.col("t") + 1, F.size("ls")), T.strip), " ")
        rows = rows.withColumn("lines", F.array(text)).filter(F.col("lines")[0] != "")
    return rows.select(
        "rec_id", *keep, T.parse_clock("time", 1).alias("start_ms"), T.parse_clock("time", 5).alias("end_ms"), "lines"
    )


def read_subtitles(
    spark: SparkSession, path: str, dialect: str = "tolerant", rec: Callable[[Column], Column] | None = None, **options: str
) -> DataFrame:
    """Subtitle files to cues as ``parse_subtitles`` gives them, read in splits.

    ``rec`` names the recording of a file path, by default the file's name; files of one recording are read one after
    the other in path order. Each line learns the last mark at or before it (time or blank line) inside its split, from
    one row a split across borders; the lines of a block then meet by their mark. A file is nowhere in one task.
    """
    raw = text_lines(spark, path, **options)
    value = F.replace(F.col("value"), F.lit(BOM), F.lit(""))
    if dialect == "tolerant":
        value = F.regexp_replace(F.replace(value, F.lit(BLOCK_MARK), F.lit("")), "(?U)\\s+\\z", "")
    # A path is long: a row holds it once, as its shard, and only up to the numbers of the lines.
    lines = raw.select((rec or rec_of)(F.col("file")).alias("rec_id"), F.struct("file", "block").alias("_shard"), "ticket", value.alias("value"))
    timed = F.col("value").rlike(T.CUE_TIMES) & F.lit(dialect == "tolerant")
    blank = F.col("value").rlike("^\\s*\\z")
    mark = F.when(timed | blank, F.struct("ticket", timed.alias("timed")))
    # An empty file part and one that begins inside a block both look back to the split before.
    marked = running(lines.withColumn("blank", blank), ["rec_id"], ["ticket"], F.col("_shard"), [
        Running("mark", "last", mark), Running("line_no", "sum", F.lit(1).cast("bigint")),
    ])
    inside = marked.filter("not blank")
    if dialect == "tolerant":
        inside = inside.filter("mark.timed")
    blocks = inside.groupBy("rec_id", F.col("mark.ticket").alias("mark")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("rows")
    ).select("rec_id", F.col("rows")[0]["line_no"].alias("line_no"), F.col("rows.value").alias("ls"))
    cues = _cues_of_blocks(blocks, dialect, "line_no")
    if dialect == "tolerant":
        order, shard = ["start_ms", "line_no"], time_shard("start_ms")
    else:
        order, shard = ["line_no"], F.floor(F.col("line_no") / SHARD_LINES).cast("bigint")
    return numbered(cues, ["rec_id"], order, shard, "cue_no").select(*CUE_COLUMNS)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested recogniser output, one JSON object per line."""
    return spark.read.schema(schemas.RESULTS).json(path)


def result_segments(results: DataFrame) -> DataFrame:
    """Segments of each result: its sentences; else those that its token times give; else its whole text at 0..0.

    A result with token times needs a text and at least one character in its tokens.
    """
    plain = results.select("rec_id", "text", "sentence_info", "timestamps")
    sentences = F.size(F.coalesce("sentence_info", F.array().cast(
        "array<struct<text:string,start:bigint,end:bigint,spk:string>>"))) > 0
    heard, _ = token_times("timestamps")
    tokens = ~sentences & (F.length(T.strip_tags("text")) > 0) & F.coalesce(F.length(heard) > 0, F.lit(False))
    zero = F.lit(0).cast("bigint")
    whole = F.array(
        F.struct(
            F.coalesce("text", F.lit("")).alias("text"), zero.alias("start"), zero.alias("end"),
            F.lit("0").alias("spk"),
        )
    )
    rows = plain.filter(~tokens).select(
        "rec_id", F.posexplode(F.when(sentences, F.col("sentence_info")).otherwise(whole)).alias("seg_no", "s")
    )
    given = rows.select(
        "rec_id", "seg_no", T.speaker_label("s.spk").alias("speaker"),
        T.strip_tags("s.text").alias("text"),
        F.coalesce("s.start", zero).alias("start_ms"), F.coalesce("s.end", zero).alias("end_ms"),
    )
    # A segment's number follows the order in its result, from 0.
    timed = text_segments(aligned_texts(plain.filter(tokens)).withColumn("pos", F.lit(0))).select(
        "rec_id", (F.col("seg_no") - F.min("seg_no").over(Window.partitionBy("rec_id"))).cast("int").alias("seg_no"),
        T.speaker_label(F.lit("0")).alias("speaker"), "text", "start_ms", "end_ms",
    )
    return given.unionByName(timed)


def token_times(timestamps: str) -> tuple[Column, Column]:
    """What the tokens say, and the (start, end) in ms of each of its characters: a token's span split evenly."""
    tokens = F.coalesce(F.col(timestamps), F.array().cast("array<struct<token:string,start_time:double,end_time:double>>"))

    def spread(t: Column) -> Column:
        n = F.coalesce(F.length(t["token"]), F.lit(0))
        t0, t1 = (F.coalesce(t[c], F.lit(0.0)) * 1000 for c in ("start_time", "end_time"))
        edge = lambda i: (t0 + (t1 - t0) * i / n).cast("bigint")
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(edge(i).alias("start"), edge(i + 1).alias("end")))
        return F.when(n > 0, each).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))

    return F.array_join(F.transform(tokens, lambda t: F.coalesce(t["token"], F.lit(""))), ""), F.flatten(F.transform(tokens, spread))


def aligned_texts(results: DataFrame) -> DataFrame:
    """(rec_id, text, times): the final text, and for each of its characters the times of the token it aligns to."""
    heard, times = token_times("timestamps")
    rows = results.select("rec_id", T.strip_tags("text").alias("text"), heard.alias("heard"), times.alias("times"))
    return rows.select("rec_id", "text", align_chars(F.col("text"), F.col("heard"), F.col("times")).alias("times"))


def aligned_chars(results: DataFrame) -> DataFrame:
    """(rec_id, pos, ch, start_ms, end_ms): the final text's characters with the times of the tokens they align to."""
    chars = F.arrays_zip(F.split("text", "").alias("ch"), F.col("times").alias("t"))
    each = aligned_texts(results).filter("text <> ''").select("rec_id", F.posexplode(chars).alias("pos", "x"))
    return each.select(
        "rec_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.ch").alias("ch"),
        F.col("x.t.start").alias("start_ms"), F.col("x.t.end").alias("end_ms"),
    )


def token_chars(results: DataFrame) -> DataFrame:
    """Token times to characters: (rec_id, pos, ch, start_ms, end_ms), a token's span split evenly."""
    heard, times = token_times("timestamps")
    each = results.select("rec_id", heard.alias("heard"), F.posexplode(times).alias("pos", "t"))
    return each.select(
        "rec_id", F.col("pos").cast("bigint").alias("pos"), F.substring("heard", F.col("pos") + 1, F.lit(1)).alias("ch"),
        F.col("t.start").alias("start_ms"), F.col("t.end").alias("end_ms"),
    )


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, errors). UTF-8, else GBK with undecodable bytes dropped.

    Unsupported extensions and files that are empty after trimming become error rows.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
        .select("path", "content")
    )
    named = files.withColumn("source", F.regexp_extract("path", "([^/]*)$", 1)).withColumn(
        "ok", F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1)).isin(TEXT_EXTENSIONS)
    )
    # GBK bytes are decoded by the worker: the JVM function accepts only a few charsets.
    gbk = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("gbk", errors="ignore")), "string")
    utf8 = named.filter("ok and is_valid_utf8(content)").select(
        "path", "source", F.decode("content", "UTF-8").alias("text")
    )
    other = named.filter("ok and not is_valid_utf8(content)").select(
        "path", "source", gbk("content").alias("text")
    )
    read = utf8.unionByName(other)
    empty = T.is_blank("text")
    errors = named.filter("not ok").select("path", "source", F.lit(UNSUPPORTED).alias("error")).unionByName(
        read.filter(empty).select("path", "source", F.lit(EMPTY).alias("error"))
    )
    return read.filter(~empty), errors


def media_filter(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """files(path, ...) with a media extension, own temporary names left out, distinct by path."""
    wanted = "|".join(extensions or VIDEO_EXTENSIONS + AUDIO_EXTENSIONS)
    return files.filter(F.lower("path").rlike(f"\\.({wanted})$")).filter(
        ~F.col("path").rlike(OWN_TEMP_NAMES)
    ).dropDuplicates(["path"])


def list_media(spark: SparkSession, roots: list[str], recursive: bool = False,
               extensions: list[str] | None = None) -> DataFrame:
    """Sorted inventory of media files under the roots; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots)
        .select("path", "length", "modificationTime")
    )
    return media_filter(files, extensions).orderBy("path")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SAMPLES).json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Score reports, one JSON document per file or line, to (tag, condition, cer, ...)."""
    raw = spark.read.schema(schemas.REPORT).option("multiLine", "true").json(path)
    return explode_reports(raw)


def explode_reports(raw: DataFrame) -> DataFrame:
    return raw.select("tag", F.explode("conditions").alias("condition", "s")).select(
        "tag", "condition", "s.cer", "s.sent_acc", "s.n", "s.sec"
    )


def read_decode_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(texts(uid, text), timings(time_speech, time_escape)) found in a free-form progress log."""
    lines = spark.read.text(path)
    shape = "^(\\w[\\w.-]*)\\t(.*)$"
    texts = lines.filter(F.col("value").rlike(shape)).select(
        F.regexp_extract("value", shape, 1).alias("uid"), F.regexp_extract("value", shape, 2).alias("text")
    )
    pair = "time_speech:\\s*([0-9.]+), time_escape:\\s*([0-9.]+)"
    # A progress bar repeats its figures on one line; the last one counts.
    speech = F.try_element_at(F.regexp_extract_all("value", F.lit(pair), F.lit(1)), F.lit(-1))
    escape = F.try_element_at(F.regexp_extract_all("value", F.lit(pair), F.lit(2)), F.lit(-1))
    timings = lines.select(
        speech.cast("double").alias("time_speech"), escape.cast("double").alias("time_escape")
    ).filter("time_speech is not null")
    return texts, timings


def read_fragments(spark: SparkSession, path: str, fmt: str = "json", per_trigger: int | None = None) -> DataFrame:
    """A stream of live caption fragments with control rows."""
    reader = spark.readStream.schema(schemas.FRAGMENTS).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)
