"""Reader, writer and stream queries: the given tables go out through a sink and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import cues as C
from lectern.operators import datasets as A
from lectern.operators import scorer as M
from lectern.operators import scoring as S
from lectern.plans import bindings as B
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.session import scratch_path
from lectern.sources import readers as R
from lectern.sources import sinks as K
from lectern.streaming import live as V

_ONE_LINE = "trim(replace(text, chr(10), ' '))"


def _one_line():
    return F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))


@query(f"""WITH h AS (SELECT doc_id, lang, {_ONE_LINE} AS t FROM documents)
SELECT concat('doc', doc_id) AS uid, t AS text FROM h UNION ALL
SELECT concat('lang_', lang), arg_max(t, (t, doc_id)) FROM h GROUP BY lang""")
def uid_text_round_trip(spark, d):
    """Hypothesis files: written sorted by uid and text; of a repeated uid the last line wins."""
    docs = B.table(spark, d, "documents").select("doc_id", "lang", _one_line().alias("hyp"))
    unique = docs.select(F.concat(F.lit("doc"), "doc_id").alias("uid"), "hyp")
    repeated = docs.select(F.concat(F.lit("lang_"), "lang").alias("uid"), "hyp")
    path = scratch_path(spark, "hyps")
    lines = unique.unionByName(repeated).repartitionByRange("uid", "hyp").sortWithinPartitions("uid", "hyp")
    lines.select(F.concat_ws("\t", "uid", "hyp").alias("value")).write.text(path)
    return R.read_uid_text(spark, path + "/*.txt")


@query(f"""SELECT concat('d', doc_id) AS uid, {_ONE_LINE} AS path FROM documents WHERE {_ONE_LINE} <> '' UNION ALL
SELECT concat('e', event_id), event_type FROM events""")
def manifest_round_trip(spark, d):
    path = scratch_path(spark, "manifest")
    docs = B.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit("  "), _one_line()).alias("value"))
    events = B.table(spark, d, "events").select(F.concat(F.lit("e"), "event_id", F.lit("\t"), "event_type").alias("value"))
    broken = B.table(spark, d, "nation").select(F.col("n_name").alias("value"))  # one field: skipped
    docs.unionByName(events).unionByName(broken).write.text(path)
    return R.read_manifest(spark, path)


@query(f"""WITH {Q.SENTENCES} SELECT 'a' AS system, uid, trim({Q.SYSTEM_A}) AS text FROM sent WHERE {Q.DECODED} UNION ALL
SELECT 'b', uid, trim({Q.SYSTEM_B}) FROM sent WHERE {Q.DECODED}""")
def hypotheses_round_trip(spark, d):
    """A file of hypotheses per system, and back."""
    path = scratch_path(spark, "hyps")
    heard = [B.hypotheses(spark, d, s).withColumn("system", F.lit(s)) for s in "ab"]
    K.write_hypotheses(heard[0].unionByName(heard[1]), path, ["system"])
    read = [R.read_uid_text(spark, f"{path}/system={s}").withColumn("system", F.lit(s)) for s in "ab"]
    return read[0].unionByName(read[1]).select("system", "uid", "text")


@query(f"""SELECT lang AS split, concat('d', doc_id) AS uid, concat('audio/', doc_id, '.wav') AS path, trim({_ONE_LINE}) AS text
FROM documents WHERE {_ONE_LINE} <> ''""")
def manifest_lists_round_trip(spark, d):
    """Lists of audio files and of texts per language, paired again by their ids."""
    path = scratch_path(spark, "lists")
    docs = B.documents(spark, d).select(
        F.col("lang").alias("split"), F.concat(F.lit("d"), "doc_id").alias("utt_id"),
        F.concat(F.lit("audio/"), "doc_id", F.lit(".wav")).alias("path"), _one_line().alias("text"),
    )
    K.write_manifests(docs, path)
    text = R.read_manifest(spark, f"{path}/text").withColumnRenamed("path", "text")
    split = spark.read.text(f"{path}/wav").select("split", F.split("value", " ")[0].alias("uid"))
    return R.read_manifest(spark, f"{path}/wav").join(text, "uid").join(split, "uid").select("split", "uid", "path", "text")


_SPOKEN = "replace(text, chr(10), ' ')"


@query(f"""SELECT conv_id::VARCHAR AS rec, count(*) AS n, md5(string_agg(concat('【', role, '】', {_SPOKEN}), chr(10) ORDER BY turn)) AS digest
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def transcript_lines(spark, d):
    """A transcript per conversation; the part files of one hold its lines in order."""
    path = scratch_path(spark, "transcripts")
    said = B.table(spark, d, "conversations").filter("text is not null").select(
        F.col("conv_id").alias("rec_id"), F.col("turn").alias("seg_no"), F.col("role").alias("speaker"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"),
    )
    K.write_transcript(said, path)
    lines = R.text_lines(spark, path).withColumn("rec", F.regexp_extract("file", "/rec_id=([^/]*)/", 1))
    # A conversation has a handful of lines.
    told = F.array_sort(F.collect_list(F.struct("file", "block", "ticket", "value")))
    return lines.groupBy("rec").agg(told.alias("told")).select(
        "rec", F.size("told").cast("bigint").alias("n"), F.md5(F.array_join("told.value", "\n")).alias("digest")
    )


@query(f"""WITH {Q.CUES} SELECT concat('rec_id=', rec_id) AS rec, start_ms, end_ms, text FROM cues""")
def srt_round_trip(spark, d):
    """Subtitle files per recording, written strictly and parsed back tolerantly."""
    path = scratch_path(spark, "srt")
    K.write_srt(C.renumber(B.cues(spark, d)), path, "strict")
    cues = R.read_subtitles(spark, path, rec=_folder, **_PART_FILES)
    return cues.select("rec_id", "start_ms", "end_ms", F.array_join("lines", " ").alias("text")).withColumnRenamed("rec_id", "rec")


@query(f"""WITH {Q.CUES} SELECT concat('rec_id=', rec_id) AS rec, start_ms, end_ms, text FROM cues""")
def srt_strict_round_trip(spark, d):
    path = scratch_path(spark, "srt")
    K.write_srt(C.renumber(B.cues(spark, d)), path, "plain")
    cues = R.read_subtitles(spark, path, "strict", _folder, **_PART_FILES)
    return cues.select("rec_id", "start_ms", "end_ms", F.array_join("lines", " ").alias("text")).withColumnRenamed("rec_id", "rec")


_PART_FILES = {"recursiveFileLookup": "true", "pathGlobFilter": "*.txt"}


def _folder(path):
    """A recording is a folder of part files."""
    return F.regexp_extract(path, "/(rec_id=[^/]*)/", 1)


@query(f"""WITH {Q.CUES} SELECT rec_id::VARCHAR AS rec, count(*) + 21 AS lines, 1::BIGINT AS heads FROM cues GROUP BY 1""")
def ass_round_trip(spark, d):
    path = scratch_path(spark, "ass")
    K.write_ass(C.renumber(B.cues(spark, d)), path)
    lines = R.read_text(spark, path, recursiveFileLookup="true").select(
        F.regexp_extract(F.input_file_name(), "/rec_id=([^/]*)/", 1).alias("rec"), "value"
    )
    return lines.groupBy("rec").agg(
        (F.count("*") + 6).alias("lines"), F.count_if(F.col("value").startswith("[Script Info]")).alias("heads")
    )


@query(f"""WITH {Q.SENTENCES} SELECT uid AS rec_id, 0 AS seg_no, '说话人0' AS speaker, trim(text) AS text, 0::BIGINT AS start_ms, 0::BIGINT AS end_ms
 FROM sent WHERE piece > 0 UNION ALL
SELECT uid, 0, concat('说话人', CASE WHEN lang = 'fr' THEN '未知' ELSE lang END), trim(text), (sent_no * 1000)::BIGINT, (sent_no * 1000 + length(text))::BIGINT FROM sent WHERE piece = 0""")
def results_round_trip(spark, d):
    """Nested recogniser output as JSON, with and without sentences, back to segments."""
    s = B.sentences(spark, d)
    sentence = F.struct(
        F.concat(F.lit("<|zh|><|Speech|>"), "text").alias("text"),
        (F.col("sent_no") * 1000).cast("bigint").alias("start"),
        (F.col("sent_no") * 1000 + F.length("text")).cast("bigint").alias("end"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("spk"),
    )
    path = scratch_path(spark, "results")
    s.select(
        F.col("uid").alias("rec_id"), "text", F.when(F.col("piece") == 0, F.array(sentence)).alias("sentence_info")
    ).write.json(path)
    return R.result_segments(R.read_results(spark, path))


# Tokens are a part name's words in lower case, 400 ms apart and 50 ms a character; the final text was rewritten.
_ALIGNED = """WITH RECURSIVE p AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS w,
  '<' || replace(replace(replace(p_name, 'a', 'oo'), 'i', ''), ' ', ', ') || '.' AS text FROM part),
tok AS (SELECT id, unnest(w) AS t, unnest(range(len(w))) AS k FROM p),
heard AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, c) - 1 AS i, substring(t, c + 1, 1) AS a, k * 400 + c * 50 AS s
  FROM (SELECT id, t, k, unnest(range(length(t))) AS c FROM tok)),
said AS (SELECT id, unnest(range(length(text))) AS j, text FROM p),
eq AS (SELECT h.id, i, j, i - row_number() OVER (PARTITION BY h.id, j - i ORDER BY i) AS run
  FROM heard h JOIN said s ON h.id = s.id AND h.a = substring(s.text, j + 1, 1)),
m AS (SELECT id, i, j, max(i) OVER (PARTITION BY id, j - i, run) - i + 1 AS n FROM eq),
size AS (SELECT p.id, (SELECT count(*) FROM heard h WHERE h.id = p.id) AS na, length(text) AS nb FROM p),
b AS (
  SELECT s.id, 0::BIGINT AS a0, na AS a1, 0::BIGINT AS b0, nb AS b1, max({'n': least(n, na - i, nb - j), 'i': -i, 'j': -j}) AS best
  FROM size s JOIN m ON m.id = s.id GROUP BY ALL
  UNION ALL
  SELECT c.id, c.a0, c.a1, c.b0, c.b1, max({'n': least(n, c.a1 - m.i, c.b1 - m.j), 'i': -m.i, 'j': -m.j})
  FROM (SELECT id, unnest([{'a0': a0, 'a1': -best.i, 'b0': b0, 'b1': -best.j},
    {'a0': best.n - best.i, 'a1': a1, 'b0': best.n - best.j, 'b1': b1}], recursive := true) FROM b) c
  JOIN m ON m.id = c.id AND m.i >= c.a0 AND m.i < c.a1 AND m.j >= c.b0 AND m.j < c.b1 GROUP BY ALL
),
blocks AS (SELECT id, -best.i AS i, -best.j AS j, best.n AS n FROM b UNION ALL SELECT id, na, nb, 0 FROM size),
gaps AS (SELECT id, i, j, n, lag(i + n, 1, 0) OVER (PARTITION BY id ORDER BY j, n DESC) AS i1, lag(j + n, 1, 0) OVER (PARTITION BY id ORDER BY j, n DESC) AS j1 FROM blocks),
src AS (SELECT id, i + k AS h, j + k AS j FROM (SELECT id, i, j, unnest(range(n)) AS k FROM gaps)
  UNION ALL SELECT id, i1 + least(i - i1 - 1, floor((k + 0.5) * (i - i1) / (j - j1))::BIGINT), j1 + k FROM (SELECT *, unnest(range(j - j1)) AS k FROM gaps WHERE i > i1)),
t AS (SELECT s.id, s.j, h.s, h.s + 50 AS e FROM said s LEFT JOIN src ON src.id = s.id AND src.j = s.j LEFT JOIN heard h ON h.id = s.id AND h.i = src.h),
f AS (SELECT id, j, s, e, last_value(e IGNORE NULLS) OVER (PARTITION BY id ORDER BY j) AS before, first_value(s IGNORE NULLS) OVER (PARTITION BY id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM t)
SELECT id AS rec_id, count(*) AS n, string_agg(coalesce(s, before, after, 0) || '-' || coalesce(e, before, after, 0), ' ' ORDER BY j) AS times FROM f GROUP BY id"""


def _token_results(spark, d):
    words = F.split(F.lower("p_name"), " ")
    token = F.transform(words, lambda w, k: F.struct(
        w.alias("token"), (k * 0.4).alias("start_time"), (k * 0.4 + F.length(w) * 0.05).alias("end_time")
    ))
    text = F.replace(F.replace(F.replace("p_name", F.lit("a"), F.lit("oo")), F.lit("i"), F.lit("")), F.lit(" "), F.lit(", "))
    return B.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("rec_id"), F.concat(F.lit("<"), text, F.lit(".")).alias("text"), token.alias("timestamps")
    )


@query(_ALIGNED)
def aligned_chars(spark, d):
    """Times of the characters of rewritten names, aligned to the names' words."""
    chars = R.aligned_chars(_token_results(spark, d))
    pair = F.concat_ws("-", "start_ms", "end_ms")
    return chars.groupBy(F.col("rec_id").cast("bigint").alias("rec_id")).agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", pair.alias("t")))), lambda x: x["t"]), " ").alias("times"),
    )


@query("""SELECT p_partkey::VARCHAR AS rec_id, 0 AS seg_no, '说话人0' AS speaker, '<' || replace(replace(replace(p_name, 'a', 'oo'), 'i', ''), ' ', ', ') || '.' AS text FROM part""")
def token_results(spark, d):
    """Results that carry only token times, as JSON, to segments: the names hold one sentence and no pause."""
    path = scratch_path(spark, "tokens")
    _token_results(spark, d).write.json(path)
    return R.result_segments(R.read_results(spark, path)).select("rec_id", "seg_no", "speaker", "text")


@query("""SELECT count(*) AS n, sum(length(trim(text, ' ' || chr(10))))::BIGINT AS chars FROM documents""")
def documents_round_trip(spark, d):
    """Document texts as text files, read back whole."""
    path = scratch_path(spark, "docs")
    B.table(spark, d, "documents").select("source", F.col("text").alias("value")).write.option(
        "lineSep", "\n\u0001\n"
    ).partitionBy("source").text(path)
    docs, _ = R.read_documents(spark, path, recursive=True)
    units = docs.select(F.explode(F.split("text", "\n\u0001\n")).alias("t")).filter("t <> ''")
    return units.agg(F.count("*").alias("n"), F.sum(F.length(T.strip("t"))).alias("chars"))


@query(f"""WITH {Q.SENTENCES} SELECT text AS answer, length(text)::BIGINT AS text_length, (floor((length(text) * 100 - 25) / 10) + 1)::BIGINT AS speech_length FROM sent""")
def samples_round_trip(spark, d):
    u = B.sentences(spark, d).select(
        "uid", "text", F.concat(F.lit("wav/"), "uid").alias("path"), (F.length("text") / 10.0).alias("duration_s")
    )
    path = scratch_path(spark, "samples")
    K.write_samples(A.build_samples(u), path, ["uid"])
    s = R.read_samples(spark, path)
    return s.select(F.element_at("messages", -1)["content"].alias("answer"), "text_length", "speech_length")


@query("""SELECT l_returnflag AS tag, l_linestatus AS condition, count(*) AS n, round(avg(l_tax), 6) AS cer, round(avg(l_discount), 6) AS sent_acc,
 round(sum(l_quantity), 3) AS sec FROM lineitem GROUP BY 1, 2""")
def report_round_trip(spark, d):
    """Measures per (tag, condition) as score reports and back to a long table."""
    rates = B.table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linestatus").alias("condition")).agg(
        F.round(F.avg("l_tax"), 6).alias("cer"), F.round(F.avg("l_discount"), 6).alias("sent_acc"),
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("sec"),
    )
    path = scratch_path(spark, "reports")
    K.write_report(S.report_map(rates, F.col("l_returnflag")), path)
    return R.explode_reports(spark.read.schema(R.schemas.REPORT).json(path))


@query("""SELECT concat('utt', event_id) AS uid, event_type AS text FROM events""")
def decode_log_texts(spark, d):
    return R.read_decode_log(spark, _log(spark, d))[0]


@query("""SELECT count(*) AS n, round(sum(value), 2) AS time_speech, round(sum(value + 1), 2) AS time_escape FROM events""")
def decode_log_timings(spark, d):
    return R.read_decode_log(spark, _log(spark, d))[1].agg(
        F.count("*").alias("n"), F.round(F.sum("time_speech"), 2).alias("time_speech"),
        F.round(F.sum("time_escape"), 2).alias("time_escape"),
    )


def _log(spark, d) -> str:
    """A progress log with one decoded event per pair of lines, among noise."""
    e = B.table(spark, d, "events")
    bar = F.format_string("rtf_avg: 0.1, time_speech:  %.2f, time_escape: %.2f: 100%%|####| 1/1", F.col("value"), F.col("value") + 1)
    text = F.concat(F.lit("utt"), "event_id", F.lit("\t"), "event_type")
    path = scratch_path(spark, "log")
    e.select(F.explode(F.array(F.lit("  0%|      | 0/1 [00:00<?]"), bar, text)).alias("value")).write.text(path)
    return path


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, event_type FROM events)
SELECT i AS line_no, event_type AS value FROM r""")
def numbered_lines(spark, d):
    """Line numbers over several files match the order the lines were written in."""
    path = scratch_path(spark, "lines")
    B.table(spark, d, "events").select("event_id", "event_type").repartitionByRange("event_id").sortWithinPartitions(
        "event_id"
    ).select(F.col("event_type").alias("value")).write.text(path)
    return R.numbered_lines(spark, path).select("line_no", "value")


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE upper(source) END AS text, CASE WHEN lang = 'fr' THEN 'refused' END AS error FROM documents""")
def scored_rows(spark, d):
    """The batch scorer hook: a batch with a refused row is retried row by row."""

    def make():
        def run(items):
            if any(x.endswith("fr") for x in items):
                raise ValueError("refused")
            return [x.split("/")[0].upper() for x in items]

        return run

    rows = B.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    return M.recognise(rows, make).select("doc_id", "text", "error")


@query("""SELECT doc_id, source AS punctuated FROM documents""")
def punctuated_rows(spark, d):
    """The punctuator hook returns its input on any failure."""

    def make():
        def run(items):
            raise RuntimeError("no model")

        return run

    rows = B.table(spark, d, "documents").select("doc_id", F.col("source").alias("text"))
    return M.punctuate(rows, make).select("doc_id", "punctuated")


# --------------------------------------------------------------------------- live

_PARTS = """WITH f AS (SELECT user_id AS session_id, event_id AS seq, substring(event_type, 1, 1) AS text, event_type = 'purchase' AS fin FROM events),
p AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM f)"""
_CHUNKED = _PARTS + """, s AS (SELECT *, (row_number() OVER (PARTITION BY session_id, part ORDER BY seq) - 1) // 4 AS slot FROM p),
c AS (SELECT session_id, part, slot, count(*) AS n, string_agg(text, '' ORDER BY seq) AS text, max(seq) AS last_seq, bool_or(fin) AS fin FROM s GROUP BY 1, 2, 3)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY last_seq) - 1 AS chunk_no, n, text, last_seq FROM c WHERE n = 4 OR fin"""
_FINALS = _PARTS + """SELECT session_id, part AS utt_no, max(seq) AS seq, string_agg(text, '' ORDER BY seq) AS text FROM p GROUP BY 1, 2 HAVING bool_or(fin)"""


#: Events of a user lie hours apart; none of these silences ends a part, as in the SQL twins.
YEAR_MS = 366 * 24 * 3600 * 1000


def _event_stream(spark, d):
    """The events as a stream, and a fragment a day after the last of them, so that all are released."""
    end = B.table(spark, d, "events").agg(F.date_add(F.max("ts"), 1).cast("timestamp") + F.expr("INTERVAL 1 DAY")).first()[0]
    return V.close_at(B.fragments_of(B.table_stream(spark, d, "events")), end)


@query(_CHUNKED)
def fixed_count_windows(spark, d):
    return V.rechunk_batch(B.fragments_of(B.table(spark, d, "events")), 4)


@query(_CHUNKED)
def fixed_count_windows_stream(spark, d):
    stream = V.rechunk_stream(_event_stream(spark, d), 4, YEAR_MS, 2 * YEAR_MS)
    return V.run_available(stream, spark, "chunks").drop("batch")


@query(_FINALS)
def caption_finals(spark, d):
    return V.caption_finals(B.fragments_of(B.table(spark, d, "events")))


@query(_FINALS)
def caption_finals_stream(spark, d):
    stream = V.accumulate_captions(_event_stream(spark, d), YEAR_MS, 2 * YEAR_MS)
    return V.stream_finals(V.run_available(stream, spark, "captions")).select("session_id", "utt_no", "seq", "text")


@query("SELECT user_id AS session_id, event_id AS seq, substring(event_type, 1, 1) AS text FROM events")
def caption_partials_stream(spark, d):
    stream = V.accumulate_captions(_event_stream(spark, d), YEAR_MS, 2 * YEAR_MS)
    return V.stream_partials(V.run_available(stream, spark, "captions")).select("session_id", "seq", "text")


@query("SELECT conv_id AS session_id, least(count(*), 16) AS messages FROM conversations WHERE length(text) > 0 GROUP BY 1")
def session_memory_stream(spark, d):
    turns = B.table_stream(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )
    return V.run_available(V.session_memory(turns), spark, "memory", "update").select("session_id", "messages")


@query("""SELECT user_id AS task_id, count(*) AS done, count(*) FILTER (event_type = 'error') AS failed, max(event_id) AS latest,
 concat('file', max(event_id)) AS current FROM events GROUP BY 1""")
def job_progress_stream(spark, d):
    stream = V.job_progress(B.items_of(B.table_stream(spark, d, "events")))
    return V.run_available(stream, spark, "progress", "update").drop("batch")


@query("""SELECT user_id AS session_id, hour(ts) AS line_no, arg_max(event_type, event_id) AS text, max(event_id) AS version FROM events GROUP BY 1, 2""")
def amended_lines(spark, d):
    v = B.table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.hour("ts").alias("line_no"),
        F.col("event_type").alias("text"), F.col("event_id").alias("version"),
    )
    return V.amend_lines(v)


@query("SELECT user_id AS session_id, count(*) AS fragments FROM events GROUP BY 1")
def deduplicated_stream(spark, d):
    """Every fragment delivered twice and kept once, with state bounded by a watermark."""
    e = B.table_stream(spark, d, "events")
    twice = e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"),
    )
    out = V.run_available(V.within_watermark(twice), spark, "dedup")
    return out.groupBy("session_id").agg(F.count("*").alias("fragments"))
