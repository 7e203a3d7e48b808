"""Dialogue, dataset and batch-job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import datasets as A
from lectern.operators import dialogue as D
from lectern.operators import jobs as J
from lectern.plans import bindings as B
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.sources.readers import media_filter

# --------------------------------------------------------------------------- dialogue

_RANKED = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE length(text) > 0)"""


@query(_RANKED + "SELECT conv_id AS session_id, turn, role, age FROM r WHERE age <= 4")
def session_history(spark, d):
    """Two turns are kept here, so that the given conversations are long enough to be trimmed."""
    return D.session_history(B.turns(spark, d), 2).select("session_id", "turn", "role", "age")


@query(_RANKED + """SELECT conv_id AS session_id, turn, role, trim(text, ' ' || chr(10)) AS content FROM r
WHERE age <= 6 AND role IN ('user', 'assistant') AND trim(text, ' ' || chr(10)) <> ''""")
def prompt_history(spark, d):
    return D.prompt_history(B.turns(spark, d), 3).select("session_id", "turn", "role", "content")


@query("SELECT conv_id AS session_id, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY min(turn) DESC, conv_id DESC LIMIT 60")
def evict_sessions(spark, d):
    return D.evict_sessions(B.turns(spark, d), 60)


@query("""SELECT role, count(*) AS messages, count(*) FILTER (role IN ('user', 'assistant') AND trim(text, ' ' || chr(10)) <> '') AS usable
FROM conversations GROUP BY role""")
def role_counts(spark, d):
    return D.role_counts(B.turns(spark, d))


_ROLE = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text FROM conversations WHERE role = "


@query(f"""WITH u AS ({_ROLE} 'user'), a AS ({_ROLE} 'assistant'), s AS ({_ROLE} 'system'),
n AS (SELECT conv_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT u.conv_id, u.i, concat(CASE WHEN u.i = 1 THEN concat('<|im_start|>system', chr(10), s.text, '<|im_end|>', chr(10)) ELSE '' END,
  '<|im_start|>user', chr(10), u.text, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) AS prompt,
  concat(a.text, '<|im_end|>') AS target
 FROM u JOIN a ON a.conv_id = u.conv_id AND a.i = u.i JOIN n ON n.conv_id = u.conv_id
 JOIN s ON s.conv_id = u.conv_id AND s.i = (u.i - 1) % n.n + 1 WHERE u.i <= 5),
y AS (SELECT *, coalesce(sum(length(prompt) + length(target)) OVER (PARTITION BY conv_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM x)
SELECT conv_id AS session_id, i::INT AS turn_no, prompt, target, used FROM y WHERE used <= 1500""")
def chat_samples(spark, d):
    return D.chat_samples(B.turns(spark, d))


@query("""SELECT doc_id, concat(CASE WHEN lang = 'en' THEN concat('请结合上下文信息，更加准确地完成语音转写任务。如果没有相关信息，我们会留空。',
 chr(10), chr(10), chr(10), '**上下文信息：**', chr(10), chr(10), chr(10), '热词列表：[', source, ', ', lang, ']', chr(10)) ELSE '' END,
 CASE WHEN lang = 'fr' THEN '语音转写' ELSE concat('语音转写成', lang) END, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '，不进行文本规整' END, '：') AS prompt
FROM documents""")
def instruction_prompt(spark, d):
    words = F.when(F.col("lang") == "en", F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    language = F.when(F.col("lang") != "fr", F.col("lang"))
    return B.table(spark, d, "documents").select(
        "doc_id", D.instruction_prompt(words, language, F.col("doc_id") % 2 == 0).alias("prompt")
    )


# --------------------------------------------------------------------------- datasets


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS uid, CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'matched' END AS status
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def labelled_pairs_audit(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.col("source").alias("path"))
    labels = B.table(spark, d, "labels").select(F.col("doc_id").alias("uid"), F.col("quality").cast("string").alias("text"))
    return A.pair_by_uid(docs, labels).select("uid", "status")


@query("""WITH a AS (SELECT doc_id AS line_no, doc_id AS uid, source AS path FROM documents),
b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, doc_id AS uid, CASE WHEN quality = 1 THEN 'good' END AS text FROM labels)
SELECT coalesce(a.line_no, b.line_no) AS line_no, CASE WHEN a.line_no IS NULL THEN 'right_only' WHEN b.line_no IS NULL THEN 'left_only'
 WHEN text IS NULL THEN 'malformed' WHEN a.uid <> b.uid THEN 'mismatch' ELSE 'matched' END AS status,
 CASE WHEN a.line_no IS NOT NULL AND b.line_no IS NOT NULL AND text IS NOT NULL AND a.uid <> b.uid
  THEN concat('UTT mismatch: ', a.uid, ' vs ', b.uid) END AS error
FROM a FULL OUTER JOIN b ON a.line_no = b.line_no""")
def positional_pairs(spark, d):
    """Documents and labels zipped by position."""
    from lectern.operators.ordered import global_rank

    docs = B.table(spark, d, "documents").select(
        F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("uid"), F.col("source").alias("path")
    )
    labels = B.table(spark, d, "labels")
    ranked = global_rank(labels, ["doc_id"], F.floor(F.col("doc_id") / 1000)).select(
        (F.col("rank") - 1).alias("line_no"), F.col("doc_id").cast("string").alias("uid"),
        F.when(F.col("quality") == 1, "good").alias("text"),
    )
    return A.pair_by_position(docs, ranked).select("line_no", "status", "error")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id AS uid FROM r WHERE i % greatest(1, n // 80) = 0 AND i < 80 * greatest(1, n // 80)""")
def systematic_sample(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("uid"))
    return A.systematic_sample(docs, "uid")


@query(f"""WITH {Q.SENTENCES}, r AS (SELECT uid, row_number() OVER (ORDER BY md5(concat('42#', uid)), uid) - 1 AS i FROM sent)
SELECT uid, CASE WHEN i % 8 = 0 THEN 'val' ELSE 'train' END AS split FROM r""")
def split_by_hash(spark, d):
    return A.train_val_split(B.sentences(spark, d).select("uid"), "uid").select("uid", "split")


_UTTS = f"""WITH {Q.SENTENCES}, utt AS (SELECT uid, text, concat('wav/', uid, '.wav') AS path,
 CASE WHEN piece = 0 THEN length(text) / 8.0 END AS duration_s FROM sent)"""


def _utterances(spark, d):
    dur = F.when(F.col("piece") == 0, F.length("text") / 8.0)
    return B.sentences(spark, d).select(
        "uid", "text", F.concat(F.lit("wav/"), "uid", F.lit(".wav")).alias("path"), dur.alias("duration_s")
    )


@query(_UTTS + """SELECT uid, CASE WHEN duration_s IS NOT NULL THEN concat('语音转写：<|startofspeech|>!', path, '<|endofspeech|>') END AS asked,
 CASE WHEN duration_s IS NOT NULL THEN text END AS answer, (floor((duration_s * 1000 - 25) / 10) + 1)::BIGINT AS speech_length,
 CASE WHEN duration_s IS NOT NULL THEN length(text) END AS text_length, CASE WHEN duration_s IS NULL THEN concat('WAV not found: ', path) END AS error FROM utt""")
def build_samples(spark, d):
    s = A.build_samples(_utterances(spark, d))
    return s.select(
        "uid", F.element_at("messages", 2)["content"].alias("asked"), F.element_at("messages", 3)["content"].alias("answer"),
        "speech_length", "text_length", "error",
    )


@query(_UTTS + """, f AS (SELECT uid, (floor((duration_s * 1000 - 25) / 10) + 1)::BIGINT AS n, length(text) AS t FROM utt WHERE duration_s IS NOT NULL),
g AS (SELECT uid, n, t, (1 + floor((n - 1) / 2.0))::BIGINT AS a FROM f), h AS (SELECT *, (1 + floor((a - 1) / 2.0))::BIGINT AS b FROM g)
SELECT uid, (floor((b - 1) / 2.0) + 1)::BIGINT AS audio_tokens FROM h WHERE floor((b - 1) / 2.0) + 1 + t <= 200""")
def token_budget(spark, d):
    s = A.build_samples(_utterances(spark, d)).filter("error is null")
    return A.within_token_budget(s, 200).select("uid", T.audio_tokens("speech_length").alias("audio_tokens"))


@query(f"""WITH {Q.SENTENCES}, r AS (SELECT uid, length(text) AS n, row_number() OVER (ORDER BY md5(concat('42#', uid)), uid) - 1 AS i FROM sent),
s AS (SELECT CASE WHEN i % 8 = 0 THEN 'val' ELSE 'train' END AS split, n FROM r)
SELECT split, count(*) AS n, sum(n) / 60.0 AS minutes FROM s GROUP BY ROLLUP (split)""")
def dataset_summary(spark, d):
    u = B.sentences(spark, d).select("uid", F.length("text").alias("duration_s"))
    return A.dataset_summary(A.train_val_split(u, "uid"))


@query("""WITH m AS (SELECT 'documents' AS corpus FROM documents UNION ALL SELECT 'conversations' FROM conversations
 UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT 'pages' FROM pages) SELECT corpus, count(*) AS n FROM m GROUP BY ROLLUP (corpus)""")
def corpus_mixture(spark, d):
    def texts(name: str, column: str):
        return B.table(spark, d, name).select(F.col(column).alias("text"))

    return A.mixture_counts(
        A.mixture(
            {
                "documents": texts("documents", "text"), "conversations": texts("conversations", "text"),
                "benchmark": texts("benchmark", "text"), "pages": texts("pages", "html"),
            }
        )
    )


@query(_UTTS + """, e AS (SELECT uid, concat('WAV not found: ', path) AS error FROM utt WHERE duration_s IS NULL),
r AS (SELECT error, row_number() OVER (ORDER BY uid) AS rank FROM e)
SELECT rank::INT AS rank, error, (SELECT count(*) FROM utt WHERE duration_s IS NOT NULL) AS processed, (SELECT count(*) FROM e) AS failed,
 greatest(0, (SELECT count(*) FROM e) - 10) AS not_shown FROM r WHERE rank <= 10""")
def error_sample(spark, d):
    return A.error_sample(A.build_samples(_utterances(spark, d)), ["uid"])


@query("""SELECT l_returnflag AS job, sum(l_quantity)::DOUBLE AS rows, sum(l_tax) AS elapsed_s, count(*) AS batches,
 round(sum(l_quantity) / sum(l_tax), 4) AS rows_per_s FROM lineitem GROUP BY 1""")
def throughput(spark, d):
    p = B.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("job"), F.col("l_quantity").alias("rows"), F.col("l_tax").alias("elapsed_s")
    )
    return A.throughput(p).withColumn("rows_per_s", F.round("rows_per_s", 4))


# --------------------------------------------------------------------------- jobs


@query(r"""WITH m AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
s AS (SELECT DISTINCT path, regexp_extract(path, '([^/\\]*)$', 1) AS base FROM m),
t AS (SELECT path, concat('subtitle/', CASE WHEN regexp_matches(base, '^.+\.[^.]*$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END, '.srt') AS target FROM s),
w AS (SELECT target, min(path) AS winner FROM t GROUP BY 1),
e AS (SELECT DISTINCT concat('subtitle/', CASE WHEN regexp_matches(b, '^.+\.[^.]*$') THEN regexp_replace(b, '\.[^.]*$', '') ELSE b END, '.srt') AS target
 FROM (SELECT regexp_extract(path, '([^/\\]*)$', 1) AS b FROM m WHERE page_id % 2 = 0))
SELECT path, t.target, CASE WHEN path <> winner THEN 'conflict' WHEN e.target IS NOT NULL THEN 'skipped' ELSE 'todo' END AS status, winner
FROM t JOIN w ON w.target = t.target LEFT JOIN e ON e.target = t.target""")
def output_plan(spark, d):
    """Pages as inputs; the outputs of even pages exist already."""
    files = B.media_files(spark, d)
    existing = files.filter(F.col("page_id") % 2 == 0).select(
        F.concat(F.lit("subtitle/"), J.output_name("path"), F.lit(".srt")).alias("target")
    )
    return J.plan_outputs(files, existing)


@query(r"""WITH m AS (SELECT regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 3 = 0 THEN '.MP4' WHEN page_id % 3 = 1 THEN '.wav' ELSE '.txt' END AS path FROM pages)
SELECT DISTINCT path FROM m WHERE regexp_matches(lower(path), '\.(mp4|wav)$')""")
def media_inventory(spark, d):
    ext = F.when(F.col("page_id") % 3 == 0, ".MP4").when(F.col("page_id") % 3 == 1, ".wav").otherwise(".txt")
    files = B.media_files(spark, d).select(F.concat("path", ext).alias("path"))
    return media_filter(files).orderBy("path")


@query("""SELECT user_id AS task_id, count(*) AS total, count(*) AS done, count(*) FILTER (event_type <> 'error') AS success,
 count(*) FILTER (event_type = 'error') AS failed, coalesce(sum(floor(value)) FILTER (event_type <> 'error'), 0)::BIGINT AS lines,
 concat('file', max(event_id)) AS current FROM events GROUP BY 1""")
def job_summary(spark, d):
    return J.job_summary(B.items_of(B.table(spark, d, "events")))


@query("""SELECT user_id AS task_id, concat('file', event_id) AS file, concat('Error code: ', event_id % 7 + 400) AS error FROM events WHERE event_type = 'error'""")
def failed_items(spark, d):
    return J.failed_items(B.items_of(B.table(spark, d, "events")))


@query("""WITH e AS (SELECT concat('Error code: ', event_id % 7 + 400) AS m FROM events WHERE event_type = 'error')
SELECT CASE WHEN contains(m, '401') THEN '401' WHEN contains(m, '402') THEN '402' WHEN contains(m, '404') THEN '404' ELSE concat('other: ', m) END AS error_class,
 count(*) AS n FROM e GROUP BY 1""")
def error_classes(spark, d):
    return J.error_classes(B.items_of(B.table(spark, d, "events")).filter("error is not null"))


@query("""SELECT count(*) AS n, round(avg(l_extendedprice / l_quantity), 6) AS mean_rtf, round(sum(l_extendedprice) / sum(l_quantity), 6) AS total_rtf,
 round(sum(l_quantity) / sum(l_extendedprice), 9) AS speed FROM lineitem WHERE l_quantity > 0""")
def rtf_summary(spark, d):
    t = B.table(spark, d, "lineitem").select(F.col("l_quantity").alias("duration_s"), F.col("l_extendedprice").alias("cost_s"))
    return J.rtf_summary(t).select(
        "n", F.round("mean_rtf", 6).alias("mean_rtf"), F.round("total_rtf", 6).alias("total_rtf"), F.round("speed", 9).alias("speed")
    )


@query("SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages ORDER BY path LIMIT 5")
def first_files(spark, d):
    return J.first_files(B.media_files(spark, d).select("path").distinct())
