"""Keyword, term, chunking and retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import DIMS, embed_texts
from lectern.operators import dialogue as D
from lectern.operators import keywords as K
from lectern.operators import knowledge as N
from lectern.operators import lines as L
from lectern.operators import store as S
from lectern.operators import terms as X
from lectern.operators.grid import rows_within
from lectern.plans import bindings as B
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.session import materialise, scratch_path

_KEYWORDS = """kw AS (SELECT DISTINCT lower(array_to_string((string_split(trim(text), ' '))[1:2], ' ')) AS keyword FROM benchmark)"""
_EXACT = f"""WITH {Q.WHOLE_SENTENCES}, {_KEYWORDS}, ex AS (SELECT uid, doc_id, keyword FROM sent JOIN kw ON contains(lower(text), keyword))"""


@query(_EXACT + "SELECT uid, keyword FROM ex")
def keyword_exact(spark, d):
    return K.match_exact(B.whole_sentences(spark, d), B.keywords(spark, d)).select("uid", "keyword")


@query(_EXACT + "SELECT uid, keyword FROM ex")
def keyword_exact_joined(spark, d):
    """The gram-join plan that long keyword lists take."""
    segments = B.whole_sentences(spark, d)
    return K._match_grams(segments, K.distinct_keywords(B.keywords(spark, d))).select("uid", "keyword")


@query(_EXACT + """SELECT uid, count(*) AS n, string_agg(keyword, '|' ORDER BY keyword) AS keywords FROM ex GROUP BY uid""")
def matched_group(spark, d):
    hits = K.match_exact(B.whole_sentences(spark, d), B.keywords(spark, d)).select(
        "uid", "keyword", F.lit("exact").alias("match_type"), F.lit(100.0).alias("similarity")
    )
    out = K.matched_segments(hits, ["uid"])
    return out.select("uid", F.size("hits").cast("bigint").alias("n"), F.array_join("keywords", "|").alias("keywords"))


@query(_EXACT + """SELECT (SELECT count(*) FROM sent) AS total_segments, (SELECT count(DISTINCT doc_id) FROM sent) AS total_files,
 count(DISTINCT uid) AS matched_segments, count(DISTINCT doc_id) AS matched_files FROM ex""")
def search_summary(spark, d):
    segments = B.whole_sentences(spark, d)
    return K.search_summary(segments, K.match_exact(segments, B.keywords(spark, d)), "doc_id", ["doc_id", "uid"])


@query()
def keyword_fuzzy(spark, d):
    return K.search_keywords(B.whole_sentences(spark, d), B.keywords(spark, d), ["uid"], 75)


@query(r"""SELECT event_id, array_to_string(list_sort(list_distinct([trim(t) FOR t IN string_split(props, ',') IF trim(t) <> ''])), '|') AS terms FROM events""")
def parse_terms(spark, d):
    terms = F.array_sort(T.parse_keywords("props"))
    return B.table(spark, d, "events").select("event_id", F.array_join(terms, "|").alias("terms"))


def _terms(spark, d) -> list[str]:
    rows = rows_within(B.keywords(spark, d), 20_000)
    if rows is None:
        raise ValueError("a term list is a call argument; pass at most 20000 terms")
    return [r.keyword for r in rows]


@query()
def term_fixes(spark, d):
    out = X.correct_terms(B.whole_sentences(spark, d), ["uid", "doc_id"], _terms(spark, d))
    return out.filter(F.size("fixes") > 0).select(
        "uid", "text", F.size("fixes").alias("n"), F.element_at("fixes", 1)["from"].alias("first_from"),
        F.element_at("fixes", 1)["to"].alias("first_to"),
    )


@query()
def distinct_fixes(spark, d):
    out = X.correct_terms(B.whole_sentences(spark, d), ["uid", "doc_id"], _terms(spark, d))
    return X.distinct_fixes(out, "doc_id", ["uid"])


@query(f"""WITH {Q.WHOLE_SENTENCES} SELECT uid, length(text) AS chars FROM sent""")
def term_lengths_kept(spark, d):
    """The lengths of corrected texts are those of the given ones."""
    out = X.correct_terms(B.whole_sentences(spark, d), ["uid"], _terms(spark, d))
    return out.select("uid", F.length("text").alias("chars"))


# A letter's syllable is the letter and an i. An s is no initial, so si against zi are finals that share one letter of
# three, and no like initials: 0.6 * 200 / 3 = 40. Names have more than two letters.
@query("""WITH p AS (SELECT p_partkey AS pair_id, lower(p_name) AS term, replace(lower(p_name), 's', 'z') AS cand FROM part),
n AS (SELECT *, length(term) - length(replace(term, 's', '')) AS changed FROM p)
SELECT pair_id, cand, term, (100.0 * (length(term) - changed) + 40.0 * changed)::DOUBLE / length(term) AS similarity FROM n
WHERE (100.0 * (length(term) - changed) + 40.0 * changed) / length(term) >= 55 AND NOT (term[1] = 's' AND term[-1] = 's')""")
def pronunciation_match(spark, d):
    """Part names against names a letter apart, with the letters themselves as the lexicon."""
    parts = B.table(spark, d, "part").select(
        F.col("p_partkey").alias("pair_id"), F.lower("p_name").alias("term"),
        F.replace(F.lower("p_name"), F.lit("s"), F.lit("z")).alias("cand"),
    )
    letters = parts.select(F.explode(F.split("term", "")).alias("char")).unionByName(
        parts.select(F.explode(F.split("cand", "")).alias("char"))
    ).filter("char <> ''").distinct()
    return X.pronunciation_match(parts, letters.withColumn("syllable", F.concat("char", F.lit("i"))))


# --------------------------------------------------------------------------- chunks


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '([.!?\n])', '\1' || chr(1), 'g') AS t FROM documents),
u AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS s FROM t)
SELECT doc_id, count(*) AS n, sum(length(trim(s, ' ' || chr(10))))::BIGINT AS chars FROM u WHERE trim(s, ' ' || chr(10)) <> '' GROUP BY doc_id""")
def sentence_units(spark, d):
    units = B.documents(spark, d).select("doc_id", F.explode(L.sentence_units("text", ".!?\n")).alias("s"))
    return units.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.length("s")).cast("bigint").alias("chars")
    )


_CHUNKS = r"""WITH RECURSIVE b AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS t FROM documents),
q AS (SELECT doc_id, string_split(regexp_replace(t, '([!?;\n])', '\1' || chr(1), 'g'), chr(1)) AS l FROM b WHERE length(t) > 400
  UNION ALL SELECT doc_id, [t] FROM b WHERE length(t) <= 400),
v AS (SELECT doc_id, [trim(x, ' ' || chr(10)) FOR x IN l IF trim(x, ' ' || chr(10)) <> ''] AS l FROM q),
w AS (SELECT doc_id, 1 AS i, l[1] AS cur, NULL::VARCHAR AS done FROM v WHERE len(l) > 0 UNION ALL
  SELECT w.doc_id, i + 1,
   CASE WHEN length(cur) + length(l[i + 1]) + 1 <= 400 THEN cur || chr(10) || l[i + 1]
        WHEN length(cur) > 80 THEN substring(cur, length(cur) - 79, 80) || chr(10) || l[i + 1] ELSE l[i + 1] END,
   CASE WHEN length(cur) + length(l[i + 1]) + 1 <= 400 THEN NULL ELSE cur END
  FROM w JOIN v USING (doc_id) WHERE i < len(l)),
c AS (SELECT doc_id, i, done AS c FROM w WHERE done IS NOT NULL UNION ALL
  SELECT w.doc_id, i + 1, cur FROM w JOIN v USING (doc_id) WHERE i = len(l)),
h AS (SELECT doc_id, i, 0 AS k, c FROM c WHERE length(c) <= 800 UNION ALL
  SELECT doc_id, i, k, substring(c, k * 400 + 1, 400) FROM (SELECT *, unnest(range(0, (length(c) - 1) // 400 + 1))::INT AS k FROM c WHERE length(c) > 800)),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS chunk, trim(c, ' ' || chr(10)) AS text
  FROM h WHERE trim(c, ' ' || chr(10)) <> ''),
idx AS (SELECT chunks.doc_id, chunk, chunks.text, substring(md5(b.t), 1, 12) AS digest FROM chunks JOIN b USING (doc_id))
"""


def _chunks(spark, d):
    docs = B.documents(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id")).alias("source"), "text")
    return N.chunk_documents(docs)


@query(_CHUNKS + """SELECT concat('doc', doc_id) AS source, chunk::INT AS chunk, length(text) AS chars, text FROM idx""")
def chunk_documents(spark, d):
    return _chunks(spark, d).select("source", "chunk", "chars", "text")


@query(_CHUNKS + """SELECT concat('doc', doc_id, '#', digest, '#', chunk) AS chunk_id, digest FROM idx""")
def chunk_ids(spark, d):
    return _chunks(spark, d).select("chunk_id", "digest")


@query(_CHUNKS + """SELECT concat('doc', doc_id) AS source, count(*) AS chunks FROM idx GROUP BY doc_id""")
def kb_sources(spark, d):
    return N.kb_sources(_chunks(spark, d))


@query(_CHUNKS + "SELECT count(*) AS chunks FROM idx")
def kb_count(spark, d):
    return N.kb_count(_chunks(spark, d))


@query(_CHUNKS + """SELECT concat('doc', b.doc_id) AS source, coalesce(n, 0) AS chunks, length(t) AS chars,
 substring(md5(t), 1, 12) AS digest, NULL AS error FROM b LEFT JOIN (SELECT doc_id, count(*) AS n FROM idx GROUP BY 1) USING (doc_id)""")
def index_report(spark, d):
    docs = B.documents(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id")).alias("source"), "text")
    return N.index_report(docs)


@query("""WITH old AS (SELECT source, doc_id, length(text) AS chars FROM documents),
new AS (SELECT d.source, d.doc_id, 0 AS chars FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)
SELECT source, count(*) AS chunks, sum(chars)::BIGINT AS chars FROM (SELECT * FROM new UNION ALL
 SELECT * FROM old WHERE source NOT IN (SELECT source FROM new)) GROUP BY source""")
def kb_upsert(spark, d):
    """Sources that own a toxic document are re-added with only those documents."""
    docs = B.table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("chars"))
    toxic = B.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    again = docs.join(toxic, "doc_id", "left_semi").select("source", "doc_id", F.lit(0).alias("chars"))
    return N.merged(docs, again).groupBy("source").agg(
        F.count("*").alias("chunks"), F.sum("chars").cast("bigint").alias("chars")
    )


@query("""WITH new AS (SELECT d.source, d.doc_id, replace(d.text, 'e', 'E') AS text FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)
SELECT source, count(*) AS chunks, sum(length(text))::BIGINT AS chars, min(md5(text)) AS lowest FROM (SELECT * FROM new UNION ALL
 SELECT source, doc_id, text FROM documents WHERE source NOT IN (SELECT source FROM new)) GROUP BY source""")
def kb_upsert_stored(spark, d):
    """The same on a stored table: only the buckets of re-added sources are rewritten."""
    path = scratch_path(spark, "kb")
    docs = B.table(spark, d, "documents").select("source", "doc_id", "text")
    S.create(spark, path, docs)
    S.upsert(spark, path, docs)
    toxic = B.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    again = docs.join(toxic, "doc_id", "left_semi").select("source", "doc_id", F.replace("text", F.lit("e"), F.lit("E")).alias("text"))
    S.upsert(spark, path, again)
    return S.load(spark, path).groupBy("source").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.min(F.md5("text")).alias("lowest"),
    )


@query("""SELECT source, count(*) AS before, sum(CASE WHEN source IN (SELECT DISTINCT source FROM documents d JOIN labels l USING (doc_id)
 WHERE toxic = 1) THEN 0 ELSE 1 END)::BIGINT AS after, min(md5(text)) AS lowest FROM documents GROUP BY source""")
def kb_delete_stored(spark, d):
    """Sources with a toxic document leave a stored table; the version before it still has them."""
    path = scratch_path(spark, "kb")
    docs = B.table(spark, d, "documents").select("source", "doc_id", "text")
    S.create(spark, path, docs)
    first = S.upsert(spark, path, docs)
    toxic = B.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    S.delete(spark, path, docs.join(toxic, "doc_id", "left_semi"))
    old = S.load(spark, path, first).groupBy("source").agg(F.count("*").alias("before"), F.min(F.md5("text")).alias("lowest"))
    new = S.load(spark, path).groupBy("source").agg(F.count("*").alias("left"))
    return old.join(new, "source", "left").select("source", "before", F.coalesce("left", F.lit(0)).cast("bigint").alias("after"), "lowest")


@query("""SELECT source, count(*) AS chunks FROM documents WHERE source NOT IN
 (SELECT DISTINCT source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1) GROUP BY source""")
def kb_delete(spark, d):
    docs = B.table(spark, d, "documents").select("source", "doc_id")
    toxic = B.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return N.kb_sources(N.without_source(docs, docs.join(toxic, "doc_id", "left_semi")))


# --------------------------------------------------------------------------- retrieval


@query("""WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS dot
 FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, chunk_id) AS rank FROM p)
SELECT query_id, rank, chunk_id, round(greatest(0, dot), 4) AS score FROM r WHERE rank <= 3 AND round(greatest(0, dot), 4) >= 0.35""")
def vector_topk(spark, d):
    """The nearest other vectors of every vector."""
    v = B.vectors(spark, d)
    return N.search_vectors(
        v.select(F.col("vec_id").alias("query_id"), "embedding"),
        v.select(F.col("vec_id").alias("chunk_id"), "embedding"), 3, N.MIN_SCORE, skip_self=True,
    )


@query(f"""WITH {Q.SENTENCES}, p AS (SELECT uid, unnest(range(1, length(text))) AS i, text FROM sent),
b AS (SELECT uid, (unicode(text[i]) * 31 + unicode(text[i + 1])) % {DIMS} AS slot FROM p),
n AS (SELECT DISTINCT uid, slot FROM b)
SELECT uid, count(*) AS slots, sum(slot)::BIGINT AS slot_sum, 1.0::DOUBLE AS norm FROM n GROUP BY uid""")
def embed_sentences(spark, d):
    """Which weights of the default sentence vectors are not zero, and that the length is one."""
    v = B.sentences(spark, d).select("uid", F.posexplode(embed_texts(F.col("text"))).alias("slot", "w"))
    return v.filter("w > 0").groupBy("uid").agg(
        F.count("*").alias("slots"), F.sum("slot").alias("slot_sum"),
        F.round(F.sqrt(F.sum(F.col("w").cast("double") * F.col("w"))), 3).alias("norm"),
    )


# The vectors of chunks and questions by slot, their products, and the three best chunks of every question.
_FOUND = _CHUNKS + f""", named AS (SELECT concat('doc', doc_id, '#', digest, '#', chunk) AS chunk_id, concat('doc', doc_id) AS source, chunk::INT AS chunk, text FROM idx),
texts AS (SELECT 'c' AS side, chunk_id AS id, text FROM named UNION ALL
 SELECT 'q', item_id::VARCHAR, concat('{N.QUERY_INSTRUCTION}', trim(text, ' ' || chr(10))) FROM benchmark WHERE trim(text, ' ' || chr(10)) <> ''),
pairs AS (SELECT *, unnest(range(1, length(text))) AS i FROM texts),
slots AS (SELECT side, id, (unicode(text[i]) * 31 + unicode(text[i + 1])) % {DIMS} AS slot, count(*) AS n FROM pairs GROUP BY ALL),
units AS (SELECT side, id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY side, id)) AS x FROM slots),
weights AS (SELECT side, id, slot, (x / sqrt(sum(x * x) OVER (PARTITION BY side, id)))::FLOAT::DOUBLE AS x FROM units),
dots AS (SELECT a.id AS query_id, e.id AS chunk_id, round(sum(a.x * e.x), 9) AS dot FROM weights a JOIN weights e USING (slot)
 WHERE a.side = 'q' AND e.side = 'c' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, chunk_id) AS rank FROM dots),
hit AS (SELECT query_id::BIGINT AS query_id, rank, source, chunk, round(greatest(0, dot), 4) AS score, text
 FROM ranked JOIN named USING (chunk_id) WHERE rank <= 3 AND round(greatest(0, dot), 4) >= {N.MIN_SCORE}),
origin AS (SELECT query_id, string_agg(source, '|' ORDER BY r) AS sources FROM (SELECT query_id, source, min(rank) AS r FROM hit GROUP BY 1, 2) GROUP BY 1),
clipped AS (SELECT *, replace(trim(text, ' ' || chr(10)), chr(10), ' ') AS t FROM hit),
shown AS (SELECT query_id, string_agg(concat('【', source, '】', CASE WHEN length(t) <= {D.SNIPPET_CHARS} THEN t
  ELSE concat(substring(t, 1, {D.SNIPPET_CHARS}), '…') END), chr(10) || chr(10) ORDER BY rank) AS snippets,
 string_agg(concat('【资料', rank, '｜来源：', source, '｜相似度', score::VARCHAR, '】', chr(10), text), chr(10) || chr(10) ORDER BY rank) AS materials
 FROM clipped GROUP BY 1),
aged AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE length(text) > 0),
past AS (SELECT conv_id, count(*) AS n FROM aged WHERE age <= 2 * {D.PROMPT_TURNS} AND role IN ('user', 'assistant') AND trim(text, ' ' || chr(10)) <> '' GROUP BY 1)
"""


def _hits(spark, d):
    """Hits of every benchmark item, as a question, among the chunks of all documents."""
    docs = B.documents(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id")).alias("source"), "text")
    chunks = materialise(N.index_documents(docs), "chunks")
    questions = B.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    found = N.search_vectors(N.question_vectors(questions), chunks, 3)
    hits = found.join(chunks.select("chunk_id", "source", "chunk", "text"), "chunk_id")
    return questions, hits


@query(_FOUND + f"SELECT query_id, rank, source, chunk, score, substring(text, 1, {D.PREVIEW_CHARS}) AS text FROM hit")
def answer_hits(spark, d):
    _, hits = _hits(spark, d)
    return D.hit_previews(hits.select("query_id", "rank", "source", "chunk", "score", "text"))


@query(_FOUND + f"""SELECT item_id AS query_id, CASE WHEN materials IS NULL THEN '{D.NOTHING_FOUND}' END AS answer, coalesce(sources, '') AS sources,
 CASE WHEN materials IS NOT NULL THEN 2 + coalesce(n, 0) END::INT AS n_messages,
 CASE WHEN materials IS NOT NULL THEN concat('《知识库资料》', chr(10), materials, chr(10), chr(10), '用户问题：', benchmark.text) END AS ask
FROM benchmark LEFT JOIN shown ON item_id = shown.query_id LEFT JOIN origin ON item_id = origin.query_id LEFT JOIN past ON item_id = conv_id""")
def answer_context(spark, d):
    questions, hits = _hits(spark, d)
    asked = questions.withColumn("session_id", F.col("query_id"))
    out = D.context_prompt(asked, hits, B.turns(spark, d), "system")
    return out.select(
        "query_id", "answer", F.array_join("sources", "|").alias("sources"),
        F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("ask"),
    )


@query(_FOUND + f"""SELECT item_id AS query_id, CASE WHEN snippets IS NULL THEN '{D.NOTHING_FOUND}'
 ELSE concat('{D.NO_ANSWERER}', chr(10), chr(10), snippets) END AS answer, coalesce(sources, '') AS sources
FROM benchmark LEFT JOIN shown ON item_id = shown.query_id LEFT JOIN origin ON item_id = origin.query_id""")
def retrieval_fallback(spark, d):
    questions, hits = _hits(spark, d)
    out = D.context_prompt(questions, hits, has_answerer=False)
    return out.select("query_id", "answer", F.array_join("sources", "|").alias("sources"))


# Lexical hits, so that prompt assembly has an exact twin: the question is a search term and its
# materials are the first three sentences that hold it.
_PICKED = f"""{Q.WHOLE_SENTENCES}, {_KEYWORDS},
k AS (SELECT keyword AS query_id, row_number() OVER (PARTITION BY keyword ORDER BY uid) AS rank, source, text
 FROM sent JOIN kw ON contains(lower(text), keyword)),
c AS (SELECT keyword AS query_id, concat('what about ', keyword) AS question FROM kw),
h AS (SELECT * FROM k WHERE rank <= 3)"""


def _picked(spark, d):
    words = B.keywords(spark, d)
    questions = words.select(
        F.col("keyword").alias("query_id"), F.concat(F.lit("what about "), "keyword").alias("question")
    )
    w = Window.partitionBy("query_id").orderBy("uid")
    hits = (
        K.match_exact(B.whole_sentences(spark, d), words).withColumnRenamed("keyword", "query_id")
        .withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
        .select("query_id", "rank", "source", "text", F.lit("0.5").alias("score"))
    )
    return questions, hits


@query(f"""WITH {_PICKED}, m AS (SELECT query_id, string_agg(concat('【资料', rank, '｜来源：', source, '｜相似度0.5】', chr(10), text),
 chr(10) || chr(10) ORDER BY rank) AS mat FROM h GROUP BY 1)
SELECT c.query_id, CASE WHEN mat IS NULL THEN '{D.NOTHING_FOUND}' END AS answer,
 CASE WHEN mat IS NOT NULL THEN concat('《知识库资料》', chr(10), mat, chr(10), chr(10), '用户问题：', question) END AS ask
FROM c LEFT JOIN m USING (query_id)""")
def context_prompt(spark, d):
    out = D.context_prompt(*_picked(spark, d))
    return out.select("query_id", "answer", F.element_at("messages", -1)["content"].alias("ask"))


@query(f"""WITH {_PICKED} SELECT query_id, string_agg(concat('【', source, '】', CASE WHEN length(t) <= 200 THEN t
 ELSE concat(substring(t, 1, 200), '…') END), chr(10) || chr(10) ORDER BY rank) AS snippets
FROM (SELECT *, replace(trim(text, ' ' || chr(10)), chr(10), ' ') AS t FROM h) GROUP BY 1""")
def fallback_snippets(spark, d):
    return D.snippets(_picked(spark, d)[1])


@query(f"""WITH {_PICKED}, f AS (SELECT query_id, source, min(rank) AS r FROM h GROUP BY 1, 2)
SELECT query_id, string_agg(source, '|' ORDER BY r) AS sources FROM f GROUP BY 1""")
def ordered_distinct_sources(spark, d):
    return D.ordered_sources(_picked(spark, d)[1]).select("query_id", F.array_join("sources", "|").alias("sources"))


@query(rf"""SELECT doc_id, length({Q.norm('text')}) AS norm_len, length(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]+', '', 'g')) AS word_len,
 regexp_matches(text, '[0-9]') AS has_digit, regexp_matches(text, '[.,?!;:]') AS has_punct, substring(md5(text), 1, 12) AS fingerprint,
 length(regexp_replace(replace(text, '/sil', ' '), '\s+', ' ', 'g')) AS spoken_len FROM documents""")
def text_profile(spark, d):
    return B.documents(spark, d).select(
        "doc_id", F.length(T.norm("text")).alias("norm_len"), F.length(T.words_only("text")).alias("word_len"),
        F.col("text").rlike("[0-9]").alias("has_digit"), T.has_punct("text", "[.,?!;:]").alias("has_punct"),
        T.fingerprint("text").alias("fingerprint"), F.length(T.spoken_text("text")).alias("spoken_len"),
    )


@query(r"""SELECT page_id, length(trim(regexp_replace(t, '<\|[^|]*\|>', '', 'g'), ' ' || chr(10))) AS n FROM
 (SELECT page_id, replace(replace(html, '<', '<|'), '>', '|>') AS t FROM pages)""")
def strip_tags(spark, d):
    marked = F.replace(F.replace("html", F.lit("<"), F.lit("<|")), F.lit(">"), F.lit("|>"))
    return B.table(spark, d, "pages").select("page_id", F.length(T.strip_tags(marked)).alias("n"))
