"""Knowledge base: index documents as chunks, keep them by source, search by vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import embed_texts
from lectern.operators.grid import block_pairs, rows_within
from lectern.operators.lines import CHUNK_OVERLAP, CHUNK_SENTENCE_MARKS, CHUNK_SIZE, chunks_of

# Retrieval defaults and the instruction put before a question.
MIN_SCORE = 0.35
TOP_K = 3
TOP_K_MAX = 20
QUERY_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："
EMPTY_FILE = "文件内容为空"

BROADCAST_QUERIES = 4096
BLOCK_CHUNKS = 50_000
CELLS = 8_000_000
HITS = "query_id {q}, chunk_id {c}, dot double"


def clamp_k(k: int) -> int:
    return max(1, min(k, TOP_K_MAX))


def chunk_documents(
    docs: DataFrame, source: str = "source", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    marks: str = CHUNK_SENTENCE_MARKS,
) -> DataFrame:
    """documents(source, text) to chunks(source, digest, chunk, chars, text, chunk_id)."""
    body = T.strip(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("digest", T.fingerprint(body)).select(
        F.col(source).alias("source"), "digest",
        F.posexplode(chunks_of("text", size, overlap, marks)).alias("chunk", "text"),
    )
    return rows.withColumn("chars", F.length("text")).withColumn(
        "chunk_id", T.chunk_id("source", "digest", "chunk")
    )


def index_documents(docs: DataFrame, embed: Callable[[Column], Column] = embed_texts) -> DataFrame:
    """Chunks with their vectors, ready for the knowledge base."""
    return chunk_documents(docs).withColumn("embedding", embed(F.col("text")))


def index_report(docs: DataFrame, source: str = "source") -> DataFrame:
    """Per document: chunks, characters, digest, or the error of an empty one."""
    body = T.strip(F.coalesce("text", F.lit("")))
    n = F.size(chunks_of("text"))
    empty = body == ""
    return docs.select(
        F.col(source).alias("source"),
        F.when(empty, 0).otherwise(n).alias("chunks"),
        F.when(empty, 0).otherwise(F.length(body)).alias("chars"),
        F.when(~empty, T.fingerprint(body)).alias("digest"),
        F.when(empty, EMPTY_FILE).alias("error"),
    )


def kb_sources(chunks: DataFrame) -> DataFrame:
    """Chunks per source, by name; a missing source has a fixed label."""
    name = T.or_default("source", T.UNKNOWN_SOURCE).alias("source")
    return chunks.groupBy(name).agg(F.count("*").alias("chunks")).orderBy("source")


def kb_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"))


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after an upsert: every re-added source is replaced as a whole."""
    replaced = incoming.select("source").distinct()
    return existing.join(replaced, "source", "left_anti").unionByName(incoming)


def without_source(existing: DataFrame, sources: DataFrame) -> DataFrame:
    return existing.join(sources.select("source").distinct(), "source", "left_anti")


def search_vectors(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE,
    skip_self: bool = False,
) -> DataFrame:
    """The k most similar chunks of every query: hits(query_id, rank, chunk_id, score).

    queries(query_id, embedding) and chunks(chunk_id, embedding) hold unit vectors. The score is
    max(0, cosine) to four decimals; hits below ``min_score`` are dropped. Ranking and gate
    commute, so the gate is applied inside the tasks and each task keeps k hits per query.
    Equal similarities rank by chunk id. Exact: no candidate is left out.
    """
    k = clamp_k(k)
    types = {**dict(queries.dtypes), **dict(chunks.dtypes)}
    schema = HITS.format(q=types["query_id"], c=types["chunk_id"])
    slim_q = queries.select("query_id", F.col("embedding").alias("vq"))
    slim_c = chunks.select("chunk_id", F.col("embedding").alias("vc"))
    few = rows_within(slim_q, BROADCAST_QUERIES)
    if few is not None:
        q_ids = np.array([r.query_id for r in few])
        q_mat = np.array([r.vq for r in few], dtype=np.float64)
        spark = queries.sparkSession
        shared = spark.sparkContext.broadcast((q_ids, q_mat))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, mat = shared.value
            best = None
            for pdf in batches:
                if len(ids) and len(pdf):
                    found = _best(ids, mat, pdf["chunk_id"].to_numpy(), np.stack(pdf["vc"]), k, min_score, skip_self)
                    best = found if best is None else _keep(pd.concat([best, found]), k)
            if best is not None:
                yield best

        partial = slim_c.mapInPandas(scan, schema)
    else:
        def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if q.empty or c.empty:
                return pd.DataFrame({"query_id": [], "chunk_id": [], "dot": []})
            return _best(
                q["query_id"].to_numpy(), np.stack(q["vq"]).astype(np.float64),
                c["chunk_id"].to_numpy(), np.stack(c["vc"]), k, min_score, skip_self,
            )

        partial = block_pairs(
            slim_q, slim_c, "query_id", "chunk_id", BROADCAST_QUERIES, BLOCK_CHUNKS, pair, schema
        )
    order = Window.partitionBy("query_id").orderBy(F.desc("dot"), "chunk_id")
    score = F.bround(F.greatest(F.lit(0.0), F.col("dot")), 4)
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("score", score)
        .filter(F.col("score") >= min_score)
        .select("query_id", "rank", "chunk_id", "score")
    )


def _best(q_ids, q_mat, c_ids, c_mat, k: int, min_score: float, skip_self: bool) -> pd.DataFrame:
    """Up to k hits per query among one batch of chunks."""
    parts = []
    step = max(1, CELLS // max(1, len(q_ids)))
    c_mat = c_mat.astype(np.float64)
    for lo in range(0, len(c_ids), step):
        # Nine decimals: equal vectors tie whatever order the products were summed in.
        dots = np.round(q_mat @ c_mat[lo : lo + step].T, 9)
        ids = c_ids[lo : lo + step]
        # The gate looks at the clamped score: with no minimum, negative products stay.
        keep = np.maximum(dots, 0.0) >= min_score - 0.0001
        if skip_self:
            keep &= q_ids[:, None] != ids[None, :]
        if len(ids) > k:
            # Only the k best products of a query, and their ties, are ranked by chunk id.
            kept = np.where(keep, dots, -np.inf)
            keep &= dots >= np.partition(kept, -k, axis=1)[:, -k, None]
        qi, ci = np.nonzero(keep)
        parts.append(pd.DataFrame({"query_id": q_ids[qi], "chunk_id": ids[ci], "dot": dots[qi, ci]}))
        parts = [_keep(pd.concat(parts), k)]
    return parts[0]


def _keep(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ranked = hits.sort_values(["query_id", "dot", "chunk_id"], ascending=[True, False, True])
    return ranked.groupby("query_id", sort=False).head(k).reset_index(drop=True)


def question_vectors(questions: DataFrame, embed: Callable[[Column], Column] = embed_texts) -> DataFrame:
    """questions(query_id, question) to query vectors; blank questions find nothing."""
    asked = questions.filter(~T.is_blank("question"))
    text = F.concat(F.lit(QUERY_INSTRUCTION), T.strip("question"))
    return asked.select("query_id", embed(text).alias("embedding"))
