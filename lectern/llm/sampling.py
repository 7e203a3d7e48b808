"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, overall: Column, max_per_class: int) -> DataFrame:
    """Labelled documents (doc_id, text and the label columns), at most ``max_per_class`` of either class of ``overall``.

    Labels are chosen first, by a hash, so only the texts of chosen documents move. A doc_id with several labels or
    texts counts once, with the largest labels and the smallest text.
    """
    marks = [c for c in labels.columns if c != "doc_id"]
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in marks])
    by_hash = F.xxhash64("doc_id", F.lit("sample"))
    chosen = [one.filter(F.coalesce(overall, F.lit(False)) == side).orderBy(by_hash, "doc_id").limit(max_per_class) for side in (True, False)]
    # At most two classes of max_per_class ids: a proven bound for the broadcast.
    ids = F.broadcast(chosen[0].union(chosen[1]))
    return docs.join(ids, "doc_id").groupBy("doc_id", *marks).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
