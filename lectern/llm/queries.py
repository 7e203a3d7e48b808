"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    decontaminate,
    fuzzy_lines,
    html_template,
    mixing,
    near_dedup,
    packing,
    quality_mil,
    quality_rules,
    substring_dedup,
    token_alignment,
    toxicity,
    twins,
    warc_fixity,
    whitening,
)
from lectern.plans.registry import Query
from lectern.session import materialise, scratch_path

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(table(spark, sf_dir, "documents")).drop("lang", "source")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archives, against a replica in which some records have a flipped byte and some archives end early."""
    first = materialise(warc_fixity.archive_pages(table(spark, sf_dir, "pages")), "archive")
    mark = F.crc32(F.col("page_id").cast("string").cast("binary"))
    flipped = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit(b"?"), F.expr("substring(record, -4, 4)"))
    cut_off = (F.crc32(F.col("archive").cast("binary")) % 5 == 0) & (F.col("page_id") % 1000 >= 900)
    second = first.filter(~F.coalesce(cut_off, F.lit(False))).withColumn("record", F.when(mark % 50 == 7, flipped).otherwise(F.col("record")))
    found = warc_fixity.audit(first.drop("page_id"), second.drop("page_id"))
    return found.join(first.select("archive", "offset", "page_id"), ["archive", "offset"]).select(
        "archive", "offset", "n_bytes", "problem", "hash_a", "hash_b", "page_id"
    )


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_lines.duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group_documents(table(spark, sf_dir, "documents")).drop("text_key")


def op4_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_template.extract(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("bigint"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.size("shards")).cast("bigint")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_mil.train(docs, labels.filter(~quality_mil.held_out(F.col("doc_id"))))
    predicted = (F.col("score") >= quality_mil.THRESHOLD).cast("int")
    return quality_mil.score(docs, model).select(
        "doc_id", quality_mil.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, toxicity.categories_of(docs, table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    scored = toxicity.score(docs.select("doc_id", "text"), chain, toxicity.CATEGORIES)
    each = [F.col("toxicity")[i].alias(f"p_{name}") for i, name in enumerate(toxicity.CATEGORIES)]
    return scored.select("doc_id", *each, (F.col("toxicity")[len(each) - 1] >= toxicity.THRESHOLD).alias("toxic"))


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed")
    packing.write_packed(packing.pack_documents(table(spark, sf_dir, "documents")), path)
    return packing.digest(spark.read.parquet(path))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.compare_tokenizers(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


for _query in (
    op1_quality_rules, op2_warc_fixity, op3_near_dedup, op4_html_template, op5_fuzzy_lines, op6_decontaminate, op7_mixing, op8_quality_mil, op9_toxicity,
    op10_token_packing, op11_token_alignment, op12_substring_dedup, op13_whitening,
):
    QUERIES[_query.__name__] = _query

ORACLES |= {
    "op1_quality_rules": twins.quality_sql(), "op2_warc_fixity": twins.fixity_sql(), "op6_decontaminate": twins.decontaminate_sql(),
    "op12_substring_dedup": twins.substring_sql(),
}
