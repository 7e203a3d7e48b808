"""Logical inputs derived from the given parquet tables, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T

MAX_PIECE = 400
MEDIA_EPOCH = 1_704_067_200  # one second of event time stands for one millisecond of media
CONDITIONS = ["clean", "slow", "fast", "pitch", "noise"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a table arrives in fewer splits than the session has slots.

    Large tables already have more splits than that and pass through without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as spoken segments: cut at sentence ends, over-long ones every 400 chars.

    uid is ``<source>_<doc id>_<sentence>_<piece>``.
    """
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    units = docs.select(
        "doc_id", "source", "lang", F.posexplode(F.split("text", "[.!?\\n]")).alias("sent_no", "s")
    ).withColumn("s", F.trim("s")).filter("s <> ''")
    starts = F.sequence(F.lit(0), F.floor((F.length("s") - 1) / MAX_PIECE).cast("int"))
    pieces = units.withColumn("piece", F.explode(starts)).withColumn(
        "text", F.substring(F.col("s"), F.col("piece") * MAX_PIECE + 1, F.lit(MAX_PIECE))
    )
    uid = F.concat_ws("_", "source", "doc_id", "sent_no", "piece")
    return pieces.select(uid.alias("uid"), "doc_id", "source", "lang", "sent_no", "piece", "text")


def whole_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences uncut, so that a search term is found wherever it stands: uid is ``<source>_<doc id>_<sentence>``."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    units = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "[.!?\\n]")).alias("sent_no", "s"))
    said = units.withColumn("text", F.trim("s")).filter("text <> ''")
    return said.select(F.concat_ws("_", "source", "doc_id", "sent_no").alias("uid"), "doc_id", "source", "lang", "sent_no", "text")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).withColumnRenamed("text", "ref")


def spoken_by(system: str, text: Column) -> Column:
    """What a recogniser would have heard: system b confuses more sounds than system a."""
    heard = F.replace(text, F.lit("tion"), F.lit("shun"))
    return F.replace(heard, F.lit("th"), F.lit("d")) if system == "b" else heard


def under(condition: str, text: Column) -> Column:
    return {
        "clean": text,
        "slow": F.substring(text, F.lit(1), F.greatest(F.lit(0), F.length(text) - 1)),
        "fast": F.replace(text, F.lit(" "), F.lit("")),
        "pitch": F.replace(text, F.lit("e"), F.lit("i")),
        "noise": F.replace(text, F.lit("s"), F.lit("")),
    }[condition]


def hypotheses(spark: SparkSession, sf_dir: str, system: str) -> DataFrame:
    """One system's clean output. Documents labelled toxic were never decoded."""
    refused = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return (
        sentences(spark, sf_dir)
        .join(refused, "doc_id", "left_anti")
        .select("uid", spoken_by(system, F.col("text")).alias("hyp"))
    )


def both_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hyps(uid, hyp_a, hyp_b): the clean output of both systems."""
    refused = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return (
        sentences(spark, sf_dir)
        .join(refused, "doc_id", "left_anti")
        .select("uid", *[spoken_by(s, F.col("text")).alias(f"hyp_{s}") for s in "ab"])
    )


def condition_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hyps(uid, hyps): two systems under five conditions, as an array of (system, condition, hyp)."""
    refused = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    rows = [
        F.struct(
            F.lit(s).alias("system"),
            F.lit(c).alias("condition"),
            under(c, spoken_by(s, F.col("text"))).alias("hyp"),
        )
        for s in "ab"
        for c in CONDITIONS
    ]
    return (
        sentences(spark, sf_dir)
        .join(refused, "doc_id", "left_anti")
        .select("uid", F.array(*rows).alias("hyps"))
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the cues of one recording."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    start = (T.media_seconds("ts") - F.lit(MEDIA_EPOCH)).cast("bigint")
    return e.select(
        F.col("user_id").alias("rec_id"),
        F.col("event_id").alias("cue_no"),
        start.alias("start_ms"),
        (start + F.floor(F.round(F.col("value") * 100, 4)).cast("bigint")).alias("end_ms"),
        F.col("event_type").alias("speaker"),
        F.col("event_type").alias("text"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )


def fragments_of(events: DataFrame) -> DataFrame:
    """Caption fragments from an events table or stream."""
    return events.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.substring("event_type", 1, 1).alias("text"),
        (F.col("event_type") == "purchase").alias("is_final"),
    )


def items_of(events: DataFrame) -> DataFrame:
    """Batch-job items from an events table or stream: an error event is a failed item."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").alias("task_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("file"), F.col("event_id").cast("string")).alias("file"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, F.concat(F.lit("Error code: "), (F.col("event_id") % 7 + 400).cast("string"))).alias("error"),
        F.floor("value").cast("bigint").alias("lines"),
    )


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file, or the files of its folder, as a stream source."""
    schema = table(spark, sf_dir, name).schema
    # A file stream wants a folder; the glob picks the one table in it.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each benchmark item as a search term."""
    words = F.slice(F.split(F.trim("text"), " "), 1, 2)
    return table(spark, sf_dir, "benchmark").select(
        F.lower(F.array_join(words, " ")).alias("keyword")
    ).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as media paths, without query and fragment."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "[?#].*$", "").alias("path")
    )
