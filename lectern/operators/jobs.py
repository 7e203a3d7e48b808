"""Planning and reporting of batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def output_name(path: str) -> F.Column:
    """Last path segment without its extension."""
    base = F.regexp_extract(path, "([^/\\\\]*)$", 1)
    return F.when(base.rlike("^.+\\.[^.]*$"), F.regexp_replace(base, "\\.[^.]*$", "")).otherwise(base)


def plan_outputs(files: DataFrame, existing: DataFrame, force: bool = False, out_dir: str = "subtitle",
                 suffix: str = ".srt") -> DataFrame:
    """files(path) to (path, target, status, winner) before any costly step.

    Several inputs for one target: the first path wins, the rest are ``conflict``. A target that
    exists is ``skipped`` unless forced; otherwise ``todo``. The winner is a minimum, so a target
    shared by very many inputs combines map-side.
    """
    named = files.select("path").distinct().withColumn(
        "target", F.concat(F.lit(out_dir + "/"), output_name("path"), F.lit(suffix))
    )
    winners = named.groupBy("target").agg(F.min("path").alias("winner"))
    have = existing.select("target").distinct().withColumn("_have", F.lit(True))
    rows = named.join(winners, "target").join(have, "target", "left")
    status = (
        F.when(F.col("path") != F.col("winner"), "conflict")
        .when(F.col("_have").isNotNull() & F.lit(not force), "skipped")
        .otherwise("todo")
    )
    return rows.select("path", "target", status.alias("status"), "winner")


def job_summary(items: DataFrame) -> DataFrame:
    """items(task_id, file, status, error, lines) to one row per task."""
    return items.groupBy("task_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin("success", "failed")).alias("done"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("lines"))), F.lit(0)).alias("lines"),
        F.max_by("file", "seq").alias("current"),
    )


def failed_items(items: DataFrame) -> DataFrame:
    """The failures as rows: a failed list of any length stays distributed."""
    return items.filter(F.col("status") == "failed").select("task_id", "file", "error")


def error_classes(errors: DataFrame) -> DataFrame:
    """How often each class of error message occurs."""
    return errors.groupBy(T.classify_error("error").alias("error_class")).agg(F.count("*").alias("n"))


def rtf_summary(timings: DataFrame) -> DataFrame:
    """timings(duration_s, cost_s): mean of ratios, ratio of sums and speed factor."""
    used = timings.filter(F.col("duration_s") > 0)
    return used.agg(
        F.count("*").alias("n"),
        F.avg(F.col("cost_s") / F.col("duration_s")).alias("mean_rtf"),
        (F.sum("cost_s") / F.sum("duration_s")).alias("total_rtf"),
        (F.sum("duration_s") / F.nullif(F.sum("cost_s"), F.lit(0.0))).alias("speed"),
    )


def first_files(files: DataFrame, n: int = 5) -> DataFrame:
    """The first n files of a sorted listing."""
    return files.orderBy("path").limit(n)


def ranked_timings(timings: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n slowest items per group by real-time factor."""
    rtf = timings.filter(F.col("duration_s") > 0).withColumn("rtf", F.col("cost_s") / F.col("duration_s"))
    w = Window.partitionBy(*by).orderBy(F.desc("rtf"), "file")
    return rtf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
