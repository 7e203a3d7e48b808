"""The stored knowledge base: chunks in hash buckets of their source, and a log of which write each bucket is in.

``<root>/data/write=<id>/bucket=<n>`` holds the rows one change wrote, ``<root>/log`` one small file a version with the
buckets it switched, ``<root>/columns`` the columns. A change reads and writes the buckets of its sources only. It counts
once its log file is there, so a change that fails leaves the version before it as it was, and a reader that has begun
keeps the files it chose. One writer at a time. A source may be null; an unknown source deletes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialise

# Chosen at creation: a change rewrites whole buckets, so a large table wants more of them.
BUCKETS = 256
LOG = "version long, bucket int, write string"
PLACE = ["write", "bucket"]


def create(spark: SparkSession, root: str, like: DataFrame, buckets: int = BUCKETS) -> None:
    """An empty table with the columns of ``like``, which has a ``source``."""
    like.limit(0).write.parquet(f"{root}/columns")
    empty = spark.range(buckets).select(F.lit(0).cast("long").alias("version"), F.col("id").cast("int").alias("bucket"), F.lit(None).cast("string").alias("write"))
    empty.coalesce(1).write.parquet(f"{root}/log")


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the last version, or of an earlier one."""
    state, _ = _state(spark, root, version)
    return _rows(spark, root, state).drop(*PLACE)


def version_of(spark: SparkSession, root: str) -> int:
    return _state(spark, root)[1]


def upsert(spark: SparkSession, root: str, incoming: DataFrame) -> int:
    """Replace every incoming source as a whole; returns the version this makes."""
    state, version = _state(spark, root)
    columns = _columns(spark, root).columns
    new = materialise(incoming.select(*columns).withColumn("bucket", _bucket("source", len(state))), "kb-incoming")
    touched = _buckets_of(new)
    kept = _without(_rows(spark, root, state, touched).drop("write"), new)
    # Buckets come in files of even size: those of a large source are split, small ones share a task.
    return _switch(spark, root, kept.unionByName(new.hint("rebalance", "bucket")), touched, version + 1)


def delete(spark: SparkSession, root: str, sources: DataFrame) -> int:
    """Drop the rows of ``sources(source)``; returns how many there were."""
    state, version = _state(spark, root)
    gone = materialise(sources.select("source", _bucket("source", len(state)).alias("bucket")).distinct(), "kb-deleted")
    old = _rows(spark, root, state, _buckets_of(gone)).drop("write")
    hit = old.join(gone.select(F.col("source").alias("_gone")), F.col("source").eqNullSafe(F.col("_gone")), "left_semi")
    # Buckets without a row of these sources stay where they are.
    removed = {r["bucket"]: r["n"] for r in hit.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    if removed:
        touched = sorted(removed)
        _switch(spark, root, _without(_rows(spark, root, state, touched).drop("write"), gone), touched, version + 1)
    return sum(removed.values())


def reset(spark: SparkSession, root: str) -> int:
    """A version without rows; earlier ones stay readable."""
    state, version = _state(spark, root)
    return _commit(spark, root, version + 1, dict.fromkeys(state))


def _bucket(source: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")


def _buckets_of(rows: DataFrame) -> list[int]:
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def _columns(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/columns")


def _state(spark: SparkSession, root: str, version: int | None = None) -> tuple[dict[int, str | None], int]:
    """The write each bucket is in, one row a bucket, and the version that is."""
    log = spark.read.schema(LOG).parquet(f"{root}/log")
    if version is not None:
        log = log.filter(F.col("version") <= version)
    last = log.groupBy("bucket").agg(F.max_by("write", "version").alias("write"), F.max("version").alias("version")).collect()
    return {r["bucket"]: r["write"] for r in last}, max(r["version"] for r in last)


def _rows(spark: SparkSession, root: str, state: dict[int, str | None], buckets: list[int] | None = None) -> DataFrame:
    chosen = state if buckets is None else buckets
    paths = [f"{root}/data/write={state[b]}/bucket={b}" for b in chosen if state[b] is not None]
    schema = _columns(spark, root).schema.add("write", "string").add("bucket", "integer")
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    named = gone.select(F.col("source").alias("_gone")).distinct()
    return rows.join(named, F.col("source").eqNullSafe(F.col("_gone")), "left_anti")


def _switch(spark: SparkSession, root: str, rows: DataFrame, touched: list[int], version: int) -> int:
    """Write the touched buckets anew, then log them; a bucket left without rows is in no write."""
    write = uuid.uuid4().hex
    rows.write.partitionBy("bucket").parquet(f"{root}/data/write={write}")
    written = spark.read.schema(rows.schema).parquet(f"{root}/data/write={write}")
    filled = set(_buckets_of(written))
    return _commit(spark, root, version, {b: write if b in filled else None for b in touched})


def _commit(spark: SparkSession, root: str, version: int, writes: dict[int, str | None]) -> int:
    """One file with all rows of the version, so that it appears at once or not at all."""
    rows = [(version, b, w) for b, w in writes.items()]
    if rows:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return version
