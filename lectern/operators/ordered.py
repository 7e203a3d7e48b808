"""Window functions over a long ordered group, computed shard by shard.

``Window.partitionBy(recording)`` sends a whole recording to one task, so a recording that
holds a third of the corpus would hang the job. Here a recording is cut into shards of bounded
media time. Each shard is windowed on its own; what crosses a shard border comes from a summary
with one row per shard, made from the same shuffled rows, so the input is evaluated once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialise

SHARD_MS = 600_000
#: Rows of a range in which one task ranks.
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Running:
    """One derived column.

    kind is ``lead`` or ``lag`` (value of the neighbouring row), ``sum`` or ``max`` (running,
    current row included), or ``last`` / ``next`` (nearest non-null value at or before / at or
    after the current row).
    """

    alias: str
    kind: str
    value: Column


def time_shard(time_col: str, width: int = SHARD_MS) -> Column:
    return F.floor(F.col(time_col) / F.lit(width)).cast("bigint")


def running(
    df: DataFrame, keys: list[str], order: list[str], shard: Column, specs: list[Running]
) -> DataFrame:
    """Add every spec of ``specs``; ``order`` must be unique per key and agree with ``shard``.

    One shuffle on (keys, shard) serves the windows and the summary: chains of calls read their source once.
    """
    kept = df.columns
    values = [s.value.alias(f"_v{i}") for i, s in enumerate(specs)]
    df = df.withColumn("_shard", shard).select("*", *values).repartition(*keys, "_shard")
    within = Window.partitionBy(*keys, "_shard").orderBy(*order)
    upto, onward = (
        within.rowsBetween(Window.unboundedPreceding, 0),
        within.rowsBetween(0, Window.unboundedFollowing),
    )
    shards = Window.partitionBy(*keys).orderBy("_shard")
    before = shards.rowsBetween(Window.unboundedPreceding, -1)
    after = shards.rowsBetween(1, Window.unboundedFollowing)
    position = F.struct(*order)

    local, summary, carried, final = [], [], [], []
    for i, s in enumerate(specs):
        v, part, carry = F.col(f"_v{i}"), f"_s{i}", f"_c{i}"
        wrapped = F.struct(v.alias("v"))
        if s.kind == "lead":
            here, agg = F.lead(wrapped).over(within), F.min_by(wrapped, position)
            link, both = F.lead(part).over(shards), lambda h, c: F.coalesce(h, c)["v"]
        elif s.kind == "lag":
            here, agg = F.lag(wrapped).over(within), F.max_by(wrapped, position)
            link, both = F.lag(part).over(shards), lambda h, c: F.coalesce(h, c)["v"]
        elif s.kind == "sum":
            here, agg = F.sum(v).over(upto), F.sum(v)
            link = F.sum(part).over(before)
            both = lambda h, c: h + F.coalesce(c, F.lit(0))
        elif s.kind == "max":
            here, agg = F.max(v).over(upto), F.max(v)
            link, both = F.max(part).over(before), lambda h, c: F.greatest(h, c)
        elif s.kind == "last":
            here = F.last(v, ignorenulls=True).over(upto)
            agg = F.max_by(v, F.when(v.isNotNull(), position))
            link = F.last(part, ignorenulls=True).over(before)
            both = lambda h, c: F.coalesce(h, c)
        elif s.kind == "next":
            here = F.first(v, ignorenulls=True).over(onward)
            agg = F.min_by(v, F.when(v.isNotNull(), position))
            link = F.first(part, ignorenulls=True).over(after)
            both = lambda h, c: F.coalesce(h, c)
        else:
            raise ValueError(f"unknown kind {s.kind}")
        local.append(here.alias(f"_h{i}"))
        summary.append(agg.alias(part))
        carried.append(link.alias(carry))
        final.append(both(F.col(f"_h{i}"), F.col(carry)).alias(s.alias))

    # The summary refers to all columns: with fewer its shuffle would differ from that of the windows and be made anew.
    # The join's keys are aggregates, through which no filter on them passes down, for the same reason.
    whole = F.max(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])).alias("_row")
    place = [F.first(c).alias(c) for c in (*keys, "_shard")]
    grouped = df.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate((*keys, "_shard"))])
    borders = grouped.agg(*summary, whole, *place).filter("_row is not null").select(*keys, "_shard", *carried)
    return (
        df.select("*", *local)
        .join(borders, [*keys, "_shard"], "left")
        .select(*kept, *final)
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], shard: Column, alias: str) -> DataFrame:
    """Contiguous 1..n per key, as ``row_number`` would give."""
    return running(df, keys, order, shard, [Running(alias, "sum", F.lit(1).cast("bigint"))])


def global_rank(df: DataFrame, order: list[str], bucket: Column, alias: str = "rank") -> DataFrame:
    """Rank 1..n over the whole table without one global sort task.

    ``bucket`` is a deterministic value that never decreases along ``order``. Only the bucket
    counts (one row per bucket) meet in a single window.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "_bucket",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    local = Window.partitionBy("_bucket").orderBy(*order)
    return (
        df.withColumn("_local", F.row_number().over(local))
        .join(offsets, "_bucket")
        .withColumn(alias, F.col("_local") + F.col("_offset"))
        .drop("_bucket", "_local", "_offset")
    )


def range_rank(df: DataFrame, order: list[str], rows: int, alias: str = "rank") -> DataFrame:
    """Rank 1..n over the whole table, ``rows`` long, from ranges of ``order`` that Spark samples.

    There are as many ranges as the rows need, and their sizes give the offsets. The ranges are written, as
    another run of the sampling may cut elsewhere. Rows equal in ``order`` share a range: it should tell rows apart.
    """
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(max(shuffles, -(-rows // RANGE_ROWS)), *order)
    return global_rank(materialise(ranges.withColumn("_range", F.spark_partition_id()), "ranges"), order, F.col("_range"), alias).drop("_range")


def fold_stream(df: DataFrame, keys: list[str], order: list[str], fn, schema: str) -> DataFrame:
    """Run a sequential fold over each key in order, one row batch in memory at a time.

    ``fn`` takes an iterator of pandas frames in key and order sequence and carries its own state
    from batch to batch, so even a key with very many rows is never collected.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fn, schema)
