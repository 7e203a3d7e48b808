"""Sequential rules over one very long run of rows, as pointers that many tasks follow.

Where a rule's state after some row depends on that row alone, each row points to the next such row, and what the rule
does is the chain of pointers from the first row. A pointer is the first later row whose value is above a bound; it is
looked for in the row's block, then among the maxima of the blocks, and so on. Chains cross blocks on a graph with
one node per row where a pointer enters a block; doubled pointers find which of them the chain passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordered import fold_stream
from lectern.session import materialise

#: Rows of a block: what one call of a task's function holds.
BLOCK = 4096


def block_of(position: Column | str) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / BLOCK).cast("bigint")


def first_above(queries: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q, found): for each query (keys, q, pos, v) the first position after ``pos`` with a value above ``v``.

    ``values`` is (keys, pos, v), positions count from 0 in each key; queries without such a position are absent.
    """
    near = materialise(_probe(queries.withColumn("at", block_of("pos")), values, keys), "found")
    done = near.filter("found >= 0").select(*keys, "q", "found")
    if (values.agg(F.max("pos")).first()[0] or 0) < BLOCK:
        return done
    tops = materialise(values.groupBy(*keys, block_of("pos").alias("pos")).agg(F.max("v").alias("v")), "tops")
    beyond = first_above(near.filter("found < 0").select(*keys, "q", block_of("pos").alias("pos"), "v"), tops, keys)
    wanted = near.select(*keys, "q", "v").join(beyond, [*keys, "q"])
    entered = wanted.select(*keys, "q", (F.col("found") * BLOCK - 1).alias("pos"), "v", F.col("found").alias("at"))
    return done.union(_probe(entered, values, keys).select(*keys, "q", "found"))


def _probe(queries: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q, pos, v, found): the position in block ``at`` of each query, or -1. A block's values are held, its queries,
    which may be many, stream by."""
    rows = values.select(*keys, block_of("pos").alias("at"), F.lit(0).alias("kind"), "pos", "v", F.col("pos").alias("q")).union(
        queries.select(*keys, "at", F.lit(1).alias("kind"), "pos", "v", "q")
    )
    names = [*keys, "q", "pos", "v", "found"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, table = None, [], None
        for pdf in batches:
            group = pdf[[*keys, "at"]]
            new = (group != group.shift()).any(axis=1).to_numpy()
            found = np.full(len(pdf), -1, np.int64)
            kind, pos, v, at = (pdf[c].to_numpy() for c in ("kind", "pos", "v", "at"))
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
                here = tuple(group.iloc[lo])
                if here != now:
                    now, held, table = here, [], None
                first = lo + int(np.searchsorted(kind[lo:hi], 1))
                held.append(v[lo:first])
                if first < hi:
                    if table is None:
                        table = _maxima(np.concatenate(held))
                    base = at[lo] * BLOCK
                    place = _above(table, pos[first:hi] + 1 - base, v[first:hi])
                    found[first:hi] = np.where(place < table.shape[1], place + base, -1)
            yield pdf.assign(found=found).loc[kind == 1, names]

    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "q", "pos", "v"]) + ", found bigint"
    return fold_stream(rows, [*keys, "at"], ["kind", "pos"], run, schema)


def _maxima(values: np.ndarray) -> np.ndarray:
    """Row k: the largest of the 2^k values from each place on."""
    rows = [values]
    while 1 << len(rows) <= len(values):
        step, last = 1 << (len(rows) - 1), rows[-1].copy()
        last[:-step] = np.maximum(last[:-step], rows[-1][step:])
        rows.append(last)
    return np.stack(rows)


def _above(table: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on with a value above ``bound``; the number of values where there is none."""
    n = table.shape[1]
    place = start.astype(np.int64)
    for k in range(len(table) - 1, -1, -1):
        low = table[k][np.minimum(place, n - 1)] <= bound
        place = np.where((place < n) & low, np.minimum(place + (1 << k), n), place)
    return place


def chain(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos) of the positions on the way of ``pointers`` (keys, pos, next) from position 0 of each key.

    ``next`` is a later position, or null at the end; every position has a row.
    """
    types = dict(pointers.dtypes)
    named = ", ".join(f"{c} {types[c]}" for c in keys)
    blocks = materialise(pointers.withColumn("at", block_of("pos")), "pointers")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where the way from each row of a block leaves it."""
        pdf = pdf.sort_values("pos", ignore_index=True)
        to = pdf["next"].fillna(-1).to_numpy(np.int64)
        base = int(pdf["pos"].iloc[0])
        for i in range(len(to) - 1, -1, -1):
            if 0 <= to[i] - base < len(to):
                to[i] = to[to[i] - base]
        return pdf[[*keys, "pos"]].assign(next=to)

    entries = blocks.filter(F.col("at") != block_of("next")).select(*keys, F.col("next").alias("pos")).union(
        blocks.filter("pos = 0").select(*keys, "pos")
    ).distinct()
    left = blocks.groupBy(*keys, "at").applyInPandas(leave, f"{named}, pos bigint, next bigint")
    jumps = [materialise(left.join(entries, [*keys, "pos"]).filter("next >= 0"), "jumps")]
    while not jumps[-1].isEmpty():
        twice = jumps[-1].withColumnRenamed("next", "mid").join(
            jumps[-1].select(*keys, F.col("pos").alias("mid"), "next"), [*keys, "mid"]
        )
        jumps.append(materialise(twice.select(*keys, "pos", "next"), "jumps"))
    passed = entries.filter("pos = 0")
    for jump in reversed(jumps[:-1]):
        passed = materialise(passed.union(passed.join(jump, [*keys, "pos"]).select(*keys, F.col("next").alias("pos"))), "passed")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of a block on the way from the one where it is entered, if it is."""
        pdf = pdf.sort_values("pos", ignore_index=True)
        to, base = pdf["next"].fillna(-1).to_numpy(np.int64), int(pdf["pos"].iloc[0])
        entered, on = np.flatnonzero(pdf["entered"].to_numpy(bool)), []
        i = int(entered[0]) if len(entered) else -1
        while 0 <= i < len(to):
            on.append(i)
            i = to[i] - base
        return pdf.loc[on, [*keys, "pos"]]

    # A way enters a block once, so no block has two entries.
    marked = blocks.join(passed.distinct().withColumn("entered", F.lit(True)), [*keys, "pos"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return marked.groupBy(*keys, "at").applyInPandas(follow, f"{named}, pos bigint")
