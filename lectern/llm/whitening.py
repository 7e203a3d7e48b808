"""Embedding whitening with distributed block matrices.

Entries become integers, so sums are exact. Centred rows are indexed into the blocks of a BlockMatrix; its transpose times
itself is the scatter matrix, whose eigenvectors, scaled, make the whitening matrix on the driver (dimension squared);
the block matrix times that matrix projects the rows. Rows go to Spark's block matrices as DataFrames, without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Larger entries have no long at this scale; their rows are left out.
LARGEST = float(1 << 56)
BLOCK_ROWS = 4096
#: The driver keeps the coordinates of a matrix's blocks, so more rows than these blocks hold make several matrices.
MATRIX_ROWS = BLOCK_ROWS << 16
#: Blocks that one task multiplies and adds up.
BLOCKS_A_TASK = 16
#: Eigenvalues below this share of the largest are rounding: such components have no whitened values.
ROUNDING = 1e-12


@dataclass
class Whitening:
    """n vectors with the sums ``S`` (exact), eigenvalues and eigenvectors (columns) of their covariance, falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def kept(self) -> int:
        """Components whose eigenvalue is more than rounding."""
        return int((self.values > max(self.values[0], 0) * ROUNDING).sum())


def integer_rows(rows: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector has the table's usual length and finite entries."""
    c = F.col("embedding")
    clean = rows.select("vec_id", "embedding").filter(
        (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= LARGEST))
    )
    lengths = clean.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("bigint") + OFFSET)
    return clean.filter(F.size(c) == (lengths.d if lengths else 0)).select("vec_id", x.alias("x"))


def indexed(rows: DataFrame, label: str, matrix_rows: int | None = None) -> tuple[DataFrame, int]:
    """``rows``, written, with the number of their matrix and their row in it, both from 0; and how many matrices.

    A part is what one task wrote; parts are dealt to matrices in order, so a matrix reads only its files.
    """
    spark = rows.sparkSession
    place = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")]
    written = materialise(rows.select("*", *place), label)
    matrix, start, first = 0, 0, []
    for part, n in written.groupBy("part").agg(F.count("*")).orderBy("part").toLocalIterator():
        if start and start + n > (matrix_rows or MATRIX_ROWS):
            matrix, start = matrix + 1, 0
        first.append((part, matrix, start))
        start += n
    parts = spark.createDataFrame(first, "part int, matrix int, first bigint")
    out = written.join(parts, "part").withColumn("row", F.col("first") + F.col("pos")).drop("pos", "first")
    return out, matrix + 1 if first else 0


def block_matrix(rows: DataFrame, vector: Column, width: int) -> BlockMatrix:
    """The block matrix of ``rows`` (row) with their ``vector`` (an array of ``width`` doubles)."""
    made = rows.select(F.col("row").alias("index"), array_to_vector(vector).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(made, "vector")).toBlockMatrix(BLOCK_ROWS, width)


def scatter(rows: DataFrame, matrices: int, vector: Column, width: int) -> np.ndarray:
    """The sum of the outer products of the centred vectors with themselves."""
    total = np.zeros((width, width))
    for k in range(matrices):
        a = block_matrix(rows.filter(F.col("matrix") == k), vector, width)
        splits = a.numRows() // (BLOCK_ROWS * BLOCKS_A_TASK) + 1
        # The result is one block; splits of the middle dimension make its partial sums many tasks. Scala's parameter.
        product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
        total += BlockMatrix(product, width, width).toLocalMatrix().toArray()
    return (total + total.T) / 2


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """x - S/n without rounding of large sums: the integer part of S/n is taken off first."""
    whole, part = (F.array(*[F.lit(v) for v in side]) for side in ([s // n for s in sums], [(s % n) / n for s in sums]))
    return F.zip_with(F.zip_with(x, whole, lambda a, b: (a - b).cast("double")), part, lambda a, b: a - b)


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over the dimensions of (n*x - S)^2, exact; null where it is no long."""
    whole, rest = (F.array(*[F.lit(v).cast("bigint") for v in side]) for side in ([s // n for s in sums], [s % n for s in sums]))
    term = F.zip_with(F.zip_with(x, whole, lambda a, b: F.try_multiply(a - b, F.lit(n).cast("bigint"))), rest, F.try_subtract)
    return F.aggregate(term, F.lit(0).cast("bigint"), lambda total, t: F.try_add(total, F.try_multiply(t, t)))


def fit(rows: DataFrame, matrices: int) -> Whitening | None:
    """The whitening of the indexed distinct vectors ``x``; None without any."""
    # Two halves of each entry, so that no sum leaves a long.
    halves = [F.sum(F.shiftright("v", 20)).alias("high"), F.sum(F.col("v").bitwiseAND(F.lit((1 << 20) - 1))).alias("low"), F.count("*").alias("n")]
    found = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(*halves).orderBy("k").collect()
    if not found:
        return None
    n, sums = found[0].n, [(r.high << 20) + r.low for r in found]
    covariance = scatter(rows, matrices, centred(F.col("x"), n, sums), len(sums)) / n
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(covariance)))


def project(rows: DataFrame, matrices: int, model: Whitening, components: int) -> DataFrame:
    """(matrix, row, z): the rows times the whitening matrix, the first ``components`` that are no rounding."""
    spark, width = rows.sparkSession, len(model.sums)
    kept = min(components, model.kept())
    if not kept:
        return rows.select("matrix", "row", F.array().cast("array<double>").alias("z"))
    # Scaled eigenvectors, column by column.
    weights = (model.vectors[:, :kept] / np.sqrt(model.values[:kept])).T.ravel()
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, kept, weights))], 1), width, kept)
    out = spark.createDataFrame([], "matrix int, row bigint, z array<double>")
    for k in range(matrices):
        left = block_matrix(rows.filter(F.col("matrix") == k), centred(F.col("x"), model.n, model.sums), width)

        def lines(block: tuple, k: int = k) -> list[tuple]:
            (i, _), values = block
            return [(k, i * BLOCK_ROWS + r, z) for r, z in enumerate(values.toArray().tolist())]

        out = out.union(spark.createDataFrame(left.multiply(right).blocks.flatMap(lines), out.schema))
    return out


def identity_error(rows: DataFrame, matrices: int, model: Whitening, components: int) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; None without components."""
    kept = min(components, model.kept())
    if not kept:
        return None
    z = materialise(project(rows, matrices, model, components), "whitened")
    means = z.select(F.posexplode("z").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).orderBy("k").collect()
    middle = F.array(*[F.lit(r.v) for r in means])
    covariance = scatter(z, matrices, F.zip_with("z", middle, lambda a, b: a - b), kept) / model.n
    return float(np.abs(covariance - np.eye(kept)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, matrix_rows: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per row (vec_id, embedding) and component.

    Left out: null and empty vectors, those with a null, non-finite or unrepresentably large entry, and those whose
    length is not the most frequent one (ties: the longer). Repeated rows and null vec_ids are rows like others; the fit
    takes each distinct integer vector once. Components whose eigenvalue is mere rounding have a null ``whitened``, and
    without variance ``explained`` and ``identity_error`` are null. ``deviation`` is null where it exceeds a long.
    Other columns are ignored. An empty table gives no rows.
    """
    numbers = integer_rows(rows)
    table, matrices = indexed(numbers, "vectors", matrix_rows)
    distinct, fit_matrices = indexed(table.select("x").distinct(), "fit", matrix_rows)
    model = fit(distinct, fit_matrices)
    if model is None:
        empty = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    error = identity_error(distinct, fit_matrices, model, components)
    count = min(components, len(model.sums))
    explained = F.array(*[F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values[:count]])
    facts = table.select("matrix", "row", "vec_id", deviation(F.col("x"), model.n, model.sums).alias("deviation"))
    each = facts.join(project(table, matrices, model, components), ["matrix", "row"]).select(
        "vec_id", "deviation", "z", F.posexplode(explained).alias("k", "explained")
    )
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        F.get("z", F.col("k")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"),
    )
