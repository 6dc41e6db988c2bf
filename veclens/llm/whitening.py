"""Whitening of embeddings with MLlib's BlockMatrix.

Centred rows get consecutive indices and become an IndexedRowMatrix, then blocks. The blocks' transpose times the blocks is the scatter
matrix, as large as the dimension squared, whose eigenvectors the driver takes. The blocks times the whitening matrix are the projected
rows. All of that runs in the JVM; no vector passes through Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block, and how many blocks of rows meet in one task of a product whose sides share the long dimension.
ROWS, TOGETHER = 1024, 8
#: An eigenvalue under this share of the greatest is a direction in which the rows don't differ.
FLAT = 1e-12
#: Entries of this size or more are left out with the infinite ones: they have no exact long.
_TOO_LARGE = float(2**52)


@dataclass
class Moments:
    n: int
    sums: list[int]
    least: int
    most: int


def _usable(column: str) -> Column:
    """Whether a vector is there, and all of its entries can be made long."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) >= _TOO_LARGE)
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda c: F.coalesce(bad(c.cast("double")), F.lit(True))), F.lit(False))


def integer_rows(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """index, key, x: rows with a usable vector, floor(1024 c) + 100000 of its entries, numbered from 0 without gaps.

    Rows whose vectors are of another length than most are left out as well; of lengths as frequent as each other, the greatest stays.
    The numbers come from the places inside each written part and a sum over the parts.
    """
    usable = embeddings.where(_usable(column))
    size = usable.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    place = F.monotonically_increasing_id()  # the partition's number in its upper bits, the row's place in the lower 33
    rows = usable.where(F.size(column) == (size.d if size else 0)).select(F.col(key).alias(key), x.alias("x"), F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place"))
    rows = staged(rows, "vectors")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    return rows.join(before, "part").select((F.col("before") + F.col("place")).alias("index"), key, "x")


def moments(rows: DataFrame) -> Moments:
    """Number, exact sums by dimension, least and greatest entry."""
    each = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    found = each.orderBy("at").collect()  # a row a dimension
    return Moments(found[0].n, [int(r.s) for r in found], min(r.least for r in found), max(r.most for r in found)) if found else Moments(0, [], 0, 0)


def deviation(m: Moments, x: str = "x") -> Column:
    """The sum over dimensions of (n x - S)^2, exact; null where that may be no long."""
    widest = m.n * (m.most - m.least)
    if widest * widest * len(m.sums) >= 2**63:  # decided for each row, by an estimate that errs by far less than the factor of 2
        about = F.aggregate(F.zip_with(x, F.array(*(F.lit(s / m.n) for s in m.sums)), lambda a, b: F.pow((a - b) * m.n, F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
        if m.n * max(abs(m.most), abs(m.least)) >= 2**62:
            return F.lit(None).cast("long")
        return F.when(about < 2.0**62, _squares(m, x))
    return _squares(m, x)


def _squares(m: Moments, x: str) -> Column:
    apart = F.zip_with(x, F.array(*(F.lit(s).cast("long") for s in m.sums)), lambda a, b: a * F.lit(m.n).cast("long") - b)
    return F.aggregate(apart, F.lit(0).cast("long"), lambda a, b: a + b * b)


def indexed(rows: DataFrame, vector: str, index: str = "index") -> IndexedRowMatrix:
    """A distributed matrix of an array column, row by row at its index."""
    old = MLUtils.convertVectorColumnsFromML(rows.select(index, array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(old)


def blocks(matrix: IndexedRowMatrix, dimension: int, rows: int = ROWS) -> BlockMatrix:
    return matrix.toBlockMatrix(rows, max(1, min(dimension, 1024)))


def product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a times b, `splits` parts of their common dimension apart: a task holds no more than its part's blocks, and partial sums are added."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def scatter(a: BlockMatrix, n: int) -> np.ndarray:
    """The transpose of a times a, as one matrix of the dimension squared."""
    return product(a.transpose(), a, max(1, math.ceil(n / (a.rowsPerBlock * TOGETHER)))).toLocalMatrix().toArray()


def from_local(spark: SparkSession, matrix: np.ndarray, rows: int) -> BlockMatrix:
    """A small matrix in blocks of `rows` rows."""
    parts = np.split(matrix, range(rows, len(matrix), rows))
    dense = [((i, 0), Matrices.dense(len(p), p.shape[1], p.ravel(order="F"))) for i, p in enumerate(parts)]
    return BlockMatrix(spark.sparkContext.parallelize(dense, 1), rows, matrix.shape[1], *matrix.shape)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """index, y: the rows of a distributed matrix, as arrays, without leaving the JVM."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("y"))


def whitened(embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding", rows: int = ROWS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for each usable row and each of the first `components` principal
    components, fewer if there are fewer dimensions.

    whitened: the centred row's projection over the square root of the eigenvalue; identity_error: the largest entry of the covariance of
    these, centred anew, less the identity. Where an eigenvalue is nothing beside the greatest (FLAT), whitened is null and the component
    has no part in identity_error, which is null if there is no other. Ties between eigenvalues stand in the order that the decomposition
    gives, the same for all rows.

    A null vector, one without entries, one with a null, infinite or NaN entry or one that 1024 takes beyond 2^52, and one of an unusual
    length (`integer_rows`) has no rows and no part in the fit. Repeated rows count, and come out, as often as they stand; a null key stays
    null. An empty table gives no rows. Other columns aren't read.
    """
    spark, kind = embeddings.sparkSession, dict(embeddings.dtypes)[key]
    x = staged(integer_rows(embeddings, key, column), "indexed")
    m = moments(x)
    if not m.n:
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    d = len(m.sums)
    mean = F.array(*(F.lit(s / m.n) for s in m.sums))
    a = blocks(indexed(x.select("index", F.zip_with("x", mean, lambda v, c: v - c).alias("v")), "v"), d, rows)
    covariance = scatter(a, m.n) / m.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    wide = values[order] > FLAT * max(float(values[-1]), 0.0)
    matrix = np.where(wide, vectors[:, order] / np.sqrt(np.where(wide, values[order], 1.0)), 0.0)

    y = staged(rows_of(product(a, from_local(spark, matrix, a.colsPerBlock))), "whitened")
    error = _identity_error(y, np.flatnonzero(wide).tolist())
    per = [F.struct(F.lit(i + 1).alias("component"), (F.get("y", F.lit(i)) if wide[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(float(values[k]) / trace if trace > 0 else None).cast("double").alias("explained")) for i, k in enumerate(order)]
    rows_out = x.select("index", key, deviation(m).alias("deviation")).join(y, "index").select(key, "deviation", F.explode(F.array(*per)).alias("c"))
    return rows_out.select(key, "c.component", F.lit(m.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))


def _identity_error(y: DataFrame, which: list[int]) -> float | None:
    """The largest entry, without its sign, of the covariance of these columns less the identity."""
    if not which:
        return None
    pairs = [(i, j) for i in which for j in which if i <= j]
    found = y.agg(*(F.covar_pop(F.get("y", F.lit(i)), F.get("y", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
