"""Second moments of vectors by partial sums, and maps of whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def moments(df: DataFrame, column: str = "vec") -> DataFrame:
    """i, sums: row i of the sum of all outer products, and, at -1, the sum of all vectors with their number behind it.

    Each task adds up its own rows, so that as many rows are shuffled as a task has dimensions, however many vectors there are.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram, n = None, None, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                total, gram, n = (x.sum(axis=0), x.T @ x, len(x)) if total is None else (total + x.sum(axis=0), gram + x.T @ x, n + len(x))
        if total is not None:
            rows = [np.r_[total, n], *gram]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(gram)), pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["i", "sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([np.sum(table.column("sums").to_pylist(), axis=0).tolist()], pa.list_(pa.float64()))})

    return df.select(column).mapInArrow(part, "i int, sums array<double>").groupBy("i").applyInArrow(add, "i int, sums array<double>")


def covariance(df: DataFrame, ridge: float = 1e-4, column: str = "vec") -> DataFrame:
    """i, j, value: the covariance about the mean, over n, with `ridge` on its diagonal; no rows for no vectors."""
    rows = moments(df, column)
    first = rows.where("i = -1").select(F.slice("sums", F.lit(1), F.size("sums") - 1).alias("total"), F.element_at("sums", -1).alias("n"))
    cells = rows.where("i >= 0").crossJoin(F.broadcast(first)).select("i", "n", "total", F.posexplode("sums").alias("j", "x"))  # one row
    value = F.col("x") / F.col("n") - F.get("total", "i") / F.col("n") * F.get("total", "j") / F.col("n")
    return cells.select("i", "j", (value + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)).alias("value"))


def mapped(df: DataFrame, f, column: str = "vec", name: str = "vec") -> DataFrame:
    """df with `name` = f of the matrix of the batch's vectors, which gives a row each."""
    others = [c for c in df.columns if c != name]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = f(_matrix(batch.column(column)))
                at = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.ListArray.from_arrays(at, pa.array(y.ravel()))], [*others, name])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"{name} array<double>"]))


def coloured(df: DataFrame, target: DataFrame, ridge: float = 1e-4) -> DataFrame:
    """df's vectors with the covariance and mean of df taken off and those of target put on. The matrices have the dimension squared."""

    def known(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        sums = {r.i: r.sums for r in moments(rows).collect()}
        mean = np.array(sums[-1][:-1]) / sums[-1][-1]
        gram = np.array([sums[i] for i in range(len(mean))]) / sums[-1][-1]
        return mean, gram - np.outer(mean, mean) + ridge * np.eye(len(mean))

    def power(m: np.ndarray, p: float, floor: float) -> np.ndarray:
        w, u = np.linalg.eigh(m)
        return u @ np.diag(np.maximum(w, floor) ** p) @ u.T

    (mean_a, cov_a), (mean_b, cov_b) = known(df), known(target)
    turn = power(cov_a, -0.5, 1e-8) @ power(cov_b, 0.5, 0.0)
    return mapped(df, lambda x: (x - mean_a) @ turn + mean_b)


def residual_head(x: np.ndarray, base: np.ndarray | None, hidden: np.ndarray, out: np.ndarray, beta: float) -> np.ndarray:
    """A stored head at work: a linear base and a small network's correction, each at unit length, added and scaled. Without a base the
    vectors themselves are it."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return unit(unit(x if base is None else x @ base.T) + beta * unit(np.maximum(x @ hidden.T, 0) @ out.T))
