"""Vectors as columns of array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(TINY))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column | str) -> Column:
    """At unit length; vector and length are each worked out once, as what a lambda is called with."""
    return F.transform(F.array(a), lambda v: F.transform(F.array(norm(v)), lambda length: F.transform(v, lambda x: x / length))[0])[0]


def scaled(df: DataFrame, column: str = "vec") -> DataFrame:
    """df with the column at unit length."""
    return df.withColumn(column, unit(column))


def fused(a: Column | str, b: Column | str) -> Column:
    """Both at unit length, one after the other, at unit length."""
    return F.transform(F.concat(unit(a), unit(b)), lambda x: x / F.sqrt(F.lit(2.0)))


def mean_vector(df: DataFrame, by: list[str], column: str = "vec", name: str = "vec") -> DataFrame:
    """Element-wise mean of each group; positions are summed apart, so that no group comes together in one task."""
    long = df.select(*by, F.posexplode(column).alias("pos", "x"))
    means = long.groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(name))


def shifted(column: str, minus: str, plus: str | None = None) -> Column:
    out = F.zip_with(column, minus, lambda x, y: x - y)
    return F.zip_with(out, plus, lambda x, y: x + y) if plus else out


def log_sum_exp(values: Column | str) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def energy(logits: Column | str) -> Column:
    return -log_sum_exp(logits)


def one_minus_top_softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    at = F.transform(logits, lambda x: x / temperature)
    return 1 - F.exp(F.array_max(at) - log_sum_exp(at))


def retrieval_energy(sims: Column | str, tau: float = 0.07) -> Column:
    top = F.array_max(sims)
    return -(top + tau * F.log(F.aggregate(sims, F.lit(0.0), lambda s, x: s + F.exp((x - top) / tau))))
