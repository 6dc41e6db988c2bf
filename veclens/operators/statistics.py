"""Resampling and paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drawn(seed: int, n: Column | str, *keys: str) -> Column:
    """A number from 1 to n that the seed and keys decide."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long") % F.col(n) + 1


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    group = Window.partitionBy(*by)
    return df.withColumn("j", F.row_number().over(group.orderBy(*order)).cast("long")).withColumn("n", F.count("*").over(group))


def resampled(df: DataFrame, by: list[str], order: list[str], draws: int, seed: int = 42) -> DataFrame:
    """df with b and w: how often each row of a group is drawn in each of `draws` resamples; rows that aren't drawn are left out.

    One row of draws for each row of df, counted before it meets the data again.
    """
    rows = numbered(df, by, order)
    picks = rows.select(*by, "j", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("j", drawn(seed, "n", *by, "b", "j"))
    counts = picks.groupBy(*by, "b", "j").agg(F.count("*").alias("w"))
    return rows.drop("n").join(counts, [*by, "j"]).drop("j")


def mean_interval(df: DataFrame, by: list[str], value: str, order: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """by, mean, ci_lo, ci_hi of a value's resampled means: the 2.5th and 97.5th percentile; nulls and NaNs are left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    means = resampled(kept, by, order, draws, seed).groupBy(*by, "b").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("m"))
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("ci_lo"), F.percentile("m", F.lit(0.975)).alias("ci_hi"))


def signed_rank(differences: np.ndarray) -> tuple[float, float]:
    """Statistic and two-sided p of the signed-rank test, zeros dropped: exact for up to 25 pairs without ties, else by the normal
    approximation with its correction for ties."""
    d = differences[differences != 0]
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    size, inverse, ties = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(ties) - (ties - 1) / 2)[inverse]
    low = float(min(rank[d > 0].sum(), rank[d < 0].sum()))
    if n <= 25 and len(size) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return low, float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    return low, float(math.erfc(abs(low - n * (n + 1) / 4) / spread / math.sqrt(2)))


def wilcoxon(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, statistic, p_value: one paired test a group, each over a row a label."""
    keys = pairs.select(*by).dtypes

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        statistic, p = signed_rank((pdf[a] - pdf[b]).to_numpy(float))
        return pd.DataFrame([[*pdf[by].iloc[0], len(pdf), statistic, p]], columns=[*by, "n", "statistic", "p_value"])

    return pairs.select(*by, a, b).groupBy(*by).applyInPandas(test, ", ".join([*(f"{k} {t}" for k, t in keys), "n long", "statistic double", "p_value double"]))
