"""Retrieval and open-set metrics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import staged


def hit(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


def per_label(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, q_label, n, accuracy."""
    return preds.groupBy(*(by or []), "q_label").agg(F.count("*").alias("n"), F.avg(hit(F.col("pred") == F.col("q_label"))).alias("accuracy"))


def macro(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_label(preds, by).groupBy(*(by or [])).agg(F.avg("accuracy").alias("macro"), F.count("*").alias("labels"))


#: Ranges of scores that are accumulated apart, in each group; more where a range would have too many rows.
RANGES = 64


def in_ranges(rows: DataFrame, by: list[str], score: str, most: int | None = None) -> DataFrame:
    """rows with `range`, from 0: the approximate quantiles of their group's scores that are less than theirs, so that equal scores are in one
    range and no outlier widens one. most: rows of a range, about, which may make more ranges of the greatest group."""
    ranges = RANGES
    if most:
        ranges = max(RANGES, math.ceil(rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) // most)
    cuts = F.percentile_approx(score, [i / ranges for i in range(1, ranges)], F.lit(20 * ranges)).alias("cuts")
    ends = rows.groupBy(*by).agg(cuts)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by)) if by else None
    whole = rows.join(ends.select(*(F.col(c).alias(f"{c}_of") for c in by), "cuts"), same) if by else rows.crossJoin(F.broadcast(ends))  # one row
    return whole.select(*rows.columns, F.coalesce(F.size(F.filter("cuts", lambda e: e < F.col(score))), F.lit(0)).alias("range"))


def steps(scores: DataFrame, by: list[str], score: str = "score", positive: str = "positive", weight: str | None = None) -> DataFrame:
    """by, score, tp, fp, p, n: the ROC curve, a point for each distinct score, highest first.

    Raw rows are first counted by score, and the counts written once, so that what the scores come from runs once. The window that
    accumulates them sees those of one range of the group's scores only; a window over the ranges' sums tells where each begins. weight:
    how often a row counts.
    """
    times = F.col(weight) if weight else F.lit(1)
    counts = staged(scores.groupBy(*by, score).agg(F.sum(times * hit(positive)).alias("pos"), F.sum(times * (1 - hit(positive))).alias("neg")), "steps")
    placed = in_ranges(counts, by, score)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    over = group.orderBy(F.desc("range"))
    starts = placed.groupBy(*by, "range").agg(F.sum("pos").alias("range_pos"), F.sum("neg").alias("range_neg"))
    starts = starts.select(*by, "range", *((F.sum(f"range_{x}").over(over) - F.col(f"range_{x}")).alias(f"before_{x}") for x in ("pos", "neg")), F.sum("range_pos").over(group).alias("p"), F.sum("range_neg").over(group).alias("n"))
    down = Window.partitionBy(*by, "range").orderBy(F.desc(score))
    rows = placed.withColumns({f"within_{x}": F.sum(x).over(down) for x in ("pos", "neg")}).join(starts, [*by, "range"])
    return rows.select(*by, score, "pos", "neg", (F.col("before_pos") + F.col("within_pos")).alias("tp"), (F.col("before_neg") + F.col("within_neg")).alias("fp"), "p", "n")


def roc(scores: DataFrame, by: list[str] | None = None, target: float = 0.95, **names) -> DataFrame:
    """by, auroc, fpr, aupr. auroc: tied scores count half; fpr: at the first point with a true positive rate of `target` or more."""
    by = by or []
    at = steps(scores, by, **names)
    area = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2.0))
    first = F.min(F.when(F.col("tp") >= target * F.col("p"), F.col("fp")))
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return at.groupBy(*by, "p", "n").agg((area / F.col("p") / F.col("n")).alias("auroc"), (first / F.col("n")).alias("fpr"), (precision / F.col("p")).alias("aupr")).drop("p", "n")


def ranked_quality(ranks: DataFrame) -> DataFrame:
    """q_id, q_label, ap, mrr, hit1, hit5, hit10, purity5, first_rank, gallery of each query over its full ranking, from the ranks of its
    relevant rows; ap, mrr and first_rank are null where nothing is relevant."""
    seen = F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))
    first = F.min("rank")
    at = lambda k: F.coalesce((first <= k).cast("int"), F.lit(0))
    five = F.least(F.lit(5), F.max("gallery"))
    return ranks.withColumn("seen", seen).groupBy("q_id", "q_label").agg(
        F.avg(F.col("seen") / F.col("rank")).alias("ap"), (1.0 / first).alias("mrr"), at(1).alias("hit1"), at(5).alias("hit5"), at(10).alias("hit10"),
        (F.count_if(F.col("rank") <= 5) / five).alias("purity5"), first.alias("first_rank"), F.max("gallery").alias("gallery"),
    )


def quality(found: DataFrame) -> DataFrame:
    """The columns of `ranked_quality` from `similarity.relevant_quality`."""
    at = lambda k: F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)).alias(f"hit{k}")
    return found.select("q_id", "q_label", "ap", (1.0 / F.col("first_rank")).alias("mrr"), at(1), at(5), at(10), (F.col("within5") / F.least(F.lit(5), "gallery")).alias("purity5"), "first_rank", "gallery")


def average_rank(column: str, by: list[str]) -> Column:
    """Rank from 1, equal values sharing the mean of their places."""
    group = Window.partitionBy(*by)
    return F.rank().over(group.orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho: null for fewer than three pairs; pairs with a null are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", average_rank(x, by)).withColumn("ry", average_rank(y, by))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("rx", "ry")).alias("rho"))


def holm(df: DataFrame, by: list[str], p: str = "p_value", order: str = "pair") -> DataFrame:
    """df with p_holm, step down within each family; a null p stays null and doesn't count."""
    known = df.where(F.col(p).isNotNull())
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy(p, order))
    raw = F.least(F.lit(1.0), (F.count("*").over(group) - place + 1) * F.col(p))
    done = known.withColumn("raw", raw).withColumn("p_holm", F.max("raw").over(group.orderBy(p, order).rowsBetween(Window.unboundedPreceding, 0))).drop("raw")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))
