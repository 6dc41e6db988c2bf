"""Seeded splits: every shuffle is an order by a hash, so that no partitioning changes a split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import shuffled
from . import sampling

#: Hexadecimal digits of a hash that make a range of it: 256 ranges of about as many rows each.
DIGITS = 2


def placed(items: DataFrame, by: list[str], seed: int = 42, *keys: str) -> DataFrame:
    """items with place (from 1) and n within each group of `by`, in the seeded order of by and item_id.

    Hashes are spread evenly, so a group's rows are sorted in ranges of their hash, and each range begins where the counts of those before
    it end: a group with a third of all rows is sorted by as many tasks as a hash has ranges. Null is a group like others.
    """
    rows = items.withColumn("order", shuffled(seed, *(keys or (*by, "item_id")))).withColumn("range", F.substring("order", 1, DIGITS))
    group = Window.partitionBy(*by)
    counts = rows.groupBy(*by, "range").agg(F.count("*").alias("c"))  # at most 256 rows a group
    before = counts.select(*(F.col(c).alias(f"{c}_of") for c in (*by, "range")), (F.sum("c").over(group.orderBy("range")) - F.col("c")).alias("before"), F.sum("c").over(group).alias("n"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*by, "range")))
    inside = F.row_number().over(Window.partitionBy(*by, "range").orderBy("order"))
    return rows.join(before, same).withColumn("place", (F.col("before") + inside).cast("int")).select(*items.columns, "place", "n")


def part(fraction: float, least: int) -> Column:
    """max(least, int(fraction * n)): the product truncated as a double."""
    return F.greatest(F.lit(least), F.floor(F.lit(fraction) * F.col("n")).cast("int"))


def train_val_test(items: DataFrame, by: list[str], train: float = 0.65, val: float = 0.15, seed: int = 42) -> DataFrame:
    first, second = part(train, 1), part(val, 0)
    split = F.when(F.col("place") <= first, "train").when(F.col("place") <= first + second, "val").otherwise("test")
    return placed(items, by, seed).withColumn("split", split).drop("place", "n")


def two_way(items: DataFrame, by: list[str], size: Column, names: tuple[str, str], seed: int = 42) -> DataFrame:
    """size: how many of n come first, a column over n."""
    return placed(items, by, seed).withColumn("split", F.when(F.col("place") <= size, names[0]).otherwise(names[1])).drop("place", "n")


def sampled(items: DataFrame, by: list[str], k: int, reps: int, seed: int = 42) -> DataFrame:
    """rep, and items: at most k of each group in each of `reps` draws."""
    return sampling.drawn(items, by, k, reps, seed).drop("place")


def meta(labels: DataFrame, train: float = 0.6, val: float = 0.1, least: int = 3, seed: int = 42) -> DataFrame:
    """labels (label, grp, known) with split: known labels are tested on. The others of a group of `least` labels or more are shared out inside
    it, those of smaller groups go where their group goes; shares are rounded half to even, and the last part takes what is left."""
    free = labels.where("not known").withColumn("size", F.count("*").over(Window.partitionBy("grp")))
    inside = placed(free.where(F.col("size") >= least), ["grp"], seed, "grp", "label").select(*labels.columns, "place", "n")
    small = free.where(F.col("size") < least)
    groups = placed(small.select("grp").distinct().withColumn("one", F.lit(0)), ["one"], seed, "grp").select("grp", "place", "n")
    first, second = (F.bround(F.lit(share) * F.col("n"), 0) for share in (train, val))
    split = F.when(F.col("place") <= first, "train").when(F.col("place") <= first + second, "val").otherwise("test")
    shared = inside.unionByName(small.join(groups, "grp").select(*labels.columns, "place", "n")).withColumn("split", split).drop("place", "n")
    return shared.unionByName(labels.where("known").withColumn("split", F.lit("test")))
