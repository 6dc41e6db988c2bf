"""Reading the tables, and the roles that the embeddings play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import folder

LAST_KNOWN = 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, label, vec: vectors as doubles, so that every kernel and order of summing starts from the same numbers."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def gallery(items: DataFrame) -> DataFrame:
    return items.where(f"item_id % 2 = 0 and label <= {LAST_KNOWN}")


def id_queries(items: DataFrame) -> DataFrame:
    return items.where(f"item_id % 2 = 1 and label <= {LAST_KNOWN}")


def ood_queries(items: DataFrame) -> DataFrame:
    return items.where(f"label > {LAST_KNOWN}")


def shuffled(seed: int, *keys: str) -> Column:
    """A seeded order that no partitioning changes."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def incremental(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of `expected` whose key isn't among `done`."""
    return expected.join(done.select(key), key, "left_anti")


def lookup(names: DataFrame, cache: DataFrame, key: str, value: str, missing: str) -> DataFrame:
    """names with the cached value, or `missing`."""
    return names.join(cache.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: what it comes from runs once, and a lost executor loses nothing. The table stays
    as long as results may rest on it, for whoever clears the folder."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
