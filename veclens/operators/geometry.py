"""Distances inside and between labels, over samples that are bounded for each label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shuffled
from . import sampling

#: Queries, rows of the own label, and rows of other labels that a label is compared with at most.
QUERIES, SAME, OTHER = 40, 80, 160


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    return sampling.least(df, by, k).drop("place")


def distances(queries: DataFrame, gallery: DataFrame, group: Column, most: tuple[int, int, int] = (QUERIES, SAME, OTHER)) -> DataFrame:
    """label, kind, d: cosine distances, to six places, from a label's sampled queries to sampled rows of its own label (same), of others of
    its group (group) and of other groups (other). queries, gallery: item_id, label, vec; group: the group of a label.

    No more than 40 * (80 + 160 + 160) rows a label, and only sampled rows are ever moved. Of a group's rows, OTHER of each label at most,
    the first 2 * OTHER in the seeded order hold the first OTHER outside of any one label, and so they do for groups and all rows.
    """
    h = shuffled(42, "label", "item_id").alias("h")
    q, g = (df.select("item_id", "label", "vec", group.alias("grp"), h) for df in (queries, gallery))
    asked = _first(q, ["label"], most[0])
    labels = asked.select(F.col("label").alias("own"), F.col("grp").alias("own_grp")).distinct()
    same = _first(g, ["label"], most[1]).withColumn("own", F.col("label"))
    pools = _first(_first(g, ["grp", "label"], most[2]), ["grp"], 2 * most[2])
    near = _first(pools.join(labels, F.col("grp") == F.col("own_grp")).where("label <> own"), ["own"], most[2])
    pool = _first(g, ["grp"], most[2]).orderBy("h").limit(2 * most[2])
    far = _first(labels.crossJoin(F.broadcast(pool)).where("grp <> own_grp"), ["own"], most[2])  # at most 320 rows
    sides = [df.select(F.col("own").alias("label"), F.lit(kind).alias("kind"), "vec") for df, kind in ((same, "same"), (near, "group"), (far, "other"))]
    there = sides[0].unionByName(sides[1]).unionByName(sides[2])
    label = dict(queries.dtypes)["label"]

    def measure(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = b.column("kind").to_numpy() if b.num_rows else np.array([], object)
        unit = lambda t: (x := np.array(t.column("vec").to_pylist())) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if not a.num_rows or not (kinds == "same").any():
            return pa.table({"label": pa.array([], a.schema.field("label").type), "kind": pa.array([], pa.string()), "d": pa.array([], pa.float64())})
        d = np.round(1 - unit(a) @ unit(b).T, 6)
        return pa.table({"label": a.column("label").take(pa.array(np.zeros(d.size, np.int64))), "kind": pa.array(np.tile(kinds, len(d)), pa.string()), "d": pa.array(d.ravel())})

    return asked.select(F.col("label").alias("label"), F.col("vec").alias("vec")).groupBy("label").cogroup(there.groupBy("label")).applyInArrow(measure, f"label {label}, kind string, d double")


def by_label(d: DataFrame) -> DataFrame:
    """label, same, near, far: mean distances; null where a label has none of a kind."""
    mean = lambda k, n: F.avg(F.when(F.col("kind") == k, F.col("d"))).alias(n)
    return d.groupBy("label").agg(mean("same", "same"), mean("group", "near"), mean("other", "far"))
