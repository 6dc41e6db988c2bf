"""Stored heads: weights as rows of a table, and all heads applied in one pass over the vectors.

A table of heads has head, layer, row, values: row i of a layer's matrix. Layers are `base` (absent: the vectors themselves), `hidden` and
`out`. A head's weights are as large as its matrices, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.tables import staged
from . import openset, splits
from .gram import residual_head

SCHEMA = "head string, layer string, row int, values array<double>"
#: Numbers in all heads' weights that go to every task at once; more heads take more passes.
WEIGHTS = 1 << 24


def fitted(gallery: DataFrame, seeds: tuple[int, ...], share: float = 0.65) -> DataFrame:
    """A head for each seed, learnt from the seed's `share` of each label's rows: `base` has the means of the labels' unit vectors, `hidden`
    the means less their own mean, `out` the products of the hidden rows with each other. gallery: item_id, label, vec."""
    out = None
    for seed in seeds:
        kept = splits.placed(gallery, ["label"], seed).where(F.col("place") <= splits.part(share, 1))
        means = openset.class_means(kept).select("label", "vec")
        middle = vectors.mean_vector(means, [], name="middle")
        rows = means.crossJoin(F.broadcast(middle)).select("label", "vec", vectors.shifted("vec", "middle").alias("less"))  # a row a label
        ordered = rows.agg(F.sort_array(F.collect_list(F.struct("label", "vec", "less"))).alias("rows"))
        product = F.transform("rows", lambda a: F.transform("rows", lambda b: vectors.dot(a["less"], b["less"])))
        layers = F.map_from_arrays(F.array(*map(F.lit, ("base", "hidden", "out"))), F.array(F.transform("rows", lambda r: r["vec"]), F.transform("rows", lambda r: r["less"]), product))
        one = ordered.select(F.explode(layers).alias("layer", "matrix")).select(F.lit(str(seed)).alias("head"), "layer", F.posexplode("matrix").alias("row", "values"))
        out = one if out is None else out.unionByName(one)
    return out


def load(heads: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """head -> layer -> matrix. Fails where a layer's rows have gaps, repeats or different lengths."""
    rows: dict[str, dict[str, dict[int, list[float]]]] = {}
    for r in heads.select("head", "layer", "row", "values").collect():
        if r.row in rows.setdefault(r.head, {}).setdefault(r.layer, {}):
            raise ValueError(f"head {r.head!r} has row {r.row} of {r.layer!r} twice")
        rows[r.head][r.layer][r.row] = r["values"]
    out: dict[str, dict[str, np.ndarray]] = {}
    for head, layers in rows.items():
        for layer, matrix in layers.items():
            if sorted(matrix) != list(range(len(matrix))) or len({len(v) for v in matrix.values()}) > 1:
                raise ValueError(f"head {head!r} has no whole matrix {layer!r}")
            out.setdefault(head, {})[layer] = np.array([matrix[i] for i in range(len(matrix))])
    return out


def _groups(heads: DataFrame, most: int) -> list[list[str]]:
    """Heads in groups of at most `most` numbers, by counts of their rows; a row a head comes to the driver."""
    sizes = heads.groupBy("head").agg(F.sum(F.size("values")).alias("n")).orderBy("head").collect()
    groups, total = [[]], 0
    for r in sizes:
        if groups[-1] and total + r.n > most:
            groups.append([])
            total = 0
        groups[-1].append(r.head)
        total += r.n
    return groups if sizes else []


def projected(items: DataFrame, heads: DataFrame, beta: float = 0.1, most: int = WEIGHTS) -> DataFrame:
    """items once for each head, with head and the head's vec. Every batch of vectors is read once for all heads of a group."""
    kinds = dict(items.dtypes)
    others = [c for c in items.columns if c not in ("vec", "head")]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "head string, vec array<double>"])
    heads = staged(heads.select("head", "layer", "row", "values"), "heads")
    out = None
    for group in _groups(heads, most):
        weights = items.sparkSession.sparkContext.broadcast(load(heads.where(F.col("head").isin(group))))

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
                    for head, layers in sorted(weights.value.items()):
                        y = residual_head(x, layers.get("base"), layers["hidden"], layers["out"], beta)
                        ends = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([head] * len(y)), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], [*others, "head", "vec"])

        one = items.select(*others, "vec").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return items.sparkSession.createDataFrame([], schema) if out is None else out
