"""Patches of images: sizes, places and quality of tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest size and step of sizes, where steps become factors, and the factor.
BASE, LINEAR, FACTOR = 256, 1024, 1.5
#: A pixel below DARK counts as black.
DARK = 30


def sizes(width: Column, height: Column, base: int = BASE, linear: int = LINEAR, factor: float = FACTOR) -> Column:
    """Patch sizes of an image: multiples of `base` up to `linear`, then each `factor` times the last; narrow images have their own side."""
    side = F.least(width, height).cast("int")
    steps = F.when(side >= base, F.sequence(F.lit(base), F.least(side, F.lit(linear)), F.lit(base))).otherwise(F.array().cast("array<int>"))
    grown = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.element_at(steps, -1) * F.pow(F.lit(factor), k))
    far = F.when((side > linear) & (F.size(steps) > 0), F.transform(F.filter(grown, lambda x: x <= side), lambda x: F.bround(x, 0).cast("int"))).otherwise(F.array().cast("array<int>"))
    found = F.array_sort(F.array_union(steps, far))
    narrow = F.when(side < base, F.array(side)).otherwise(F.array_distinct(F.array(F.lit(base), side)))
    return F.when(F.size(found) <= 1, F.array_sort(narrow)).otherwise(found)


def tiles(images: DataFrame, base: int = BASE, linear: int = LINEAR, factor: float = FACTOR) -> DataFrame:
    """images (width, height) with size, i, j, left, top of each patch; patches of one size overlap to reach the far edge."""
    some = images.withColumn("size", F.explode(sizes(F.col("width"), F.col("height"), base, linear, factor)))
    across, down = (F.ceil(F.col(c) / F.col("size")) for c in ("width", "height"))
    some = some.withColumns({"across": across, "down": down}).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)))
    some = some.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)))
    at = lambda i, side, n: F.when(F.col(n) > 1, F.floor(F.col(i) * ((F.col(side) - F.col("size")) / (F.col(n) - 1)))).otherwise(0)
    return some.withColumns({"left": at("i", "width", "across"), "top": at("j", "height", "down")}).drop("across", "down")


def _measures(patch: np.ndarray) -> tuple[float, float, float]:
    """Share of black pixels, variance of the Laplacian (the rows beyond an edge mirror those inside), entropy of grey levels in bits."""
    wide = np.pad(patch.astype(float), 1, mode="reflect" if min(patch.shape) > 1 else "edge")
    edges = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * patch
    share = np.bincount(patch.ravel(), minlength=256) / patch.size
    share = share[share > 0]
    return float((patch < DARK).mean()), float(edges.var()), float(-(share * np.log2(share)).sum())


def measured(patches: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Patches (of `tiles`, pixels row by row as array<int>) with black, sharpness and entropy in place of their pixels."""
    others = [c for c in patches.columns if c != pixels]
    kinds = dict(patches.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            box = [batch.column(c).to_pylist() for c in ("width", "height", "left", "top", "size")]
            for k, (w, h, x, y, s) in enumerate(zip(*box, strict=True)):
                grid = batch.column(pixels).slice(k, 1).flatten().to_numpy().reshape(h, w)
                out.append(_measures(grid[y : min(y + s, h), x : min(x + s, w)]))
            columns = [pa.array([m[i] for m in out], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], [*others, "black", "sharpness", "entropy"])

    return patches.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in others), "black double", "sharpness double", "entropy double"]))


def judged(patches: DataFrame, black: float = 0.5, sharpness: float = 5.0, entropy: float = 3.5) -> DataFrame:
    """Patches with status and reason: the first fault in turn decides; a column `cracked`, where there is one, comes second."""
    reason = F.when(F.col("black") > black, F.format_string("black_ratio_%.2f", "black"))
    if "cracked" in patches.columns:
        reason = reason.when(F.col("cracked"), F.lit("crack_detected"))
    reason = reason.when(F.col("sharpness") < sharpness, F.format_string("low_sharpness_%.2f", "sharpness")).when(F.col("entropy") < entropy, F.format_string("low_entropy_%.2f", "entropy"))
    return patches.withColumn("reason", F.coalesce(reason, F.lit("good"))).withColumn("status", F.when(F.col("reason") == "good", "kept").otherwise("removed"))
