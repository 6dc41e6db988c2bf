"""Open-set scores from the tails of each class's own distances, and diverse members of groups of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from . import similarity

TAIL, ALPHAS = 20, (5, 10, 15, 20)
#: Rows of a large group that its centres are fitted on, about; every row may still be chosen.
FIT_ROWS, ROUNDS = 4096, 20


def weibull(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of greatest likelihood, located at zero; the shape by halving, as its equation rises steadily."""
    x = np.maximum(np.asarray(x, float), 1e-9)
    top, logs = x.max(), np.log(x)

    def over(shape: float) -> float:
        p = (x / top) ** shape
        return (p * logs).sum() / p.sum() - 1 / shape - logs.mean()

    low, high = 1e-3, 1e4
    for _ in range(100):
        mid = (low * high) ** 0.5
        low, high = (low, mid) if over(mid) > 0 else (mid, high)
    return mid, float(top * ((x / top) ** mid).mean() ** (1 / mid))


def class_means(gallery: DataFrame) -> DataFrame:
    """A row of item_id, label, vec for each label: the mean of its unit vectors."""
    return vectors.mean_vector(vectors.scaled(gallery), ["label"]).select(F.col("label").cast("long").alias("item_id"), "label", "vec")


def activations(rows: DataFrame, means: DataFrame, tau: float) -> DataFrame:
    """q_id, q_label, grid, x: the logits of all known labels, cosines to their means over tau, by label; grid has z and label."""
    cell = F.sort_array(F.collect_list(F.struct("g_id", (F.col("sim") / tau).alias("z"), F.col("g_label").alias("label"))))
    rows = similarity.matches(rows, means, None).groupBy("q_id", "q_label").agg(cell.alias("grid"))
    return rows.withColumn("x", F.transform("grid", lambda c: c["z"]))


def openmax(queries: DataFrame, gallery: DataFrame, tau: float, alphas: tuple[int, ...] = ALPHAS) -> DataFrame:
    """q_id, q_label, alpha, unknown: the probability of none of the known labels.

    A label's mean activation is that of the gallery rows whose greatest logit is their own label's, or of all its rows where there is none;
    its tail are the greatest TAIL distances of these to it. Each of the alpha greatest logits gives up the part that the Weibull curve of
    its label's tail says of the distance; what they give up together is the logit of none.
    """
    means = class_means(gallery)
    own = activations(gallery, means, tau)
    own = own.withColumn("correct", F.array_max(F.transform("grid", lambda c: F.struct(c["z"].alias("z"), c["label"].alias("label"))))["label"] == F.col("q_label"))
    any_right = own.groupBy(F.col("q_label").alias("label")).agg(F.max("correct").alias("any_right"))  # a row a label
    right = own.join(any_right, F.col("q_label") == F.col("label")).where("correct or not any_right").select("label", "x")
    middle = vectors.mean_vector(right, ["label"], "x", "middle")
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    far = right.join(middle, "label").select("label", apart("x", "middle").alias("d"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("d")))
    kind = dict(gallery.dtypes)["label"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        shape, scale = weibull(pdf["d"].to_numpy())
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "shape": [shape], "scale": [scale]})

    fits = far.withColumn("k", place).where(F.col("k") <= TAIL).select("label", "d").groupBy("label").applyInPandas(fit, f"label {kind}, shape double, scale double").join(middle, "label")
    rows = activations(queries, means, tau).withColumn("down", F.sort_array(F.transform("grid", lambda c: F.struct(c["z"].alias("z"), c["label"].alias("label"))), asc=False))
    first = rows.select("q_id", "q_label", "x", F.transform("down", lambda c: c["z"]).alias("down"), F.posexplode(F.slice("down", 1, max(alphas))).alias("pos", "c"))
    w = 1 - F.exp(-F.pow(apart("x", "middle") / F.col("scale"), "shape"))
    given = first.select("q_id", "q_label", "x", "down", "pos", "c.*").join(fits, "label").select("q_id", "q_label", "down", F.struct("pos", "z", w.alias("w")).alias("c"))
    top = given.groupBy("q_id", "q_label").agg(F.first("down").alias("down"), F.sort_array(F.collect_list("c")).alias("top")).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    top = top.withColumn("part", F.slice("top", F.lit(1), F.col("alpha"))).withColumn("none", total("part", lambda c: c["z"] * c["w"]))
    rest = F.slice("down", F.col("alpha") + 1, F.greatest(F.size("down"), F.lit(0)))
    others = total("part", lambda c: F.exp(c["z"] * (1 - c["w"]) - F.col("none"))) + total(rest, lambda z: F.exp(z - F.col("none")))
    return top.select("q_id", "q_label", "alpha", (1 / (1 + others)).alias("unknown"))


def centres(x: np.ndarray, most: int, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from seeded rows of x; a centre that loses its members stays."""
    out = x[np.random.default_rng(seed).permutation(len(x))[:most]]
    for _ in range(rounds):
        near = ((x**2).sum(axis=1)[:, None] - 2 * x @ out.T + (out**2).sum(axis=1)[None]).argmin(axis=1)
        new = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(out)])
        if np.array_equal(new, out):
            break
        out = new
    return out


def diverse(items: DataFrame, by: list[str], most: int, fit_rows: int = FIT_ROWS, seed: int = 42) -> DataFrame:
    """by, item_id: all rows of a group of at most `most`; of a larger one the nearest to each of `most` centres, each row once.

    Centres are fitted on about `fit_rows` rows of a group, taken by a hash of item_id; all its rows are then measured against them where
    they are, and only the nearest of each task are shuffled. Of equal distances, to 9 places, the smallest item_id wins.
    """
    counts = items.groupBy(*by).agg(F.count("*").alias("n"))
    rows = items.select(*by, "item_id", "vec").join(counts, by)
    large = rows.where(F.col("n") > most)
    at = (F.xxhash64(F.lit(seed), "item_id").bitwiseAND(0x7FFFFFFF)) / float(1 << 31)
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("at", "item_id"))
    sample = large.withColumn("at", at).where(F.col("at") * F.col("n") < fit_rows).withColumn("turn", turn).where(F.col("turn") <= 2 * fit_rows)
    kinds = dict(items.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = centres(np.stack(pdf.sort_values("item_id")["vec"].to_numpy()).astype(float), most, seed)
        return pdf[by].iloc[:1].assign(centres=[[c.tolist() for c in found]])

    fitted = sample.select(*by, "item_id", "vec").groupBy(*by).applyInPandas(fit, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "centres array<array<double>>"]))
    far = F.transform("centres", lambda c: F.aggregate(F.zip_with("vec", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    measured = large.join(fitted, by).select(*by, "item_id", far.alias("far"))
    nearest = measured.groupBy(*by).agg(*(F.min(F.struct(F.round(F.get("far", F.lit(k)), 9).alias("d"), "item_id")).alias(f"c{k}") for k in range(most)))
    chosen = nearest.select(*by, F.explode(F.array_distinct(F.array(*(F.col(f"c{k}.item_id") for k in range(most))))).alias("item_id"))
    return rows.where(F.col("n") <= most).select(*by, "item_id").unionByName(chosen)
