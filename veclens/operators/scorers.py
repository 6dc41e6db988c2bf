"""The scorers of a labelled memory, registered by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..functions import vectors
from ..sources.tables import staged
from . import openset, similarity

TAU, NEAR = 0.07, 50


_held: ContextVar[dict | None] = ContextVar("held", default=None)


@contextmanager
def shared() -> Iterator[None]:
    """Scorers that are called within for the same queries and gallery rest on one table of the nearest rows, written once."""
    token = _held.set({})
    try:
        yield
    finally:
        _held.reset(token)


def _once(what: str, tables: tuple[DataFrame, ...], build: Callable[[], object]):
    """build(), or within `shared` what it gave for these tables before, which stay alive so that their ids stay theirs."""
    held = _held.get()
    if held is None:
        return build()
    key = (what, *map(id, tables))
    if key not in held:
        held[key] = (tables, build())
    return held[key][1]


def near_rows(queries: DataFrame, gallery: DataFrame, near: int = NEAR) -> DataFrame:
    """q_id, q_label, g_label, sim, rank of the nearest rows."""
    find = lambda: similarity.matches(queries, gallery, near).select("q_id", "q_label", "g_label", "sim", "rank")
    return find() if _held.get() is None else _once(f"near {near}", (queries, gallery), lambda: staged(find(), "near"))


def centred(items: DataFrame, gallery: DataFrame, key: str | None = None) -> DataFrame:
    """items less the gallery's mean, at unit length; with a key, less the mean of its value. The mean is one row, or a row a value."""
    mean = vectors.mean_vector(gallery, [key] if key else [], name="mean")
    both = items.join(mean, key) if key else items.crossJoin(F.broadcast(mean))
    return vectors.scaled(both.withColumn("vec", vectors.shifted("vec", "mean")).drop("mean"))


def mixed(queries: DataFrame, gallery: DataFrame, alpha: float = 0.5, counts: DataFrame | None = None, tau: float = TAU, near: int = NEAR) -> DataFrame:
    """q_id, q_label, label, score: nearest rows' scores and centroids' similarities mixed; a class without a near row has its centroid's."""
    own = similarity.class_scores(near_rows(queries, gallery, near), tau, counts).select("q_id", "label", F.col("score").alias("near"))
    grid = similarity.matches(queries, openset.class_means(gallery), None).select("q_id", "q_label", F.col("g_label").alias("label"), (F.col("sim") / tau).alias("proto"))
    both = grid.join(own, ["q_id", "label"], "left")
    return both.select("q_id", "q_label", "label", (alpha * F.coalesce("near", "proto") + (1 - alpha) * F.col("proto")).alias("score"))


def memory(queries: DataFrame, gallery: DataFrame, centre: bool = False, by_size: bool = False, mix: bool = False) -> DataFrame:
    """q_id, q_label, label, score by the nearest rows: their sums by label, or means of the label's size, or mixed with centroids; centred
    by the gallery's mean first."""
    counts = gallery.groupBy("label").agg(F.count("*").alias("n")) if by_size else None
    q, g = _once("centred", (queries, gallery), lambda: (centred(queries, gallery), centred(gallery, gallery))) if centre else (queries, gallery)
    if mix:
        return mixed(q, g, counts=counts)
    return similarity.class_scores(near_rows(q, g), TAU, counts).select("q_id", "q_label", "label", "score")


def prototypes(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """q_id, q_label, label, score: cosines to the labels' centroids."""
    return similarity.matches(queries, openset.class_means(gallery), None).select("q_id", "q_label", F.col("g_label").alias("label"), F.col("sim").alias("score"))


def _register() -> None:
    for centre in (False, True):
        for kind, more in (("", {}), ("logmeanexp", {"by_size": True}), ("prototype_mix", {"mix": True})):
            name = "_".join(x for x in ("centered" if centre else "", kind) if x) or "raw"
            registry.register_scorer(name, lambda q, g, centre=centre, more=more: memory(q, g, centre, **more), mode=True)
    registry.register_scorer("prototypes", prototypes)
    for name, build in {"A": lambda items: items.withColumn("vec", F.slice("vec", 1, 32)), "B": lambda items: items.withColumn("vec", F.slice("vec", 33, 32)), "Full": lambda items: items}.items():
        registry.register_space(name, build)


_register()
