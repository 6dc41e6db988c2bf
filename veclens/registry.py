"""Scorers and spaces by name: what protocols run over, and where a user adds more.

A scorer is a function of queries and gallery (item_id, label, vec each) that returns q_id, q_label, label, score: a score for each query and
label that it considers, the greatest is its prediction. A space is a function of the items (item_id, label, vec) that returns them with the
space's own vec, or a table of them; it names the scorer that `headline` and the ablations give its measures by. Protocols read both when a
query is called, so what is registered before takes part in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame, DataFrame], DataFrame]
#: The scorer that needs no table of scores: the label of the nearest row.
NEAREST = "nearest"
SCORE_COLUMNS = ("q_id", "q_label", "label", "score")


@dataclass(frozen=True)
class Space:
    build: Callable[[DataFrame], DataFrame]
    scorer: str = NEAREST


SPACES: dict[str, Space] = {}
SCORERS: dict[str, Scorer] = {}
#: Names of the scorers that stand side by side in the ablation of memory modes.
MODES: list[str] = []


def register_scorer(name: str, scorer: Scorer, mode: bool = False) -> None:
    """Adds a scorer. mode: it takes part in the ablation of memory modes."""
    if name in SCORERS or name == NEAREST:
        raise ValueError(f"there is a scorer {name!r}")
    SCORERS[name] = scorer
    if mode:
        MODES.append(name)


def register_space(name: str, space: Callable[[DataFrame], DataFrame] | DataFrame, scorer: str = NEAREST) -> None:
    """Adds a space: a function of the items, or a table of item_id, label, vec."""
    if name in SPACES:
        raise ValueError(f"there is a space {name!r}")
    if scorer != NEAREST and scorer not in SCORERS:
        raise ValueError(f"no scorer {scorer!r}")
    SPACES[name] = Space((lambda items: space) if isinstance(space, DataFrame) else space, scorer)


def remove(name: str) -> None:
    """Takes a space or a scorer out again."""
    if name not in SPACES and name not in SCORERS:
        raise KeyError(name)
    SPACES.pop(name, None)
    if SCORERS.pop(name, None) and name in MODES:
        MODES.remove(name)


@contextmanager
def registered(scorers: dict[str, Scorer] | None = None, spaces: dict[str, tuple] | None = None, modes: bool = False) -> Iterator[None]:
    """Scorers, and spaces with their scorers, that are registered within."""
    done = []
    try:
        for name, scorer in (scorers or {}).items():
            register_scorer(name, scorer, modes)
            done.append(name)
        for name, (space, scorer) in (spaces or {}).items():
            register_space(name, space, scorer)
            done.append(name)
        yield
    finally:
        for name in reversed(done):
            remove(name)


def scored(name: str, queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """q_id, q_label, label, score by a registered scorer; fails where it gives other columns."""
    if name not in SCORERS:
        raise ValueError(f"no scorer {name!r}")
    out = SCORERS[name](queries, gallery)
    if missing := [c for c in SCORE_COLUMNS if c not in out.columns]:
        raise ValueError(f"scorer {name!r} gives no {missing}")
    return out.select(*SCORE_COLUMNS)


def predicted(name: str, queries: DataFrame, gallery: DataFrame, digits: int = 9) -> DataFrame:
    """q_id, q_label, pred by a scorer: the label of the greatest score, to so many digits, ties to the least label."""
    from .operators import similarity

    if name == NEAREST:
        return similarity.nearest(queries, gallery).select("q_id", "q_label", "pred")
    return similarity.best_class(scored(name, queries, gallery).withColumn("score", F.round("score", digits))).select("q_id", "q_label", "pred")
