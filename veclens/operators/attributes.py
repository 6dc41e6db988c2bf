"""Matrices of attributes: a row a label, a column an attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uninformative(matrix: DataFrame, attributes: list[str]) -> list[str]:
    """The attributes that are present (1) in none, or in all, of the labels where they are known; one that is never known isn't among them.

    All columns are counted in one aggregate, whose one row has two numbers an attribute, however many labels there are.
    """
    if not attributes:
        return []
    counts = [x for i, c in enumerate(attributes) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.count_if(F.col(f"`{c}`") == 1.0).alias(f"p{i}"))]
    row = matrix.agg(*counts).first()
    return [c for i, c in enumerate(attributes) if row[f"n{i}"] and row[f"p{i}"] in (0, row[f"n{i}"])]


def informative(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """matrix without its uninformative columns; `keys` aren't attributes and stay."""
    drop = set(uninformative(matrix, [c for c in matrix.columns if c not in keys]))
    return matrix.select(*(F.col(f"`{c}`") for c in matrix.columns if c not in drop))
