"""Resampled curves: intervals of ranking metrics without a row for each row and draw.

How often a row counts in a draw is a Poisson number of mean one that a hash of draw, class and row decides: what counts of rows drawn with
replacement are, but for their total, which the metrics are divided by. So a row's counts in all draws are known wherever the row is. Rows
are dealt into ranges of scores; each range adds up its counts for every draw, a sum over ranges tells what stands above each, and each range
then gives its share of every draw's curve. What moves is each row once, and a number for each range and draw.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .metrics import in_ranges

#: Rows whose counts in all draws are in memory at a time, and rows of a range, about.
CHUNK, RANGE_ROWS = 1024, 1_000_000
_LOW = np.uint64(0xFFFFFFFF)
#: A uniform number of 32 bits at or above the k-th of these counts k + 1 times or more.
STEPS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: The multiplier of the hash's rounds.
ROUND = 73_244_475


def _round(x: np.ndarray) -> np.ndarray:
    x = ((x >> np.uint64(16)) ^ x) * np.uint64(ROUND) & _LOW
    x = ((x >> np.uint64(16)) ^ x) * np.uint64(ROUND) & _LOW
    return (x >> np.uint64(16)) ^ x


def counts(ids: np.ndarray, positive: np.ndarray, draws: int, seed: int = 42) -> np.ndarray:
    """How often each row, by its id and class, counts in each draw: rows by draws."""
    b = np.arange(draws, dtype=np.uint64)
    own = ids.astype(np.int64).view(np.uint64)
    row = _round(_round(own & _LOW) + (own >> np.uint64(32)) & _LOW)
    out = np.zeros((len(ids), draws), np.int64)
    for side in (0, 1):
        at = np.flatnonzero(positive == side)
        draw = _round(_round(np.array([2 * seed + side], np.uint64)) + b & _LOW)
        out[at] = np.searchsorted(np.array(STEPS, np.uint64), _round(row[at][:, None] + draw[None, :] & _LOW), side="right")
    return out


def sql_counts(rows: str, columns: str, draws: int, name: str = "z", seed: int = 42) -> str:
    """CTE `name`: columns, pos, score, b, w of rows (columns, q_id, pos, score), w as `counts` has it and not 0."""
    half = lambda x, y: f"xor({x} >> 16, {x}) * {ROUND} & 4294967295 AS {y}"
    f = lambda x, y: f"{half(x, y + 'a')}, {half(y + 'a', y + 'b')}, xor({y}b >> 16, {y}b) AS {y}"
    rows_ = f"SELECT *, q_id & 4294967295 AS r0, {f('r0', 'r1')}, (r1 + ((q_id >> 32) & 4294967295)) & 4294967295 AS r2, {f('r2', 'r3')} FROM {rows}"
    draws_ = f"SELECT side, b, {2 * seed}::BIGINT + side AS d0, {f('d0', 'd1')}, (d1 + b) & 4294967295 AS d2, {f('d2', 'd3')} FROM (SELECT unnest([0, 1]::BIGINT[]) AS side), (SELECT unnest(range({draws})) AS b)"
    w = " + ".join(f"(u >= {t})::INT" for t in STEPS)
    return f"""{name}r AS ({rows_}), {name}d AS ({draws_}), {name}w AS (SELECT {columns}, pos, score, b, (r3 + d3) & 4294967295 AS u0, {f('u0', 'u')} FROM {name}r JOIN {name}d ON side = pos), {name} AS (SELECT {columns}, pos, score, b, {w} AS w FROM {name}w WHERE u >= {STEPS[0]})"""


def _steps(score: np.ndarray, ids: np.ndarray, positive: np.ndarray, draws: int, seed: int):
    """pos, neg of distinct scores by draws, highest first, a bounded number of rows at a time. One score's rows may come in several parts;
    `whole` tells of the last of a part whether its score is done."""
    order = np.lexsort((ids, -score))
    score, ids, positive = score[order], ids[order], positive[order]
    for k in range(0, len(score), CHUNK):
        part = slice(k, k + CHUNK)
        first = np.flatnonzero(np.r_[True, score[part][1:] != score[part][:-1]])
        w = counts(ids[part], positive[part], draws, seed)
        side = (positive[part] == 1)[:, None]
        end = k + len(w)
        yield np.add.reduceat(w * side, first, axis=0), np.add.reduceat(w * ~side, first, axis=0), end == len(score) or score[end] != score[end - 1]


def _arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _lists(*rows: np.ndarray) -> list[pa.Array]:
    return [pa.array([r.tolist()], pa.list_(pa.from_numpy_dtype(r.dtype))) for r in rows]


def curves(scores: DataFrame, by: list[str], draws: int, seed: int = 42) -> DataFrame:
    """by, b, auroc, fpr, aupr of each draw b from 0. scores: by, q_id long, pos (0 or 1), score; rows with a null are left out.

    A metric is null in a draw that has no row of a class. Known and novel rows are drawn apart; rows of one q_id and class are drawn alike
    in all groups, so that differences between groups are paired. No window stands over rows, and no row is repeated for a draw.
    """
    kinds = dict(scores.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    rows = scores.select(*by, F.col("q_id").cast("long").alias("q_id"), F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score")).dropna()
    rows = staged(in_ranges(staged(rows, "scores"), by, "score", RANGE_ROWS), "ranges")  # what the scores come from runs once
    parts = rows.groupBy(*by, "range")

    def total(key, table):
        ids, pos = _arrays(table, "q_id", "pos")
        sums = np.zeros((2, draws), np.int64)
        for k in range(0, len(ids), CHUNK):
            w, side = counts(ids[k : k + CHUNK], pos[k : k + CHUNK], draws, seed), pos[k : k + CHUNK] == 1
            sums += [w[side].sum(axis=0), w[~side].sum(axis=0)]
        return pa.Table.from_arrays([*(pa.array([x.as_py()], t) for x, t in zip(key, _types(table, [*by, "range"]))), *_lists(*sums)], [*by, "range", "p", "n"])

    def above(key, table):
        order = np.argsort(-table.column("range").to_numpy(), kind="stable")
        p, n = (np.array(table.column(c).to_pylist())[order] for c in ("p", "n"))
        names = ["range", "p", "n", "all_p", "all_n"]
        columns = [table.column("range").take(pa.array(order)), *(pa.array(list(x), pa.list_(pa.int64())) for x in (np.cumsum(p, axis=0) - p, np.cumsum(n, axis=0) - n)), *(pa.array([x.sum(axis=0)] * len(x), pa.list_(pa.int64())) for x in (p, n))]
        return pa.Table.from_arrays([*(table.column(c).take(pa.array(order)) for c in by), *columns], [*by, *names])

    def share(key, table, sums):
        if not table.num_rows:
            return pa.table({**{c: table.column(c) for c in by}, **{c: pa.array([], pa.list_(pa.float64())) for c in ("area", "precision", "first", "p", "n")}})
        tp, fp, p, n = (np.array(sums.column(c)[0].as_py(), float) for c in ("p", "n", "all_p", "all_n"))
        area, precision, first = np.zeros(draws), np.zeros(draws), np.full(draws, np.inf)
        rest = None
        for pos, neg, whole in _steps(*_arrays(table, "score", "q_id", "pos"), draws, seed):
            if rest is not None:
                pos[0], neg[0] = pos[0] + rest[0], neg[0] + rest[1]
            rest = None if whole else (pos[-1], neg[-1])
            if not whole:
                pos, neg = pos[:-1], neg[:-1]
            if len(pos):
                t, f = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
                area += (pos * (n - f + neg / 2)).sum(axis=0)
                precision += (pos * t / np.maximum(t + f, 1)).sum(axis=0)
                first = np.minimum(first, np.where(t >= 0.95 * p, f, np.inf).min(axis=0))
                tp, fp = t[-1], f[-1]
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in by), *_lists(area, precision, first, p, n)], [*by, "area", "precision", "first", "p", "n"])

    def whole(key, table):
        area, precision, first, p, n = (np.array(table.column(c).to_pylist()) for c in ("area", "precision", "first", "p", "n"))
        p, n = p[0], n[0]
        none = (p == 0) | (n == 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = [area.sum(axis=0) / p / n, first.min(axis=0) / n, precision.sum(axis=0) / p]
        group = [table.column(c).take(pa.array(np.zeros(draws, np.int64))) for c in by]
        return pa.Table.from_arrays([*group, pa.array(np.arange(draws)), *(pa.array(x, mask=none) for x in found)], [*by, "b", "auroc", "fpr", "aupr"])

    head = f"{keys}, " if by else ""
    sums = parts.applyInArrow(total, f"{head}range int, p array<long>, n array<long>").groupBy(*by).applyInArrow(above, f"{head}range int, p array<long>, n array<long>, all_p array<long>, all_n array<long>")
    shares = parts.cogroup(sums.groupBy(*by, "range")).applyInArrow(share, head + ", ".join(f"{c} array<double>" for c in ("area", "precision", "first", "p", "n")))
    return shares.groupBy(*by).applyInArrow(whole, f"{head}b long, auroc double, fpr double, aupr double")


def _types(table: pa.Table, names: list[str]) -> list[pa.DataType]:
    return [table.schema.field(c).type for c in names]
