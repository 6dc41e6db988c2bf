"""Exact similarity joins: a query set against a gallery, in blocks.

Both sides are packed into blocks of bounded rows. A search deals its queries into groups; a group's task has its queries in memory and the
gallery's blocks go past, in matrix products, so that the best rows so far, or the counts of what is nearer, never leave the task. For the
best rows these are of single precision, and of double for the pairs that its error leaves in question, which alone decide. What
is shuffled is the gallery once for each group, of which there are about as many whatever the tables' sizes, and what is found. Neither side
has to fit anywhere whole. Where every pair is asked for, each pair of blocks is a row of its own.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block, about: 4096 vectors of 512 doubles are 16 MB.
BLOCK = 4096


#: Groups that a search's queries are dealt into, about; least and most rows of one, and rows to be kept for all its queries.
GROUPS, LEAST_ROWS, MOST_ROWS, KEPT = 32, 128, 1 << 15, 1 << 22
#: Queries of one matrix product, and gallery rows of one in single precision, so that what it gives stays in a core's cache.
SLICE, TILE = 512, 1024
#: Pairs whose similarities are computed on their own at a time.
APART = 1 << 15
#: Similarities to rows of their own label that a group's task holds at a time, about: 16 bytes each.
HELD = 1 << 23
#: Numbers of the vectors of other labels, and similarities to them, that are counted at a time.
ACROSS, SEEN = 1 << 22, 1 << 21
#: Bins of the labels that have few queries each.
BINS = 16

#: Rows of a query block, and copies of the gallery that let one of its blocks meet query blocks in several tasks, at most.
QUERY_BLOCK, COPIES = 1024, 32


def sizes(*tables: DataFrame) -> list[int]:
    """How many rows each table has, counted in one job."""
    marked = [t.select(F.lit(i).alias("t")) for i, t in enumerate(tables)]
    found = {r.t: r["count"] for r in reduce(DataFrame.unionByName, marked).groupBy("t").count().collect()}
    return [found.get(i, 0) for i in range(len(tables))]


def _parts(size: int, block: int) -> int:
    return max(1, -(-size // block))


def _blocks(df: DataFrame, key: str, parts: Column, *more: str, within: str | None = None) -> DataFrame:
    """within, key, key_rows: the rows in `parts` blocks, as many for each value of `within`."""
    own = df.withColumn(key, F.pmod(F.xxhash64("item_id", *more), parts).cast("int"))
    by = [within, key] if within else [key]
    return own.groupBy(*by).agg(F.collect_list(F.struct("item_id", "label", "vec", *more)).alias(f"{key}_rows"), *([F.max(f"{within}_parts").alias(f"{within}_parts")] if within else []))


def _pairs(queries: DataFrame, gallery: DataFrame, block: int, q_more: tuple[str, ...] = (), g_more: tuple[str, ...] = (), counts: list[int] | None = None) -> DataFrame:
    """qb, qb_rows, gb, gb_rows of every pair of blocks, dealt out by both: no gallery block meets all queries in one task."""
    n_q, n_g = counts or sizes(queries, gallery)
    q_parts, parts = _parts(n_q, min(block, QUERY_BLOCK)), _parts(n_g, block)
    q, g = _blocks(queries, "qb", F.lit(q_parts), *q_more), _blocks(gallery, "gb", F.lit(parts), *g_more)
    copies = min(q_parts, COPIES)
    g = g.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return q.withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("copy", F.col("qb") % copies).join(g, ["gb", "copy"]).select("qb", "qb_rows", "gb", "gb_rows")


def _pairs_within(queries: DataFrame, gallery: DataFrame, within: str, block: int) -> DataFrame:
    """within, qb_rows, gb_rows of every pair of blocks that have the same value of `within`: no other pair is built or moved.

    A value has as many blocks as its rows need on either side, so a value with a third of all rows is cut like a table of its own; the
    counts are joined in Spark, a row a value. Rows whose value is null or stands on one side only are in no pair.
    """
    of = lambda df, size, name: df.groupBy(within).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias(name))
    parts = of(queries, min(block, QUERY_BLOCK), "q_parts").join(of(gallery, block, "g_parts"), within)
    cut = lambda df, key, n, other: _blocks(df.join(parts.select(within, F.col(n).alias("n"), F.col(other).alias(f"{within}_parts")), within), key, F.col("n"), within=within)
    q, g = cut(queries, "qb", "q_parts", "g_parts"), cut(gallery, "gb", "g_parts", "q_parts")
    copies = F.least(F.col(f"{within}_parts"), F.lit(COPIES))
    g = g.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop(f"{within}_parts")
    q = q.withColumn("gb", F.explode(F.sequence(F.lit(0), F.col(f"{within}_parts") - 1))).drop(f"{within}_parts")
    q = q.join(parts.select(within, F.least("q_parts", F.lit(COPIES)).alias("deal")), within).withColumn("copy", F.col("qb") % F.col("deal"))
    return q.join(g, [within, "gb", "copy"]).select(within, "qb_rows", "gb_rows")


def _rows(column: pa.Array, i: int, raw: bool, *more: str):
    """ids, labels, vectors and further fields of a block, in order of ids."""
    part = column.slice(i, 1).flatten()
    fields = {n: part.field(n) for n in ("item_id", "label", "vec", *more)}
    x = fields["vec"].flatten().to_numpy().reshape(len(part), -1)
    ids = fields["item_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x = x[order] if raw else x[order] / np.maximum(np.linalg.norm(x[order], axis=1, keepdims=True), 1e-12)
    return ids[order], fields["label"].take(pa.array(order)), x, *(fields[n].take(pa.array(order)) for n in more)


def _best(sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's `keep` greatest values, equal ones from the left."""
    if keep < sims.shape[1]:
        least = np.partition(sims, sims.shape[1] - keep, axis=1)[:, sims.shape[1] - keep]
        own, at = np.nonzero(sims >= least[:, None])
    else:
        own, at = np.divmod(np.arange(sims.size), sims.shape[1])
    order = np.lexsort((at, -sims[own, at], own))
    own, at = own[order], at[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return own[place < keep], at[place < keep]


def _group_rows(total: Column, m: int = 1) -> Column:
    """Rows of a group of queries, given how many queries there are and how many rows are kept for each."""
    return F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), F.lit(KEPT // m), F.ceil(total / GROUPS)))


def _packed(df: DataFrame, key: str, parts: Column, by: list[str]) -> DataFrame:
    """by, key, rows: the rows of each value of `by` in `parts` blocks."""
    own = df.withColumn(key, F.pmod(F.xxhash64("item_id", F.lit(1)), parts).cast("int"))
    return own.groupBy(*by, key).agg(F.collect_list(F.struct("item_id", "label", "vec")).alias("rows"))


def _passing(asked: DataFrame, held: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, asked, order, rows: blocks of each group's queries, then those of the gallery that its task is to see, in order."""
    names = [*keys, "asked", *order, "rows"]
    kinds = dict(held.dtypes)
    q = asked.withColumn("asked", F.lit(True)).withColumns({c: F.lit(None).cast(kinds[c]) for c in order})
    both = q.select(*names).unionByName(held.withColumn("asked", F.lit(False)).select(*names))
    return both.repartition(*keys).sortWithinPartitions(*keys, F.desc("asked"), *order)


def _finite(block: tuple, *more: np.ndarray) -> tuple:
    """ids, labels, vectors of a block without the rows whose vector isn't finite: they are like nothing."""
    ids, labels, x = block
    ok = np.isfinite(x).all(axis=1)
    return block if ok.all() else (ids[ok], labels.filter(pa.array(ok)), x[ok])


class _Best:
    """The m best gallery rows so far of n queries, best first: similarity, id and the label's place in `labels`."""

    def __init__(self, n: int, m: int):
        self.m, self.sim = m, np.full((n, m), -np.inf)
        self.id, self.label = np.zeros((n, m), np.int64), np.full((n, m), -1, np.int32)
        self.labels: dict = {}

    def codes(self, labels: pa.Array) -> np.ndarray:
        """Places of a block's labels, -1 for null."""
        coded = labels.dictionary_encode()
        place = np.array([*(self.labels.setdefault(x, len(self.labels)) for x in coded.dictionary.to_pylist()), -1], np.int32)
        return place[coded.indices.fill_null(-1).to_numpy()]

    def add(self, k: int, sims: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> None:
        """Queries from the k-th on against a block, whose ids are in order."""
        width, m = sims.shape[1], self.m
        if not width:
            return
        least = self.sim[k : k + len(sims), -1]
        own, at = np.divmod(np.flatnonzero(sims >= least[:, None]), width)
        if len(own) > 4 * m * len(sims) or not np.isfinite(least).all():
            own, at = _best(sims, min(m, width))
        if not len(own):
            return
        self.merge(k, own, sims[own, at], ids[at], codes[at])

    def merge(self, k: int, own: np.ndarray, sim: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> None:
        """Pairs of queries, counted from the k-th, in order, with rows that may be among their best."""
        rows, m = own[np.flatnonzero(np.r_[True, own[1:] != own[:-1]])], self.m
        s, g, c = (np.concatenate([x[k + rows].ravel(), y]) for x, y in ((self.sim, sim), (self.id, ids), (self.label, codes)))
        row = np.concatenate([np.repeat(rows, m), own])
        order = np.lexsort((g, -s, row))
        first = np.searchsorted(row[order], rows)
        order = order[first[:, None] + np.arange(m)]
        self.sim[k + rows], self.id[k + rows], self.label[k + rows] = s[order], g[order], c[order]


def _slack(x: np.ndarray) -> float:
    """Twice what a product of unit vectors of this precision can be wrong by, in whatever order its terms are added."""
    return (x.shape[1] + 4) * float(np.finfo(x.dtype).eps)


def _close(x: np.ndarray, y: np.ndarray, least: np.ndarray, m: int, mine: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column, in order of rows, of all pairs of unit vectors that can be among a row's m best, given its m-th best so far (-inf:
    fewer were seen). mine: row, first and last column of pairs that don't count."""
    sims, slack = x @ y.T, _slack(x)
    for r, first, last in mine:
        sims[r, first:last] = -np.inf
    floor = (least - slack).astype(sims.dtype)
    if (new := np.isneginf(least)).any() and m < len(y):
        floor[new] = np.partition(sims[new], len(y) - m, axis=1)[:, len(y) - m] - sims.dtype.type(2 * slack)
    rows = np.flatnonzero(sims.max(axis=1) >= floor)
    some = sims[rows]
    own, at = np.nonzero((some >= floor[rows, None]) & np.isfinite(some))
    return rows[own], at


def _products(x: np.ndarray, y: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Products of pairs of rows in double precision: equal for equal vectors, wherever they stand."""
    parts = [slice(i, i + APART) for i in range(0, len(own), APART)]
    return np.concatenate([np.einsum("ij,ij->i", x[own[p]], y[at[p]]) for p in parts]) if parts else np.zeros(0)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """key, batch, row of each block, blocks of a group in a row; the key is a tuple of Python values."""
    for batch in batches:
        key = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
        for i in range(batch.num_rows):
            yield key[i], batch, i


def matches(queries: DataFrame, gallery: DataFrame, m: int | None = 1, skip_self: bool = False, block: int = BLOCK, raw: bool = False, by: str | None = None, within: str | None = None) -> DataFrame:
    """q_id, q_label, g_id, g_label, sim, rank: the m nearest gallery rows of each query by cosine, ties by item_id; all of them for None.

    queries, gallery: item_id, label, vec array<double>. skip_self: a query isn't its own neighbour. raw: dot products instead. by: a
    column of the gallery; each of its values is a gallery of its own, and comes along. within: a column of both sides; a query is
    searched for among rows of its own value only, which comes along, and blocks of different values never meet. Not both. Vectors that
    aren't finite are near nothing.
    """
    if by and within:
        raise ValueError("either galleries of their own or a search within a key")
    if m is None:
        return _all_pairs(queries, gallery, skip_self, block, raw, by, within)
    kinds, ends, key = dict(queries.dtypes), ["item_id", "label", "vec"], by or within
    extra = f", `{key}` {dict(gallery.dtypes)[key]}" if key else ""
    own = [F.col(key).alias("key")] if key else []
    g = gallery.select(*(F.col(c).cast(kinds[c]).alias(c) if c != "vec" else F.col(c) for c in ends), *own)
    q = queries.select(*ends, *(own if within else []))
    if within:
        n_q, n_g = (df.groupBy("key").agg(F.count("*").alias(name)) for df, name in ((q, "n_q"), (g, "n_g")))
        rows = _group_rows(F.sum("n_q").over(Window.partitionBy(F.lit(0))), m)  # a row a value
        parts = n_q.join(n_g, "key").withColumn("rows", rows).select("key", F.ceil(F.col("n_q") / F.col("rows")).cast("int").alias("q_parts"), F.ceil(F.col("n_g") / block).cast("int").alias("g_parts"))
        q, g = q.join(parts, "key"), g.join(parts, "key")
        q_parts, g_parts, keys, kept = F.col("q_parts"), F.col("g_parts"), ["key", "group"], ["key", "q_parts"]
    else:
        counts = sizes(queries, gallery)
        q_parts, g_parts, keys, kept = F.lit(_parts(counts[0], _rows_of(counts[0], m))), F.lit(_parts(counts[1], block)), ["group"], []
        if by:
            g = g.join(g.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("g_parts")), "key")
            g_parts, kept = F.col("g_parts"), ["key"]
    asked = _packed(q.withColumn("group", F.pmod(F.xxhash64("item_id"), q_parts).cast("int")), "part", F.lit(MOST_ROWS // BLOCK), keys)
    held = _packed(g, "part", g_parts, kept).withColumn("group", F.explode(F.sequence(F.lit(0), q_parts - 1)))
    order = ["key"] if by else []
    names = ["q_id", "q_label", "g_id", "g_label", "sim", "rank", *([key] if key else [])]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value, blocks, best, qi, ql, qx, q_low = None, None, [], None, None, None, None, None

        def out(mark: pa.Array | None) -> Iterator[pa.RecordBatch]:
            """What was found for the group's queries; rows that share a query's id share its m best."""
            whole = len(qi) > 1 and bool((qi[1:] == qi[:-1]).any())
            for k in [0] if whole else range(0, len(qi), max(1, (1 << 18) // m)):
                part = slice(k, None if whole else k + max(1, (1 << 18) // m))
                own, at = np.nonzero(np.isfinite(best.sim[part]))
                s, g, c, rank = best.sim[part][own, at], best.id[part][own, at], best.label[part][own, at], at + 1
                own = own + k
                if whole:
                    order = np.lexsort((g, -s, qi[own]))
                    own, s, g, c = own[order], s[order], g[order], c[order]
                    rank = np.arange(len(own)) - np.searchsorted(qi[own], qi[own]) + 1
                    ok = rank <= m
                    own, s, g, c, rank = own[ok], s[ok], g[ok], c[ok], rank[ok]
                found = pa.array(list(best.labels), ql.type).take(pa.array(c, mask=c < 0))
                columns = [pa.array(qi[own]), ql.take(pa.array(own)), pa.array(g.astype(qi.dtype)), found, pa.array(s), pa.array(rank.astype(np.int32))]
                if mark is not None:
                    columns.append(mark.take(pa.array(np.zeros(len(own), np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)

        mark = None
        for of, batch, i in _groups(batches, keys):
            if of != now:
                if best is not None:
                    yield from out(mark)
                now, blocks, best = of, [], None
            if batch.column("asked")[i].as_py():
                blocks.append(_finite(_rows(batch.column("rows"), i, raw)))
                continue
            if not blocks:
                continue
            kind = batch.column("key")[i].as_py() if by else None
            if best is None:
                ids, labels, x = (list(c) for c in zip(*blocks, strict=True))
                qi, ql, qx = np.concatenate(ids), pa.concat_arrays(labels), np.concatenate(x)
                line = np.argsort(qi, kind="stable")
                qi, ql, qx = qi[line], ql.take(pa.array(line)), qx[line]
                q_low = None if raw else qx.astype(np.float32)
            elif kind != value:
                yield from out(mark)
                best = None
            if best is None:
                best, value = _Best(len(qi), m), kind
                mark = batch.column("key").slice(i, 1) if "key" in batch.schema.names else None
            gi, gl, gx = _finite(_rows(batch.column("rows"), i, raw))
            codes = best.codes(gl)
            low = None if raw else gx.astype(np.float32)
            width = block if raw else TILE
            for k, c in ((k, c) for k in range(0, len(qi), SLICE) for c in range(0, len(gi), width)):
                ids, mine = gi[c : c + width], []
                if skip_self:
                    first, last = (np.searchsorted(ids, qi[k : k + SLICE], side=side) for side in ("left", "right"))
                    mine = [(r, first[r], last[r]) for r in np.flatnonzero(first < last)]
                x, y = qx[k : k + SLICE], gx[c : c + width]
                if raw:
                    sims = x @ y.T
                    for r, a, b in mine:
                        sims[r, a:b] = -np.inf
                    best.add(k, sims, ids, codes[c : c + width])
                    continue
                least = best.sim[k : k + SLICE, -1]
                own, at = _close(q_low[k : k + SLICE], low[c : c + width], least, m, mine)
                if len(own) > len(x) * len(y) // 16:  # too many near copies for single precision
                    own, at = _close(x, y, least, m, mine)
                if len(own):
                    best.merge(k, own, _products(x, y, own, at), ids[at], codes[c + at])
        if best is not None:
            yield from out(mark)

    return _passing(asked, held, keys, order).mapInArrow(search, f"q_id {kinds['item_id']}, q_label {kinds['label']}, g_id {kinds['item_id']}, g_label {kinds['label']}, sim double, rank int{extra}").select(*names[:5], *names[6:], "rank")


def _rows_of(total: int, m: int = 1) -> int:
    """`_group_rows` of a number that the driver knows."""
    return max(LEAST_ROWS, min(MOST_ROWS, KEPT // m, _parts(total, GROUPS)))


def _all_pairs(queries: DataFrame, gallery: DataFrame, skip_self: bool, block: int, raw: bool, by: str | None, within: str | None) -> DataFrame:
    """What `matches` has for no m: every pair, of which there are as many as rows on either side allow."""
    more = [by] if by else []
    pairs = _pairs_within(queries, gallery, within, block) if within else _pairs(queries, gallery, block, (), tuple(more))
    names = ["q_id", "q_label", "g_id", "g_label", "sim", *more, *([within] if within else [])]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qi, ql, qx = _rows(batch.column("qb_rows"), i, raw)
                gi, gl, gx, *kind = _rows(batch.column("gb_rows"), i, raw, *more)
                if kind:
                    values, which = np.unique(kind[0].to_numpy(zero_copy_only=False), return_inverse=True)
                    groups = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])
                else:
                    groups = [np.arange(len(gi))]
                for k in range(0, len(qi), 512):
                    whole = qx[k : k + 512] @ gx.T
                    if skip_self:
                        whole[qi[k : k + 512][:, None] == gi[None, :]] = -np.inf
                    for group in groups:
                        sims = whole[:, group] if kind else whole
                        own, at = _best(sims, len(group))
                        s = sims[own, at]
                        ok = np.isfinite(s)
                        own, there, s = own[ok] + k, group[at[ok]], s[ok]
                        columns = [pa.array(qi[own]), ql.take(pa.array(own)), pa.array(gi[there]), gl.take(pa.array(there)), pa.array(s), *(x.take(pa.array(there)) for x in kind)]
                        if within:
                            columns.append(batch.column(within).take(pa.array(np.full(len(own), i))))
                        yield pa.RecordBatch.from_arrays(columns, names)

    kinds = dict(queries.dtypes)
    key = by or within
    extra = f", `{key}` {dict(gallery.dtypes)[key]}" if key else ""
    found = pairs.select("qb_rows", "gb_rows", *([within] if within else [])).mapInArrow(compare, f"q_id {kinds['item_id']}, q_label {kinds['label']}, g_id {kinds['item_id']}, g_label {kinds['label']}, sim double{extra}")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id", *([key] if key else [])).orderBy(F.desc("sim"), "g_id")))
    return found


#: Relevant similarities that a row of a second pass holds, about.
BUNDLE = 1 << 20


def _nearer(row: np.ndarray, gi: np.ndarray, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How many of a query's rows (row, of ids gi in order) stand before each of its relevant ones (s, of ids g): those of greater
    similarity, and of equal ones those of smaller ids. A row never stands before itself."""
    line = np.sort(row)
    above = np.searchsorted(line, s, side="right")
    count = len(line) - above
    for t in np.flatnonzero(above > np.searchsorted(line, s, side="left")):
        count[t] += np.count_nonzero((row == s[t]) & (gi < g[t]))
    at = np.minimum(np.searchsorted(gi, g), len(gi) - 1)
    return count - ((gi[at] == g) & (row[at] > s))


def _alike(ql: pa.Array, gl: pa.Array) -> np.ndarray:
    """Which query, by row, and which gallery row, by column, have one label; null is like nothing."""
    codes = pa.concat_arrays([ql, gl]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    q, g = codes[: len(ql)], codes[len(ql) :]
    return (q[:, None] == g[None, :]) & (q[:, None] >= 0)


def _relevant(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
    """Of the blocks in a row, 512 queries at a time: their first place, the relevant pairs' places in queries and gallery, all similarities,
    and both blocks' ids."""
    (qi, ql, qx), (gi, gl, gx) = (_rows(batch.column(c), i, False) for c in ("qb_rows", "gb_rows"))
    same = _alike(ql, gl)
    for k in range(0, len(qi), 512):
        yield k, *np.nonzero(same[k : k + 512]), qx[k : k + 512] @ gx.T, qi, gi


def bundles(queries: DataFrame, gallery: DataFrame, block: int = BLOCK, bundle: int = BUNDLE, counts: list[int] | None = None) -> DataFrame:
    """qb, bundle, own: the relevant pairs (q_id, g_id, sim) of each query block, in as many rows as its labels need for about `bundle` pairs
    each. What two blocks have in common stays together, so a row has no more than that beyond its share."""
    counts = counts or sizes(queries, gallery)
    kind = dict(queries.dtypes)["item_id"]
    qb = F.pmod(F.xxhash64("item_id"), F.lit(_parts(counts[0], min(block, QUERY_BLOCK)))).cast("int").alias("qb")
    of_label = gallery.groupBy("label").agg(F.count("*").alias("n"))
    many = queries.join(of_label, "label").groupBy(qb).agg(F.ceil(F.sum("n") / bundle).cast("int").alias("bundles"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for k, a, b, sims, qi, gi in _relevant(batch, i):
                    if len(a):
                        found = pa.StructArray.from_arrays([pa.array(qi[k + a]), pa.array(gi[b]), pa.array(sims[a, b])], ["q_id", "g_id", "sim"])
                        yield pa.RecordBatch.from_arrays([batch.column("qb").slice(i, 1), batch.column("gb").slice(i, 1), pa.ListArray.from_arrays(np.array([0, len(a)], np.int32), found)], ["qb", "gb", "own"])

    found = _pairs(queries, gallery, block, counts=counts).mapInArrow(alike, f"qb int, gb int, own array<struct<q_id:{kind},g_id:{kind},sim:double>>")
    return found.join(many, "qb").withColumn("bundle", F.col("gb") % F.col("bundles")).groupBy("qb", "bundle").agg(F.flatten(F.collect_list("own")).alias("own"))


def relevant_ranks(queries: DataFrame, gallery: DataFrame, block: int = BLOCK, bundle: int = BUNDLE) -> DataFrame:
    """q_id, q_label, g_id, rank, gallery: where each gallery row of a query's own label stands in the query's full ranking; a row with null
    g_id and rank for a query whose label the gallery doesn't have.

    Against a gallery of one block the ranks come from one pass. Else a first pass over the pairs of blocks finds the similarities of the
    relevant rows and keeps those of a pair together; a query block's are put in as many bundles as its labels' rows need for about
    `bundle` similarities each, so that a label with a third of the gallery makes more bundles, not larger ones. A second pass counts, for
    each bundle and gallery block, what is nearer; the counts are added up.
    """
    kinds = dict(queries.dtypes)
    own = f"q_id {kinds['item_id']}, g_id {kinds['item_id']}"
    counts = sizes(queries, gallery)
    asked = queries.select(F.col("item_id").alias("q_id"), F.col("label").alias("q_label"))
    done = lambda ranks: asked.join(ranks, "q_id", "left").withColumn("gallery", F.lit(counts[1]).cast("long"))

    if _parts(counts[1], block) == 1:

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    for k, a, b, sims, qi, gi in _relevant(batch, i):
                        ends = np.searchsorted(a, np.arange(len(sims) + 1))
                        rank = [_nearer(row, gi, row[b[x:y]], gi[b[x:y]]) + 1 for row, x, y in zip(sims, ends[:-1], ends[1:], strict=True) if x < y]
                        yield pa.RecordBatch.from_arrays([pa.array(qi[k + a]), pa.array(gi[b]), pa.array(np.concatenate([np.zeros(0, np.int64), *rank]))], ["q_id", "g_id", "rank"])

        return done(_pairs(queries, gallery, block, counts=counts).mapInArrow(ranked, f"{own}, rank long"))

    q_parts = _parts(counts[0], min(block, QUERY_BLOCK))
    rows = bundles(queries, gallery, block, bundle, counts).join(_blocks(queries, "qb", F.lit(q_parts)), "qb").withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(_parts(counts[1], block) - 1))))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple] = {}

        def out():
            for q, g, n in sums.values():
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(g), pa.array(n)], ["q_id", "g_id", "n"])
            sums.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                (qi, _, qx), (gi, _, gx) = (_rows(batch.column(c), i, False) for c in ("qb_rows", "gb_rows"))
                part = batch.column("own").slice(i, 1).flatten()
                q, g, s = (part.field(n).to_numpy(zero_copy_only=False) for n in ("q_id", "g_id", "sim"))
                order = np.lexsort((g, q))
                q, g, s = q[order], g[order], s[order]
                first, last, n = np.searchsorted(q, qi), np.searchsorted(q, qi, side="right"), np.zeros(len(q), np.int64)
                for k in range(0, len(qi), 512):
                    if (first[k : k + 512] < last[k : k + 512]).any():
                        for row, x, y in zip(qx[k : k + 512] @ gx.T, first[k:], last[k:]):
                            n[x:y] = _nearer(row, gi, s[x:y], g[x:y]) if x < y else 0
                key = (batch.column("qb")[i].as_py(), batch.column("bundle")[i].as_py())
                if key in sums:
                    sums[key][2][:] += n
                else:
                    sums[key] = (q, g, n)
                if sum(len(x[1]) for x in sums.values()) > 4 * bundle:
                    yield from out()
        yield from out()

    copies = min(q_parts, COPIES)
    g = _blocks(gallery, "gb", F.lit(_parts(counts[1], block))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    counted = rows.withColumn("copy", F.col("qb") % copies).join(g, ["gb", "copy"]).select("qb", "bundle", "qb_rows", "own", "gb_rows").mapInArrow(ahead, f"{own}, n long")
    return done(counted.groupBy("q_id", "g_id").agg((F.sum("n") + 1).alias("rank")))


def relevant_quality(queries: DataFrame, gallery: DataFrame, depth: int | None = None, block: int = BLOCK, held: int = HELD, bins: int = BINS) -> DataFrame:
    """q_id, q_label, ap, first_rank, within5, gallery: of each query the mean precision at its relevant rows, the first one's rank, and how
    many stand in the first five, all over the query's full ranking; ap and first_rank are null where nothing is relevant. depth: so many of
    the nearest relevant rows are ranked, at least five; ap is null then.

    Queries are dealt into groups of one label, labels of few queries into `bins`. A group's task sees the gallery's rows of these labels
    first and keeps each query's relevant similarities in order, about `held` of them; of all other rows, block by block, it counts only
    between which two of these each one stands. So no pair is shuffled. Where a group has more similarities than `held`, its queries go by
    in parts, and the other rows, which came once, are read for each part from a temporary file of the task: a label of many rows makes
    neither more groups, for each of which the gallery is shuffled, nor a task that holds more.
    """
    if depth is not None and depth < 5:
        raise ValueError("the first five have to be ranked")
    kinds, ends, kept = dict(queries.dtypes), ["item_id", "label", "vec"], ["own", "bin"]
    counts = sizes(queries, gallery)
    most = _rows_of(counts[0])
    q, g = queries.select(*ends), gallery.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ends))
    n_q, n_g = (df.where("label is not null").groupBy("label").agg(F.count("*").alias(name)) for df, name in ((q, "n_q"), (g, "n_g")))
    alone = F.coalesce(F.col("n_q"), F.lit(0)) * 4 >= most
    both = n_g.join(n_q, "label", "left").withColumns({"own": F.when(alone, F.col("label")), "bin": F.when(alone, F.lit(-1)).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins))).cast("int")})
    whole = Window.partitionBy(*kept)  # a row a label
    parts = both.select("label", *kept, F.col("n_q").isNotNull().alias("asked_for"), F.ceil(F.sum("n_q").over(whole) / most).cast("int").alias("q_parts"), F.ceil(F.sum("n_g").over(whole) / block).cast("int").alias("g_parts"))
    asked = q.join(parts, "label").withColumn("group", F.pmod(F.xxhash64("item_id"), F.col("q_parts")).cast("int"))
    asked = _packed(asked, "part", F.lit(MOST_ROWS // BLOCK), [*kept, "group"]).withColumnsRenamed({"own": "of", "bin": "of_bin"})
    blocks = g.join(parts, "label", "left").withColumns({"bin": F.coalesce("bin", F.lit(-2)), "g_parts": F.coalesce("g_parts", F.lit(_parts(counts[1], block)))})
    blocks = _packed(blocks, "part", F.col("g_parts"), kept)
    groups = parts.where("asked_for").select(F.col("own").alias("of"), F.col("bin").alias("of_bin"), "q_parts").distinct().withColumn("group", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    passing = blocks.crossJoin(F.broadcast(groups)).withColumn("other", ~(F.col("own").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("of_bin"))))  # a row a group
    keys, names = ["of", "of_bin", "group"], ["q_id", "q_label", "ap", "first_rank", "within5"]

    def ranked(qi: np.ndarray, ql: pa.Array, qx: np.ndarray, blocks: Iterator[tuple], near: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A group's queries, in order of labels: `near`, the blocks that have rows of their labels, then the other blocks."""
        coded = pa.concat_arrays([ql, *(gl for _, gl, _ in near)]).dictionary_encode().indices.fill_null(-1).to_numpy()
        mine, theirs = coded[: len(qi)], np.split(coded[len(qi) :], np.cumsum([len(gi) for gi, _, _ in near])[:-1])
        edges = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1], True])
        segments = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = [np.flatnonzero(c == mine[a]) for c in theirs]
            gi, gx = np.concatenate([x[0][i] for x, i in zip(near, at, strict=True)]), np.concatenate([x[2][i] for x, i in zip(near, at, strict=True)])
            if depth:
                best, down = _Best(b - a, depth), np.argsort(gi, kind="stable")
                for j in range(0, len(gi), block):
                    part = down[j : j + block]
                    for k in range(a, b, SLICE):
                        best.add(k - a, qx[k : min(b, k + SLICE)] @ gx[part].T, gi[part], np.zeros(len(part), np.int32))
                line, ids, at = best.sim[:, ::-1].copy(), best.id[:, ::-1].copy(), None
            else:
                down = np.argsort(-gi, kind="stable")
                ids, gx, line, at = gi[down], gx[down], np.empty((b - a, len(gi))), np.empty((b - a, len(gi)), np.int32)
                for k in range(a, b, 64):
                    sims = qx[k : min(b, k + 64)] @ gx.T
                    at[k - a : k - a + 64] = np.argsort(sims, axis=1, kind="stable")  # of equal ones the greater id first
                    line[k - a : k - a + 64] = np.take_along_axis(sims, at[k - a : k - a + 64], axis=1)
            segments.append((a, line, at, ids, np.zeros((b - a, line.shape[1] + 1), np.int64 if depth else np.int32)))
        of = [(x, r) for x in segments for r in range(len(x[1]))]
        least = np.array([x[1][r, 0] if x[1].shape[1] else np.inf for x, r in of])

        def count(gi: np.ndarray, gx: np.ndarray, codes: np.ndarray | None) -> None:
            deep = max(1, SEEN // max(1, len(gi)))
            for k in range(0, len(qi), deep):
                sims = qx[k : k + deep] @ gx.T
                if codes is not None:
                    sims[mine[k : k + deep, None] == codes[None, :]] = -np.inf
                close = sims >= least[k : k + deep, None]
                if codes is not None:
                    close &= np.isfinite(sims)
                for r in np.flatnonzero(close.any(axis=1)):
                    (_, line, at, ids, ahead), i = of[k + r]
                    x = np.sort(sims[r][close[r]])
                    if line.shape[1] <= 2 * len(x):  # fewer to be looked up than to look up in
                        passed = np.searchsorted(x, line[i])
                        if not (x[np.minimum(passed, len(x) - 1)] == line[i]).any():
                            ahead[i, 1:] += np.diff(passed, append=len(x)).astype(ahead.dtype)
                            continue
                    to = np.searchsorted(line[i], x)
                    if (tied := line[i][np.minimum(to, line.shape[1] - 1)] == x).any():
                        to = _past(to, np.searchsorted(line[i], x, side="right"), tied, x, sims[r], gi, ids[i] if at is None else ids[at[i]])
                    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                    ahead[i, to[first]] += np.diff(np.r_[first, len(to)]).astype(ahead.dtype)

        for (gi, _, gx), codes in zip(near, theirs, strict=True):
            if len(segments) > 1 or (codes != mine[0]).any():
                count(gi, gx, codes)
        for gi, gx in _together(blocks, ACROSS // qx.shape[1]):
            count(gi, gx, None)
        for a, line, _, _, ahead in segments:
            seen = np.arange(1, line.shape[1] + 1)
            for k in range(0, len(line), 64):
                some = np.isfinite(line[k : k + 64])[:, ::-1]
                place = np.cumsum(ahead[k : k + 64, :0:-1], axis=1, dtype=np.int64) + seen  # the nearest first
                n = some.sum(axis=1)
                ap = np.where(some, seen / place, 0).sum(axis=1) / np.maximum(n, 1)
                first = place[:, 0] if len(seen) else np.zeros(len(n), np.int64)
                columns = [pa.array(ap, mask=(n == 0) | (depth is not None)), pa.array(first, mask=n == 0), pa.array((some & (place <= 5)).sum(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(qi[a + k : a + k + 64][: len(n)]), ql.slice(a + k, len(n)), *columns], names)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_groups(batches, keys), key=lambda x: x[0]):
            asked, near, rest = [], [], iter(())
            for _, batch, i in rows:
                found = _rows(batch.column("rows"), i, False)
                if batch.column("asked")[i].as_py():
                    asked.append((found[0], found[1], np.where(np.isfinite(found[2]), found[2], np.nan)))
                elif not batch.column("other")[i].as_py():
                    near.append(_finite(found))
                else:
                    rest = chain([_finite(found)], (_finite(_rows(batch.column("rows"), i, False)) for _, batch, i in rows))
                    break
            if not asked:  # no query's hash is of this group
                continue
            qi, ql, qx = np.concatenate([x[0] for x in asked]), pa.concat_arrays([x[1] for x in asked]), np.concatenate([x[2] for x in asked])
            codes = ql.dictionary_encode()
            codes, values = codes.indices.to_numpy(), codes.dictionary
            order = np.lexsort((qi, codes))
            qi, ql, qx = qi[order], ql.take(pa.array(order)), qx[order]
            own = pa.concat_arrays([values, *(gl for _, gl, _ in near)]).dictionary_encode().indices.fill_null(len(values)).to_numpy()
            each = np.bincount(own[len(values) :], minlength=len(values))[codes[order]]
            cuts = _cuts(np.minimum(each, depth) if depth else each, held)
            if len(cuts) == 2:
                yield from ranked(qi, ql, qx, rest, near)
                continue
            with tempfile.TemporaryFile() as kept_rows:
                again = _kept(rest, kept_rows)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield from ranked(qi[a:b], ql.slice(a, b - a), qx[a:b], again(), near)

    found = _passing(asked, passing, keys, ["other"]).mapInArrow(rank, f"q_id {kinds['item_id']}, q_label {kinds['label']}, ap double, first_rank long, within5 int")
    none = q.join(parts.select("label"), "label", "left_anti").select(F.col("item_id").alias("q_id"), F.col("label").alias("q_label"), F.lit(None).cast("double").alias("ap"), F.lit(None).cast("long").alias("first_rank"), F.lit(0).alias("within5"))
    return found.unionByName(none).withColumn("gallery", F.lit(counts[1]).cast("long"))


def _cuts(each: np.ndarray, held: int) -> list[int]:
    """Ends of runs of queries that have about `held` relevant rows together, or are one query. each: how many each query has."""
    cuts, total = [0], 0
    for k, n in enumerate(each.tolist()):
        if k > cuts[-1] and total + n > held:
            cuts.append(k)
            total = 0
        total += n
    return [*cuts, len(each)]


def _together(blocks: Iterator[tuple], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the blocks, about so many rows at a time."""
    held: list[tuple] = []
    for block in blocks:
        held.append(block)
        if sum(len(x[0]) for x in held) >= rows:
            yield np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
            held = []
    if held:
        yield np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])


def _kept(blocks: Iterator[tuple], file) -> Callable[[], Iterator[tuple]]:
    """Writes the blocks' ids and vectors to a file of this task; what comes back reads them, block by block, as often as it is called."""
    kinds = []
    for gi, _, gx in blocks:
        if not len(gi):
            continue
        kinds.append((gi.dtype, len(gi), gx.shape[1]))
        file.write(np.ascontiguousarray(gi).data)
        file.write(np.ascontiguousarray(gx, float).data)

    def again() -> Iterator[tuple]:
        file.seek(0)
        for kind, n, width in kinds:
            ids = np.frombuffer(file.read(n * kind.itemsize), kind)
            yield ids, None, np.frombuffer(file.read(8 * n * width)).reshape(n, width)

    return again


def _past(to: np.ndarray, upto: np.ndarray, tied: np.ndarray, x: np.ndarray, row: np.ndarray, gi: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Before how many of a query's relevant rows (furthest first, of ids `ids`) each of x, in order, stands: of equal similarity it passes those
    of greater ids, which come first. `row`: similarities of the block's rows, of ids gi in order."""
    to = to.copy()
    for value in np.unique(x[tied]):
        a, b = np.searchsorted(x, value), np.searchsorted(x, value, side="right")
        run = ids[to[a] : upto[a]]
        to[a:b] += np.sort(np.searchsorted(-run, -gi[row == value]))
    return to


def nearest(queries: DataFrame, gallery: DataFrame, skip_self: bool = False) -> DataFrame:
    """q_id, q_label, g_id, pred, sim, correct."""
    top = matches(queries, gallery, 1, skip_self)
    return top.select("q_id", "q_label", "g_id", F.col("g_label").alias("pred"), "sim", (F.col("q_label") == F.col("g_label")).alias("correct"))


def votes(top: DataFrame) -> DataFrame:
    """q_id, q_label, pred of a table of matches: the most frequent label, then the nearest, then the least."""
    counted = top.groupBy("q_id", "q_label", "g_label").agg(F.count("*").alias("n"), F.max("sim").alias("best"))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("n"), F.desc("best"), "g_label"))
    return counted.withColumn("place", place).where("place = 1").select("q_id", "q_label", F.col("g_label").alias("pred"), "n")


def class_scores(top: DataFrame, tau: float = 0.07, counts: DataFrame | None = None) -> DataFrame:
    """q_id, q_label, label, score: log-sum-exp over each class's share of the nearest rows. counts: label, n of the whole gallery, for a
    mean instead of a sum."""
    best = F.max("sim").over(Window.partitionBy("q_id", "g_label"))
    out = top.withColumn("best", best).groupBy("q_id", "q_label", F.col("g_label").alias("label")).agg((F.max("best") / tau + F.log(F.sum(F.exp((F.col("sim") - F.col("best")) / tau)))).alias("score"))
    return out if counts is None else out.join(counts, "label").withColumn("score", F.col("score") - F.log("n")).drop("n")


def best_class(scores: DataFrame) -> DataFrame:
    """q_id, q_label, pred, score: the class of the greatest score, ties to the least label."""
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "label"))
    return scores.withColumn("place", place).where("place = 1").select("q_id", "q_label", F.col("label").alias("pred"), "score")


#: Rows of matches that are scored together, about.
TOGETHER = 1 << 16


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of about TOGETHER rows that end where the keys change, so that what has one key and stands together stays in one table."""
    held: list[pa.RecordBatch] = []

    def changes(table: pa.Table) -> np.ndarray:
        """Rows whose keys aren't those of the row before."""
        codes = [table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for c in keys]
        return np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in codes))) + 1

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            table = pa.Table.from_batches(held)
            if len(at := changes(table)):
                yield table.slice(0, at[-1])
                table = table.slice(at[-1])
            held = table.to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def settled(top: DataFrame, counts: DataFrame, by: str, ms: tuple[int, ...], taus: tuple[float, ...], digits: int = 7) -> DataFrame:
    """by, m, tau, mean, q_id, q_label, pred: for each of ms nearest rows, each temperature, and sums and means, the class of the greatest
    `class_scores`, to so many digits, ties to the least label.

    top: rows of `matches` within `by`, sim rounded, no row moved since; a query's rows stand together and are scored where they are, ranked
    anew by sim and g_id, so that no row is repeated for a setting. counts: label, n, a row a label, goes to every task.
    """
    kinds = dict(top.dtypes)
    rows = top.select(by, "q_id", "q_label", "g_id", "g_label", "sim").join(F.broadcast(counts.select(F.col("label").alias("g_label"), F.col("n").cast("double"))), "g_label")
    names = [by, "m", "tau", "mean", "q_id", "q_label", "pred"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, [by, "q_id"]):
            of, qi, ql, gl = (table.column(c).combine_chunks() for c in (by, "q_id", "q_label", "g_label"))
            q, g, sim, n = (table.column(c).to_numpy() for c in ("q_id", "g_id", "sim", "n"))
            codes = of.dictionary_encode().indices.to_numpy()
            run = np.cumsum(np.r_[False, (q[1:] != q[:-1]) | (codes[1:] != codes[:-1])])
            labels, label = np.unique(gl.to_numpy(), return_inverse=True)
            line = np.lexsort((g, -sim, run))
            place = np.arange(len(run)) - np.searchsorted(run, run)
            line, place = line[place < max(ms)], place[place < max(ms)]
            inner = np.lexsort((label[line], run[line]))  # of a run's label the nearest first
            line, place = line[inner], place[inner]
            r, c, s = run[line], label[line], sim[line]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
            best, size = s[first], np.diff(np.r_[first, len(s)])
            less, pair_run = s - np.repeat(best, size), r[first]
            start = np.flatnonzero(np.r_[True, pair_run[1:] != pair_run[:-1]])
            head = pa.array(np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))
            own = [x.take(head) for x in (of, qi, ql)]
            for m in ms:
                near = place < m
                for tau in taus:
                    total = np.add.reduceat(np.where(near, np.exp(less / tau), 0.0), first)
                    summed = np.where(near[first], best / tau + np.log(np.maximum(total, 1e-300)), -np.inf)
                    for mean in (False, True):
                        x = np.round(summed - np.log(n[line[first]]) if mean else summed, digits)
                        top_ = np.flatnonzero(x == np.repeat(np.maximum.reduceat(x, start), np.diff(np.r_[start, len(x)])))
                        pred = c[first][top_[np.unique(pair_run[top_], return_index=True)[1]]]
                        k = len(pred)
                        columns = [own[0], pa.array(np.full(k, m, np.int32)), pa.array(np.full(k, tau)), pa.array(np.full(k, mean)), own[1], own[2], pa.array(labels[pred]).cast(gl.type)]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(score, f"`{by}` {kinds[by]}, m int, tau double, mean boolean, q_id {kinds['q_id']}, q_label {kinds['q_label']}, pred {kinds['g_label']}")
