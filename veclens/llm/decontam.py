"""Benchmark decontamination by latent semantic retrieval.

Passages become TF-IDF rows; a randomised SVD, its products summed over the cluster, gives each term a place in a latent space. Every
passage of every document is compared by cosine with the pieces of all benchmark items, the stated query set, and what comes near is
checked word by word: the longest common subsequence with the item, and how many of the item's rarest words, its answer, are there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, staged
from .words import Words, row_slices, tokenise, trimmed

#: Words of a passage and from one passage to the next: any SIZE - STEP + 1 words in a row lie inside one.
SIZE, STEP = 32, 16
#: Words of a benchmark item's piece.
PIECE = 16
#: Documents whose passages the index is fitted on, about; terms and dimensions of it.
SAMPLE_DOCS, TERMS, RANK = 500, 32_768, 96
POWER_ROUNDS = 2
#: Least cosine of a candidate; least share of an item's words in common order; least share of its answer.
COSINE, COMMON, ANSWER = 0.55, 0.6, 0.5
ANSWER_WORDS = 4
#: Benchmark text that is broadcast at a time, and with it the terms of the index that it adds; a larger benchmark is searched for in blocks.
BLOCK_BYTES = 2 << 20
SLICE = 1 << 20
#: Rows of the index's matrices that are sent, or held as doubles, at a time: few, so that the driver's heap gets no large arrays.
STRIP = 512
#: Passages, and pieces of items, whose cosines are held at a time.
TALL, BROAD = 2048, 4096
_SEED = 7


def _words(column: pa.Array) -> Words:
    """Words in lower case, of any alphabet, without ASCII punctuation at their ends."""
    return trimmed(tokenise(pc.utf8_lower(column)))


def _passages(w: Words, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word + 1, and text of each passage; a text's last passage may be short, an empty text has none."""
    counts = np.where(w.last > w.first, np.maximum(-(-(w.last - w.first - size) // step), 0) + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = w.first[text] + place * step
    return first, np.minimum(first + size, w.last[text]), text


def _keys(docs: DataFrame, size: int, step: int) -> DataFrame:
    """keys: the word hashes of each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, SLICE):
                w = _words(part.column("text"))
                first, last, _ = _passages(w, size, step)
                n = last - first
                flat = w.hashes[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(flat))], ["keys"])

    return docs.select("text").mapInArrow(run, "keys array<bigint>")


class Terms:
    """Word hash -> place in the index, -1 for none, by direct addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.r_[keys, np.uint64(0)]
        self.tables, left, shift = [], np.arange(len(keys)), 44
        while len(left):
            table = np.full(1 << 20, -1, np.int32)
            slot = (keys[left] >> np.uint64(shift)) & np.uint64((1 << 20) - 1)
            table[slot] = left
            self.tables.append((table, np.uint64(shift)))
            left = left[table[slot] != left]
            shift = (shift + 50) % 53

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        for table, shift in self.tables:
            at = table[(hashes[todo] >> shift) & np.uint64((1 << 20) - 1)]
            hit = (self.keys[at] == hashes[todo]) & (at >= 0)
            out[todo[hit]] = at[hit]
            todo = todo[~hit]
        return out


def _rows(ids: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term, value of the unit TF-IDF rows. ids: terms of all passages, -1 for none; n: words of each passage."""
    row = np.repeat(np.arange(len(n)), n)[ids >= 0]
    own = ids[ids >= 0]
    pair, tf = np.unique(row * len(idf) + own, return_counts=True)
    row, own = np.divmod(pair, len(idf))
    value = tf * idf[own]
    norm = np.sqrt(np.maximum(np.bincount(row, value**2, len(n)), 1e-12))
    return row, own, value / norm[row]


def _add(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, with repeats."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    out[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def _strips(n: int) -> Iterator[slice]:
    return (slice(k, min(k + STRIP, n)) for k in range(0, n, STRIP))


def _start(n: int, rank: int) -> np.ndarray:
    """A random orthonormal basis of n rows. A tall one comes from the small Gram matrix of its normal numbers, made twice, so that the
    driver never holds all of them as doubles."""
    if n <= STRIP:
        return np.linalg.qr(np.random.default_rng(_SEED).standard_normal((n, rank)))[0].astype(np.float32)
    first, again = np.random.default_rng(_SEED), np.random.default_rng(_SEED)
    draw = lambda numbers, part: numbers.standard_normal((part.stop - part.start, rank))
    squares = sum((x := draw(first, part)).T @ x for part in _strips(n))
    turn, out = np.linalg.inv(np.linalg.cholesky(squares)).T, np.empty((n, rank), np.float32)
    for part in _strips(n):
        out[part] = draw(again, part) @ turn
    return out


def _orthonormal(product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left singular vectors of a tall matrix, and its singular values, from its small Gram matrix; doubles for a strip at a time. product is overwritten."""
    squares = sum((x := product[part].astype(float)).T @ x for part in _strips(len(product)))
    squares, right = np.linalg.eigh(squares)
    scale = np.sqrt(np.maximum(squares[::-1], 0))
    turn = (right[:, ::-1] / np.maximum(scale, 1e-6 * scale[0] + 1e-12)[None, :]).astype(np.float32)
    for part in _strips(len(product)):
        product[part] = product[part] @ turn
    return product, scale


def fit(docs: DataFrame, items: DataFrame, sample_docs: int = SAMPLE_DOCS, terms: int = TERMS, rank: int = RANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, idf, place) of each term of the index: all words of the items and the most frequent ones of about `sample_docs` documents.

    The sample is taken evenly by a hash of doc_id and text, repeated rows once; only the index rests on it, every passage is then searched. place: terms by rank.
    """
    sample = sampled(docs, sample_docs)
    rows = staged(_keys(sample, SIZE, STEP).withColumn("own", F.lit(False)).unionByName(_keys(items, PIECE, PIECE).withColumn("own", F.lit(True))), "passages")
    total = rows.count()
    df = rows.select("own", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("df"), F.max("own").alias("own"))
    chosen = df.where("own").select("key", "df").unionByName(df.where("not own and df > 1").orderBy(F.desc("df"), "key").limit(terms).select("key", "df")).toArrow()
    order = np.argsort(chosen.column("key").to_numpy())
    keys = chosen.column("key").to_numpy()[order].view(np.uint64)
    idf = np.log((1 + total) / (1 + chosen.column("df").to_numpy()[order])) + 1
    if not len(keys):
        return keys, idf, np.zeros((0, rank), np.float32)
    context = docs.sparkSession.sparkContext
    rank = min(rank, len(keys))
    basis = _start(len(keys), rank)
    for _ in range(POWER_ROUNDS + 1):
        shared = context.broadcast((keys, idf, basis))
        del basis

        def gram(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, idf, basis = shared.value
            index, out = Terms(keys), np.zeros(basis.shape, np.float64)
            for batch in batches:
                column = batch.column("keys")
                at = column.offsets.to_numpy()
                ids = index.find(column.flatten().to_numpy().view(np.uint64))
                for k in range(0, len(at) - 1, 1024):
                    n = np.diff(at[k : k + 1025])
                    row, own, value = _rows(ids[at[k] - at[0] : at[min(k + 1024, len(at) - 1)] - at[0]], n, idf)
                    if len(row):
                        y = np.zeros((len(n), basis.shape[1]), np.float32)
                        _add(y, row, value.astype(np.float32)[:, None] * basis[own])
                        _add(out, own, value.astype(np.float32)[:, None] * y[row])
            if out.any():
                for k in range(0, len(out), STRIP):
                    yield pa.RecordBatch.from_arrays([pa.array([k // STRIP], pa.int32()), pa.array([out[k : k + STRIP].astype(np.float32).tobytes()], pa.binary())], ["strip", "sums"])

        def add(table: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in table.column("sums")).astype(np.float32)
            return pa.table({"strip": table.column("strip").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

        product = np.zeros((len(keys), rank), np.float32)
        for p in rows.select("keys").mapInArrow(gram, "strip int, sums binary").groupBy("strip").applyInArrow(add, "strip int, sums binary").toLocalIterator():
            product[p.strip * STRIP : (p.strip + 1) * STRIP] = np.frombuffer(p.sums, np.float32).reshape(-1, rank)
        shared.destroy()
        basis, scale = _orthonormal(product)
        del product
    # whitened, and each term as long as its idf: no direction and no term outweighs another for being well covered
    basis /= np.maximum(np.sqrt(scale), 1e-6 * np.sqrt(scale[0]) + 1e-12)[None, :].astype(np.float32)
    basis *= (idf / np.maximum(np.linalg.norm(basis, axis=1), 1e-12))[:, None].astype(np.float32)
    return keys, idf, basis


def _near(a: np.ndarray, b: np.ndarray, cosine: float) -> Iterator[tuple[int, int, float]]:
    """Row of a, row of b and cosine of the pairs of `cosine` or more, BROAD rows of b at a time."""
    for j in range(0, len(b), BROAD):
        near = a @ b[j : j + BROAD].T
        p, q = np.nonzero(near >= cosine)
        yield from zip(p.tolist(), (q + j).tolist(), near[p, q].tolist(), strict=True)


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = row & where.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, common: float = COMMON, answer: float = ANSWER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, cosine, common, answer: a row for each document and benchmark item that it holds.

    Words are compared in lower case without punctuation at their ends. Texts and items that are null or without words hold nothing and
    are in nothing; an empty table on either side gives no rows. Repeated documents and repeated items give a row each; a null doc_id or
    item_id is kept. Only doc_id and text, item_id and text are read. A benchmark of more than `block_bytes` is searched for in blocks, a
    pass over the documents each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = [_search(docs, items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b), cosine, common, answer) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _search(docs: DataFrame, items: DataFrame, cosine: float, common: float, answer: float) -> DataFrame:
    keys, idf, place = fit(docs, items)
    held = items.toArrow()  # at most a block's bytes
    w = _words(held.column("text"))
    index = Terms(keys)
    ids = index.find(w.hashes) if len(w.start) else np.zeros(0, np.int32)
    first, last, item = _passages(w, PIECE, PIECE)
    first = np.maximum(np.minimum(first, last - PIECE), w.first[item])  # an item's last piece is as long as the others
    vectors = np.stack([place[ids[a:b]].sum(axis=0) for a, b in zip(first, last, strict=True)]) if len(first) else np.zeros((0, place.shape[1]), np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    texts, answers = [], []
    for a, b in zip(w.first, w.last, strict=True):
        texts.append(w.hashes[a:b].tolist())
        rarest = sorted(set(range(a, b)), key=lambda k: (-idf[ids[k]], k))
        answers.append(set(w.hashes[rarest[:ANSWER_WORDS]].tolist()))
    shared = docs.sparkSession.sparkContext.broadcast((keys, place, vectors, item, held.column("item_id").to_pylist(), texts, answers))
    names = ["doc_id", "item_id", "first_word", "n_words", "cosine", "common", "answer"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, place, vectors, item, item_ids, texts, answers = shared.value
        longest = max(map(len, texts), default=0)
        index, place = Terms(keys), np.r_[place, np.zeros((1, place.shape[1]), np.float32)]
        for batch in batches:
            for part in row_slices(batch, SLICE):
                w = _words(part.column("text"))
                first, last, text = _passages(w, SIZE, STEP)
                if not len(first) or not len(vectors):
                    continue
                hashes = w.hashes
                ids = index.find(hashes)
                best: dict[tuple[int, int], tuple] = {}
                # each word is looked up once: a passage is the sum of the steps that it spans
                steps, step_last, step_text = _passages(w, STEP, STEP)
                grid = steps[:, None] + np.arange(STEP)
                grid = np.where(grid < step_last[:, None], ids[np.minimum(grid, len(ids) - 1)], -1)
                begin = np.searchsorted(steps, first)
                for k in range(0, len(first), TALL):
                    a, b = first[k : k + TALL], last[k : k + TALL]
                    lo = begin[k]
                    sums = place[grid[lo : begin[k : k + TALL][-1] + SIZE // STEP]].sum(axis=1)
                    v = np.zeros((len(a), place.shape[1]), np.float32)
                    for j in range(SIZE // STEP):
                        at = begin[k : k + TALL] + j
                        own = np.flatnonzero(at < len(steps))
                        own = own[step_text[at[own]] == text[k + own]]
                        v[own] += sums[at[own] - lo]
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    seen, around = -1, set()
                    for p, q, close in _near(v, vectors, cosine):
                        pair = (int(text[k + p]), int(item[q]))
                        words, begins, ends = texts[pair[1]], w.first[pair[0]], w.last[pair[0]]
                        if p != seen:  # as far as the longest item may reach
                            seen, around = p, set(hashes[max(begins, a[p] - longest) : min(ends, b[p] + longest)].tolist())
                        if len(answers[pair[1]] & around) < answer * len(answers[pair[1]]):
                            continue
                        reach = max(0, len(words) - STEP)
                        lo, hi = max(begins, a[p] - reach), min(ends, b[p] + reach)
                        there = hashes[lo:hi].tolist()
                        share, known = common_words(words, there) / len(words), len(answers[pair[1]] & set(there)) / len(answers[pair[1]])
                        if share >= common and known >= answer and (pair not in best or (share, close) > (best[pair][3], best[pair][2])):
                            best[pair] = (int(lo - begins), int(hi - lo), close, share, known)
                if best:
                    rows = sorted(best.items())
                    columns = [part.column("doc_id").take(pa.array([d for (d, _), _ in rows])), pa.array([item_ids[i] for (_, i), _ in rows], pa.int64())]
                    columns += [pa.array([x[j] for _, x in rows], pa.int64() if j < 2 else pa.float64()) for j in range(5)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(search, "doc_id long, item_id long, first_word long, n_words long, cosine double, common double, answer double")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item, all their columns kept.

    Null and empty texts hold nothing and stay; rows that share a doc_id go together; rows with a null doc_id stay unless a row without
    an id holds one. An empty benchmark leaves docs as it is; an empty table stays empty; other columns may have any name.
    """
    leaked = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col("__leaked")), "left_anti")
