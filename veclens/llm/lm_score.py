"""Language-model scores from the subword lattice of each word.

The pieces of an existing vocabulary weight every way to cut a word into pieces; a forward recursion in log space sums over all of them, so
a text's score is its marginal probability, not that of one best cut. Piece probabilities start from the vocabulary's own scores and are
re-estimated from the training documents' words. The most frequent words join the vocabulary as pieces of their own, next to the ways to cut
them; each gives a discount of its count to those. Every word's score is its lattice's, whether training saw it or not. The base score is an
add-one unigram model of whole words.

Words travel as 64-bit hashes. A bounded table of frequent words is broadcast; only the other words of a document are shuffled, to be
joined with their counts, and none of them is frequent, so no key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, staged
from .recompression import _ODD, mix
from .words import column_of, row_slices, tokenise

VOCABULARY = "piece_bpe_32k.model"
#: Words in the broadcast table at most; they decide what is shuffled, never a result.
FREQUENT = 65_536
#: Frequent words that become pieces, at most.
PIECES = 65_536
#: Rounds of re-estimation before the one on all words, and the most frequent words that they learn from.
WARM_ROUNDS, WARM_WORDS = 4, 65_536
#: Weight of the vocabulary's own scores in each re-estimate, in words.
PRIOR = 1000.0
#: What each word that becomes a piece gives of its count to its other cuts, and the longest such word, in bytes.
DISCOUNT, LONGEST_PIECE = 0.75, 32
SLICE = 8 << 20
#: Longest word, in bytes, that is scored among others of its length; longer ones go one by one.
LONG = 48


def vocabulary(name: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a blank for the mark of a word's start, and their probabilities by the vocabulary's scores.

    A byte pair vocabulary's scores are ranks, so probabilities fall as one over the rank. Byte pieces follow the others.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    size = model.get_piece_size()
    usual = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    rank = {i: r for r, i in enumerate(sorted(usual, key=lambda i: (-model.get_score(i), i)))}
    seen: dict[bytes, float] = {}
    for i in usual:
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            seen[piece] = seen.get(piece, 0.0) + 1 / (rank[i] + 10)
    pieces = list(seen)
    weights = np.array([*seen.values(), *([1 / size] * 256)])
    return pieces, weights / weights.sum()


def with_words(pieces: list[bytes], weights: np.ndarray, words: list[bytes], counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The pieces and these words as pieces, a blank before each, their weights raised by their counts less the discount. Bytes stay last."""
    at = {p: i for i, p in enumerate(pieces)}
    new = [b" " + w for w in words if b" " + w not in at]
    at.update((p, len(pieces) + i) for i, p in enumerate(new))
    out = np.r_[weights[: len(pieces)], np.zeros(len(new)), weights[len(pieces) :]]
    np.add.at(out, np.array([at[b" " + w] for w in words], np.int64), counts - DISCOUNT)
    return pieces + new, out


class Lattice:
    """All ways to cut words into pieces, over arrays of words of one length at a time."""

    def __init__(self, pieces: list[bytes], prob: np.ndarray):
        self.pieces, self.index = pieces, {p: i for i, p in enumerate(pieces)}
        self.bytes0, self.size = len(pieces), len(pieces) + 256
        self.longest = max(map(len, pieces))
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.tables = {}
        lengths = np.array(list(map(len, pieces)))
        for size in range(1, self.longest + 1):
            own = np.flatnonzero(lengths == size)
            raw = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(-1, size)
            h = np.zeros(len(own), np.uint64)
            for k in range(size):
                h = h * _ODD + raw[:, k] + np.uint64(1)
            order = np.argsort(mix(h))
            self.tables[size] = mix(h)[order], own[order].astype(np.int32)
        self.weigh(prob)

    def weigh(self, prob: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            self.log = np.r_[np.log(prob), -np.inf]  # at -1: no piece
        self.logs = self.log.tolist()

    def _edges(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each length from 1, which piece starts at each place of each word, -1 for none. chars: places by words."""
        size, n = chars.shape
        out, h, codes = [], np.zeros((size, n), np.uint64), chars.astype(np.uint64)
        for length in range(1, min(size, self.longest) + 1):
            h = h[: size - length + 1] * _ODD + codes[length - 1 :] + np.uint64(1)
            keys, ids = self.tables[length]
            if not len(keys):
                out.append(np.full(h.shape, -1, np.int32))
                continue
            wanted = mix(h)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out.append(np.where(keys[at] == wanted, ids[at], -1).astype(np.int32))
        return out

    def _into(self, chars, edges, t, alpha) -> np.ndarray:
        ways = [alpha[t - 1] + self.log[self.bytes0 + chars[t - 1]], *(alpha[t - k] + self.log[edges[k - 1][t - k]] for k in range(1, min(t, self.longest) + 1))]
        return _log_sum(ways)

    def _forward(self, chars: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        alpha = np.zeros((len(chars) + 1, chars.shape[1]))
        for t in range(1, len(chars) + 1):
            alpha[t] = self._into(chars, edges, t, alpha)
        return alpha

    def _from(self, word: bytes, t: int) -> Iterator[tuple[int, int]]:
        """End and number of each piece that starts at place t of a word."""
        yield t + 1, self.bytes0 + word[t]
        for end in range(t + 1, min(len(word), t + self.longest) + 1):
            part = word[t:end]
            if part not in self.prefixes:
                return
            i = self.index.get(part)
            if i is not None:
                yield end, i

    def _forward_one(self, word: bytes) -> list[float]:
        """The forward pass of a long word by itself: the log probability of all ways to each of its places."""
        alpha, ways = [0.0], {}
        for t in range(len(word)):
            for end, i in self._from(word, t):
                ways.setdefault(end, []).append(alpha[t] + self.logs[i])
            alpha.append(_log_sum_one(ways.pop(t + 1)))
        return alpha

    def _one(self, word: bytes) -> float:
        """A long word by itself."""
        return self._forward_one(word)[-1]

    def _expect_one(self, word: bytes, times: float, out: np.ndarray) -> None:
        """Adds to out how often each piece is expected in a long word, which counts `times` times."""
        alpha, beta = self._forward_one(word), [0.0] * (len(word) + 1)
        for t in range(len(word) - 1, -1, -1):
            ways = [(i, beta[end] + self.logs[i]) for end, i in self._from(word, t)]
            beta[t] = _log_sum_one([way for _, way in ways])
            for i, way in ways:
                out[i] += times * math.exp(alpha[t] - alpha[-1] + way)

    def _groups(self, start: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
        size = end - start
        order = np.argsort(size, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            for k in range(0, len(group), 20_000):
                yield group[k : k + 20_000]

    def _chars(self, data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        body = data[start[None, :] + np.arange(size)[:, None]] if size else np.zeros((0, len(start)), np.uint8)
        return np.r_[np.full((1, len(start)), 32, np.uint8), body].astype(np.int64)

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability; words are data[start:end]."""
        out = np.zeros(len(start))
        for group in self._groups(start, end) if len(start) else ():
            size = int(end[group[0]] - start[group[0]])
            if size > LONG:
                out[group] = [self._one(b" " + data[start[i] : end[i]].tobytes()) for i in group]
                continue
            chars = self._chars(data, start[group], size)
            out[group] = self._forward(chars, self._edges(chars))[-1]
        return out

    def expected(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each counted `counts` times."""
        out = np.zeros(self.size)
        for group in self._groups(start, end) if len(start) else ():
            size, n = int(end[group[0]] - start[group[0]]), counts[group].astype(float)
            if size > LONG:
                for i, times in zip(group, n, strict=True):
                    self._expect_one(b" " + data[start[i] : end[i]].tobytes(), times, out)
                continue
            chars = self._chars(data, start[group], size)
            edges = self._edges(chars)
            alpha, total = self._forward(chars, edges), len(chars)
            beta = np.zeros_like(alpha)
            for t in range(total - 1, -1, -1):
                single = self.log[self.bytes0 + chars[t]]
                ways = [beta[t + 1] + single, *(beta[t + k] + self.log[edges[k - 1][t]] for k in range(1, min(total - t, self.longest) + 1))]
                beta[t] = _log_sum(ways)
                base = alpha[t] - alpha[total]
                out += np.bincount(self.bytes0 + chars[t], n * np.exp(base + ways[0]), len(out))
                for k, way in enumerate(ways[1:]):
                    found = np.flatnonzero(edges[k][t] >= 0)
                    if len(found):
                        out += np.bincount(edges[k][t][found], n[found] * np.exp(base[found] + way[found]), len(out))
        return out


def _log_sum(ways: list[np.ndarray]) -> np.ndarray:
    ways = np.stack(ways)
    top = ways.max(axis=0)
    return top + np.log(np.exp(ways - top).sum(axis=0))


def _log_sum_one(ways: list[float]) -> float:
    top = max(ways)
    return top + math.log(sum(math.exp(way - top) for way in ways))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data, start, end of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], at[1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """key, word, n: each lower-cased word of all texts, counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, SLICE):
                w = tokenise(part.column("text"), lower=True)
                key, at, n = np.unique(w.hashes, return_index=True, return_counts=True)
                for k in range(0, len(key), 50_000):
                    i = at[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 50_000].view(np.int64)), column_of(w.data, w.start[i], w.end[i]), pa.array(n[k : k + 50_000].astype(np.int64))], ["key", "word", "n"])

    return docs.select("text").mapInArrow(count, "key long, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))


def _estimate(lattice: Lattice, expected: np.ndarray, prior: np.ndarray) -> None:
    weights = expected + PRIOR * prior
    lattice.weigh(weights / weights.sum())


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2, frequent: int = FREQUENT, name: str = VOCABULARY, pieces_most: int = PIECES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    score: the sum over words of their lattices' log probability, and the end's, whose weight is the number of training documents. Words and
    counts learn from documents that aren't held out. A null or empty text is its end alone. Without training documents all
    counts are 0. Rows that repeat a doc_id and text are scored alike, each for itself; a null doc_id counts as training. A word of any
    length, in any alphabet, has a probability: bytes are pieces, too. Words are told apart by 64-bit hashes. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = docs.where(~held_out(modulus, remainder))
    counts = staged(word_counts(train), "words")
    n_docs = train.count()
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, n_distinct = (totals.n or 0) + n_docs, totals.v + (n_docs > 0)
    first = counts.orderBy(F.desc("n"), "key").limit(max(frequent, WARM_WORDS, pieces_most)).toArrow()
    top = first.slice(0, frequent)
    top = top.take(np.argsort(top.column("key").to_numpy().view(np.uint64)))
    keys, times = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()

    pieces, prior = vocabulary(name)
    lattice = Lattice(pieces, prior)
    warmest = _bytes(pa.array(first.slice(0, WARM_WORDS).column("word").to_pylist(), pa.binary()))
    for _ in range(WARM_ROUNDS):
        _estimate(lattice, lattice.expected(*warmest, np.ones(len(warmest[1]))), prior)
    kept = first.slice(0, pieces_most)
    kept = kept.filter(pc.less_equal(pc.binary_length(kept.column("word")), LONGEST_PIECE))
    as_piece = np.sort(kept.column("key").to_numpy())
    context = docs.sparkSession.sparkContext
    warm = context.broadcast((np.exp(lattice.log[:-1]), as_piece))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob, own_pieces = warm.value
        own, total = Lattice(pieces, prob), np.zeros(len(prob))
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy().astype(float)
            at = np.minimum(np.searchsorted(own_pieces, key), max(len(own_pieces) - 1, 0))
            if len(own_pieces):
                n[own_pieces[at] == key] = DISCOUNT
            total += own.expected(*_bytes(batch.column("word")), n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

    found = counts.select("key", "word", "n").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # as many rows as pieces
    expected = np.zeros(len(prior))
    expected[found.column("piece").to_numpy()] = found.column("n").to_numpy()
    every, weights = with_words(pieces, expected + PRIOR * prior, kept.column("word").to_pylist(), kept.column("n").to_numpy())
    all_weights = weights.sum() + max(n_docs, 1)
    lattice = Lattice(every, weights / all_weights)
    end_score = float(np.log10(max(n_docs, 1) / all_weights))
    scale = float(n_all + n_distinct + 1)
    often = lattice.scores(*_bytes(pa.array(top.column("word").to_pylist(), pa.binary()))) / np.log(10)
    model = context.broadcast((every, np.exp(lattice.log[:-1]), keys, np.log10((times + 1) / scale), often))
    end_base = float(np.log10((n_docs + 1) / scale))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_pieces, prob, keys, base, scores = model.value
        own = Lattice(own_pieces, prob)
        names = ["doc_id", "print", "head", "key", "n", "n_tokens", "known", "base", "score", "lattice"]
        for batch in batches:
            for part in row_slices(batch, SLICE):
                w, rows = tokenise(part.column("text"), lower=True), part.num_rows
                key, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
                where = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                often = keys[where] == key if len(keys) else np.zeros(len(key), bool)
                b, s, lattice = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key))
                b[often], s[often] = base[where[often]], scores[where[often]]
                rare = np.flatnonzero(~often)
                lattice[rare] = own.scores(w.data, w.start[at[rare]], w.end[at[rare]]) / np.log(10)
                doc = np.repeat(np.arange(rows), w.last - w.first)
                sums = [np.bincount(doc, x[back], rows) for x in (often.astype(float), b, s)]
                zero = np.zeros(rows, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("print"), pa.array(zero == 0), part.column("print"), pa.array(zero), pa.array((w.last - w.first + 1).astype(np.int64)), pa.array(sums[0].astype(np.int64) + (n_docs > 0)), pa.array(sums[1] + end_base), pa.array(sums[2] + end_score), pa.array(np.zeros(rows))], names)
                seldom = ~often[back]
                pair, n = np.unique(doc[seldom] * len(key) + back[seldom], return_counts=True)
                for k in range(0, len(pair), 50_000):
                    i, word = np.divmod(pair[k : k + 50_000], len(key))
                    i, zero = pa.array(i), np.zeros(len(word))
                    none = pa.array(zero.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(i), part.column("print").take(i), pa.array(zero > 0), pa.array(key[word].view(np.int64)), pa.array(n[k : k + 50_000].astype(np.int64)), none, none, pa.array(zero), pa.array(zero), pa.array(lattice[word])], names)

    prints = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"))
    flat = prints.mapInArrow(look, "doc_id long, print long, head boolean, key long, n long, n_tokens long, known long, base double, score double, lattice double")
    seen = flat.join(counts.select("key", F.col("n").alias("c")), "key", "left").withColumn("c", F.when(F.col("head"), F.lit(0)).otherwise(F.coalesce("c", F.lit(0))))
    known = F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0))
    base = F.sum(F.col("base") + F.when(F.col("head"), F.lit(0.0)).otherwise(F.col("n") * F.log10((F.col("c") + 1) / scale)))
    score = F.sum(F.col("score") + F.when(F.col("head"), F.lit(0.0)).otherwise(F.col("n") * F.col("lattice")))
    # repeated rows come in together, and go out one by one
    rows = seen.groupBy("doc_id", "print").agg(F.sum(F.col("head").cast("int")).alias("rows"), F.sum("n_tokens").alias("n_tokens"), known.alias("n_known"), base.alias("base_score"), score.alias("score"))
    rows = rows.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    per = lambda c: F.col(c) / F.col("rows")
    return rows.select("doc_id", held_out(modulus, remainder).alias("held_out"), per("n_tokens").cast("long").alias("n_tokens"), per("n_known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), per("base_score").alias("base_score"), per("score").alias("score"))
