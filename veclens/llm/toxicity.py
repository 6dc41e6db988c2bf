"""Toxicity by a small bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is a learned vector of its own, for words that training knows, beside the mean of learned vectors of its character
trigrams. All overlapping windows of a text are scored and the greatest counts. Training is multiple-instance: a toxic document says that
some window of it is toxic, so the window that the words' odds point at stands for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .decontam import Terms, _passages
from .recompression import _ODD, mix
from .words import Words, row_slices, tokenise, trimmed

WINDOW, STEP = 32, 16
#: Bounds of the training sample: documents of each class, and bytes of a document that may be in it.
CLASS_DOCS, DOC_BYTES = 1500, 65_536
WORDS, GRAMS = 8192, 2048
WORD_DIM, GRAM_DIM, HIDDEN = 8, 8, 8
STEPS, BATCH, RATE, HARDEN = 700, 96, 0.01, 70
#: Share of words that training shows by their characters alone.
DROP = 0.1
#: How fast the trigrams' vectors fade, so that only trigrams of many words count.
DECAY = 0.1
#: One training document in so many sets the scale of scores and doesn't train the network.
ASIDE = 4
THRESHOLD = 0.3
SLICE = 1 << 20
_SEED = 11


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _grams(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of the words at `at`, and how many each word has: a trigram about each byte, blanks at the ends."""
    start, n = w.start[at], w.end[at] - w.start[at]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    byte = np.repeat(start, n) + place
    padded = np.r_[w.data, np.uint8(32)].astype(np.uint64)
    before = np.where(place > 0, padded[byte - 1], np.uint64(32))
    after = np.where(place + 1 < np.repeat(n, n), padded[byte + 1], np.uint64(32))
    return (mix(before * np.uint64(65536) + padded[byte] * np.uint64(256) + after + _ODD) % np.uint64(GRAMS)).astype(np.int64), n


def _mean(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    first = np.cumsum(n) - n
    return np.add.reduceat(rows, first, axis=0) / n[:, None] if len(n) else np.zeros((0, rows.shape[1]), np.float32)


class Network:
    """Parameters by name, all float32."""

    def __init__(self, rng: np.random.Generator, words: int):
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": normal(words + 1, WORD_DIM) * 0.1, "gram": normal(GRAMS, GRAM_DIM), "att": normal(2 * h, h), "pick": normal(h), "out": normal(2 * h), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": normal(d, 3 * h), f"h{side}": normal(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}

    def run(self, gates: dict[str, np.ndarray], size: np.ndarray, keep: bool = False):
        """Logit of each window. gates: inputs to the gates, time by window by 3 * HIDDEN, a direction each; size: words of each window."""
        h, steps, n = HIDDEN, *gates["f"].shape[:2]
        states = np.zeros((steps, n, 2 * h), np.float32)
        memory: dict[str, list] = {"f": [], "b": []}
        for k, side in enumerate("fb"):
            now = np.zeros((n, h), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                on = (t < size)[:, None]
                u, x = now @ self.p[f"h{side}"], gates[side][t]
                rz = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                m = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                new = np.where(on, m + z * (now - m), now)
                if keep:
                    memory[side].append((t, on, now, u[:, 2 * h :], r, z, m))
                now = new
                states[t, :, k * h : (k + 1) * h] = now
        there = np.arange(steps)[:, None] < size[None, :]
        a = np.tanh(states @ self.p["att"])
        e = np.where(there, a @ self.p["pick"], -1e9)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = (e[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, states, memory, a, e, pooled) if keep else logit

    def gradient(self, x: np.ndarray, size: np.ndarray, label: np.ndarray):
        """Gradients of the mean log loss, and of x: time by window by input."""
        h = HIDDEN
        logit, states, memory, a, e, pooled = self.run({s: x @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in "fb"}, size, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * self.p["out"]
        ds = e[:, :, None] * dp[None]
        de = (states * dp[None]).sum(axis=2)
        de = e * (de - (e * de).sum(axis=0))
        g["pick"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * self.p["pick"] * (1 - a * a)
        g["att"] = np.einsum("tni,tnh->ih", states, da)
        ds += da @ self.p["att"].T
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            carry = np.zeros((len(label), h), np.float32)
            for t, on, old, um, r, z, m in reversed(memory[side]):
                dh = carry + ds[t, :, k * h : (k + 1) * h]
                own = np.where(on, dh, 0)
                dm = own * (1 - z) * (1 - m * m)
                dz = own * (old - m) * z * (1 - z)
                dr = dm * um * r * (1 - r)
                gate = np.concatenate([dr, dz, dm], axis=1)
                du = np.concatenate([dr, dz, dm * r], axis=1)
                g[f"h{side}"] += old.T @ du
                g[f"x{side}"] += x[t].T @ gate
                g[f"c{side}"] += gate.sum(axis=0)
                dx[t] += gate @ self.p[f"x{side}"].T
                carry = np.where(on, own * z, dh) + du @ self.p[f"h{side}"].T
        return g, dx


def train(texts: list[str], labels: list[int], steps: int = STEPS) -> tuple[np.ndarray, Network] | None:
    """(hashes of the words that have vectors, network); None where there are not both classes."""
    label = np.array(labels, bool)
    if label.all() or not label.any():
        return None
    rng = np.random.default_rng(_SEED)
    w = trimmed(tokenise(pa.array(texts), lower=True))
    hashes = w.hashes
    key, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), w.last - w.first)
    pairs = np.unique(doc * len(key) + back)
    in_doc, word = np.divmod(pairs, len(key))
    toxic, clean = np.bincount(word[label[in_doc]], minlength=len(key)), np.bincount(word[~label[in_doc]], minlength=len(key))
    # the root of each word's likelihood ratio, signed: a word must be frequent as well as one-sided
    both, share = toxic + clean, label.mean()
    part = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(both * p, 1e-12)), 0)
    sure = np.sign(toxic - both * share) * np.sqrt(2 * np.maximum(part(toxic, share) + part(clean, 1 - share), 0))
    chosen = np.sort(np.argsort(-np.sqrt(both) - 10 * np.abs(sure), kind="stable")[:WORDS])
    number = np.full(len(key), len(chosen))
    number[chosen] = np.arange(len(chosen))

    net = Network(rng, len(chosen))
    net.p["word"][:-1, 0] = np.clip(sure[chosen] / 4, -3, 3)
    first, last, text = _passages(w, WINDOW, STEP)
    worst = np.array([sure[back[a:b]].max() for a, b in zip(first, last, strict=True)])
    order = np.lexsort((-worst, text))
    lead = order[np.r_[True, np.diff(text[order]) > 0]]  # each text's window of greatest odds
    yes, no = lead[label[text[lead]]], lead[~label[text[lead]]]
    calm = np.flatnonzero(~label[text])
    grams, n = _grams(w, at)
    starts = np.cumsum(n) - n
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}

    def inputs(token: np.ndarray, ids: np.ndarray):
        """Inputs of a grid of words, with what led to their characters' part."""
        uniq, where = np.unique(token, return_inverse=True)
        length = n[uniq]
        own = np.repeat(starts[uniq] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        chars = _mean(net.p["gram"][grams[own]], length).astype(np.float32)
        return np.concatenate([net.p["word"][ids], chars[where.reshape(token.shape)]], axis=2), where.ravel(), length, own, chars

    def words_of(picked: np.ndarray) -> np.ndarray:
        return back[np.minimum(first[picked][None, :] + np.arange(WINDOW)[:, None], len(back) - 1)]

    third = BATCH // 3
    for step in range(1, steps + 1):
        if step % HARDEN == 0:  # what it now takes for toxic in clean texts
            score = np.concatenate([net.run({s: x @ net.p[f"x{s}"] + net.p[f"c{s}"] for s in "fb"}, (last - first)[c]) for c in np.array_split(calm, len(calm) // 4096 + 1) for x in [inputs(words_of(c), number[words_of(c)])[0]]])
            no = calm[np.argsort(-score, kind="stable")[: 12 * BATCH]]
        picked = np.r_[rng.choice(yes, third), rng.choice(no, third), rng.choice(calm, BATCH - 2 * third)]
        size = last[picked] - first[picked]
        token = words_of(picked)
        ids = np.where(rng.random(token.shape) < DROP, len(chosen), number[token])
        x, where, length, own, chars = inputs(token, ids)
        g, dx = net.gradient(x, size, np.r_[np.ones(third), np.zeros(BATCH - third)].astype(np.float32))
        np.add.at(g["word"], ids.ravel(), dx[:, :, :WORD_DIM].reshape(-1, WORD_DIM))
        spread = np.zeros_like(chars)
        np.add.at(spread, where, dx[:, :, WORD_DIM:].reshape(-1, GRAM_DIM))
        np.add.at(g["gram"], grams[own], np.repeat(spread / length[:, None], length, axis=0))
        for k, v in net.p.items():
            m, s = moment[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            if k == "gram":
                v *= np.float32(1 - DECAY * RATE)
            v -= (RATE * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return key[chosen], net


def learn(docs: DataFrame, labels: DataFrame, class_docs: int = CLASS_DOCS):
    """A model from at most `class_docs` documents of each class, the first by a hash of doc_id and text, none longer than DOC_BYTES.

    Rows that repeat a doc_id and text count once, however many they are; of a doc_id's labels the greatest counts. None without rows of
    both classes, as with empty tables; then every score is 0.
    """
    ids = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.where(~held_out(4, 2))
    texts = docs.where(f"octet_length(text) <= {DOC_BYTES} and text <> ''").select("doc_id", F.xxhash64("doc_id", "text").alias("h"))
    known = texts.groupBy("doc_id", "h").agg(F.lit(1).alias("one")).join(ids, "doc_id")
    parts = [known.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(class_docs).select("doc_id", "h", "toxic") for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most two times class_docs rows of two numbers
    own = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).join(chosen, ["doc_id", "h"])
    rows = own.groupBy("doc_id", "h").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id", "h").collect()
    aside = np.array([zlib.crc32(f"aside {r.doc_id}".encode()) % ASIDE == 0 for r in rows], bool)
    texts, label = np.array([r.text for r in rows], object), np.array([r.toxic for r in rows], int)
    model = train(texts[~aside].tolist(), label[~aside].tolist()) if len(rows) else None
    if model is None:
        return None
    logit = _logits(*model, pa.array(texts[aside].tolist(), pa.string()))
    there = np.isfinite(logit)
    return *model, *_scale(logit[there], label[aside][there])


def _logits(known: np.ndarray, net: Network, column: pa.Array) -> np.ndarray:
    """The greatest logit of each text's windows, minus infinity where there are none."""
    out, index = np.full(len(column), -np.inf), Terms(known)
    w = trimmed(tokenise(column, lower=True))
    _, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    if not len(at):
        return out
    grams, n = _grams(w, at)
    x = np.concatenate([net.p["word"][index.find(w.hashes[at])], _mean(net.p["gram"][grams], n)], axis=1).astype(np.float32)  # -1: no word of its own
    gates = {s: x @ net.p[f"x{s}"] + net.p[f"c{s}"] for s in "fb"}
    first, last, text = _passages(w, WINDOW, STEP)
    for k in range(0, len(first), 4096):
        a, size = first[k : k + 4096], (last - first)[k : k + 4096]
        token = back[np.minimum(a[None, :] + np.arange(WINDOW)[:, None], len(back) - 1)]
        np.maximum.at(out, text[k : k + 4096], net.run({s: gates[s][token] for s in "fb"}, size).astype(float))
    return out


def _scores(model, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    known, net, slope, shift = model
    logit = _logits(known, net, column)
    return np.where(np.isfinite(logit), _sigmoid(slope * np.where(np.isfinite(logit), logit, 0) + shift), 0.0)


def _scale(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through texts that training didn't see, lightly drawn to slope one and shift zero."""
    beta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    for _ in range(50):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - label) + 0.1 * (beta - prior))
        beta = beta - np.clip(step, -1, 1)
    return max(float(beta[0]), 0.05), float(beta[1])


def score_texts(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every whole text, in one narrow pass: the greatest score of its overlapping windows.

    A null text and one without words score 0, and so does every text where there is no model. Repeated rows score alike; only doc_id and
    text are read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(shared.value, part.column("text")))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
