"""Substring deduplication: windows of consecutive words that also start in a document with a smaller id are cut.

Recompression names runs and pairs of words alike wherever they stand (recompression.py), so that equal windows have an equal anchor, a
run of high-level symbols inside them. Four steps, all dealt out by a bucket of documents, a name or a window's hash:

1. every bucket sends out its anchors; Spark groups them by name, and those that come from one document only rule out their windows;
2. buckets send the windows that are left, by name and by a digest of their words, with the least document of each;
3. windows of two documents or more go back to their buckets, with the least document overall;
4. each document cuts its windows whose least document is smaller. Names only propose: windows of one name are told apart by the digest.

Texts are shuffled once, by bucket, and every step reads that exchange. Whole copies of a text with a smaller id are cut without any of
this. A bucket sends a window once however many of its documents hold it, so that a passage in a third of all documents costs a row a
bucket; windows over those rows spill and never stand in a Python task.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .recompression import anchors, window_hashes
from .words import Words, row_slices, tokenise

WINDOW = 13
#: Rounds of recompression and the words that an anchor covers at least. Each round takes two or three words off either end of what a
#: window's own words decide, so that a window of 13 has room for one.
ROUNDS, REACH = 1, 5
BUCKET_BYTES = 4 << 20
SLICE = 1 << 20
_COPY, _FOUND = 0, 1
#: Bits of a name beyond those that number the bytes of all texts.
NAME_BITS = 12
_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))


def bucket_of(buckets: int) -> Column:
    """A row's bucket, by its doc_id and its text: rows without an id, and rows of one id, don't come together."""
    return F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(buckets)).cast("int")


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def _digests(w: Words, at: np.ndarray, window: int) -> np.ndarray:
    """64 bits of the MD5 of each window's words, joined by one space, for the windows that start at these words."""
    raw, start, end = w.data.tobytes(), w.start.tolist(), w.end.tolist()
    words: dict[int, bytes] = {}

    def word(k: int) -> bytes:
        if k not in words:
            words[k] = raw[start[k] : end[k]]
        return words[k]

    digests = b"".join(hashlib.md5(b" ".join([word(j) for j in range(k, k + window)])).digest()[:8] for k in at.tolist())
    return np.frombuffer(digests, np.uint64)


def _firsts(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word, and text, of each window that lies inside one text."""
    counts = np.maximum(w.last - w.first - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return np.repeat(w.first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()), text


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("doc_id")
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()


def _copies(table: pa.Table, notes: pa.Table) -> np.ndarray:
    """Which rows are whole copies of a text with a smaller id."""
    notes = notes.filter(pc.equal(notes.column("kind"), _COPY))
    marks = set(zip(notes.column("doc").to_pylist(), notes.column("key").to_pylist(), strict=True))
    if not marks:
        return np.zeros(table.num_rows, bool)
    texts = (x or b"" for x in table.column("text").cast(pa.binary()).to_pylist())
    signed = ((h := xxhash.xxh64_intdigest(x, seed=42)) - (h >> 63 << 64) for x in texts)
    return np.fromiter(((i, h) in marks for i, h in zip(table.column("doc_id").to_pylist(), signed, strict=True)), bool, table.num_rows)


def _found(notes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that came back to the bucket, sorted with their checks, and their documents."""
    notes = notes.filter(pc.equal(notes.column("kind"), _FOUND))
    key, check = (notes.column(c).to_numpy().view(np.uint64) for c in ("key", "check"))
    order = np.lexsort((check, key))
    return key[order], check[order], notes.column("doc").fill_null(0).to_numpy()[order]


def _among(keys: np.ndarray, checks: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key with its check stands among the sorted ones, and whether it does."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    there = (keys[at] == key) & (checks[at] == check)
    other = np.flatnonzero((keys[at] == key) & ~there)
    while len(other):  # different windows of one key stand side by side
        other = other[at[other] + 1 < len(keys)]
        at[other] += 1
        other = other[keys[at[other]] == key[other]]
        there[other] = checks[at[other]] == check[other]
        other = other[~there[other]]
    return at, there


def _once(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key and check once, with its least document, and whether it has two documents or more."""
    order = np.lexsort((docs, checks, keys))
    keys, checks, docs, two = keys[order], checks[order], docs[order], two[order]
    new = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    first = np.flatnonzero(np.r_[True, new][: len(keys)])
    if not len(first):
        return keys, checks, docs, two
    last = np.r_[first[1:], len(keys)] - 1
    return keys[first], checks[first], docs[first], np.logical_or.reduceat(two, first) | (docs[first] != docs[last])


def _rows(bucket: int, parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    """key, check, doc, place: twice the bucket, and one more where two documents of it have the key."""
    keys, checks, docs, two = _once(*(np.concatenate([x, *own]) for x, *own in zip(_NOTHING, *parts, strict=True)))
    return pa.table({"key": pa.array(keys.view(np.int64)), "check": pa.array(checks.view(np.int64)), "doc": pa.array(docs, pa.int64()), "place": pa.array((2 * bucket + two).astype(np.int64))})


def _shared(rows: DataFrame) -> DataFrame:
    """bucket, key, check, doc, two, least of the keys of two documents or more: a row for each bucket that has the key, and the least document of all."""
    own, two = Window.partitionBy("key", "check"), F.col("place") % 2 == 1
    every = rows.withColumns({"least": F.min("doc").over(own), "most": F.max("doc").over(own), "any": F.max(two).over(own)})
    return every.where("any or least < most").select(F.floor(F.col("place") / 2).cast("int").alias("bucket"), "key", "check", "doc", two.alias("two"), "least")


def cut_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, reach: int = REACH, bucket_bytes: int = BUCKET_BYTES, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept: what is left of every text, its words joined by single spaces.

    A null or empty text has no words and keeps nothing. Windows are judged on the input. Two rows with one doc_id never cut each other;
    a row with a null doc_id is neither cut nor a reason to cut; both are dealt out by their texts, too, so that no bucket has all of them.
    Texts shorter than a window stay. An empty table gives no rows; only doc_id and text are read. bits: of names, as many as number all
    bytes and NAME_BITS more by default, so that the share of windows that a name proposes by chance is alike at every size; fewer propose
    more, and change no result, as 64 bits of the MD5 of a window's own words decide.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    bucket, bits = bucket_of(buckets).alias("bucket"), bits or min(64, size.bit_length() + NAME_BITS)

    digest = docs.where("doc_id is not null and text <> ''").select("doc_id", F.md5("text").alias("digest"), F.xxhash64("text").alias("key"))
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    copies = digest.join(first, "digest").where("doc_id > least").select(F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(_COPY).alias("kind"), "key", F.lit(0).cast("long").alias("check"), F.col("doc_id").alias("doc"))

    placed = docs.select(bucket, "doc_id", "text").groupBy("bucket")

    def send_anchors(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        skip, found = _copies(table, notes), []
        for part in row_slices(table.filter(pa.array(~skip)), SLICE):
            (ids, missing), w = _ids(part), tokenise(part.column("text"))
            start, anchor = anchors(w.hashes, w.first, w.last, window, rounds, reach)
            text = np.searchsorted(w.last, start, side="right")
            keep = ~missing[text]
            found.append(_once(_short(anchor, bits)[keep], np.zeros(keep.sum(), np.uint64), ids[text[keep]], np.zeros(keep.sum(), bool)))
        return _rows(key[0].as_py(), found)

    def send_windows(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        skip, found = _copies(table, notes), []
        keys, checks, _ = _found(notes)
        for part in row_slices(table.filter(pa.array(~skip)) if len(keys) else table.slice(0, 0), SLICE):
            (ids, missing), w = _ids(part), tokenise(part.column("text"))
            hashes = w.hashes
            start, anchor = anchors(hashes, w.first, w.last, window, rounds, reach)
            text = np.searchsorted(w.last, start, side="right")
            keep = _among(keys, checks, _short(anchor, bits), np.zeros(len(anchor), np.uint64))[1] & ~missing[text]
            at = start[keep]
            found.append(_once(_short(window_hashes(hashes, window), bits)[at], _digests(w, at, window), ids[text[keep]], np.zeros(len(at), bool)))
        return _rows(key[0].as_py(), found)

    def cut(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        keys, checks, least = _found(notes)
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for part in row_slices(table, SLICE):
            (ids, missing), w = _ids(part), tokenise(part.column("text"))
            start, text = _firsts(w, window)
            gone = np.zeros(len(w.start) + 1, np.int64)
            if len(keys) and len(start):
                name = _short(window_hashes(w.hashes, window), bits)[start]
                near = np.minimum(np.searchsorted(keys, name), len(keys) - 1)
                asked = np.flatnonzero((keys[near] == name) & ~missing[text])
                at, there = _among(keys, checks, name[asked], _digests(w, start[asked], window))
                there[there] = least[at[there]] < ids[text[asked[there]]]
                cut_at = start[asked[there]]
                np.add.at(gone, cut_at, 1)
                np.add.at(gone, cut_at + window, -1)
            keep = np.cumsum(gone)[:-1] == 0
            for copy, raw, a, b in zip(_copies(part, notes), part.column("text").cast(pa.binary()).to_pylist(), w.first, w.last, strict=True):
                if copy and b - a >= window:
                    keep[a:b] = False
                n = int(b - a - keep[a:b].sum())
                words = (raw or b"").split()
                out["kept"].append(b" ".join(compress(words, keep[a:b].tolist()) if n else words))
                out["n_words"].append(int(b - a))
                out["n_removed"].append(n)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.binary()).cast(pa.string())})

    def noted(rows: DataFrame, doc: Column) -> DataFrame:
        return rows.select("bucket", F.lit(_FOUND).alias("kind"), "key", "check", doc.alias("doc"))

    row = "key long, check long, doc long, place long"
    sent = placed.cogroup(copies.groupBy("bucket")).applyInArrow(send_anchors, row)
    notes = copies.unionByName(noted(_shared(sent), F.lit(None).cast("long")))
    sent = placed.cogroup(notes.groupBy("bucket")).applyInArrow(send_windows, row)
    late = noted(_shared(sent).where("two or doc > least"), F.col("least"))
    return placed.cogroup(copies.unionByName(late).groupBy("bucket")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
