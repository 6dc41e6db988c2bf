"""Token ids of a corpus as raw files with keyed access.

A store is a folder that Spark's own writers fill, so that tasks may fail and start anew and any store that Spark reaches will do:

* `kind=ids/shard=.../`: the ids of a shard's documents, one after another, as little-endian integers of 16 bits, or 32 where the
  vocabulary has more than 65,536 ids; each document ends with the end id. Shards and documents stand in ascending order of doc_id.
* `kind=keys/shard=.../`: for each document of the shard, in the same order, its doc_id, whether that is null, and its number of ids.
* `kind=index/group=.../`: a minimal perfect hash of the keys that fall in the group (perfect_hash.py) and, in the order of their numbers, a
  record each: fingerprint, shard, place in the shard, number of ids, ids of all documents before it, rows of that doc_id.
* `manifest/`: how ids are stored, how many groups, documents and ids there are. It is written last.

A key is a doc_id and which of its rows is meant, from 0; rows of one doc_id stand side by side. Every file ends with a line feed that isn't
part of it, and none outgrows a bound: SHARD_IDS ids and one document, SHARD_DOCS keys, GROUP_KEYS keys on average.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import staged
from .perfect_hash import PerfectHash
from .recompression import mix
from .words import row_slices, tokenise

TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Bytes of text of a range of doc_ids; ids and documents of a shard; keys of a group of the index.
PART_BYTES, SHARD_IDS, SHARD_DOCS, GROUP_KEYS = 32 << 20, 4 << 20, 65_536, 65_536
#: Text that is turned into arrays at a time, words after which a worker's cache starts anew, and words that are encoded at a time.
SLICE, CACHE_WORDS, TOGETHER = 2 << 20, 1 << 20, 128
_CHECK, _STEP, _PRINT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)
KEY = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
RECORD = np.dtype([("print", "<u4"), ("part", "<u4"), ("piece", "<u4"), ("n", "<u4"), ("at", "<u8"), ("start", "<u8"), ("rows", "<u8")])


@lru_cache(maxsize=2)
def _load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


class Encoder:
    """Ids of whole texts for tokenizers in whose ids white space has no part: a text's ids are those of its words, one after another. Words
    that a worker has met are looked up by two hashes; new ones are encoded TOGETHER at a time."""

    def __init__(self, tokenizer: str):
        self.tok = _load(public_tokenizers.path(tokenizer))
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has: by where in the joined words each id comes from."""
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            found = self.tok.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            own = np.searchsorted(starts, np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids)), side="right") - 1
            ids.append(np.array(found.ids, self.kind))
            sizes.append(np.bincount(own, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one row, the end id behind each text's, and how many each text has."""
        w = tokenise(texts)
        first, check = w.hashes, w.hashed(_CHECK)
        key, at, back = np.unique(first, return_index=True, return_inverse=True)
        odd = np.flatnonzero(check[at[back]] != check)  # another word of the same hash
        back[odd] = len(at) + np.arange(len(odd))
        at = np.r_[at, odd]
        if len(self.key) > CACHE_WORDS:
            self._forget()
        where = np.minimum(np.searchsorted(self.key, first[at]), max(len(self.key) - 1, 0))
        there = self.key[where] == first[at] if len(self.key) else np.zeros(len(at), bool)
        known = there & (self.check[where] == check[at]) if len(self.key) else there
        raw, fresh = w.data.tobytes(), np.flatnonzero(~known)
        ids, sizes = self._new([raw[a:b].decode() for a, b in zip(w.start[at[fresh]].tolist(), w.end[at[fresh]].tolist())])
        flat = np.concatenate([self.flat, ids])
        begin, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begin[known], size[known] = self.begin[where[known]], self.size[where[known]]
        begin[fresh], size[fresh] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        keep = fresh[(fresh < len(key)) & ~there[fresh]]
        into = np.searchsorted(self.key, first[at[keep]])
        self.key, self.check = np.insert(self.key, into, first[at[keep]]), np.insert(self.check, into, check[at[keep]])
        self.begin, self.size, self.flat = np.insert(self.begin, into, begin[keep]), np.insert(self.size, into, size[keep]), flat
        each = size[back]
        before = np.r_[0, np.cumsum(each)]
        out = flat[np.repeat(begin[back] - before[:-1], each) + np.arange(before[-1])]
        return np.insert(out, before[w.last], self.kind.type(end_id)), before[w.last] - before[w.first] + 1


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    """A worker's own, which keeps the words it has met from one task to the next."""
    return Encoder(tokenizer)


def hashed(ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A key's 64-bit hash. First rows of different ids never meet."""
    return mix(mix(np.where(null, 0, ids).astype(np.int64).view(np.uint64)) + (2 * nth + null).astype(np.uint64) * _STEP)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _PRINT) >> np.uint64(32)).astype("<u4")


def _text(df: DataFrame, path: str, *by: str) -> None:
    """Writes the bytes in body, a file for each value of `by`."""
    df.select(*by, F.col("body").cast("string")).write.mode("append").partitionBy(*by).option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str, kind: str, key: str, key_type: str) -> DataFrame:
    """key, content of the files of a kind; their line feed is still there."""
    return spark.read.format("binaryFile").load(f"{path}/kind={kind}").select(F.col(key).cast(key_type).alias(key), "content")


def _ids_of(table: pa.Table | pa.RecordBatch, name: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name)
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, part_bytes: int = PART_BYTES, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS, group_keys: int = GROUP_KEYS) -> dict:
    """Writes a store of docs' whole texts to a new folder and returns its manifest.

    tokenizer: one in whose ids white space has no part. A null or empty text has its end id only. Documents stand in ascending order of
    doc_id, null first; rows that repeat a doc_id stand side by side and are keys of their own, however many they are: ranges are cut
    inside a doc_id, too. An empty table gives a store without files. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    kind = Encoder(tokenizer).kind
    manifest = {"tokenizer": tokenizer, "end_id": end_id, "bytes": kind.itemsize, "documents": count, "groups": max(1, math.ceil(count / group_keys)), "ids": 0}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, piece = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bodies, keys, n_ids, n_docs = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            name = f"p{part:08d}s{piece:06d}"
            return pa.RecordBatch.from_arrays([pa.array(["ids", "keys"]), pa.array([name, name]), pa.array([b"".join(bodies), b"".join(keys)], pa.binary())], ["kind", "shard", "body"])

        for batch in batches:
            for rows in row_slices(batch, SLICE):
                ids, sizes = own.encode(rows.column("text"), end_id)
                who, null = _ids_of(rows)
                key = np.zeros(len(sizes), KEY)
                key["id"], key["null"], key["n"] = who, null, sizes
                upto, at = np.cumsum(sizes), 0
                while at < len(sizes):
                    begin = upto[at] - sizes[at]
                    end = min(int(np.searchsorted(upto, begin + shard_ids - n_ids, side="right")), at + shard_docs - n_docs, len(sizes))
                    if end <= at and n_docs:  # the next document goes to a new shard
                        yield shard()
                        piece, bodies, keys, n_ids, n_docs = piece + 1, [], [], 0, 0
                        continue
                    end = max(end, at + 1)
                    bodies.append(ids[begin : upto[end - 1]].tobytes())
                    keys.append(key[at:end].tobytes())
                    n_ids, n_docs, at = n_ids + int(upto[end - 1] - begin), n_docs + end - at, end
        if n_docs:
            yield shard()

    if count:
        parts = max(1, math.ceil((size or 0) / part_bytes))
        rows = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
        _text(rows.select("doc_id", "text").mapInArrow(encode, "kind string, shard string, body binary"), path, "kind", "shard")
        manifest["ids"] = _write_index(spark, path, manifest["groups"])
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def _ends(spark: SparkSession, path: str) -> DataFrame:
    """shard, ids, start, carry, first_rows, last_rows: of each shard, its ids and those before it, how many rows of its first doc_id stand in
    shards before it, and how many rows its first and its last doc_id have in all shards."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
                key = np.frombuffer(content, KEY, (len(content) - 1) // KEY.itemsize)
                runs = _runs(key)
                which = [0] if len(runs) == 2 else [0, len(runs) - 2]
                out = [(shard, int(key["n"].sum(dtype=np.int64)), k > 0, None if key["null"][runs[k]] else int(key["id"][runs[k]]), int(runs[k + 1] - runs[k])) for k in which]
                yield pa.RecordBatch.from_arrays([pa.array(x) if i != 3 else pa.array(x, pa.int64()) for i, x in enumerate(zip(*out, strict=True))], ["shard", "ids", "last", "doc_id", "n"])

    ends = staged(_files(spark, path, "keys", "shard", "string").mapInArrow(summary, "shard string, ids long, last boolean, doc_id long, n long"), "ends")
    order = Window.partitionBy("doc_id").orderBy("shard", "last")
    ends = ends.withColumn("carry", F.sum("n").over(order) - F.col("n")).withColumn("rows", F.sum("n").over(Window.partitionBy("doc_id")))
    shards = ends.groupBy("shard").agg(F.max("ids").alias("ids"), F.min(F.when(~F.col("last"), F.col("carry"))).alias("carry"), F.min(F.when(~F.col("last"), F.col("rows"))).alias("first_rows"), F.max_by("rows", "last").alias("last_rows"))
    return shards.withColumn("start", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids"))  # a row for each shard


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of rows with one doc_id begins, and the end."""
    new = (key["id"][1:] != key["id"][:-1]) | (key["null"][1:] != key["null"][:-1])
    return np.r_[0, np.flatnonzero(new) + 1, len(key)]


def _write_index(spark: SparkSession, path: str, groups: int) -> int:
    """Writes the index over the keys' files and returns how many ids there are."""
    ends = staged(_ends(spark, path), "shards")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = np.frombuffer(row["content"], KEY, (len(row["content"]) - 1) // KEY.itemsize)
                runs = _runs(key)
                size = np.diff(runs)
                rows = size.copy()
                rows[-1], rows[0] = row["last_rows"], row["first_rows"]
                nth = np.arange(len(key)) - np.repeat(runs[:-1], size)
                nth[: size[0]] += row["carry"]
                hashes = hashed(key["id"], key["null"] > 0, nth)
                n = key["n"].astype(np.int64)
                at = np.cumsum(n) - n
                part, piece = (int(x) for x in row["shard"][1:].split("s"))
                columns = [hashes % np.uint64(groups), hashes.view(np.int64), np.full(len(key), part), np.full(len(key), piece), n, at, at + row["start"], np.repeat(rows, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["group", "key", "part", "piece", "n", "at", "start", "rows"])

    def build(key, table):
        hashes = table.column("key").to_numpy().view(np.uint64)
        perfect = PerfectHash.of(hashes)
        records = np.zeros(len(hashes), RECORD)
        numbers = perfect.numbers(hashes)
        if len(np.unique(numbers)) < len(numbers):
            raise ValueError("two keys of one hash")
        records["print"][numbers] = _prints(hashes)
        for name in ("part", "piece", "n", "at", "start", "rows"):
            records[name][numbers] = table.column(name).to_numpy()
        return pa.table({"kind": ["index"], "group": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([perfect.dump() + records.tobytes()], pa.binary())})

    keys = _files(spark, path, "keys", "shard", "string").join(ends, "shard")
    places = keys.mapInArrow(place, "group long, key long, part long, piece long, n long, at long, start long, rows long")
    _text(places.groupBy("group").applyInArrow(build, "kind string, group long, body binary"), path, "kind", "group")
    return ends.agg(F.sum("ids")).first()[0]


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def _look(body: bytes | memoryview, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records of keys in a group of the index, and which keys it has."""
    perfect, at = PerfectHash.load(body)
    records = np.frombuffer(body, RECORD, perfect.placed + len(perfect.rest), at)
    numbers = perfect.numbers(keys)
    found = records[np.maximum(numbers, 0)] if len(records) else np.zeros(len(keys), RECORD)
    return found, (numbers >= 0) & (found["print"] == _prints(keys))


def locate(asked: DataFrame, path: str, groups: int) -> DataFrame:
    """doc_id, nth, shard, n, at, start, rows of the keys (doc_id, nth) that the store has, each asked for once.

    Only keys and the index move; a group's keys meet its part of the index in one task.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = hashed(*_ids_of(batch), batch.column("nth").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((key % np.uint64(groups)).astype(np.int64)), pa.array(key.view(np.int64))], ["doc_id", "nth", "group", "key"])

    def look(_, keys: pa.Table, index: pa.Table) -> pa.Table:
        if not keys.num_rows or not index.num_rows:
            keys, found = keys.slice(0, 0), np.zeros(0, RECORD)
        else:
            found, there = _look(memoryview(index.column("content")[0].as_buffer()), keys.column("key").to_numpy().view(np.uint64))
            keys, found = keys.filter(pa.array(there)), found[there]
        names = [f"p{part:08d}s{piece:06d}" for part, piece in zip(found["part"].tolist(), found["piece"].tolist(), strict=True)]
        return pa.table({"doc_id": keys.column("doc_id"), "nth": keys.column("nth"), "shard": pa.array(names, pa.string()), **{c: pa.array(found[c].astype(np.int64)) for c in ("n", "at", "start", "rows")}})

    keys = asked.select("doc_id", "nth").mapInArrow(dealt, "doc_id long, nth long, group long, key long")
    index = _files(asked.sparkSession, path, "index", "group", "long")
    return keys.groupBy("group").cogroup(index.groupBy("group")).applyInArrow(look, "doc_id long, nth long, shard string, n long, at long, start long, rows long")


def fetch(keys: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, nth, start, n_tokens, ids_crc32, and ids, of every document of the store whose doc_id is among those of `keys`.

    A doc_id that the store doesn't have gives no row, but for a chance of one in 2^32 that its fingerprint is another's; one that it has
    several times gives as many; one that is asked for repeatedly counts once, null like any other. start: ids of all documents before it.
    ids_crc32: CRC-32 of the ids as little-endian integers of 32 bits, unsigned.
    """
    spark = keys.sparkSession
    schema = "doc_id long, nth long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    manifest = manifest_of(spark, path)
    if not manifest["documents"]:
        return spark.createDataFrame([], schema)
    kind = np.dtype(f"<u{manifest['bytes']}")
    first = staged(locate(keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("nth", F.lit(0).cast("long")), path, manifest["groups"]), "places")
    again = first.where("rows > 1").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows") - 1)).alias("nth"))
    places = first.unionByName(locate(again, path, manifest["groups"])) if not again.isEmpty() else first

    def cut(_, wanted: pa.Table, files: pa.Table) -> pa.Table:
        body = memoryview(files.column("content")[0].as_buffer()) if wanted.num_rows else b""
        at, n = (wanted.column(c).to_numpy() for c in ("at", "n"))
        found = [np.frombuffer(body, kind, k, i * kind.itemsize) for i, k in zip(at.tolist(), n.tolist(), strict=True)]
        out = {c: wanted.column(c) for c in ("doc_id", "nth", "start")} | {"n_tokens": pa.array([len(x) for x in found], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())}
        if with_ids:
            ends = np.r_[0, np.cumsum(n)].astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)))
        return pa.table(out)

    files = _files(spark, path, "ids", "shard", "string").join(places.select("shard").distinct(), "shard", "left_semi")
    return places.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(cut, schema)


class Reader:
    """Keyed access without Spark: for a key, a part of its group's file and its ids' place in a shard, whatever the store holds."""

    def __init__(self, path: str, groups_kept: int = 16):
        self.fs, self.root = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
        self.manifest = json.loads(self._open("manifest").read())
        self.kind = np.dtype(f"<u{self.manifest['bytes']}")
        self._group = lru_cache(groups_kept)(self._load_group)

    def _open(self, folder: str) -> pa.NativeFile:
        files = [f.path for f in self.fs.get_file_info(pa.fs.FileSelector(f"{self.root}/{folder}")) if f.base_name.startswith("part-")]
        return self.fs.open_input_file(files[0])

    def _load_group(self, group: int) -> bytes:
        try:
            with self._open(f"kind=index/group={group}") as f:
                return f.read()
        except FileNotFoundError:  # no key fell in it
            return b""

    def _record(self, doc_id: int | None, nth: int):
        key = hashed(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([nth]))
        group = self._group(int(key[0] % np.uint64(self.manifest["groups"])))
        found, there = _look(group, key) if group else (None, [False])
        return found[0] if there[0] else None

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row of a doc_id; none for one that the store doesn't have."""
        first = self._record(doc_id, 0) if self.manifest["documents"] else None
        out = []
        for nth in range(int(first["rows"]) if first is not None else 0):
            r = self._record(doc_id, nth)
            with self._open(f"kind=ids/shard=p{r['part']:08d}s{r['piece']:06d}") as f:
                f.seek(int(r["at"]) * self.kind.itemsize)
                out.append(np.frombuffer(f.read(int(r["n"]) * self.kind.itemsize), self.kind))
        return out
