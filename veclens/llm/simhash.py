"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are grouped into tiles by the population counts of their halves. Two fingerprints within the radius differ by no more than
the radius in those counts, so most tile pairs need no comparison; the others are compared whole, by numpy exclusive-or and bit counts.
A tile pair returns a spanning forest of its links rather than all of them: components stay the same, and a group of thousands of near
copies doesn't return the square of its size.

Where a similarity of shingles is asked for, a radius well beyond it only gathers candidates; each group of them is then compared by the
shingle sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, staged
from .components import components
from .recompression import mix

#: Fingerprints in a block of a tile, about.
BLOCK = 4096
#: Rows of either side that are compared at a time: few, so that what is counted stays in a core's cache.
STRIP, WIDE = 64, 4096
#: Bands of set sizes from one size to the greatest that may be alike.
BANDS = 4
#: Pieces of up to 255 hashes whose bits are counted at a time.
PIECES = 1 << 11
#: Shingles of a group of candidates that are compared at a time, about.
GROUP_SHINGLES = 1 << 18
#: The least Jaccard similarity of near copies, as a fraction.
ALIKE = (4, 5)
SEED = 42
_STEP = 0x9E3779B97F4A7C15
_LANES = 0x0101010101010101


def _bits_over_half(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per run of hashes (ends: where each ends), the fingerprint whose bits are set in over half of them."""
    counts = np.diff(ends, prepend=0)
    pieces = -(-counts // 255)  # a byte holds what a piece counts for a bit, so eight bits are counted in one sum
    run = np.repeat(np.arange(len(ends)), pieces)
    at = (ends - counts)[run] + 255 * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.zeros(len(ends), np.uint64)
    if not len(at):
        return out
    set_ = np.empty((8, len(at), 8), np.uint8)
    for k in range(0, len(at), PIECES):  # long texts in parts
        own = at[k : k + PIECES]
        part = hashes[own[0] : at[k + PIECES] if k + PIECES < len(at) else len(hashes)]
        for bit in range(8):
            set_[bit, k : k + PIECES] = np.add.reduceat(part >> np.uint64(bit) & np.uint64(_LANES), own - own[0]).view(np.uint8).reshape(-1, 8)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    some = run[first]
    for bit in range(8):
        over = 2 * np.add.reduceat(set_[bit], first, axis=0, dtype=np.int64) > counts[some, None]
        for byte in range(8):
            out[some] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, A-Z lower-cased; one of all its words where they are fewer than a shingle."""
    words = text.lower().split()  # bytes: only ASCII letters and ASCII white space count
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, len(grams))


def fingerprints(docs: DataFrame, shingle: int = 3, words64: int = 1, sets: bool = False) -> DataFrame:
    """doc_id and fp_0..: SimHashes of the word shingles of every whole text, 64 bits a column.

    A-Z are lower-cased; a text of fewer words than a shingle has one shingle of all its words; a null text or one without words has
    fingerprint zero. Repeated rows and null ids are kept as they are. The first 64 bits are those of XXH64, further ones of its scrambled
    values. An empty table has none. sets: each shingle of a text counts once, and print, a hash of the set, and n, its size, come with it.
    """
    names = [f"fp_{i}" for i in range(words64)]
    more = ["print", "n"] if sets else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches):
            hashes = [_shingle_hashes(text, shingle) for text in texts]
            if sets:
                hashes = [np.unique(x) for x in hashes]
            size = np.array(list(map(len, hashes)), np.int64)
            first, ends = np.concatenate(hashes), np.cumsum(size)
            sums = [_bits_over_half(mix(first + np.uint64(i * _STEP % (1 << 64))) if i else first, ends) for i in range(words64)]
            known = [np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=SEED) for x in hashes], np.uint64), size] if sets else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.view(np.int64)) for x in [*sums, *known])], ["doc_id", *names, *more])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in [*names, *more])]))


def _halves(words64: int) -> list[Column]:
    """Population counts of the two halves of a fingerprint."""
    if words64 == 1:
        return [F.bit_count(F.col("fp_0").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("fp_0", 32))]
    cut = words64 // 2
    return [sum((F.bit_count(f"fp_{i}") for i in part), F.lit(0)) for part in (range(cut), range(cut, words64))]


def _forest(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, radius: int, same: bool, quick: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs of a and b (rows of uint64) that differ in at most `radius` bits.

    quick: first words, and the most bits in which those may differ, for the others to be compared at all.
    """
    words, most = quick or (a.shape[1], radius)
    n = len(a)
    label = np.arange(n + (0 if same else len(b)))
    shift = 0 if same else n
    found: list[tuple[int, int]] = []
    columns = np.ascontiguousarray(b[:, :words].T)
    for start in range(0, n, STRIP):
        strip, near = a[start : start + STRIP], []
        for first in range(start if same else 0, len(b), WIDE):
            far = np.bitwise_count(strip[:, 0, None] ^ columns[0, None, first : first + WIDE]).astype(np.uint8 if words < 4 else np.uint16, copy=False)
            for k in range(1, words):
                far += np.bitwise_count(strip[:, k, None] ^ columns[k, None, first : first + WIDE])
            x, y = np.nonzero(far <= most)
            near.append((x + start, y + first))
        x, y = map(np.concatenate, zip(*near, strict=True))
        if words < a.shape[1]:
            close = np.bitwise_count(a[x] ^ b[y]).sum(axis=1) <= radius
            x, y = x[close], y[close]
        y += shift
        while len(x):
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if not len(x):
                break
            one = np.unique(x, return_index=True)[1]  # one link of each row at a time
            for i, j in zip(x[one].tolist(), y[one].tolist(), strict=True):
                p, q = label[i], label[j]
                if p != q:
                    found.append((i, j))
                    label[label == max(p, q)] = min(p, q)
    ids = ids_a if same else np.r_[ids_a, ids_b]
    root = ids.copy()  # each component as a star around its smallest id
    np.minimum.at(root, label, ids)
    return [(int(ids[i]), int(root[label[i]])) for i in sorted({i for pair in found for i in pair}) if ids[i] != root[label[i]]]


def links(uniq: DataFrame, radius: int, words64: int = 1, block: int = BLOCK, width: int | None = None, quick: tuple[int, int] | None = None, alike: tuple[int, int] | None = None) -> DataFrame:
    """(a, b) of node ids: links that connect just what links of `radius` bits or fewer connect. uniq: node, fp_0.., each fingerprint once.

    No rows, and a single one, have no links. width: population counts in a band that share a tile; 1 where the radius is small enough to skip tiles.
    alike: only sets of such a Jaccard similarity or more are to be linked, n being their sizes. Tiles are then bands of sizes, as one set
    holds at least that share of the other's size; those further apart aren't compared.
    """
    width = width or max(1, radius // 4)
    fps = [f"fp_{i}" for i in range(words64)]
    gap = lambda d: max(0, (abs(d) - 1) * width + 1) if d else 0  # noqa: E731  the least difference of counts in bands d apart
    if alike:
        bands = (1 - 1e-9) * BANDS / math.log(alike[1] / alike[0])  # a little wider, so that rounding parts none that may be alike
        p1, p2, near = F.floor(F.log(F.greatest("n", F.lit(1))) * bands), F.lit(0), [(d, 0) for d in range(BANDS + 1)]
    else:
        p1, p2 = (F.floor(h / width) for h in _halves(words64))
        most = (32 * words64) // width + 1
        near = [(d1, d2) for d1 in range(0, most + 1) for d2 in range(-most, most + 1) if (d1, d2) >= (0, 0) and gap(d1) + gap(d2) <= radius]
    tiled = uniq.select("node", *fps, p1.cast("int").alias("p1"), p2.cast("int").alias("p2"))
    # few rows, whatever the input: a fingerprint has no other population counts, and sizes grow by a factor from band to band
    tiles = tiled.groupBy("p1", "p2").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    blocks = (
        tiled.join(F.broadcast(tiles), ["p1", "p2"])
        .withColumn("part", F.pmod(F.xxhash64(*fps), F.col("parts")).cast("int"))
        .groupBy("p1", "p2", "part")
        .agg(F.collect_list(F.struct("node", *fps)).alias("rows"))
    )
    blocks = staged(blocks.withColumn("salt", F.xxhash64("p1", "p2", "part")), "tiles")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2")) for a, b in near)))
    pairs = (
        blocks.select("p1", "p2", "part", steps.alias("d"))
        .select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("part").alias("a3"), (F.col("p1") + F.col("d.d1")).alias("p1"), (F.col("p2") + F.col("d.d2")).alias("p2"))
        .join(F.broadcast(tiles), ["p1", "p2"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("p1 <> a1 or p2 <> a2 or part >= a3")
    )
    left = blocks.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("part").alias("a3"), F.col("rows").alias("x"))
    right = blocks.select("p1", "p2", "part", F.col("rows").alias("y"))
    both = pairs.join(left, ["a1", "a2", "a3"]).join(right, ["p1", "p2", "part"]).select("x", "y", (F.expr("p1 = a1 and p2 = a2 and part = a3")).alias("same"))

    def unpack(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
        rows = column.slice(i, 1).flatten()
        fields = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
        return np.stack([fields[f].to_numpy(zero_copy_only=False).view(np.uint64) for f in fps], axis=1), fields["node"].to_numpy(zero_copy_only=False)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, ids_a = unpack(batch.column(0), i)
                same = batch.column(2)[i].as_py()
                b, ids_b = (a, ids_a) if same else unpack(batch.column(1), i)
                out = _forest(a, b, ids_a, ids_b, radius, same, quick)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, words64: int = 1, block: int = BLOCK, quick: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, fp_0.., component_id of every document: the smallest doc_id that links of `radius` differing bits reach, itself included.

    Documents without words share fingerprint zero and are linked like any other. Equal texts have equal fingerprints and so fall into
    one node before any comparison. Rows with a null doc_id have a fingerprint, link nothing, and have a null component_id. An empty
    table gives an empty result. Columns other than doc_id and text are not read.
    """
    fps = [f"fp_{i}" for i in range(words64)]
    marked = staged(fingerprints(docs, shingle, words64), "fingerprints")
    uniq = marked.where("doc_id is not null").groupBy(*fps).agg(F.min("doc_id").alias("node"))
    uniq = staged(uniq, "nodes")
    reach = components(links(uniq, radius, words64, block, quick=quick))
    node = uniq.join(reach, "node", "left").select(*fps, F.coalesce("component", "node").alias("component_id"))
    return marked.join(node, fps, "left").select("doc_id", *fps, F.expr("if(doc_id is null, null, component_id)").alias("component_id"))


def _alike(values: np.ndarray, sizes: np.ndarray, ids: np.ndarray, alike: tuple[int, int] = ALIKE) -> list[tuple[int, int]]:
    """Links that connect just what pairs of sets of a Jaccard similarity of `alike` or more connect. values: the sets, one after another."""
    codes = np.unique(values, return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    label = np.arange(len(sizes))
    for i in range(len(sizes) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[codes[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        mark[mine] = False
        near = np.flatnonzero(alike[1] * both >= alike[0] * (sizes[i] + sizes[i + 1 :] - both)) + i + 1
        if len(near):
            met = np.unique(label[np.r_[i, near]])
            label[np.isin(label, met)] = met[0]
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, label, ids)
    return sorted({(int(x), int(y)) for x, y in zip(ids, root[label], strict=True) if x != y})


def alike_links(docs: DataFrame, groups: DataFrame, shingle: int, most: int = GROUP_SHINGLES) -> DataFrame:
    """(a, b) of doc_ids: links that connect what pairs of alike shingle sets within a group connect. groups: node (a doc_id), n, group.

    All pairs of a group are compared, group by group; a large group in parts, each pair of parts by itself. No groups give no links; rows
    that repeat a doc_id and text count once.
    """
    sizes = groups.groupBy("group").agg(F.ceil(F.sum("n") / most).cast("int").alias("parts"))
    members = groups.join(sizes, "group").select(F.col("node").alias("doc_id"), "group", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select("doc_id", "group", "parts", "part", "text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in in_slices(batches):
            sets = [np.unique(_shingle_hashes(text, shingle)) for text in rows]
            own = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(list(map(len, sets)))].astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], own], ["node", "group", "parts", "part", "items"])
            yield out.filter(pa.array([len(x) > 0 for x in sets]))

    sets = texts.mapInArrow(collect, "node long, group long, parts int, part int, items array<long>")
    blocks = staged(sets.groupBy("group", "parts", "part").agg(F.collect_list(F.struct("node", "items")).alias("rows")), "sets")
    alone = blocks.where("parts = 1").select(F.col("rows").alias("x"), F.slice("rows", 1, 0).alias("y"))
    many = blocks.where("parts > 1")
    left = many.select("group", F.col("rows").alias("x"), F.explode(F.expr("sequence(part, parts - 1)")).alias("part"), F.col("part").alias("own"))
    both = left.join(many.select("group", "part", F.col("rows").alias("y")), ["group", "part"])
    both = both.select("x", F.when(F.col("own") == F.col("part"), F.slice("y", 1, 0)).otherwise(F.col("y")).alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.concat_arrays([batch.column(k).slice(i, 1).flatten() for k in (0, 1)])
                fields = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
                size = pc.list_value_length(fields["items"]).to_numpy(zero_copy_only=False).astype(np.int64)
                out = _alike(fields["items"].flatten().to_numpy(zero_copy_only=False), size, fields["node"].to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return alone.unionByName(both).mapInArrow(compare, "a long, b long")


def copies(docs: DataFrame, shingle: int = 5, words64: int = 10, radius: int = 170, quick: tuple[int, int] = (2, 48), block: int = 4 * BLOCK, most: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, component_id of every document with an id: the smallest doc_id that pairs of shingle sets of Jaccard similarity 0.8 or more reach.

    Fingerprints only gather candidates: of two sets of that similarity about 15 bits in a hundred differ, at most 19 (four shingles of
    five), so 170 of 640, and 48 of the first 128, are five standard deviations and more beyond. Only sets whose sizes allow that similarity
    are compared. What they connect is compared whole, set by set. Equal sets are one node; texts without words are equal. Rows that share one doc_id are one document.
    """
    fps = [f"fp_{i}" for i in range(words64)]
    marked = staged(fingerprints(docs, shingle, words64, sets=True).where("doc_id is not null"), "fingerprints")
    uniq = staged(marked.groupBy("print", "n", *fps).agg(F.min("doc_id").alias("node")), "nodes")
    reach = components(links(uniq, radius, words64, block, quick=quick, alike=ALIKE)).withColumnRenamed("component", "group")
    groups = staged(uniq.groupBy("node").agg(F.sum("n").alias("n")).join(reach, "node"), "groups")
    equal = marked.join(uniq.select("print", "n", *fps, "node"), ["print", "n", *fps]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    reach = components(alike_links(docs, groups, shingle, most).unionByName(equal.where("a <> b")))
    return marked.select("doc_id").distinct().join(reach.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without near copies: of each component the row of the smallest doc_id stays, with all its columns.

    Near copies are texts whose sets of shingles have a Jaccard similarity of 0.8 or more. Rows with a null doc_id stay; rows that share
    one doc_id are one document and stay or go together. Null and empty texts have the same, empty, set and so are copies of each other; an
    empty table stays empty. Other columns, whatever their names, stay as they are.
    """
    gone = copies(docs, shingle).where("component_id < doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def hexadecimal(column: str = "fp_0") -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
