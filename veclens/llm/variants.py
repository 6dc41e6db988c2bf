"""Spelling variants: words of a corpus that one code point apart from another word, found through an index of variable-length grams.

1. **Words.** Runs of letters are counted in each task before the shuffle.
2. **Gram dictionary.** Grams of 2 to LONGEST code points are counted over the words, both ends marked. A gram is in the dictionary if it
   has two code points or if the gram without its last one is frequent: frequent grams are told apart by longer ones, rare ones stay short.
3. **Decomposition.** At each place of a word stands the longest dictionary gram that starts there. Which gram that is depends on the code
   points it covers and, where it could have gone on, on the one after; those are its window.
4. **Affected grams.** One edit changes only grams whose window it touches. The most that any one edit of a word touches is the word's
   own bound b; all other grams are in the edited word too, moved by at most one place. So of the b + 1 rarest grams of either word one is
   shared, and only these rarest grams' lists are merged, by gram, place and length. With LONGEST no greater than the shortest word's
   length, b is less than the number of grams, so no word falls outside the bound.
5. **Verify.** Pairs from the lists are kept if their edit distance is exactly one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .words import Words, column_of, row_slices, tokenise

#: Shortest and longest gram in code points. Words shorter than LONGEST can't be indexed.
SHORTEST, LONGEST = 2, 5
#: Grams in the dictionary, which is broadcast, at most, besides those of two code points; lists of no more words than PRUNE aren't cut up.
DICTIONARY, PRUNE = 262_144, 16
#: Parts of a power of two in which frequencies are compared when the dictionary is bounded.
_STEPS = 8
#: Marks of a word's two ends; neither is a letter.
_FIRST, _LAST = "^", "$"
SLICE = 1 << 20


def _crc_table() -> np.ndarray:
    """The step of each byte in CRC-32, by its reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32_of(w: Words, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes, carried on from the CRC-32 `before` it."""
    c, size = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), w.end - w.start
    at, k = np.flatnonzero(size > 0), 0
    while len(at):
        c[at] = _CRC[(c[at] ^ w.data[w.start[at] + k]) & np.uint32(0xFF)] ^ (c[at] >> np.uint32(8))
        k += 1
        at = at[size[at] > k]
    return c ^ np.uint32(0xFFFFFFFF)


def _damaged(w: Words, ids: list, modulus: int) -> tuple[np.ndarray, list[bytes]]:
    """Which runs lose a code point, and what is left of each of these."""
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = crc32_of(w, np.repeat(prefix, w.last - w.first))
    hit = np.flatnonzero(crc % np.uint32(modulus) == 0)
    out = []
    for i in hit:
        run = w.data[w.start[i] : w.end[i]].tobytes().decode()
        at = int(crc[i]) % len(run)
        out.append((run[:at] + run[at + 1 :]).encode())
    return hit, out


def word_counts(docs: DataFrame, modulus: int | None = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n: runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of least_length code points and least_count
    occurrences or more over whole texts.

    modulus: a run whose CRC-32 with its doc_id, `<doc_id>:<run>`, is divisible by it loses one code point, which makes variants to find;
    None: none does. A null doc_id is written as nothing. Within a slice of text, runs are told apart by 64-bit hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, SLICE):
                w = tokenise(part.column("text"), lower=True, letters=True)
                hit, changed = _damaged(w, part.column("doc_id").to_pylist(), modulus) if modulus else (np.zeros(0, np.int64), [])
                leads = np.r_[0, np.cumsum(w.data == 0xC3)]
                keep = w.end - w.start - (leads[w.end] - leads[w.start]) >= least_length
                keep[hit] = False
                at = np.flatnonzero(keep)
                _, first, n = np.unique(w.hashes[at], return_index=True, return_counts=True)
                changed = [x for x in changed if len(x.decode()) >= least_length]
                words = pa.concat_arrays([column_of(w.data, w.start[at[first]], w.end[at[first]]), pa.array(changed, pa.binary())])
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.r_[n, np.ones(len(changed))].astype(np.int64))], ["word", "n"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def dictionary(words: DataFrame, longest: int = LONGEST, most: int = DICTIONARY, prune: int = PRUNE) -> dict[str, tuple[int, bool]]:
    """gram -> its frequency over the words, and whether longer grams go on from it.

    A gram goes on if it is more frequent than a limit: `prune`, or as much more as keeps the grams of three code points and more to `most`.
    """
    marked = F.concat(F.lit(_FIRST), "word", F.lit(_LAST))
    size = F.char_length("s")
    of = lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring("s", i, F.lit(k)))
    grams = F.flatten(F.array(*map(of, range(SHORTEST, longest + 1))))
    counts = staged(words.select(marked.alias("s")).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "grams")
    # children of each gram by steps of its frequency: at most 64 * _STEPS rows come to the driver
    longer = counts.where(F.char_length("gram") > SHORTEST).groupBy(F.expr("left(gram, char_length(gram) - 1)").alias("gram")).agg(F.count("*").alias("children"))
    parents = longer.join(counts, "gram")
    step = F.floor(F.log2("n") * _STEPS).cast("int")
    limit, total = prune, 0
    for r in parents.groupBy(step.alias("step")).agg(F.sum("children").alias("children"), F.max("n").alias("n")).orderBy(F.desc("step")).collect():
        total += r.children
        if total > most:
            limit = max(prune, r.n)
            break
    onward = parents.where(F.col("n") > limit).select(F.col("gram").alias("parent"))
    short = counts.where(F.char_length("gram") == SHORTEST)
    deep = counts.where(F.char_length("gram") > SHORTEST).withColumn("parent", F.expr("left(gram, char_length(gram) - 1)")).join(onward, "parent", "left_semi")
    kept = short.unionByName(deep.select("gram", "n")).toArrow()  # bounded: pairs of letters, and `most`
    longest_is = pc.equal(pc.utf8_length(kept.column("gram")), longest)
    inner = pc.and_(pc.greater(kept.column("n"), limit), pc.invert(longest_is))
    return dict(zip(kept.column("gram").to_pylist(), zip(kept.column("n").to_pylist(), inner.to_pylist(), strict=True), strict=True))


def decompose(word: str, grams: dict[str, tuple[int, bool]]) -> list[tuple[int, str, int]]:
    """place, gram, end of its window (exclusive), at each place of the word between its marks. The word is one of those that the dictionary
    was made from."""
    s = f"{_FIRST}{word}{_LAST}"
    out = []
    for p in range(len(s) - 1):
        end = p + SHORTEST
        inner = grams[s[p:end]][1]
        while inner and end < len(s):
            end += 1
            inner = grams[s[p:end]][1]
        out.append((p, s[p:end], min(end + inner, len(s))))
    return out


def affected(parts: list[tuple[int, str, int]]) -> int:
    """The most grams whose window one edit touches: an edit at a place touches the windows that hold it."""
    edge = [0] * (len(parts) + 2)
    for p, _, end in parts:
        edge[max(p, 1)] += 1  # the first mark stays
        edge[end] -= 1
    most = at = 0
    for x in edge:
        at += x
        most = max(most, at)
    return most


def rarest(word: str, grams: dict[str, tuple[int, bool]]) -> list[tuple[int, str, int]]:
    """The grams of a word whose lists are merged: one more than an edit can touch, rarest first, ties by gram and place."""
    parts = decompose(word, grams)
    return sorted(parts, key=lambda x: (grams[x[1]][0], x[1], x[0]))[: affected(parts) + 1]


def near_pairs(words: DataFrame, longest: int = LONGEST, most: int = DICTIONARY, prune: int = PRUNE) -> DataFrame:
    """a, a_n, b, b_n: every two words whose edit distance is one, once, the shorter first, or the lesser of the same length.

    words: word, n, each word once and none shorter than `longest` code points.
    """
    spark = words.sparkSession
    grams = spark.sparkContext.broadcast(dictionary(words, longest, most, prune))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grams.value
        for batch in batches:
            place, gram, row, size = [], [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                for p, g, _ in rarest(word, own):
                    place.append(p)
                    gram.append(g)
                    row.append(i)
                    size.append(len(word))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(place, pa.int32()), pa.array(size, pa.int32()), batch.column("word").take(at), batch.column("n").take(at)], ["gram", "place", "size", "word", "n"])

    lists = staged(words.select("word", "n").mapInArrow(post, "gram string, place int, size int, word string, n long"), "lists")
    moved = F.explode(F.array(*(F.struct((F.col("place") + p).alias("place"), (F.col("size") + k).alias("size")) for p, k in ((0, 0), (0, 1), (1, 1)))))
    ask = lists.select("gram", moved.alias("to"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size")).select("gram", "to.place", "to.size", "a", "a_n", "a_size")
    both = ask.join(lists.withColumnsRenamed({"word": "b", "n": "b_n"}), ["gram", "place", "size"]).where("a_size < size or a < b")
    return both.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame, greatest: int, factor: int) -> DataFrame:
    """word, root of every word that has a form. A form is `factor` times as frequent, so that a chain has at most log(greatest) links, and
    each round doubles what it follows."""
    links = max(1, math.ceil(math.log(max(greatest, 2), factor))) if factor > 1 else 64
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(links + 1)))):
        at = staged(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame, modulus: int | None = 199, least_length: int = 6, least_count: int = 5, factor: int = 5, longest: int = LONGEST, most: int = DICTIONARY, prune: int = PRUNE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus (`word_counts`).

    Words are near if they differ by one inserted, deleted or replaced code point. form: the near word of greatest n, ties to the least in
    the order of code points, if its n is `factor` times the word's or more; else null, as form_n. root: where following forms ends, the
    word itself without one. n_near: how many near words there are.

    Null and empty texts have no words; repeated rows count as often as they stand; texts of any length are read whole; a null doc_id
    counts as one that is written as nothing; an empty table gives no rows. Other columns aren't read, whatever their names.
    """
    if least_length < longest:
        raise ValueError("words shorter than the longest gram can't be indexed")
    if factor < 2:
        raise ValueError("a form is at least twice as frequent as its word")
    words = staged(word_counts(docs, modulus, least_length, least_count), "words")
    greatest = words.agg(F.max("n")).first()[0] or 1
    pairs = staged(near_pairs(words, longest, most, prune), "near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))
    found = words.join(near, "word", "left")
    often = F.col("near_n") >= factor * F.col("n")
    found = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(found.where("form is not null"), greatest, factor)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
