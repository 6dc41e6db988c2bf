"""Language identification by compression: a text's language is that whose dictionary codes it in the fewest bytes.

Each learned language has a zstandard raw-content dictionary of its own training text. A text's words are compressed in chunks against
every dictionary; the smallest total wins, and a narrow margin over the next is reported as a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Training documents of a language at most, bytes of one dictionary, and of those that are broadcast together.
TRAIN_DOCS, DICT_BYTES, ALL_BYTES = 256, 400_000, 32 << 20
#: Bytes of the pieces that stand for a training text longer than its share of the dictionary.
PIECE_BYTES = 256
LEVEL = 3
#: Bytes compressed at a time; a longer history would tell languages apart by the text itself, not by the dictionaries.
CHUNK = 2048
#: Least share of its own size by which the best language has to beat the next.
MARGIN = 0.02
UNKNOWN = "und"
_WORDS = regex.compile(r"\p{L}+")


def plain(text: str) -> bytes:
    """The text's words alone, in lower case, a word that repeats at once only once."""
    return " ".join(word for word, _ in groupby(_WORDS.findall(text.lower()))).encode()


def _spread(raw: bytes, share: int) -> str:
    """At most `share` bytes of a text: all of it, or pieces at even distances over the whole of it."""
    if len(raw) <= share:
        return raw.decode()
    n = max(1, share // (PIECE_BYTES + 1))
    starts = np.linspace(0, len(raw) - PIECE_BYTES, n).astype(int)
    return " ".join(raw[i : i + PIECE_BYTES].decode(errors="ignore") for i in starts)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, dict_bytes: int = DICT_BYTES) -> DataFrame:
    """place, lang, data: a dictionary of each non-null lang, those with the most documents first.

    A language learns from at most `train_docs` documents, taken evenly by a hash of doc_id and text, repeated rows once; they share the
    dictionary's bytes evenly, and a text longer than its share gives pieces of its whole length. Null and empty texts teach nothing; an empty
    table gives no dictionary, and then every text is `und`.
    """
    texts = docs.where("lang is not null and text <> ''")
    h = F.xxhash64("doc_id", "text").alias("h")
    ids = texts.select("lang", F.col("doc_id").cast("long").alias("doc_id"), h).groupBy("lang", "doc_id", "h").agg(F.count("*").alias("rows"))
    counts = ids.groupBy("lang").agg(F.sum("rows").alias("n"), F.least(F.count("*"), F.lit(train_docs)).alias("docs"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = ids.withColumn("turn", turn).where(F.col("turn") <= train_docs).select("lang", "doc_id", "h", "turn").join(counts, "lang")
    chosen = staged(chosen, "training")  # so small a table that Spark broadcasts it, unless there are very many languages

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [dict_bytes // n for n in batch.column("docs").to_pylist()]
            own = [_spread(plain(t), share) for t, share in zip(batch.column("text").to_pylist(), shares, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), batch.column("turn"), pa.array(own, pa.string())], ["lang", "n", "turn", "piece"])

    rows = texts.select("lang", h, "text").join(chosen.drop("doc_id"), ["lang", "h"]).groupBy("lang", "n", "docs", "turn").agg(F.max("text").alias("text"))
    data = rows.mapInArrow(pieces, "lang string, n long, turn int, piece string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), " ")
    found = data.groupBy("lang", "n").agg(joined.alias("data"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "lang")) - 1  # a row a language
    return staged(found.select(place.alias("place"), "lang", "data"), "dictionaries")


def _coder(data: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


def predict(docs: DataFrame, dictionaries: DataFrame, margin: float = MARGIN, block: int = ALL_BYTES // DICT_BYTES) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every whole text, in one narrow pass.

    A null text, and one without a letter, is `und` with score 0 and not accepted, as is any text where no language was learned. score is
    the winner's share where each byte more halves a language's weight. Equal sizes go to the language with more training documents, and
    aren't accepted. Repeated rows are judged alike; only doc_id and text are read; an empty table gives no rows. More languages than one
    broadcast of `block` dictionaries holds are tried in turn, what is best so far going along.
    """
    spark, last = docs.sparkSession, dictionaries.agg(F.max("place")).first()[0]
    state = "best string, least double, next double, weight double"

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, coders = [lang for lang, _ in shared.value], [_coder(data.encode()) for _, data in shared.value]
            for batch in batches:
                out = [x.to_pylist() for x in batch.columns[2:]]
                for i, text in enumerate(batch.column("text").to_pylist()):
                    raw = plain(text) if text else b""
                    if not raw:
                        continue
                    chunks = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
                    size = [float(sum(len(c.compress(x)) for x in chunks)) for c in coders]
                    best, least, after, weight = (x[i] for x in out)
                    if best is None:
                        least, after, weight = np.inf, np.inf, 0.0
                    low = min(least, *size)
                    weight = (weight * 2.0 ** max(low - least, -1000) if weight else 0.0) + sum(2.0 ** max(low - x, -1000) for x in size)
                    if low < least:
                        best = names[size.index(low)]
                    out[0][i], out[1][i], out[2][i], out[3][i] = best, low, sorted([least, after, *size])[1], weight
                kinds = [pa.string(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], ["doc_id", "text", "best", "least", "next", "weight"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in state.split(", "))))
    for start in range(0, -1 if last is None else last + 1, block):
        own = dictionaries.where(F.col("place").between(start, start + block - 1)).orderBy("place").collect()
        rows = rows.mapInArrow(step(spark.sparkContext.broadcast([(r.lang, r.data) for r in own])), f"doc_id long, text string, {state}")
    sure = F.col("next") - F.col("least") >= F.greatest(margin * F.col("least"), F.lit(1.0))
    return rows.select("doc_id", F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / F.col("weight"), F.lit(0.0)).alias("score"), F.coalesce(sure, F.lit(False)).alias("accepted"))
