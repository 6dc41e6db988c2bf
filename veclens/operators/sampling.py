"""Seeded samples of each key: a task keeps the rows of the least hashes before anything is shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of rows that a task keeps before it hands them on and starts anew. It decides memory and what is shuffled, never a result.
KEPT_BYTES = 64 << 20


def _least(table: pa.Table, by: list[str], k: int) -> pa.Table:
    """The k rows of the least h of each key."""
    order = pc.sort_indices(table.select([*by, "h"]), sort_keys=[(c, "ascending") for c in (*by, "h")])
    sorted_ = table.select(by).take(order)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in by:
        column = sorted_.column(c).combine_chunks()
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return table.take(order.filter(pa.array(place < k)))


def _partial(df: DataFrame, by: list[str], k: int, draws: int | None, seed: int, kept_bytes: int) -> DataFrame:
    """Rows that may be among the k least of their key, at most k a key and task for every kept_bytes of them: df's own h, or, for each of
    the draws, the hash of seed, draw and the column h, under rep."""
    kinds = dict(df.dtypes)
    names = [*df.columns, *(["rep"] if draws else [])]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            text = table.column("h").to_pylist() if draws else None
            for rep in range(draws or 1):
                own = table
                if draws:
                    head = f"{seed}:{rep}:"
                    own = own.set_column(own.column_names.index("h"), "h", pa.array([hashlib.md5((head + x).encode()).hexdigest() for x in text], pa.string()))
                    own = own.append_column("rep", pa.array(np.full(len(own), rep)))
                own = _least(own, by, k)
                held[rep] = _least(pa.concat_tables([held[rep], own]), by, k) if rep in held else own
            if sum(t.nbytes for t in held.values()) > kept_bytes:
                for t in held.values():
                    yield from t.to_batches()
                held = {}
        for t in held.values():
            yield from t.to_batches()

    return df.mapInArrow(keep, ", ".join([*(f"`{c}` {kinds[c]}" for c in df.columns), *(["rep long"] if draws else [])])).select(*names)


def least(df: DataFrame, by: list[str], k: int, h: str = "h", kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """df's rows with `place`, from 1, in the order of h: at most k of each key of `by`. Ties of h may fall either way.

    Null is a key like others. No key and task sends more than k rows into the shuffle, unless it has more than kept_bytes to keep.
    """
    kept = _partial(df.withColumnRenamed(h, "h") if h != "h" else df, by, k, None, 0, kept_bytes)
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("place") <= k)
    return kept.withColumnRenamed("h", h) if h != "h" else kept


def drawn(df: DataFrame, by: list[str], k: int, draws: int, seed: int = 42, key: str = "item_id", kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """df's rows with rep and place: in each of `draws` draws, at most k of each key of `by`, in the order of md5(seed:rep:by:key).

    Rows are never repeated for each draw outside of a task.
    """
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in (*by, key)))
    kept = _partial(df.withColumn("h", text), by, k, draws, seed, kept_bytes)
    place = F.row_number().over(Window.partitionBy("rep", *by).orderBy("h"))
    return kept.withColumn("place", place).where(F.col("place") <= k).drop("h")
