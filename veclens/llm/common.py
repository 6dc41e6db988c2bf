"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Most bytes of text that a Python worker turns into arrays at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Only a session without a cluster may leave it unset and gets a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's readers find it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within go at the end; what rests on them must have been written or collected by then."""
    token = _scope.set([])
    try:
        yield
    finally:
        for path in _scope.get():
            remove(spark, path)
        _scope.reset(token)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    The table stays as long as results may rest on it: to the end of `scratch`, or for whoever clears the folder after the job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veclens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scope.get() is not None:
        _scope.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(docs: DataFrame, about: int) -> DataFrame:
    """doc_id, text: about `about` different documents at most, taken evenly by a hash; repeated rows count once, nulls not at all.

    Rows are as likely as any other to be in, whatever their ids, and copies of a row meet before the shuffle.
    """
    every = max(1, docs.count() // about)
    h = F.xxhash64("doc_id", "text").alias("h")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", h).where(F.pmod("h", F.lit(every)) == 0)
    return rows.groupBy("doc_id", "h").agg(F.max("text").alias("text")).select("doc_id", "text")


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod modulus = remainder; a null doc_id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % modulus == remainder


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in runs of whole rows that hold about `most` bytes of text; one longer text is a run of its own."""
    for batch in batches:
        texts, start, size = as_bytes(batch.column(text)), 0, 0
        for i, x in enumerate(texts):
            if size and size + len(x) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(x)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
