"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table from frequent pre-tokens to their number of tokens; tier two is a bounded cache in each Python worker,
filled by encoding the pre-tokens that tier one misses. No pre-token is ever shuffled: a byte-level BPE never merges across pre-tokens,
so the count of a text is the sum over its pre-tokens.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import sampled

TOKENIZER = "byte_bpe_50k.json"
#: Texts whose pre-tokens the first tier is filled from, and the entries that it holds at most. They decide speed, never a result.
WARM_DOCS, WARM_ENTRIES = 2000, 65_536
#: Pre-tokens that a worker's cache holds before it starts anew.
CACHE_ENTRIES = 200_000
#: Longest pre-token, in characters, that is kept in a table.
LONGEST = 64
#: The byte-level pre-tokenizer's pattern, and the characters on which every regex library agrees about its classes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = regex.compile(r"[\t\n\x20-\x7e\xa1-ɏ]*+")


@lru_cache(maxsize=2)
def _load(path: str) -> tuple[Tokenizer, "regex.Pattern | None"]:
    """The tokenizer, and a pattern of the special strings that it finds inside texts."""
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    added = [x["content"] for x in json.loads(open(path, encoding="utf-8").read())["added_tokens"]]
    return tok, regex.compile("|".join(map(regex.escape, added))) if added else None


def _pieces(tok: Tokenizer, text: str) -> list[str]:
    if PLAIN.fullmatch(text):
        return PIECES.findall(text)
    return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]


def _segments(text: str, special) -> tuple[list[str], int]:
    """The ordinary stretches of a text and the number of special strings between them."""
    if special is None or not special.search(text):
        return [text], 0
    return special.split(text), len(special.findall(text))


class Lengths(dict):
    """Pre-token -> number of tokens; a miss is encoded once and kept while there is room."""

    def __init__(self, tok: Tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tok, self.frequent = tok, frequent

    def __missing__(self, piece: str) -> int:
        n = len(self.tok.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.frequent) + CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def frequent_pretokens(docs: DataFrame, tokenizer: str = TOKENIZER, warm_docs: int = WARM_DOCS, entries: int = WARM_ENTRIES) -> dict[str, int]:
    """The first tier: at most `entries` pre-tokens, the most frequent of about `warm_docs` texts, with their lengths in tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, special = _load(public_tokenizers.path(tokenizer))
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in _segments(text or "", special)[0]:
                    seen.update(p for p in _pieces(tok, part) if len(p) <= LONGEST)
                if len(seen) > 8 * entries:
                    seen = Counter(dict(seen.most_common(4 * entries)))
        top = seen.most_common(entries)
        lengths = [len(e.ids) for e in tok.encode_batch([p for p, _ in top], add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array(lengths, pa.int64())], ["piece", "n", "tokens"])

    rows = sampled(docs, warm_docs).select("text").mapInArrow(count, "piece string, n long, tokens long")
    top = rows.groupBy("piece").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens")).orderBy(F.desc("n"), "piece").limit(entries)
    return {r.piece: r.tokens for r in top.collect()}


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = 1024, warm_docs: int = WARM_DOCS, entries: int = WARM_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, in one narrow pass.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated rows, a null doc_id stays null, an empty table gives
    an empty result, other columns are not read. Texts of any length are counted whole; special strings inside texts are one token
    each, as the library has it by default.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_pretokens(docs, tokenizer, warm_docs, entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, special = _load(public_tokenizers.path(tokenizer))
        lengths = Lengths(tok, frequent.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                parts, n = _segments(text, special)
                for part in parts:
                    n += sum(map(lengths.__getitem__, _pieces(tok, part)))
                n_bytes.append(len(text.encode()))
                n_tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
