import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, documents, empty
from veclens.llm import token_store
from veclens.llm.common import shared_dir
from veclens.llm.perfect_hash import PerfectHash
from veclens.llm.words import Words

ODD = ["É́x ́y", "a b c", " ", "<|endoftext|>#<|startoftext|> # <|ENDOFTEXT|>", "İstanbul ΣΑΣ ß ﬁ", "don't I'LL x're", "\x1c\x1d a\x1fb", "12345 3½ ²", "a" * 300, "日本語テキスト🙂🙂", "क़́", "#" * 50]


def rough(seed, n=150):
    rng = random.Random(seed)
    words = [*"the quick brown fox jumps Über naïve x1 ... don't".split(), *(w for t in ODD for w in t.split(" ")), "zzyzx", "#", "�"]
    rows = list(ROWS) + [ROWS[0]] * 5 + [ROWS[14]] * 3
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t", " "]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice([rng.randrange(-50, 10**12), 77, None]), rng.choice([text, text, None, ""]), "en", "a", 0, "", "", "", ""))
    rows += [(2000 + i, t, "en", "a", 0, "", "", "", "") for i, t in enumerate(ODD)]
    return rows


def plain(rows, end=2, name="word_bpe_49k.json"):
    """doc_id -> its rows' ids as the library has them."""
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append([*tok.encode(r[1] or "", add_special_tokens=False).ids, end])
    return out


def folder(spark):
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@pytest.mark.parametrize(("seed", "part_bytes", "shard_ids", "shard_docs", "group_keys"), [(1, 1 << 25, 1 << 22, 65_536, 65_536), (2, 20_000, 500, 7, 20), (3, 3_000, 100, 3, 1)])
def test_round_trip(spark, seed, part_bytes, shard_ids, shard_docs, group_keys):
    rows, path = rough(seed), folder(spark)
    manifest = token_store.write_ids(documents(spark, rows), path, part_bytes=part_bytes, shard_ids=shard_ids, shard_docs=shard_docs, group_keys=group_keys)
    want = plain(rows)
    assert manifest["documents"] == len(rows) and manifest["ids"] == sum(len(x) for xs in want.values() for x in xs)
    got = token_store.fetch(documents(spark, rows), path).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.nth):
        found.setdefault(r.doc_id, []).append(r.ids)
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {i: Counter(map(tuple, xs)) for i, xs in found.items()} == {i: Counter(map(tuple, xs)) for i, xs in want.items()}
    assert [r.nth for r in sorted((r for r in got if r.doc_id is None), key=lambda r: r.nth)] == list(range(len(want[None])))
    # starts add up in ascending order of ids, null first
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    # some keys, absent ones among them
    some = spark.createDataFrame([(77,), (6,), (6,), (987654321,), (None,)], "doc_id long")
    assert Counter(r.doc_id for r in token_store.fetch(some, path, with_ids=False).collect()) == Counter({77: len(want.get(77, [])), 6: 1, None: len(want[None])}) - Counter()
    reader = token_store.Reader(path)
    for i in (77, None, 6, 2003):
        assert Counter(tuple(x.tolist()) for x in reader.get(i)) == Counter(map(tuple, want[i]))
    assert reader.get(987654321) == []


def test_no_documents(spark):
    path = folder(spark)
    assert token_store.write_ids(empty(spark), path)["documents"] == 0
    assert token_store.fetch(empty(spark), path).count() == 0 and token_store.Reader(path).get(1) == []


def test_many_rows_of_one_id_are_cut(spark):
    """A third of all rows under one id: neither a range of the sort nor a shard takes them all."""
    rows = [(7 if i % 3 == 0 else i, "many words of one id " * 20, "en", "a", 0, "", "", "", "") for i in range(3000)]
    path = folder(spark)
    token_store.write_ids(documents(spark, rows), path, part_bytes=60_000, shard_docs=100)
    places = token_store.locate(spark.range(1000).selectExpr("7L as doc_id", "id as nth"), path, 1).collect()
    assert len(places) == 1000 and len({p.shard[:9] for p in places}) > 5 and max(Counter(p.shard for p in places).values()) <= 100


def test_cache_and_equal_hashes(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_WORDS", 5)
    own, texts = token_store.Encoder("word_bpe_49k.json"), [r[1] for r in rough(4)]
    for k in range(0, len(texts), 20):
        ids, sizes = own.encode(pa.array(texts[k : k + 20]), 2)
        ends = np.cumsum(sizes)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [x for t in texts[k : k + 20] for x in plain([(0, t)])[0]]
    monkeypatch.setattr(Words, "hashes", property(lambda w: np.zeros(len(w.start), np.uint64)))
    ids, sizes = own.encode(pa.array(texts[20:30]), 2)
    assert ids.tolist() == [x for t in texts[20:30] for x in plain([(0, t)])[0][0]]


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 1000, 70_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        own, end = PerfectHash.load(b"xyz" + PerfectHash.of(keys).dump(), 3)
        assert sorted(own.numbers(keys).tolist()) == list(range(len(keys))) and end == 3 + len(own.dump())
        assert n < 1000 or 8 * len(own.bits) < 5 * n
        assert (own.numbers(rng.integers(2**63, 2**64, 50, dtype=np.uint64)) < max(len(keys), 1)).all()
    twice = PerfectHash.of(np.array([5, 5, 9], np.uint64))
    assert sorted(twice.numbers(np.array([5, 9], np.uint64)).tolist()) == [0, 1]
