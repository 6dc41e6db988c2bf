import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import ROWS, documents, empty
from veclens.llm import recompression, substring, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    split = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in split:
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def rough(seed, n=120):
    """Texts of a small vocabulary, with shared passages, runs, and copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 40))] for _ in range(8)] + [["w1"] * 30, ["w1", "w2"] * 12]
    rows = list(ROWS)
    for i in range(100, 100 + n):
        text = []
        for _ in range(rng.randrange(5)):
            text += [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
            text += rng.choice(passages)[rng.randrange(6) :]
        rows.append((i, rng.choice([" ", "\n"]).join(text), "en", "a", 0, "", "", "", ""))
    rows += [(500 + i, rows[20 + i % 3][1], "en", "a", 0, "", "", "", "") for i in range(9)]
    return rows


@pytest.mark.parametrize(("window", "rounds", "reach"), [(13, 1, 5), (13, 2, 4), (5, 1, 2), (30, 3, 6)])
def test_cut_repeats(spark, window, rounds, reach):
    rows = rough(window)
    got = substring.cut_repeats(documents(spark, rows), window, rounds, reach, bucket_bytes=3000).collect()
    assert Counter(map(tuple, got)) == brute(rows, window)


@pytest.mark.parametrize("bits", [1, 4, 9])
def test_names_that_stand_for_several_windows(spark, bits):
    """With names of so few bits nearly every window meets another by name: words alone decide."""
    rows = rough(7 + bits, 60)
    got = substring.cut_repeats(documents(spark, rows), 13, bits=bits, bucket_bytes=3000).collect()
    assert Counter(map(tuple, got)) == brute(rows, 13)


def test_rows_without_an_id_or_of_one_id_are_spread(spark):
    text = " ".join(f"w{k % 50}" for k in range(30))
    rows = [(None, f"{text} {i}", "en", "a", 0, "", "", "", "") for i in range(2000)] + [(7, f"{i} {text}", "en", "a", 0, "", "", "", "") for i in range(2000)]
    df = documents(spark, rows)
    for own in ("doc_id is null", "doc_id = 7"):
        sizes = [r["count"] for r in df.where(own).groupBy(substring.bucket_of(64).alias("b")).count().collect()]
        assert len(sizes) == 64 and max(sizes) < 100
    got = substring.cut_repeats(documents(spark, rows[::20]), bucket_bytes=2000).collect()
    assert Counter(map(tuple, got)) == brute(rows[::20], 13) and not any(r.n_removed for r in got)


def test_no_rows(spark):
    assert substring.cut_repeats(empty(spark)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    for vocabulary in (2, 5, 300):
        ids = recompression.mix(rng.integers(0, vocabulary, 4000).astype(np.uint64))
        for rounds, reach in ((1, 5), (2, 4), (3, 3)):
            for window in (13, 25):
                start, anchor = recompression.anchors(ids, np.array([0, 1000]), np.array([1000, 4000]), window, rounds, reach)
                seen = {}
                for s, a in zip(start.tolist(), anchor.tolist(), strict=True):
                    assert seen.setdefault(ids[s : s + window].tobytes(), a) == a


def test_words_of_a_column():
    texts = ["ab  c\n", None, "", "déf", "g", "\t", "a-long-word-of-many-bytes x", "c"]
    w = words.tokenise(pa.array(texts)[1:])
    found = [[bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(a, b)] for a, b in zip(w.first, w.last, strict=True)]
    assert found == [(t or "").split() for t in texts[1:]]
    h = words.tokenise(pa.array(["c x", "xx c", "C"]), lower=True).hashes
    assert h[0] == h[3] == h[4] and len(set(h.tolist())) == 3
