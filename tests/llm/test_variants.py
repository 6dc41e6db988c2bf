import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import ROWS, documents, empty
from veclens.llm import variants, words

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CAPITALS = str.maketrans({c: c + 32 for c in range(65, 91)})


def apart(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows, modulus=199, length=6, least=5, factor=5):
    counts = Counter()
    for r in rows:
        for run in RUN.findall(r[1] or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if modulus and h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    near = {w: [x for x in kept if apart(w, x)] for w in kept}
    form = {w: min(xs, key=lambda x: (-kept[x], x)) for w, xs in near.items() if xs}
    form = {w: f for w, f in form.items() if kept[f] >= factor * kept[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), kept[form[w]] if w in form else None) for w, n in kept.items()}


def noisy(seed, n_words=150, n_docs=150):
    """Texts of words and their misspellings, each kind at very different frequencies, runs of one letter among them."""
    rng = random.Random(seed)
    letters = "abcdeéÉ×xyZ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 11))) for _ in range(n_words)] + ["a" * k for k in range(5, 12)] + ["ab" * 4, "ba" * 4, "ab" * 4 + "a"]
    pool = []
    for w in base:
        times = rng.choice([2, 5, 8, 40, 300])
        pool += [w] * times
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w))
            x = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]])
            pool += [x] * rng.choice([1, 5, 6, 30])
    pool += ["planting"] * 300 + ["plantimg"] * 45 + ["plantimgs"] * 7
    rng.shuffle(pool)
    rows, at = list(ROWS), 0
    for i in range(n_docs):
        size = len(pool) // n_docs + 1
        rows.append((1000 + i, "".join(w + rng.choice([" ", "\n", ", ", "-", "1"]) for w in pool[at : at + size]), "en", "a", 0, "", "", "", ""))
        at += size
    return rows + [ROWS[5]] * 3


@pytest.mark.parametrize(("seed", "modulus", "most", "prune"), [(1, 199, 262_144, 16), (2, 7, 262_144, 2), (3, None, 300, 1), (4, 3, 1, 1)])
def test_spelling_variants(spark, seed, modulus, most, prune):
    rows = noisy(seed)
    got = variants.spelling_variants(documents(spark, rows), modulus, most=most, prune=prune).collect()
    want = brute(rows, modulus)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r.n_near > 0 for r in got) > 20
    assert modulus == 3 or any(r.form and r.root != r.form for r in got)


def test_empty_and_refused(spark):
    assert variants.spelling_variants(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(empty(spark), least_length=4)


def test_long_chains_of_forms(spark):
    words = ["a" * k for k in range(6, 12)]
    forms = spark.createDataFrame([(a, b) for a, b in zip(words, words[1:])], "word string, form string")
    assert {tuple(r) for r in variants._roots(forms, 5**6, 5).collect()} == {(w, words[-1]) for w in words[:-1]}


def test_edits_leave_what_their_bound_says():
    """For every edit of every word, the grams beyond the bound are in both words, moved by a place at most."""
    rng = random.Random(5)
    base = list({"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))) for _ in range(120)})
    every = set(base)
    for w in base:
        every.update(w[:k] + w[k + 1 :] for k in range(len(w)) if len(w) > 6)
        every.update(w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "abc")
        every.update(w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "abc")
    for prune in (1, 5, 40):
        counts = Counter(f"^{w}$"[i : i + k] for w in every for k in range(2, 6) for i in range(len(w) + 3 - k))
        grams = {g: (n, len(g) < 5 and n > prune) for g, n in counts.items() if len(g) == 2 or counts[g[:-1]] > prune}
        for a in base[:40]:
            mine = variants.rarest(a, grams)
            assert variants.affected(variants.decompose(a, grams)) < len(variants.decompose(a, grams))
            for b in every:
                if apart(a, b):
                    assert any(g == h and abs(p - q) <= 1 for p, g, _ in mine for q, h, _ in variants.rarest(b, grams)), (a, b)


def test_crc_and_letters():
    texts = ["Abc déf×÷ 12x", None, "", "Ünïcode_ß-", "Āa¿bÀ", "ÿ"]
    w = words.tokenise(pa.array(texts), letters=True)
    found = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(a, b)] for a, b in zip(w.first, w.last, strict=True)]
    assert found == [RUN.findall(t or "") for t in texts]
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(len(w.start))], np.uint32)
    assert variants.crc32_of(w, before).tolist() == [zlib.crc32(w.data[a:b].tobytes(), int(c)) for a, b, c in zip(w.start, w.end, before)]
