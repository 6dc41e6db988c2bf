import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import ROWS, documents, empty
from tests.llm.test_substring import rough
from veclens.llm import lm_score

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def cuts(word, prob):
    """Probability of a word: the sum over all of its cuts, one by one."""
    if not word:
        return 1.0
    return sum(p * cuts(word[len(piece) :], prob) for piece, p in prob if word.startswith(piece))


def test_marginals_and_expectations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"aba", b" ab"]
    prob = np.array([0.05, 0.1, 0.1, 0.1, 0.1, 0.05, 0.1] + [0.4 / 256] * 256)
    lattice = lm_score.Lattice(pieces, prob)
    all_ = list(zip(pieces, prob, strict=False)) + [(bytes([b]), prob[7 + b]) for b in range(256)]
    words = [b"a", b"ab", b"abab", b"aabba", b"xyz", b"b" * 6]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum(list(map(len, words)))
    start = end - np.array(list(map(len, words)))
    got = lattice.scores(data, start, end)
    assert np.exp(got) == pytest.approx([cuts(b" " + w, all_) for w in words])
    assert [lattice._one(b" " + w) for w in words] == pytest.approx(got.tolist())
    expected = lattice.expected(data, start, end, np.ones(len(words), np.int64))
    # an expected count is how the log probability moves with the log of a piece's probability
    for i in (1, 2, 4, 7 + ord("b")):
        moved = prob.copy()
        moved[i] *= math.exp(1e-6)
        lattice.weigh(moved)
        assert (lattice.scores(data, start, end).sum() - got.sum()) / 1e-6 == pytest.approx(expected[i], abs=1e-4)


def test_scores(spark):
    rows = rough(3) + [ROWS[0], ROWS[0]]
    counts = Counter(w for r in rows if not out(r[0]) for w in split(r[1]))
    ends = sum(not out(r[0]) for r in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    want = Counter((r[0], out(r[0]), len(split(r[1])) + 1, 1 + sum(counts[w] > 0 for w in split(r[1])), n, round(base(ends) + sum(base(counts[w]) for w in split(r[1])), 6)) for r in rows)
    scores = []
    for frequent in (10, 40):
        got = lm_score.score_texts(documents(spark, rows), frequent=frequent).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        scores.append(sorted((r.doc_id or 0, r.n_tokens, round(r.score, 6)) for r in got))
    assert scores[0] == scores[1]  # how many words are broadcast changes nothing
    assert lm_score.score_texts(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "Hello world"), (2, "hello  WORLD")], "doc_id long, text string")
    a, b = lm_score.score_texts(one).collect()
    assert a.score == pytest.approx(b.score)


def _cuts(word, pieces):
    """Each way to cut a word, as numbers of pieces; bytes follow the pieces."""
    if not word:
        yield []
        return
    for i in [len(pieces) + word[0], *(i for i, p in enumerate(pieces) if word.startswith(p))]:
        for rest in _cuts(word[1 if i >= len(pieces) else len(pieces[i]) :], pieces):
            yield [i, *rest]


def test_length_does_not_change_what_is_learned(monkeypatch):
    rng = np.random.default_rng(4)
    pieces = [b" ", b" a", b"a", b"ab", b"b", b"abba", b"ba", "同".encode(), "同じ".encode()]
    prob = rng.random(len(pieces) + 256) + 0.01
    lattice = lm_score.Lattice(pieces, prob / prob.sum())
    few = [b"abba", b"babab", "同じa".encode()]
    many = [rng.choice(np.frombuffer(b"abx", np.uint8), n).tobytes() for n in (49, 50, 77, 128, 200)] + [("同じ" * 20).encode()]
    for words, limits in ((few, (0, 48)), (many, (48, 1000))):
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(list(map(len, words)))
        start, counts = end - list(map(len, words)), np.arange(1, len(words) + 1)
        found = []
        for limit in limits:
            monkeypatch.setattr(lm_score, "LONG", limit)
            found.append((lattice.expected(data, start, end, counts), lattice.scores(data, start, end)))
        assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1])
        size = np.array([*map(len, pieces), *([1] * 256)])
        assert np.isclose(found[0][0] @ size, sum(n * (len(w) + 1) for n, w in zip(counts, words)))
        if words is few:
            want = np.zeros(len(prob))
            for n, word in zip(counts, words):
                ways = [(cut, np.exp(lattice.log[cut].sum())) for cut in _cuts(b" " + word, pieces)]
                for cut, p in ways:
                    np.add.at(want, cut, n * p / sum(p for _, p in ways))
            assert np.allclose(found[0][0], want)


def enumerated(word, pieces, prob):
    return sum(math.prod(prob[i] for i in cut) for cut in _cuts(b" " + word, pieces))


def expectation(words, counts, pieces, prob):
    out = np.zeros(len(prob))
    for word, n in zip(words, counts, strict=True):
        ways = [(cut, math.prod(prob[i] for i in cut)) for cut in _cuts(b" " + word, pieces)]
        for cut, p in ways:
            np.add.at(out, cut, n * p / sum(p for _, p in ways))
    return out


@pytest.mark.parametrize("most", [0, 2, 100])
def test_scores_are_sums_over_all_cuts(spark, monkeypatch, most):
    """The whole model on a small vocabulary, re-estimation and all, cut by cut."""
    pieces = [b" ", b" a", b"a", b"ab", b"b", b"ba", b"abb"]
    prior = np.r_[np.arange(1, 8), np.full(256, 0.05)]
    prior /= prior.sum()
    monkeypatch.setattr(lm_score, "vocabulary", lambda name=None: (list(pieces), prior.copy()))
    monkeypatch.setattr(lm_score, "PRIOR", 3.0)
    rng = np.random.default_rng(6)
    base = ["ab", "abb", "ba", "a", "abab", "xa", "bb", "bab"]
    rows = [(i, " ".join(rng.choice(base[: 3 + i % 6], rng.integers(0, 9))), "en", "a", 0, "", "", "", "") for i in range(40)] + [(50, None, "en", "a", 0, "", "", "", "")]
    counts = Counter(w for r in rows if not out(r[0]) for w in split(r[1]))
    ends = sum(not out(r[0]) for r in rows)
    prob = prior
    for _ in range(lm_score.WARM_ROUNDS):
        prob = expectation(list(counts), [1.0] * len(counts), pieces, prob) + 3.0 * prior
        prob /= prob.sum()
    keys = {w: k for k, w in ((lm_score.tokenise(pa.array([w.decode()])).hashes.view(np.int64)[0], w) for w in counts)}
    order = sorted(counts, key=lambda w: (-counts[w], keys[w]))[:most]
    weights = expectation(list(counts), [0.75 if w in order else counts[w] for w in counts], pieces, prob) + 3.0 * prior
    every = pieces + [b" " + w for w in order if b" " + w not in pieces]
    full = np.r_[weights[: len(pieces)], np.zeros(len(every) - len(pieces)), weights[len(pieces) :]]
    for w in order:
        full[every.index(b" " + w)] += counts[w] - 0.75
    total = full.sum() + ends
    want = {r[0]: math.log10(ends / total) + sum(math.log10(enumerated(w, every, full / total)) for w in split(r[1])) for r in rows}
    for frequent in (1, 100):
        got = lm_score.score_texts(documents(spark, rows), frequent=frequent, pieces_most=most).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(want)
