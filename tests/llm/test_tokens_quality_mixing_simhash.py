import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import PASSAGE, ROWS, TEXTS, documents, empty
from veclens.llm import components, mixing, quality, simhash, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts_match_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter(tuple(r) for r in tokens.count_tokens(documents(spark), warm_docs=3, entries=20).collect())
    want = Counter()
    for i, text, *_ in TEXTS:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        want[(i, len((text or "").encode()), n, n > 1024)] += 1
    assert got == want
    assert tokens.count_tokens(empty(spark)).count() == 0


def _measures(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures(spark):
    book = quality.judge(documents(spark))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect())
    assert got == Counter((i, *_measures(t)) for i, t, *_ in TEXTS)
    for r in book.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty(spark)).count() == 0
    for r in quality.ablation(quality.ledger(documents(spark))).collect():
        assert 0 <= r.n_only <= r.n_rejected <= len(TEXTS)


def _targets(size_by_source, weights=(5, 2, 1), cap=3):
    names = sorted(size_by_source, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(size_by_source.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * size_by_source[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * size_by_source[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("many", [False, True])
def test_mixing(spark, many):
    rows = ROWS if not many else [(i, "w " * (i % 37), "en", "hot" if i % 3 else f"s{i % 5}", 0, "", "", "", "") for i in range(3000)]
    size, by_source = defaultdict(int), defaultdict(int)
    for i, text, _, source, *_ in rows:
        n = len(WORD.findall(text or ""))
        size[(i, source)] += n
        by_source[source] += n
    want = _targets(by_source)
    kwargs = {"block_words": 64, "shard_blocks": 8}
    out = mixing.draws(documents(spark, rows), **kwargs).collect()
    taken, per = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.size == size[(r.doc_id, r.source)] and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert (r.shard is None) == (r.words == 0)
        taken[r.source] += r.words
        per[(r.doc_id, r.source)] += r.words
    assert set(per) == set(size)
    assert all(per[k] <= 3 * size[k] for k in size)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    places = defaultdict(list)
    for r in out:
        if r.shard is not None:
            places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert not many or len(places) > 10
    again = mixing.draws(documents(spark, rows, parts=5), **kwargs).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.draws(empty(spark)).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = [1000, 1, 0, 377, 90_000]
    leaves = mixing.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<bigint>"), 13).collect()
    assert len(leaves) == 13
    assert [sum(r.quotas[i] for r in leaves) for i in range(len(quotas))] == quotas
    per = [sum(r.quotas) for r in leaves]
    assert max(per) - min(per) <= 4
    share = [r.quotas[0] / sum(r.quotas) for r in leaves]
    assert all(abs(s - 1000 / sum(quotas)) < 0.006 for s in share) and len(set(share)) > 3


def test_shuffled_is_a_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing._shuffled(F.col("id"), F.lit(n), F.lit(3), F.lit("key"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 1000 or abs(np.corrcoef(got, range(n))[0, 1]) < 0.1)


def test_mixed_takes_repeated_rows_once_each(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e f g h", "x"), (None, "i j", "x"), (2, None, "x"), (3, "", None), (4, "k l m n", None), (5, "o", "y")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, mix_words int")
    out = mixing.mixed(docs, block_words=2, shard_blocks=2).collect()
    draws = mixing.draws(docs, block_words=2, shard_blocks=2, by_text=True).collect()
    want = {s: sum(r.words for r in draws if r.source == s) for s in ("x", "y", None)}
    assert {s: sum(r.mix_words for r in out if r.source == s) for s in want} == want and want["x"] == 13
    per = Counter()
    for r in out:
        per[(r.doc_id, r.text)] += r.mix_words
        assert 0 < r.mix_words <= len(r.text.split())
    assert all(n <= 3 * rows.count((i, t, s)) * len((t or "").split()) for i, t, s in rows for n in [per[(i, t)]])
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_the_mix_has_a_short_plan(spark):
    """Targets and tree are worked out once and written: the driver plans neither their windows nor the tree's levels with the joins."""
    docs = spark.createDataFrame([(i, "a b c d " * 4, f"s{i % 3}") for i in range(64)], "doc_id long, text string, source string")
    plan = mixing.mixed(docs, block_words=2, shard_blocks=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 4 and "lo#" not in plan and plan.count("Generate ") <= 6


def _fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps, radius):
    ids = [i for i in fps if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [3, 9])
def test_simhash_against_brute_force(spark, radius):
    import random

    rng = random.Random(5)
    base = [rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"]) + str(rng.randrange(30)) for _ in range(300)]
    rows = list(ROWS)
    for i in range(100, 260):
        words = list(base if i % 2 else base[::-1])
        for _ in range(rng.randrange(12)):
            words[rng.randrange(300)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words), "en", "a", 0, "", "", "", ""))
    fps = {r[0]: _fingerprint(r[1]) for r in rows}
    got = simhash.near_duplicates(documents(spark, rows), radius=radius, block=16).select("doc_id", simhash.hexadecimal().alias("f"), "component_id").collect()
    assert len(got) == len(rows)
    want = _components(fps, radius)
    for r in got:
        assert int(r.f, 16) == fps[r.doc_id] and len(r.f) == 16
        assert r.component_id == want.get(r.doc_id)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _reach(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("most", [simhash.GROUP_SHINGLES, 700])
def test_near_copies_are_those_of_their_shingles(spark, most):
    import random

    rng = random.Random(11)
    rows, line = list(ROWS), "one line that comes again and again "
    for k in range(100):  # changes of one place each touch five shingles: similarities from 0.7 to 0.9
        base = [f"w{k}x{j}" for j in range(196 if k % 2 else 60)]
        rows.append((1000 + 10 * k, " ".join(base), "en", "a", 0, "", "", "", ""))
        for copy in range(1, 4):
            words = list(base)
            for at in rng.sample(range(3, len(words) - 3), rng.randrange(2, 8) if k % 2 else rng.randrange(1, 3)):
                words[at] = f"y{rng.randrange(10**6)}"
            rows.append((1000 + 10 * k + copy, " ".join(words), "en", "a", 0, "", "", "", ""))
        words = [line * 200, *(f"z{k}x{j}" for j in range(60))]  # one line often, all else different
        rows.append((5000 + k, " ".join(words), "en", "a", 0, "", "", "", ""))
    for k in range(20):  # four shingles of five
        rows += [(7000 + 2 * k, " ".join(f"v{k}x{j}" for j in range(8)), "en", "a", 0, "", "", "", ""), (7001 + 2 * k, " ".join(f"v{k}x{j}" for j in range(9)), "en", "a", 0, "", "", "", "")]
    want = _reach({r[0]: _shingles(r[1]) for r in rows if r[0] is not None and r[0] not in (3, 4, 5)}) | {3: 3, 4: 3, 5: 3}
    docs = documents(spark, rows)
    assert {r.doc_id: r.component_id for r in simhash.copies(docs, most=most).collect()} == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i in want if want[i] == i] + [None])
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_only_sets_whose_sizes_allow_it_are_compared(spark):
    sizes = [4, 8, 12, 100, 404, 5000, 4 * 10**6]
    rows = [(10 * k + i, 63 << (6 * k + 8) | i, n * of // 4) for k, n in enumerate(sizes) for i, of in enumerate((4, 5, 8))]
    uniq = spark.createDataFrame(rows, "node long, fp_0 long, n long")
    linked = lambda **alike: {frozenset(r) for r in simhash.links(uniq, 2, **alike).collect()}
    assert linked(alike=simhash.ALIKE) == {frozenset((10 * k, 10 * k + 1)) for k in range(len(sizes))}
    assert len(linked()) > len(sizes)


def test_bits_over_half():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 2, 254, 255, 256, 0, 510, 511, 3, 700_000, 0])
    ends = np.cumsum(size)
    hashes = rng.integers(0, 1 << 64, ends[-1], dtype=np.uint64)
    got = simhash._bits_over_half(hashes, ends)
    for end, n, print_ in zip(ends, size, got, strict=True):
        bits = np.unpackbits(hashes[end - n : end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=int)
        assert int(print_) == sum(1 << i for i in range(64) if 2 * bits[i] > n)
    assert not simhash._bits_over_half(np.zeros(0, np.uint64), np.zeros(3, int)).any()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_passage_constant():
    assert len(PASSAGE.split()) >= 13
