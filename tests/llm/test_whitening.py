import math

import numpy as np
import pytest

from veclens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x long, y string, `index` int"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "y", 1) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(vectors, components=8):
    """n, deviations, eigenvalues, trace, whitened rows up to their signs, by whole matrices."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviations = [int(sum((n * c - t) ** 2 for c, t in zip(row, s))) for row in x]
    centred = (x - s / n).astype(float)
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return n, deviations, values[order], values.sum(), centred @ turn[:, order] / np.sqrt(values[order])


@pytest.mark.parametrize(("n", "d", "rows"), [(500, 12, 64), (300, 5, 1024), (1100, 9, 100)])
def test_whitened(spark, n, d, rows, monkeypatch):
    monkeypatch.setattr(whitening, "TOGETHER", 2)
    rng = np.random.default_rng(n)
    good = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d)).round(3)
    good[7] = good[8]
    odd = [(n, None), (n + 1, []), (n + 2, [None] * d), (n + 3, [float("nan")] + [1.0] * (d - 1)), (n + 4, [1.0] * (d - 1) + [-float("inf")]), (n + 5, [1.0] * (d + 1)), (n + 6, [3e38] * d)]
    got = whitening.whitened(table(spark, list(enumerate(good)) + odd + [(None, good[3]), (5, good[5])]), rows=rows).collect()
    kept = [*good, good[3], good[5]]
    count, deviations, values, trace, want = plain(kept)
    k = min(8, d)
    assert len(got) == len(kept) * k and {r.n for r in got} == {count} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    own = {}
    for r in got:
        own.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(own) == {*range(n), None} and all(len(x) == (2 if i == 5 else 1) for i in own for x in own[i].values())
    sign = [np.sign(own[int(np.argmax(abs(want[:n, c])))][c + 1][0].whitened * want[int(np.argmax(abs(want[:n, c]))), c]) for c in range(k)]
    for i, parts in own.items():
        at = len(good) if i is None else i
        for c, rs in parts.items():
            for r in rs:
                assert r.deviation == deviations[at] and r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)
                assert r.whitened == pytest.approx(sign[c - 1] * want[at, c - 1], abs=1e-8)


def test_flat_and_empty(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whitened(table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whitening.whitened(table(spark, [(i, [i / 8, 2.0]) for i in range(9)])).collect()
    flat = [r for r in line if r.component == 2]
    assert all(r.whitened is None and r.explained == 0 for r in flat) and line[0].identity_error < 1e-12
    assert sorted(abs(r.whitened) for r in line if r.component == 1)[0] == pytest.approx(0, abs=1e-12)


def test_deviation_beyond_a_long(spark):
    far = whitening.whitened(table(spark, [(i, [float(np.float32(v)), 0.0]) for i, v in enumerate((0.0, 1.0, 2.0, 4e12))])).collect()
    got = {r.vec_id: r.deviation for r in far}
    x = [math.floor(1024 * float(np.float32(v))) + 100_000 for v in (0.0, 1.0, 2.0, 4e12)]
    exact = [(4 * c - sum(x)) ** 2 for c in x]
    assert all(got[i] == (e if e < 2**62 else None) for i, e in enumerate(exact)) and None in got.values()
