import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens.operators import openset
from veclens.plans import extra, more, suites
from veclens.sources import tables


def items(spark, x, labels):
    return spark.createDataFrame([(i, int(b), v.tolist()) for i, (v, b) in enumerate(zip(x, labels, strict=True))], "item_id long, label int, vec array<double>")


def test_weibull_against_its_likelihood():
    rng = np.random.default_rng(1)
    for shape, scale in ((0.7, 2.0), (3.0, 0.1), (9.0, 1.0)):
        x = scale * rng.weibull(shape, 4000)
        k, size = openset.weibull(x)
        assert k == pytest.approx(shape, rel=0.06) and size == pytest.approx(scale, rel=0.06)
        likely = lambda k, s: (np.log(k / s) + (k - 1) * np.log(x / s) - (x / s) ** k).sum()
        assert all(likely(k, size) >= likely(k * a, size * b) for a in (0.98, 1, 1.02) for b in (0.98, 1, 1.02))
    assert all(math.isfinite(v) for v in (*openset.weibull([0.0]), *openset.weibull([0.5, 0.5])))


def test_openmax_against_numpy(spark):
    rng = np.random.default_rng(2)
    mid = rng.standard_normal((4, 6))
    labels = np.arange(160) % 4
    x = mid[labels] + 0.6 * rng.standard_normal((160, 6))
    x[labels == 3] = -x[labels == 3] * np.where(rng.random((40, 1)) < 0.5, 1, -1)  # a label with rows on the wrong side
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    u = unit(x)
    gallery, queries = np.arange(160) < 120, np.arange(160) >= 120
    z = u @ unit(np.stack([u[gallery & (labels == c)].mean(axis=0) for c in range(4)])).T / 0.5
    right = z.argmax(axis=1) == labels
    used = [gallery & (labels == c) & (right if (right & gallery & (labels == c)).any() else True) for c in range(4)]
    middle = [z[m].mean(axis=0) for m in used]
    fits = [openset.weibull(np.sort(np.linalg.norm(z[m] - middle[c], axis=1))[::-1][:20]) for c, m in enumerate(used)]
    want = {}
    for i in np.flatnonzero(queries):
        for alpha in (2, 20):
            new, none = z[i].copy(), 0.0
            for c in np.argsort(-z[i])[:alpha]:
                w = 1 - math.exp(-((np.linalg.norm(z[i] - middle[c]) / fits[c][1]) ** fits[c][0]))
                new[c], none = z[i][c] * (1 - w), none + z[i][c] * w
            want[(i, alpha)] = math.exp(none) / (math.exp(none) + np.exp(new).sum())
    df = items(spark, x, labels)
    got = openset.openmax(df.where("item_id >= 120"), df.where("item_id < 120"), 0.5, (2, 20)).collect()
    assert {(r.q_id, r.alpha): r.unknown for r in got} == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("fit_rows", [100_000, 60])
def test_diverse_against_numpy(spark, fit_rows):
    rng = np.random.default_rng(3)
    labels = np.r_[np.zeros(400, int), np.ones(5, int), np.full(6, 2)]
    x = rng.standard_normal((len(labels), 3))
    x[7] = x[8]
    got = openset.diverse(items(spark, x, labels).repartition(5), ["label"], 5, fit_rows)
    by = {b: sorted(r.item_id for r in got.where(F.col("label") == b).collect()) for b in (0, 1, 2)}
    assert by[1] == list(range(400, 405)) and got.columns == ["label", "item_id"]
    for b in (0, 2):
        own = np.flatnonzero(labels == b)
        if fit_rows == 60 and b == 0:
            assert 1 < len(by[0]) <= 5 and set(by[0]) <= set(own)
            continue
        c = openset.centres(x[own], 5)
        assert by[b] == sorted({int(own[k]) for k in ((x[own][:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=0)})
    assert openset.diverse(items(spark, x[:0], labels[:0]), ["label"], 5).count() == 0


def test_fitted_heads(spark, tmp_path):
    """Well-separated labels are told apart by every fitted head, new labels too; the alpha of the greatest AUROC is chosen."""
    rng = np.random.default_rng(4)
    labels = rng.permutation(np.arange(600) % 10)
    mid = rng.standard_normal((10, 64)) * 2
    x = mid[labels] + 0.5 * rng.standard_normal((600, 64))
    items(spark, x, labels).select(F.col("item_id").alias("vec_id"), "label", F.col("vec").alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    sf = str(tmp_path)
    assert more.native_classifier(spark, sf).first().macro > 0.98
    rows = extra.incremental_baselines(spark, sf).collect()
    assert {(r.variant, r.novel) for r in rows} == {(v, n) for v in ("exemplar mean", "rehearsal head", "calibrated head") for n in (True, False)} and all(r.macro > 0.95 for r in rows)
    scores = suites.openmax_score(spark, sf).collect()
    assert len(scores) == sum(b > tables.LAST_KNOWN or i % 2 for i, b in enumerate(labels)) and len({r.alpha for r in scores}) == 1
    df = tables.read_embeddings(spark, sf)
    every = openset.openmax(tables.id_queries(df).unionByName(tables.ood_queries(df)), tables.gallery(df), suites.TAU).collect()
    val = {r.label for r in suites.novel_validation(tables.ood_queries(df)).where("val").collect()}
    auroc = {}
    for alpha in openset.ALPHAS:
        novel, known = ([round(r.unknown, 9) for r in every if r.alpha == alpha and ok(r.q_label)] for ok in (val.__contains__, lambda b: b <= tables.LAST_KNOWN))
        auroc[alpha] = round(float(np.mean([(a > b) + 0.5 * (a == b) for a in novel for b in known])), 9)
    assert len(val) == 1 and scores[0].alpha == min(auroc, key=lambda k: (-auroc[k], k))
    assert {r.q_id: r.unknown for r in scores} == pytest.approx({r.q_id: r.unknown for r in every if r.alpha == scores[0].alpha}, abs=1e-6)
    (row,) = suites.openmax_intervals(spark, sf).collect()
    assert row.auroc_lo <= row.auroc <= row.auroc_hi and row.k == scores[0].alpha
    chosen = extra.diverse_subset(spark, sf)
    assert chosen.groupBy("label", "source").count().agg(F.max("count")).first()[0] <= 8 and chosen.distinct().count() == chosen.count()
