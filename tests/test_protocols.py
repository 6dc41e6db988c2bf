"""Paired tests, claims, splits and recalls as the queries wire them, against plain versions of what they are made from."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens.operators import splits
from veclens.operators.statistics import signed_rank
from veclens.plans import diagnosis, extra, suites
from veclens.plans.protocols import label_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def by_label(spark):
    return label_table(spark, SF).toPandas().sort_values("q_label")


def test_all_pairs_vs_anchor(spark, by_label):
    got = {r.space: r for r in extra.all_pairs_vs_anchor(spark, SF).collect()}
    for space in ("a", "b"):
        statistic, p = signed_rank((by_label.whole - by_label[space]).to_numpy())
        assert (got[space].n, got[space].statistic, got[space].p_value) == (len(by_label), statistic, pytest.approx(p, abs=1e-6))


def test_claim_table(spark, by_label):
    got = {r.space: r for r in extra.claim_table(spark, SF).collect()}
    ps = {space: signed_rank((by_label.whole - by_label[space]).to_numpy())[1] for space in ("a", "b")}
    low, high = sorted(ps, key=lambda s: (ps[s], s))
    holm = {low: min(1, 2 * ps[low])}
    holm[high] = max(holm[low], ps[high])
    for space in ("a", "b"):
        r = got[space]
        assert (r.mean, r.other_mean, r.delta) == pytest.approx((by_label.whole.mean(), by_label[space].mean(), by_label.whole.mean() - by_label[space].mean()), abs=2e-6)
        assert (r.p_value, r.p_holm) == pytest.approx((ps[space], holm[space]), abs=2e-6)
    rng = np.random.default_rng(1)
    means = rng.choice(by_label.whole.to_numpy(), (5000, len(by_label))).mean(axis=1)
    assert (got["a"].ci_lo, got["a"].ci_hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=0.015)


def test_transfer_wilcoxon(spark):
    wide = suites._facet_accuracy(spark, SF).where("q_facet = 'all'").toPandas().pivot(index="q_label", columns="g_facet", values="accuracy")
    got = {r.pair: r for r in suites.transfer_wilcoxon(spark, SF).collect()}
    for facet in "012":
        both = wide[["all", facet]].dropna()
        statistic, p = signed_rank((both["all"] - both[facet]).to_numpy())
        assert (got[facet].n, got[facet].statistic, got[facet].p_value) == (len(both), statistic, pytest.approx(p, abs=1e-6))


def test_kshot_wilcoxon(spark, monkeypatch):
    macros = {"Full": [0.5, 0.6, 0.7, 0.8], "A": [0.4, 0.61, 0.5, 0.8], "B": [0.93, 0.1, 0.25, 0.41]}
    asked = iter([])

    def kshot(g, o, ks):
        return spark.createDataFrame(list(enumerate(macros[next(asked)])), "rep long, macro double")

    monkeypatch.setattr(suites, "_kshot", kshot)
    asked = iter(suites.spaces(suites.tables.read_embeddings(spark, SF)))
    got = {r.pair: r for r in suites.kshot_wilcoxon(spark, SF).collect()}
    for space in ("A", "B"):
        statistic, p = signed_rank(np.round(np.array(macros["Full"]) - macros[space], 12))
        assert (got[space].n, got[space].statistic, got[space].p_value) == (4, statistic, pytest.approx(p, abs=1e-6))


def test_split_of_groups_small_and_large(spark):
    rows = [(f"big{i % 2} l{i}", f"big{i % 2}", i < 3) for i in range(23)] + [(f"small{i // 2} l{i}", f"small{i // 2}", False) for i in range(20)] + [("one l", "one", True)]
    got = splits.meta(spark.createDataFrame(rows, "label string, grp string, known boolean")).collect()
    of = {r.label: r.split for r in got}
    assert len(got) == len(rows) == len(of) and all(of[x] == "test" for x, _, known in rows if known)
    md5 = lambda *x: hashlib.md5(":".join(("42", *x)).encode()).hexdigest()
    for grp in ("big0", "big1"):
        free = sorted((x for x, g, known in rows if g == grp and not known), key=lambda x: md5(grp, x))
        train, val = round(0.6 * len(free)), round(0.1 * len(free))
        assert [of[x] for x in free] == ["train"] * train + ["val"] * val + ["test"] * (len(free) - train - val)
    groups = sorted({g for _, g, _ in rows if g.startswith("small")}, key=md5)
    for k, grp in enumerate(groups):
        assert {of[x] for x, g, _ in rows if g == grp} == {"train" if k < 6 else "val" if k < 7 else "test"}


def test_recalls_leave_out_what_takes_in_everything(spark):
    top = [(q, q % 2, (q + k) % 3, k + 1) for q in range(6) for k in range(3)]
    df = spark.createDataFrame(top, "q_id long, q_label long, g_label long, rank int").withColumn("scope", F.lit("x"))
    sizes = spark.createDataFrame([("x", 3)], "scope string, rows long")
    got = {r.k: r.recall for r in diagnosis.recalls(df, sizes, ["scope"], (1, 2, 3, 100)).collect()}
    want = {}
    for k in (1, 2):
        hits = Counter()
        for q in range(6):
            hits[q % 2] += any(g == q % 2 and r <= k for i, _, g, r in top if i == q)
        want[k] = np.mean([hits[x] / 3 for x in (0, 1)])
    assert got == pytest.approx(want)
