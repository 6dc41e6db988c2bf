"""Operators that must not bring a hot key, or a row for each draw, together: results against plain versions, and what a task gets."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens import registry
from veclens.operators import heads, metrics, resampling, sampling, similarity, splits
from veclens.operators.gram import residual_head
from veclens.plans import measures, suites

SMALL = "/root/testdata/sf0.001"
ITEMS = "item_id long, label int, vec array<double>"


def vectors(n, seed, dim=5, start=0, labels=4):
    rng = np.random.default_rng(seed)
    return [(start + i, int(rng.integers(labels)), rng.standard_normal(dim).tolist()) for i in range(n)]


# ---- search inside a key


def test_within_a_key(spark):
    q = [(*r, ["a", "b", "c", None][i % 4]) for i, r in enumerate(vectors(60, 1))]
    g = [(*r, "a" if i % 3 else ["b", "d", None][i // 3 % 3]) for i, r in enumerate(vectors(150, 2, start=1000))]
    schema = f"{ITEMS}, source string"
    got = similarity.matches(spark.createDataFrame(q, schema), spark.createDataFrame(g, schema), 3, block=7, within="source").collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = set()
    for i, _, v, s in q:
        near = sorted((-(unit(v) @ unit(w)), j) for j, _, w, t in g if t == s and s is not None)
        want.update((i, j, s, k + 1) for k, (_, j) in enumerate(near[:3]))
    assert {(r.q_id, r.g_id, r.source, r["rank"]) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        similarity.matches(spark.createDataFrame(q, schema), spark.createDataFrame(g, schema), 1, by="source", within="source")


def test_no_pair_of_blocks_of_different_keys(spark):
    q, g = (spark.createDataFrame(vectors(n, n), ITEMS).withColumn("source", F.when(F.col("item_id") % 10 < 7, 0).otherwise(F.col("item_id") % 10)) for n in (300, 500))
    pairs = similarity._pairs_within(q, g, "source", 32).collect()
    for r in pairs:
        assert {x.item_id % 10 < 7 for x in [*r.qb_rows, *r.gb_rows]} == {r.source == 0}
    assert len(pairs) > 60 and max(len(r.gb_rows) for r in pairs) < 80  # the hot source is cut into blocks, too
    asked = Counter((x.item_id, y.item_id) for r in pairs for x in r.qb_rows for y in r.gb_rows)
    assert set(asked.values()) == {1} and len(asked) == sum(a * b for a, b in zip(*((Counter(0 if i % 10 < 7 else i % 10 for i in range(n)).values()) for n in (300, 500))))


# ---- ranks of a hot label


@pytest.mark.parametrize(("block", "bundle"), [(16, 50), (16, 1 << 20), (1000, 50)])
def test_ranks_of_a_hot_label(spark, block, bundle):
    g = [(i, 0 if i % 3 == 0 else i % 7, v) for i, _, v in vectors(200, 3, start=500)]
    q = [(i, i % 9, v) for i, _, v in vectors(40, 4)] + [(99, None, [1.0] * 5)]
    got = similarity.relevant_ranks(spark.createDataFrame(q, ITEMS), spark.createDataFrame(g, ITEMS), block, bundle).collect()
    x = np.array([v for _, _, v in g])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i, label, v in q:
        order = np.argsort(-(x @ np.array(v)), kind="stable")
        own = {(i, g[j][0]): k + 1 for k, j in enumerate(order) if g[j][1] == label}
        want.update(own or {(i, None): None})
    assert {(r.q_id, r.g_id): r["rank"] for r in got} == want and len(got) == len(want) and {r.gallery for r in got} == {200}


def test_bundles_stay_small(spark):
    """A label with a third of the gallery makes more bundles, not larger ones: a task's row never has more than a bundle and a block."""
    g, q = ([(i, 0 if i % 3 == 0 else 1 + i % 40, v) for i, _, v in vectors(n, n)] for n in (600, 100))
    sizes = {}
    for bundle in (400, 1 << 20):
        packed = similarity.bundles(spark.createDataFrame(q, ITEMS), spark.createDataFrame(g, ITEMS), 32, bundle)
        sizes[bundle] = [r.n for r in packed.select(F.size("own").alias("n")).collect()]
    assert sum(sizes[400]) == sum(sizes[1 << 20]) > 30 * 200
    assert max(sizes[400]) < 400 + 2 * 32 * 32 and len(sizes[400]) > 4 * len(sizes[1 << 20])


# ---- samples


def test_least(spark):
    rows = [(i, None if i % 5 == 0 else "k" if i % 3 else f"k{i % 4}", hashlib.md5(str(i).encode()).hexdigest()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, key string, h string").repartition(3)
    got = Counter()
    for kept in (1 << 26, 1):
        found = sampling.least(df, ["key"], 7, kept_bytes=kept).collect()
        want = {}
        for i, key, h in rows:
            want.setdefault(key, []).append((h, i))
        assert {(r.key, r.place, r.id) for r in found} == {(k, n + 1, i) for k, xs in want.items() for n, (_, i) in enumerate(sorted(xs)[:7])}
        got[kept] = sampling._partial(df, ["key"], 7, None, 0, kept).count()
    assert got[1 << 26] <= 7 * 6 * 3  # what is shuffled: k rows a key and task


def test_drawn(spark):
    rows = [(i, i % 3 if i % 2 else 0, [float(i)]) for i in range(600)]
    df = spark.createDataFrame(rows, ITEMS).repartition(3)
    got = sampling.drawn(df, ["label"], 4, 20, 42).collect()
    want = set()
    for rep in range(20):
        for label in range(3):
            h = sorted((hashlib.md5(f"42:{rep}:{label}:{i}".encode()).hexdigest(), i) for i, x, _ in rows if x == label)
            want.update((rep, label, i, k + 1) for k, (_, i) in enumerate(h[:4]))
    assert {(r.rep, r.label, r.item_id, r.place) for r in got} == want and all(r.vec == [float(r.item_id)] for r in got)
    assert sampling._partial(df.withColumn("h", F.concat_ws(":", "label", "item_id")), ["label"], 4, 20, 42, 1 << 26).count() <= 4 * 3 * 20 * 3
    assert splits.sampled(df, ["label"], 4, 20).count() == len(want) and sampling.drawn(df.limit(0), ["label"], 4, 2).count() == 0


def test_placed_in_ranges(spark):
    rows = [(i, None if i % 11 == 0 else 0 if i % 3 else i % 5, [0.0]) for i in range(1500)]
    got = splits.placed(spark.createDataFrame(rows, ITEMS), ["label"]).collect()
    want = {}
    for i, label, _ in rows:
        text = f"42:{i}" if label is None else f"42:{label}:{i}"
        want.setdefault(label, []).append((hashlib.md5(text.encode()).hexdigest(), i))
    assert {(r.item_id, r.label, r.place, r.n) for r in got} == {(i, k, n + 1, len(xs)) for k, xs in want.items() for n, (_, i) in enumerate(sorted(xs))}
    plan = splits.placed(spark.createDataFrame(rows, ITEMS), ["label"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert windows and all("range#" in line for line in windows)  # no window over a whole label numbers rows


# ---- resampled curves


def plain_curve(score, positive, w):
    """auroc, fpr, aupr of weighted rows."""
    order = np.argsort(-score, kind="stable")
    p, n = (w * positive).sum(), (w * (1 - positive)).sum()
    tp = fp = area = precision = 0
    first = None
    for s in sorted(set(score[order]), reverse=True):
        at = score == s
        pos, neg = (w * positive)[at].sum(), (w * (1 - positive))[at].sum()
        tp, fp = tp + pos, fp + neg
        area += pos * (n - fp + neg / 2)
        precision += pos * tp / (tp + fp) if tp + fp else 0
        if first is None and tp >= 0.95 * p:
            first = fp
    return area / p / n, first / n, precision / p


def test_resampled_curves(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 8)
    rng = np.random.default_rng(7)
    rows = [(g, i * 2**33 - 5, int(rng.random() < 0.4), round(float(rng.normal()), 1 if g == "ties" else 6)) for g in ("ties", "none") for i in range(150)] + [("flat", i, i % 2, 0.5) for i in range(40)]
    got = resampling.curves(spark.createDataFrame([*rows, ("ties", 3, 1, None)], "g string, q_id long, pos int, score double").repartition(3), ["g"], 12).collect()
    assert len(got) == 36
    for g in ("ties", "none", "flat"):
        ids, pos, score = (np.array(x) for x in zip(*[r[1:] for r in rows if r[0] == g]))
        w = resampling.counts(ids, pos, 12)
        for r in (r for r in got if r.g == g):
            assert (r.auroc, r.fpr, r.aupr) == pytest.approx(plain_curve(score, pos, w[:, r.b]))


def test_a_class_that_is_not_there(spark):
    rows = [("a", 1, 1, 0.5), ("a", 2, 1, 0.7)]
    got = resampling.curves(spark.createDataFrame(rows, "g string, q_id long, pos int, score double"), ["g"], 5).collect()
    assert len(got) == 5 and all(r.auroc is None and r.fpr is None for r in got)


def test_counts_are_poisson_and_intervals_as_with_replacement(spark):
    """Against rows drawn with replacement: means within a thousandth, ends of the interval within a tenth of its width."""
    n, draws = 400, 1000
    w = resampling.counts(np.arange(n), np.arange(n) % 2, draws)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    for k, share in enumerate([math.exp(-1) / math.factorial(k) for k in range(5)]):
        assert (w == k).mean() == pytest.approx(share, abs=0.003)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.12 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2
    rng = np.random.default_rng(1)
    pos = np.arange(n) % 2
    score = rng.normal(size=n) + 0.8 * pos
    got = resampling.curves(spark.createDataFrame([("g", i, int(p), float(s)) for i, (p, s) in enumerate(zip(pos, score))], "g string, q_id long, pos int, score double"), ["g"], draws).toPandas().auroc.to_numpy()
    want = []
    for _ in range(draws):
        a, b = (rng.choice(score[pos == k], n // 2) for k in (1, 0))
        want.append((np.searchsorted(np.sort(b), a) / len(b)).mean())
    ends, wanted = (np.percentile(x, [2.5, 97.5]) for x in (got, want))
    assert got.mean() == pytest.approx(np.mean(want), abs=0.003)
    assert np.abs(ends - wanted).max() < 0.15 * (wanted[1] - wanted[0])


def test_an_outlier_widens_no_range(spark):
    rows = [(float(x), bool(i % 3)) for i, x in enumerate(np.random.default_rng(3).normal(size=3000))] + [(1e12, True), (-1e12, False)]
    df = spark.createDataFrame(rows, "score double, positive boolean")
    sizes = [r["count"] for r in metrics.in_ranges(df, [], "score").groupBy("range").count().collect()]
    assert len(sizes) == metrics.RANGES and max(sizes) < 120
    assert metrics.roc(df).first().auroc == pytest.approx(plain_curve(np.array([r[0] for r in rows]), np.array([int(r[1]) for r in rows]), np.ones(len(rows)))[0])


# ---- spaces, scorers and heads


def test_a_space_and_a_scorer_take_part_unchanged(spark):
    def nearest_row(queries, gallery):
        top = similarity.matches(queries, gallery, 1)
        return top.select("q_id", "q_label", F.col("g_label").alias("label"), F.col("sim").alias("score"))

    with registry.registered({"own": nearest_row}, {"Twice": (lambda items: items.withColumn("vec", F.transform("vec", lambda x: 2 * x)), "own")}, modes=True):
        rows = {(r.space, r.scope): r.asDict() for r in suites.headline(spark, SMALL).collect()}
        assert len(rows) == 8
        for scope in ("full", "id_only"):
            a, b = rows[("Twice", scope)], rows[("Full", scope)]
            assert all(a[c] == pytest.approx(b[c]) for c in ("proto", "r1", "auroc", "fpr", "old", "new"))
        table = {r.space: r.asDict() for r in measures.master_summary(spark, SMALL).collect()}
        assert set(table) == {"A", "B", "Full", "Twice"} and all(table["Twice"][c] == pytest.approx(table["Full"][c]) for c in measures.MEASURES)
        assert {r.space for r in measures.space_ablation(spark, SMALL).collect()} == set(table)
        modes = {r.mode: r for r in suites.memory_mode_ablation(spark, SMALL).collect()}
        assert len(modes) == 7 and modes["own"].r1 == pytest.approx(table["Full"]["r1"]) and modes["own"].old == pytest.approx(table["Full"]["old"])
    assert "Twice" not in registry.SPACES and "own" not in registry.SCORERS and "own" not in registry.MODES


def test_registry_refuses(spark):
    for bad in (lambda: registry.register_space("Full", lambda x: x), lambda: registry.register_scorer("raw", None), lambda: registry.register_space("X", lambda x: x, "nobody"), lambda: registry.scored("nobody", None, None)):
        with pytest.raises(ValueError):
            bad()
    one = spark.createDataFrame(vectors(4, 1), ITEMS)
    with registry.registered({"short": lambda q, g: q.select(F.col("item_id").alias("q_id"))}, {"table": (one, "raw")}):
        with pytest.raises(ValueError, match="q_label"):
            registry.scored("short", one, one)
        assert registry.SPACES["table"].build(None).count() == 4


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_heads_of_a_table(spark, most):
    rng = np.random.default_rng(9)
    made = {h: {"base": rng.normal(size=(3, 5)), "hidden": rng.normal(size=(4, 5)), "out": rng.normal(size=(3, 4))} for h in ("x", "y")} | {"z": {"hidden": rng.normal(size=(2, 5)), "out": rng.normal(size=(5, 2))}}
    rows = [(h, layer, i, r.tolist()) for h, layers in made.items() for layer, m in layers.items() for i, r in enumerate(m)]
    table = spark.createDataFrame(rows, heads.SCHEMA).repartition(3)
    items = vectors(20, 2)
    got = heads.projected(spark.createDataFrame(items, ITEMS), table, 0.3, most).collect()
    assert len(got) == 60
    for r in got:
        layers = made[r.head]
        want = residual_head(np.array([items[r.item_id][2]]), layers.get("base"), layers["hidden"], layers["out"], 0.3)
        assert r.vec == pytest.approx(want[0].tolist()) and r.label == items[r.item_id][1]
    assert heads.projected(spark.createDataFrame(items, ITEMS), table.limit(0)).count() == 0


def test_heads_with_gaps_are_refused(spark):
    for rows in ([("h", "base", 1, [1.0])], [("h", "base", 0, [1.0]), ("h", "base", 0, [2.0])], [("h", "base", 0, [1.0]), ("h", "base", 1, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            heads.load(spark.createDataFrame(rows, heads.SCHEMA))


def test_fitted_heads_differ_by_seed_and_follow_their_rows(spark):
    rows = vectors(90, 4)
    made = heads.load(heads.fitted(spark.createDataFrame(rows, ITEMS), (1, 2)))
    assert set(made) == {"1", "2"} and not np.allclose(made["1"]["base"], made["2"]["base"])
    for seed, layers in made.items():
        kept = {}
        for label in range(4):
            own = sorted((hashlib.md5(f"{seed}:{label}:{i}".encode()).hexdigest(), v) for i, x, v in rows if x == label)
            kept[label] = np.mean([np.array(v) / np.linalg.norm(v) for _, v in own[: max(1, int(0.65 * len(own)))]], axis=0)
        base = np.array([kept[k] for k in range(4)])
        less = base - base.mean(axis=0)
        assert np.allclose(layers["base"], base) and np.allclose(layers["hidden"], less) and np.allclose(layers["out"], less @ less.T)
