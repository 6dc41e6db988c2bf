import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens.functions import names, vectors
from veclens.operators import attributes, gram, metrics, similarity, splits
from veclens.sources import files


def items(spark, n, seed, dim=6, start=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(start + i, int(i % 4), rng.standard_normal(dim).tolist()) for i in range(n)], "item_id long, label int, vec array<double>")


@pytest.mark.parametrize("block", [7, 1000])
def test_matches_against_numpy(spark, block):
    q, g = items(spark, 23, 1), items(spark, 41, 2, start=100)
    unit = lambda rows: np.array([np.array(r.vec) / np.linalg.norm(r.vec) for r in rows])
    qs, gs = q.orderBy("item_id").collect(), g.orderBy("item_id").collect()
    sims = unit(qs) @ unit(gs).T
    got = similarity.matches(q, g, 5, block=block).collect()
    for i, row in enumerate(qs):
        own = sorted((r.rank, r.g_id, r.sim) for r in got if r.q_id == row.item_id)
        order = np.argsort(-sims[i], kind="stable")[:5]
        assert [x[1] for x in own] == [gs[j].item_id for j in order]
        assert [x[2] for x in own] == pytest.approx(sims[i][order].tolist())
    assert similarity.matches(q, g, None, block=block).count() == 23 * 41
    assert similarity.matches(q, q, 1, skip_self=True, block=block).where("q_id = g_id").count() == 0
    assert similarity.matches(q, g.limit(0), 3).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    g = spark.createDataFrame([(9, 1, [1.0, 0.0]), (4, 2, [2.0, 0.0]), (5, 3, [0.0, 1.0])], "item_id long, label int, vec array<double>")
    q = spark.createDataFrame([(1, 1, [3.0, 0.0])], g.schema)
    assert similarity.nearest(q, g).first().g_id == 4


def test_class_scores(spark):
    top = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 0, 0.8), (1, 0, 1, 0.85)], "q_id long, q_label int, g_label int, sim double")
    got = {r.label: r.score for r in similarity.class_scores(top, tau=1.0).collect()}
    assert got == pytest.approx({0: 1.544397, 1: 0.85}, abs=1e-6)


def roc(spark, id_scores, ood_scores):
    rows = [(s, False) for s in id_scores] + [(s, True) for s in ood_scores]
    return metrics.roc(spark.createDataFrame(rows, "score double, positive boolean")).first()


def test_roc(spark):
    r = roc(spark, [0.1, 0.4], [0.35, 0.8])
    assert (r.auroc, r.fpr) == (0.75, 0.5)
    r = roc(spark, [0.5, 0.5], [0.5, 0.5])
    assert (r.auroc, r.fpr) == (0.5, 1.0)
    r = roc(spark, [0.1, 0.2], [0.8, 0.9])
    assert (r.auroc, r.fpr, r.aupr) == (1.0, 0.0, 1.0)


def test_ranked_quality(spark):
    rows = [(1, 7, 1, 4), (1, 7, 3, 4), (2, 5, None, 4), (3, 6, 6, 9)]
    got = {r.q_id: r for r in metrics.ranked_quality(spark.createDataFrame(rows, "q_id long, q_label int, rank long, gallery long")).collect()}
    assert got[1].ap == pytest.approx((1 + 2 / 3) / 2) and got[1].mrr == 1 and got[1].purity5 == 0.5
    assert got[2].ap is None and got[2].first_rank is None and got[2].hit10 == 0
    assert (got[3].hit5, got[3].hit10, got[3].purity5) == (0, 1, 0)


@pytest.mark.parametrize("block", [7, 4096])
def test_relevant_ranks_against_numpy(spark, block):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (70, 4)).astype(float)  # many equal similarities
    rows = [(i, int(i % 5), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "item_id long, label int, vec array<double>")
    q, g = df.where("item_id < 30"), df.where("item_id >= 25 and label < 4")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    ids = [i for i in range(25, 70) if i % 5 < 4]
    want = {}
    for a in range(30):
        sims = np.array([unit[a] @ unit[b] for b in ids])
        order = sorted(range(len(ids)), key=lambda k: (-round(sims[k], 9), ids[k]))
        for rank, k in enumerate(order, 1):
            if ids[k] % 5 == a % 5:
                want[(a, ids[k])] = (rank, int((sims > sims[k] - 1e-9).sum()), int((sims > sims[k] + 1e-9).sum()))
    got = similarity.relevant_ranks(q, g, block).collect()
    assert {(r.q_id, r.g_id) for r in got if r.g_id is not None} == set(want)
    assert {r.q_id for r in got if r.g_id is None} == {a for a in range(30) if a % 5 == 4}
    # equal similarities may differ in their last bit, so a rank lies among its equals
    assert all(want[(r.q_id, r.g_id)][2] < r.rank <= want[(r.q_id, r.g_id)][1] for r in got if r.g_id is not None)


def test_galleries_by_a_column(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 3), rng.standard_normal(5).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, label int, vec array<double>")
    q, g = df.where("item_id < 20"), df.where("item_id >= 20").withColumn("part", F.concat(F.lit("p"), (F.col("item_id") % 4).cast("string")))
    got = {(r.q_id, r.part): [] for r in similarity.matches(q, g, 3, block=16, by="part").collect()}
    for r in similarity.matches(q, g, 3, block=16, by="part").orderBy("q_id", "part", "rank").collect():
        got[(r.q_id, r.part)].append(r.g_id)
    for part in ("p0", "p1", "p2", "p3"):
        for r in similarity.matches(q, g.where(F.col("part") == part).drop("part"), 3).groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", "g_id"))).alias("x")).collect():
            assert got[(r.q_id, part)] == [y.g_id for y in r.x]


def test_moments_and_colouring(spark):
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((50, 4)) @ rng.standard_normal((4, 4)), rng.standard_normal((80, 4)) + 3
    one, two = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id long, vec array<double>").repartition(3) for m in (a, b))
    cells = {(r.i, r.j): r.value for r in gram.covariance(one, 0.5).collect()}
    want = np.cov(a.T, bias=True) + 0.5 * np.eye(4)
    assert all(cells[(i, j)] == pytest.approx(want[i, j]) for i in range(4) for j in range(4))
    moved = np.array([r.vec for r in gram.coloured(one, two, 1e-9).collect()])
    assert moved.mean(axis=0) == pytest.approx(b.mean(axis=0)) and np.cov(moved.T, bias=True) == pytest.approx(np.cov(b.T, bias=True), abs=1e-5)
    assert gram.covariance(one.limit(0)).count() == 0


def test_guards(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "item_id long, label string")
    files.require_disjoint(a, a.where("false"), "label", "train")
    with pytest.raises(ValueError, match="train share labels, such as \\['x'"):
        files.require_disjoint(a, a, "label", "train")
    assert files.require_aligned(a, a.select("item_id", F.lit(1).alias("n")), "item_id").count() == 2
    for bad in (a.limit(1), a.unionByName(a)):
        with pytest.raises(ValueError):
            files.require_aligned(a, bad.select("item_id", F.lit(1).alias("n")), "item_id")
    g = a.withColumn("in_train", F.col("item_id") == 1)
    assert [files.scoped(g, s, a.limit(1)).count() for s in ("full_swi", "ce_train", "id_only")] == [2, 1, 1]
    for scope, least in (("nowhere", 1), ("ce_train", 2)):
        with pytest.raises(ValueError):
            files.scoped(g, scope, least=least)
    text = '[{"method": "m", "r1": 0.5, "note": "n", "map": {"mean": 2, "ci": 1}}]'
    rows = spark.createDataFrame([(1, text), (2, '{"k": {"r1": {"mean": 1}}}'), (3, "broken"), (4, None)], "id int, t string")
    assert {tuple(r) for r in files.result_rows(rows, "t").collect()} == {(1, "m", "r1", 0.5), (1, "m", "map", 2.0), (2, "k", "r1", 1.0)}


def test_curve_without_a_key_matches_one_with(spark):
    rng = np.random.default_rng(8)
    rows = [(float(round(s, 2)), bool(p)) for s, p in zip(rng.standard_normal(500), rng.random(500) < 0.3, strict=True)]
    df = spark.createDataFrame(rows, "score double, positive boolean").withColumn("one", F.lit(1)).withColumn("w", F.lit(3))
    (a,), (b,), (c,) = metrics.roc(df).collect(), metrics.roc(df, ["one"]).drop("one").collect(), metrics.roc(df, weight="w").collect()
    assert tuple(a) == pytest.approx(tuple(b)) and tuple(a) == pytest.approx(tuple(c))
    pos, neg = ([s for s, p in rows if p == want] for want in (True, False))
    assert a.auroc == pytest.approx(np.mean([(x > y) + 0.5 * (x == y) for x in pos for y in neg]))
    flat = spark.createDataFrame([(1.0, True), (1.0, False)], "score double, positive boolean")
    assert metrics.roc(flat).first().auroc == 0.5


def test_holm_and_spearman(spark):
    rows = [("c", "a", 0.01), ("c", "b", 0.04), ("c", "d", 0.03), ("c", "e", None)]
    got = {r.pair: r.p_holm for r in metrics.holm(spark.createDataFrame(rows, "claim string, pair string, p_value double"), ["claim"]).collect()}
    assert got.pop("e") is None and got == pytest.approx({"a": 0.03, "b": 0.06, "d": 0.06})
    xy = [("g", x, y) for x, y in zip([1.0, 2.0, 2.0, 4.0], [1.0, 3.0, 2.0, 4.0], strict=True)] + [("g", None, 1.0), ("h", 1.0, 2.0), ("h", 2.0, 1.0)]
    got = {r.k: r.rho for r in metrics.spearman(spark.createDataFrame(xy, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert got["g"] == pytest.approx(0.948683, abs=1e-6) and got["h"] is None


def test_names(spark):
    def one(value, f):
        return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y

    assert one("Acer Rubrum", names.canonical_label) == "acer_rubrum"
    assert one(" a b ", names.canonical_label) == "_a_b_"
    assert one("12-Bétula_pendula ", names.standard_name) == "betula pendula"
    assert one("acer saccharum var. nigrum (michx.)", names.without_authority) == "acer saccharum var. nigrum"
    assert one("quercus robur l.", names.without_authority) == "quercus robur"
    assert one("quercus", names.without_authority) == "quercus"
    assert [one(x, names.standard_name) for x in ("dąb", "Świerk", "Wiąz\u0307y", "同じ x")] == ["dab", "swierk", "wiazy", "x"]
    assert one("\tPicea  ABIES Subsp. obovata (Ledeb.) ", names.without_authority) == "picea abies subsp. obovata"
    both = lambda x, v: tuple(names.preprocessed(spark.createDataFrame([(x,)], "x string"), F.col("x"), F.lit(v)).select("query", "variant", "std").first())
    assert both("07-Dąb", True) == ("quercus robur", "", "quercus robur") and both("07-Dąb", False) == ("dab", "", "dab")
    assert both("Shorea sp. 2", True) == ("shorea sp", "spp.", "shorea sp.") and both("Cupresus_lusitanica Mill. 3", True) == ("cupressus lusitanica", "", "cupressus lusitanica")
    for given, want in {"shorea spp": ("shorea sp", "spp."), "Shorea SP. 2": ("Shorea sp", "spp. 2"), "a b c 4": ("a b c 4", ""), "shorea spp. 2": ("shorea sp", "spp. 2"), "acer rubrum 3": ("acer rubrum", "specimen 3"), "acer rubrum": ("acer rubrum", "")}.items():
        assert tuple(one(given, names.variant)) == want
    pairs = [("Acer rubrum L.", "acer rubrum", "acer rubrum"), ("Shorea Roxb.", "shorea sp", "shorea sp."), (None, "x", "")]
    for r in spark.createDataFrame(pairs, "a string, q string, want string").select(names.binomial(F.col("a"), F.col("q")).alias("got"), "want").collect():
        assert r.got == r.want
    assert [r.y for r in spark.createDataFrame([(0.25,), (0.26,), (0.74,), (0.75,), (None,)], "x double").select(names.rounded(F.col("x")).alias("y")).collect()] == [0.0, 0.5, 0.5, 1.0, None]


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>").select(vectors.energy("x").alias("e"), vectors.one_minus_top_softmax("x").alias("m"), vectors.retrieval_energy("x", 0.5).alias("r")).first()
    x = np.array([1.0, 2.0, 4.0])
    assert row.e == pytest.approx(-math.log(np.exp(x).sum()))
    assert row.m == pytest.approx(1 - np.exp(4) / np.exp(x).sum())
    assert row.r == pytest.approx(-(4 + 0.5 * math.log(np.exp((x - 4) / 0.5).sum())))


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (10, (6, 1, 3)), (20, (13, 3, 4))])
def test_three_way_split(spark, n, want):
    rows = spark.createDataFrame([(i, "a") for i in range(n)], "item_id long, label string")
    got = {r.split: r["count"] for r in splits.train_val_test(rows, ["label"]).groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == want
    same = splits.train_val_test(rows.repartition(3), ["label"])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, splits.train_val_test(rows, ["label"]).collect()))


def test_manifest_of_nested_lists(spark):
    rows = ['{"train": [["a/1.jpg", "x"], ["a/1.jpg", "x"], ["a/2.jpg", null]], "val": []}', '{"test": null, "train": [["b/1.jpg", "y"]]}', None]
    items = files.manifest_items(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "part int, value string"))
    assert sorted((r.part, r.split, r.pos, r.path, r.label or "") for r in items.collect()) == [(0, "train", 0, "a/1.jpg", "x"), (0, "train", 1, "a/1.jpg", "x"), (0, "train", 2, "a/2.jpg", ""), (1, "train", 0, "b/1.jpg", "y")]
    assert [tuple(r) for r in files.manifest_counts(items).collect()] == [("train", 4, 3, 2)]
    for bad in ('{"train": [["a"]]}', '{"train": [["a", "b", "c"]]}', '[1]', '{"train": 3}'):
        with pytest.raises(Exception, match="pair of path|MALFORMED|PARSE"):
            files.manifest_items(spark.createDataFrame([(bad,)], "value string")).collect()


def test_uninformative_columns(spark):
    """Forty attributes, some of them of odd names, in every kind of presence."""
    kinds = {"all": [1.0, 1.0, 1.0], "none": [0.0, 0.5, 0.0], "some": [1.0, 0.0, 1.0], "half": [0.5, 0.5, 0.5], "all known": [1.0, None, 1.0], "none known": [None, 0.5, None], "unknown": [None, None, None], "one": [None, 1.0, 0.0]}
    columns = {f"{k}.{i}": v for i in range(5) for k, v in kinds.items()}
    rows = [(label, *(v[i] for v in columns.values())) for i, label in enumerate("xyz")]
    df = spark.createDataFrame(rows, "label string, " + ", ".join(f"`{c}` double" for c in columns))
    kept = attributes.informative(df, ["label"])
    assert kept.columns == ["label", *(c for c in columns if c.split(".")[0] in ("some", "unknown", "one"))]
    assert attributes.informative(df.select("label"), ["label"]).columns == ["label"]
    assert attributes.informative(df.limit(0), ["label"]).columns == df.columns


def test_coverage(spark):
    expected = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4), ("b", "y", 5), ("c", "x", 6), ("c", "x", 7)]
    got = files.coverage(spark.createDataFrame(expected, "part string, source string, k int"), spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (6,), (99,)], "k int"), "k")
    assert sorted(map(tuple, got.collect())) == [("a", 2, 2, 3, 3, "FOUND"), ("b", 2, 1, 2, 1, "1 of 2"), ("c", 1, 0, 2, 1, "MISSING")]
