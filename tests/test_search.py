"""Searches whose tasks keep what is found: results against plain versions, and what is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens.operators import metrics, resampling, similarity

ITEMS = "item_id long, label int, vec array<double>"


def rows(n, seed, labels, start=0):
    """Half of the vectors lie on the axes, so that many similarities are exactly equal."""
    rng = np.random.default_rng(seed)
    vec = lambda i: np.eye(3)[rng.integers(3)] * rng.choice([-1, 1]) if i % 2 else rng.standard_normal(3)
    return [(int(i), None if k % 17 == 0 else int(rng.integers(labels)), vec(k).tolist()) for k, i in enumerate(rng.permutation(n) + start)]


def ranking(v, g):
    """Ids, labels and similarities of g, the nearest first."""
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    return sorted(((-round(float(unit(w) @ unit(v)), 12), i, label) for i, label, w in g), key=lambda x: x[:2])


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(similarity, "LEAST_ROWS", 3)


@pytest.mark.parametrize("options", [{"block": 16, "held": 100}, {"block": 16, "bins": 2, "held": 1000}, {"block": 32, "depth": 5}])
def test_quality_against_plain(spark, small_groups, options):
    q, g = rows(60, 1, 8), rows(200, 2, 6, 1000)
    found = similarity.relevant_quality(spark.createDataFrame(q, ITEMS), spark.createDataFrame(g, ITEMS), **options)
    got = {r.q_id: r for r in metrics.quality(found).collect()}
    assert len(got) == found.count() == 60
    for i, label, v in q:
        rank = [k + 1 for k, x in enumerate(ranking(v, g)) if label is not None and x[2] == label]
        r = got[i]
        assert (r.first_rank, r.hit1, r.hit5, r.hit10) == ((rank or [None])[0], *(int(bool(rank) and rank[0] <= k) for k in (1, 5, 10)))
        assert r.purity5 == pytest.approx(sum(k <= 5 for k in rank) / 5) and r.gallery == 200
        want = np.mean([(k + 1) / x for k, x in enumerate(rank)]) if rank else None
        assert r.ap == (pytest.approx(want) if rank and "depth" not in options else None)


@pytest.mark.parametrize("m", [1, 7, 90])
def test_nearest_in_groups_against_plain(spark, small_groups, m):
    q, g = rows(40, 3, 5), rows(80, 4, 5, 20)
    frames = [spark.createDataFrame(x, ITEMS).withColumn("part", F.concat(F.lit("k"), F.col("item_id") % 3)) for x in (q, g)]
    for options, inside in (({}, lambda i, j: True), ({"skip_self": True}, lambda i, j: i != j), ({"within": "part"}, lambda i, j: i % 3 == j % 3)):
        got = {(r.q_id, r["rank"]): (r.g_id, r.g_label) for r in similarity.matches(*frames, m, block=16, **options).collect()}
        want = {(i, k + 1): x[1:] for i, _, v in q for k, x in enumerate([x for x in ranking(v, g) if inside(i, x[1])][:m])}
        assert {k for k in got} == {k for k in want} and sum(got[k] != want[k] for k in want) <= 0.01 * len(want)  # a last bit apart
    each = similarity.matches(frames[0], frames[1], m, block=16, by="part").groupBy("part", "q_id").count().collect()
    assert len(each) == 3 * 40 and {r["count"] for r in each} <= {min(m, sum(j % 3 == k for j, *_ in g)) for k in range(3)}


@pytest.mark.parametrize("m", [1, 5])
@pytest.mark.parametrize("near", [1e-9, 0.0])
def test_single_precision_decides_nothing(spark, small_groups, monkeypatch, m, near):
    """Rows that only double precision tells apart are ranked by it, copies by their ids; products of double precision are few."""
    monkeypatch.setattr(similarity, "TILE", 32)
    rng = np.random.default_rng(11)
    own = rng.standard_normal(16)
    g = [(1000 + i, i % 3, (own + near * rng.standard_normal(16) if i % 4 == 0 else rng.standard_normal(16)).tolist()) for i in range(200)]
    q = [(i, 0, (own + 0.3 * rng.standard_normal(16) if i % 2 else rng.standard_normal(16)).tolist()) for i in range(30)]
    got = {(r.q_id, r["rank"]): r.g_id for r in similarity.matches(spark.createDataFrame(q, ITEMS), spark.createDataFrame(g, ITEMS), m, block=64).collect()}
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    for i, _, v in q:
        want = sorted((-round(float(unit(w) @ unit(v)), 14), j) for j, _, w in g)[:m]
        assert [got[i, k + 1] for k in range(m)] == [j for _, j in want]
    x, y = (np.stack([unit(v) for v in rng.standard_normal((n, 64))]) for n in (50, 1000))
    sims = x @ y.T
    row, at = similarity._close(x.astype(np.float32), y.astype(np.float32), np.full(50, -np.inf), m, [(3, int(sims[3].argmax()), int(sims[3].argmax()) + 1)])
    sims[3, sims[3].argmax()] = -np.inf
    found = set(zip(row.tolist(), at.tolist(), strict=True))
    assert found >= {(r, int(c)) for r in range(50) for c in np.argsort(-sims[r])[:m]} and len(found) < 50 * m + 50
    assert np.allclose(similarity._products(x, y, row, at), sims[row, at], rtol=0, atol=1e-14)


def test_repeated_ids_and_vectors_that_are_not_finite(spark):
    q = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [float("nan"), 1.0])]
    g = [(5, 0, [1.0, 0.0]), (6, 1, [0.6, 0.8]), (7, 0, [float("inf"), 0.0])]
    got = similarity.matches(spark.createDataFrame(q, ITEMS), spark.createDataFrame(g, ITEMS), 2).collect()
    assert [(r.q_id, r.g_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 5, 1), (1, 6, 2)]
    found = {r.q_id: r.first_rank for r in similarity.relevant_quality(spark.createDataFrame(q[1:], ITEMS), spark.createDataFrame(g, ITEMS)).collect()}
    assert found == {1: 2, 2: None}


def test_nothing_found_is_shuffled(spark):
    """The best rows of a query, and the ranks of all that is relevant to it, never leave the task that has the query."""
    q, g = spark.createDataFrame(rows(40, 5, 3), ITEMS), spark.createDataFrame(rows(90, 6, 3), ITEMS)
    for df in (similarity.matches(q, g, 5), similarity.relevant_quality(q, g)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Window" not in plan[: plan.index("MapInArrow")]
    assert similarity.sizes(similarity.relevant_quality(q, g)) == [40]


def test_as_many_groups_whatever_the_size():
    """The gallery is shuffled once a group, so that more queries must not make more groups before one is full."""
    groups = [similarity._parts(n, similarity._rows_of(n, 50)) for n in (10_000, 100_000, 600_000, 1_000_000)]
    assert max(groups) <= similarity.GROUPS and min(groups) > similarity.GROUPS // 2


def test_a_large_label_makes_no_more_groups(spark, small_groups, monkeypatch):
    """The gallery is shuffled, and its blocks copied in memory, once a group, however few similarities a task may hold."""
    groups, passing = [], similarity._passing
    monkeypatch.setattr(similarity, "_passing", lambda asked, held, keys, order: (groups.append(asked.select(*keys).distinct().count()), passing(asked, held, keys, order))[1])
    q, g = spark.createDataFrame(rows(60, 1, 3), ITEMS), spark.createDataFrame(rows(200, 2, 3, 1000), ITEMS)
    found = [{tuple(r) for r in similarity.relevant_quality(q, g, block=16, held=held).collect()} for held in (1 << 20, 70)]
    assert groups[0] == groups[1] and found[0] == found[1] and len(found[0]) == 60
    assert similarity._cuts(np.array([3, 3, 3, 9, 1, 1]), 6) == [0, 2, 3, 4, 6] and similarity._cuts(np.array([7]), 6) == [0, 1]


def test_what_resampled_scores_come_from_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    scores = spark.range(50).selectExpr("id as q_id", "cast(id % 2 as int) as pos", "cast(id as double) as score", "'x' as k").mapInArrow(counted, "q_id long, pos int, score double, k string")
    assert resampling.curves(scores, ["k"], 3).count() == 3 and seen.value == 50


def test_settings_are_scored_where_the_rows_are(spark, small_groups, monkeypatch):
    """Each setting's classes are those of `class_scores` over its nearest rows, and no found row is shuffled or repeated for a setting."""
    monkeypatch.setattr(similarity, "TOGETHER", 25)
    q, g = rows(30, 7, 4), [(i, label or 0, v) for i, label, v in rows(80, 8, 4, 1000)]
    q, g = (spark.createDataFrame(x, ITEMS).withColumn("part", F.concat(F.lit("k"), F.col("item_id") % 2)) for x in (q, g))
    top, counts = similarity.matches(q, g, 30, block=16, within="part").withColumn("sim", F.round("sim", 9)), g.groupBy("label").agg(F.count("*").alias("n"))
    found = similarity.settled(top, counts, "part", (3, 20), (0.07, 0.2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("MapInArrow", plan.index("MapInArrow") + 10)].count("Exchange") <= plan[: plan.index("MapInArrow", plan.index("MapInArrow") + 10)].count("BroadcastExchange") * 2
    got = {(r.m, r.tau, r["mean"], r.q_id): (r.part, r.q_label, r.pred) for r in found.collect()}
    assert len(got) == 8 * 30
    near = top.withColumn("at", F.expr("row_number() over (partition by part, q_id order by sim desc, g_id)"))
    for m, tau, mean in ((3, 0.07, False), (3, 0.2, True), (20, 0.07, True), (20, 0.2, False)):
        scores = similarity.class_scores(near.where(F.col("at") <= m), tau, counts if mean else None).withColumn("score", F.round("score", 7))
        assert all(got[m, tau, mean, r.q_id] == (f"k{r.q_id % 2}", r.q_label, r.pred) for r in similarity.best_class(scores).collect())
