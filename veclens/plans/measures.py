"""Every measure of every space and head, and what is selected by them. Spaces and scorers come from the registry, heads from a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import registry
from ..functions import vectors
from ..operators import heads, metrics, similarity, splits
from ..operators.scorers import TAU, centred
from ..sources import tables
from .protocols import _SPACES, spaces
from .queries import E, _r, _roles, _sims, centroids, query
from .suites import _CURVES, _NEIGHBOURS, novel_validation

MEASURES = ("proto", "r1", "auroc", "fpr", "old", "new", "transfer")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_novel(g: DataFrame, o: DataFrame, most: int = 10) -> DataFrame:
    """The gallery with the first rows of each novel label's references."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("item_id"))
    return g.unionByName(o.where("item_id % 2 = 0").withColumn("at", place).where(F.col("at") <= most).drop("at"))


def _novel(c: str = "q_label") -> Column:
    return F.col(c) > tables.LAST_KNOWN


def space_measures(spark, sf) -> DataFrame:
    """space, gallery_rows, gallery_labels and MEASURES of every registered space, by its scorer.

    proto: by the nearest centroid; r1: macro accuracy; auroc, fpr: of one less the nearest similarity; old, new: accuracy once ten rows of
    each novel label have joined the gallery; transfer: queries of one facet against the other facets' gallery.
    """
    asked, held, preds, sizes = [], [], [], []
    for name, s in spaces(tables.read_embeddings(spark, sf)).items():
        scorer = registry.SPACES[name].scorer
        g, q, o = tables.gallery(s), tables.id_queries(s), tables.ood_queries(s)
        third, odd = F.col("item_id") % 3 == 0, o.where("item_id % 2 = 1")
        parts = {"r1": (q.unionByName(o), g), "big": (q.unionByName(odd), with_novel(g, o)), "transfer": (q.where(third), g.where(~third)), "proto": (q, centroids(g))}
        for size, (ask, rows) in parts.items():
            if scorer == registry.NEAREST or size in ("r1", "proto"):
                for rows_, into in ((ask, asked), (rows, held)):
                    into.append(rows_.select(F.col("item_id").cast("long").alias("item_id"), "label", "vec", F.lit(f"{name}:{size}").alias("part")))
            if scorer != registry.NEAREST and size != "proto":
                own = registry.predicted(scorer, ask.where(F.col("label") <= tables.LAST_KNOWN) if size == "r1" else ask, rows)
                preds.append(own.select(F.lit(name).alias("space"), F.lit(size).alias("size"), "q_label", "pred"))
        sizes.append(g.agg(F.count("*").alias("gallery_rows"), F.count_distinct("label").alias("gallery_labels")).withColumn("space", F.lit(name)))
    near = similarity.matches(_union(asked), _union(held), 1, within="part")  # all spaces and galleries in one pass, each in itself
    near = tables.staged(near.select(F.split("part", ":")[0].alias("space"), F.split("part", ":")[1].alias("size"), "q_label", F.col("g_label").alias("pred"), "sim"), "measures")
    curve = near.where("size = 'r1'").select("space", _novel().alias("positive"), F.round(1 - F.col("sim"), 9).alias("score"))
    rows = near.where((F.col("size") != "r1") | ~_novel()).select("space", "size", "q_label", "pred")
    if preds:
        own = _union(preds)
        rows = rows.join(own.select("space", "size").distinct(), ["space", "size"], "left_anti").unionByName(own)
    kind = F.when(F.col("size") != "big", F.col("size")).when(_novel(), "new").otherwise("old")
    wide = metrics.macro(rows.withColumn("kind", kind), ["space", "kind"]).groupBy("space").pivot("kind", [k for k in MEASURES if k not in ("auroc", "fpr")]).agg(F.max("macro"))
    return _union(sizes).join(wide, "space", "left").join(metrics.roc(curve, ["space"]).drop("aupr"), "space", "left")


_MEASURED = f"""{_SPACES}, g AS (SELECT * FROM n WHERE item_id % 2 = 0 AND label <= 7), q AS (SELECT * FROM n WHERE item_id % 2 = 1 AND label <= 7), pool AS (SELECT * FROM n WHERE label > 7 AND item_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY space, label ORDER BY item_id) <= 10),
gb AS (SELECT 'base' AS size, * FROM g UNION ALL SELECT 'big', * FROM g UNION ALL SELECT 'big', * FROM pool UNION ALL SELECT 'part', * FROM g WHERE item_id % 3 <> 0), ask AS (SELECT * FROM n WHERE label > 7 OR item_id % 2 = 1),
b AS (SELECT size, a.space, a.item_id, a.label AS q_label, gb.label AS g_label, list_dot_product(a.v, gb.v) / (a.l * gb.l) AS sim FROM ask a JOIN gb USING (space) WHERE size <> 'part' OR (a.label <= 7 AND a.item_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY size, a.space, a.item_id ORDER BY sim DESC, gb.item_id) = 1),
pu AS (SELECT space, label, i, avg(x) AS m FROM (SELECT space, label, unnest(list_transform(v, lambda x: x / l)) AS x, unnest(range(1, len(v) + 1)) AS i FROM g) GROUP BY ALL), pc AS (SELECT space, label, list(m ORDER BY i) AS v FROM pu GROUP BY space, label),
pb AS (SELECT 'proto' AS size, q.space, q.item_id, q.label AS q_label, pc.label AS g_label, 0.0::DOUBLE AS sim FROM q JOIN pc USING (space) QUALIFY row_number() OVER (PARTITION BY q.space, q.item_id ORDER BY list_dot_product(q.v, pc.v) / (q.l * sqrt(list_dot_product(pc.v, pc.v))) DESC, pc.label) = 1),
ac AS (SELECT space, size, q_label, avg((q_label = g_label)::INT) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM pb) WHERE q_label <= 7 OR item_id % 2 = 1 GROUP BY ALL),
z AS (SELECT space, (q_label > 7)::INT AS pos, round(1 - sim, 9) AS score, 1 AS w FROM b WHERE size = 'base'), {_CURVES.format(c="cv", by="space", rows="z")},
me AS (SELECT space, avg(x) FILTER (size = 'proto') AS proto, avg(x) FILTER (size = 'base' AND q_label <= 7) AS r1, any_value(auroc) AS auroc, any_value(fpr) AS fpr, avg(x) FILTER (size = 'big' AND q_label <= 7) AS old, avg(x) FILTER (size = 'big' AND q_label > 7) AS new, avg(x) FILTER (size = 'part') AS transfer FROM ac JOIN cvr USING (space) GROUP BY space),
ms AS (SELECT me.*, (SELECT count(*) FROM g WHERE g.space = me.space) AS gallery_rows, (SELECT count(DISTINCT label) FROM g WHERE g.space = me.space) AS gallery_labels FROM me)"""
_LONG = "SELECT space, metric, value FROM me UNPIVOT (value FOR metric IN (" + ", ".join(MEASURES) + "))"


@query(f"{_MEASURED} SELECT space, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("r1", "auroc", "fpr", "old", "new")) + " FROM ms")
def space_ablation(spark, sf):
    return space_measures(spark, sf).select("space", *map(_r, ("r1", "auroc", "fpr", "old", "new")))


@query(f"{_MEASURED} SELECT space, gallery_rows, gallery_labels, " + ", ".join(f"round({c}, 6) AS {c}" for c in MEASURES) + " FROM ms")
def master_summary(spark, sf):
    """A row for each space over all result tables, nulls where one has none."""
    return space_measures(spark, sf).select("space", "gallery_rows", "gallery_labels", *map(_r, MEASURES))


@query(f"{_MEASURED} SELECT space, metric, round(value, 6) AS value FROM ({_LONG})")
def ablation_matrix(spark, sf):
    """space, metric, value: the long form that reports and charts read."""
    return space_measures(spark, sf).unpivot("space", list(MEASURES), "metric", "value").select("space", "metric", _r("value"))


@query(f"{_MEASURED} SELECT space, round(r1 + proto + auroc, 6) AS total FROM ms ORDER BY round(r1 + proto + auroc, 9) DESC, space LIMIT 1")
def select_best_space(spark, sf):
    both = space_measures(spark, sf).withColumn("t", F.col("r1") + F.col("proto") + F.col("auroc"))
    return both.orderBy(F.desc(F.round("t", 9)), "space").limit(1).select("space", _r("t", "total"))


@query(f"""{_MEASURED}, rk AS (SELECT space, metric, value, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'fpr' THEN 1 ELSE -1 END * round(value, 9), space) AS place FROM ({_LONG}))
SELECT metric, round(max(value) FILTER (space = 'Full'), 6) AS value, max(space) FILTER (place = 1) AS best_space, round(max(value) FILTER (place = 1), 6) AS best FROM rk GROUP BY metric""")
def run_report(spark, sf):
    """Every measure of a run, a row each: the whole space's, and which space has the best, from one table of measures."""
    long = space_measures(spark, sf).unpivot("space", list(MEASURES), "metric", "value")
    first = Window.partitionBy("metric").orderBy(F.when(F.col("metric") == "fpr", 1).otherwise(-1) * F.round("value", 9), "space")  # a row a space
    long = long.withColumn("best", F.row_number().over(first) == 1)
    at = lambda c, x, name: F.max(F.when(c, F.col(x))).alias(name)
    found = long.groupBy("metric").agg(at(F.col("space") == "Full", "value", "value"), at(F.col("best"), "space", "best_space"), at(F.col("best"), "value", "best"))
    return found.select("metric", _r("value"), "best_space", _r("best"))


# ---- heads

SEEDS = (42, 43, 44)
_HEADS = f"""hk AS (SELECT seed, item_id, label, v, l, row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || ':' || label || ':' || item_id)) AS place, count(*) OVER (PARTITION BY seed, label) AS c FROM g, (SELECT unnest({list(SEEDS)}) AS seed)),
ht AS (SELECT seed, label, list_transform(v, lambda x: x / l) AS v FROM hk WHERE place <= greatest(1, floor(0.65::DOUBLE * c))), hm AS (SELECT seed, label, list(m ORDER BY i) AS b FROM (SELECT seed, label, i, avg(x) AS m FROM (SELECT seed, label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM ht) GROUP BY ALL) GROUP BY ALL),
hc AS (SELECT seed, list(m ORDER BY i) AS c FROM (SELECT seed, i, avg(x) AS m FROM (SELECT seed, unnest(b) AS x, unnest(range(1, 65)) AS i FROM hm) GROUP BY ALL) GROUP BY seed), hl AS (SELECT seed, label, b, list_transform(list_zip(b, c), lambda z: z[1] - z[2]) AS h FROM hm JOIN hc USING (seed)),
ho AS (SELECT a.seed, a.label, list(list_dot_product(a.h, b.h) ORDER BY b.label) AS o FROM hl a JOIN hl b USING (seed) GROUP BY ALL), h1 AS (SELECT seed, e.item_id, e.label, list(list_dot_product(e.v, b) ORDER BY hl.label) AS b, list(greatest(list_dot_product(e.v, h), 0) ORDER BY hl.label) AS h FROM e, hl GROUP BY ALL),
h2 AS (SELECT h1.seed, h1.item_id, list(list_dot_product(h, o) ORDER BY ho.label) AS d FROM h1 JOIN ho USING (seed) GROUP BY ALL), h3 AS (SELECT seed, item_id, label, list_transform(list_zip(b, d), lambda z: z[1] / greatest(sqrt(list_dot_product(b, b)), 1e-12) + 0.1::DOUBLE * z[2] / greatest(sqrt(list_dot_product(d, d)), 1e-12)) AS v FROM h1 JOIN h2 USING (seed, item_id)),
hy AS (SELECT seed::VARCHAR AS head, item_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM h3)"""


def headed(spark, sf) -> DataFrame:
    """item_id, label, head, vec: all items through the stored heads, one for each of SEEDS."""
    items, g, _, _ = _roles(spark, sf)
    return heads.projected(items, heads.fitted(g, SEEDS))


@query(f"""WITH {E}, {_HEADS}, n2 AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM hy), b AS (SELECT a.head, a.item_id, a.label AS q_label, g2.label AS g_label, list_dot_product(a.v, g2.v) / (a.l * g2.l) AS sim FROM n2 a JOIN n2 g2 USING (head) WHERE (a.label > 7 OR a.item_id % 2 = 1) AND g2.label <= 7 AND g2.item_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY a.head, a.item_id ORDER BY round(sim, 9) DESC, g2.item_id) = 1),
pu AS (SELECT head, label, i, avg(x) AS m FROM (SELECT head, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM n2 WHERE label <= 7 AND item_id % 2 = 0) GROUP BY ALL), pc AS (SELECT head, label, list(m ORDER BY i) AS v FROM pu GROUP BY ALL), pb AS (SELECT a.head, a.label AS q_label, pc.label AS g_label FROM n2 a JOIN pc USING (head) WHERE a.label <= 7 AND a.item_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY a.head, a.item_id ORDER BY round(list_dot_product(a.v, pc.v) / (a.l * sqrt(list_dot_product(pc.v, pc.v))), 9) DESC, pc.label) = 1),
ac AS (SELECT 'r1' AS metric, head, q_label, avg((q_label = g_label)::INT) AS x FROM b WHERE q_label <= 7 GROUP BY ALL UNION ALL SELECT 'proto', head, q_label, avg((q_label = g_label)::INT) FROM pb GROUP BY ALL), z AS (SELECT head, (q_label > 7)::INT AS pos, round(1 - sim, 9) AS score, 1 AS w FROM b), {_CURVES.format(c="cv", by="head", rows="z")},
me AS (SELECT metric, head, avg(x) AS value FROM ac GROUP BY ALL UNION ALL SELECT 'auroc', head, auroc FROM cvr UNION ALL SELECT 'fpr', head, fpr FROM cvr)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) AS n FROM me GROUP BY metric""")
def seed_sensitivity(spark, sf):
    """Mean and spread of each measure over heads that were fitted with different seeds."""
    x = headed(spark, sf)
    g, q, o = tables.gallery(x), tables.id_queries(x), tables.ood_queries(x)
    best = lambda df: df.withColumn("at", F.row_number().over(Window.partitionBy("head", "q_id").orderBy(F.desc(F.round("sim", 9)), "g_id"))).where("at = 1")  # noqa: E731  equal to nine places
    near = best(similarity.matches(q.unionByName(o), g, 5, within="head"))
    means = vectors.mean_vector(vectors.scaled(g), ["head", "label"]).select(F.col("label").cast("long").alias("item_id"), "label", "vec", "head")
    proto = best(similarity.matches(q, means, 5, within="head"))
    acc = lambda df, name: metrics.macro(df.withColumn("pred", F.col("g_label")), ["head"]).select(F.lit(name).alias("metric"), "head", F.col("macro").alias("value"))
    curve = metrics.roc(near.select("head", _novel().alias("positive"), F.round(1 - F.col("sim"), 9).alias("score")), ["head"]).unpivot("head", ["auroc", "fpr"], "metric", "value")
    rows = acc(near.where(~_novel()), "r1").unionByName(acc(proto, "proto")).unionByName(curve)
    return rows.groupBy("metric").agg(_r(F.avg("value"), "mean"), _r(F.stddev_samp("value"), "std"), _r(F.min("value"), "least"), _r(F.max("value"), "most"), F.count("*").alias("n"))


# ---- settings

SETTING = ["head", "mode", "m", "tau"]
_GRID = f"""WITH {E}, {_HEADS}, hx AS (SELECT 'none' AS head, item_id, label, v FROM e UNION ALL SELECT head, item_id, label, v FROM hy), mu AS (SELECT head, list(m ORDER BY i) AS c FROM (SELECT head, i, avg(x) AS m FROM (SELECT head, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM hx WHERE item_id % 2 = 0 AND label <= 7) GROUP BY ALL) GROUP BY head),
ha AS (SELECT head, 'raw' AS centre, item_id, label, v FROM hx UNION ALL SELECT head, 'centered', item_id, label, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) FROM hx JOIN mu USING (head)), hb AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM ha),
nb AS (SELECT a.head, a.centre, a.item_id AS q_id, a.label AS q_label, b.label AS g_label, round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) AS sim, row_number() OVER (PARTITION BY a.head, a.centre, a.item_id ORDER BY round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) DESC, b.item_id) AS rank FROM hb a JOIN hb b USING (head, centre) WHERE a.item_id % 2 = 1 AND a.label <= 7 AND b.item_id % 2 = 0 AND b.label <= 7 QUALIFY rank <= 50), gc AS (SELECT label, count(*) AS n FROM g GROUP BY label),
vs AS (SELECT item_id AS q_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || label || ':' || item_id)) <= count(*) OVER (PARTITION BY label) // 2 AS val FROM q),
t AS (SELECT head, centre, m, tau, q_id, q_label, g_label, sim, max(sim) OVER (PARTITION BY head, centre, m, tau, q_id, g_label) AS best FROM nb, (SELECT unnest([5, 20, 50]) AS m), (SELECT unnest([0.03, 0.07, 0.2]::DOUBLE[]) AS tau) WHERE rank <= m),
c0 AS (SELECT head, centre, m, tau, q_id, q_label, g_label AS label, max(best) / tau + ln(sum(exp((sim - best) / tau))) AS score FROM t GROUP BY head, centre, m, tau, q_id, q_label, g_label),
c AS (SELECT head, centre AS mode, m, tau, q_id, q_label, label, score FROM c0 UNION ALL SELECT head, CASE centre WHEN 'raw' THEN 'logmeanexp' ELSE 'centered_logmeanexp' END, m, tau, q_id, q_label, label, score - ln(n) FROM c0 JOIN gc USING (label)),
b AS (SELECT *, row_number() OVER (PARTITION BY head, mode, m, tau, q_id ORDER BY round(score, 7) DESC, label) AS k FROM c),
a AS (SELECT head, mode, m, tau, avg(x) AS macro FROM (SELECT head, mode, m, tau, q_label, avg((label = q_label)::INT) AS x FROM b JOIN vs USING (q_id) WHERE k = 1 AND val GROUP BY ALL) GROUP BY ALL)"""
_BEST = "round(macro, 9) DESC, (head = 'none')::INT + (m = 50)::INT + (tau = 0.07::DOUBLE)::INT DESC, head, mode, m, tau"


def _near(q: DataFrame, g: DataFrame, m: int) -> DataFrame:
    """The m nearest of each query of a head, similarities to nine places, so that what is equal to these is equal in every engine."""
    found = similarity.matches(q, g, m + 10, within="head").withColumn("sim", F.round("sim", 9))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("head", "q_id").orderBy(F.desc("sim"), "g_id"))).where(F.col("rank") <= m)


def grid_predictions(spark, sf) -> DataFrame:
    """head, mode, m, tau, q_id, q_label, pred of the queries that choose a setting, half of each label's, in every setting: one search of each
    head and space serves them all, and scores them where it finds them. The head `none` has the vectors as they are."""
    _, g, q, _ = _roles(spark, sf)
    half = splits.placed(q, ["label"]).where(F.col("place") <= F.floor(F.col("n") / 2)).select(*q.columns)
    kept = tables.staged(g.unionByName(half), "choosing")
    x = kept.withColumn("head", F.lit("none")).unionByName(heads.projected(kept, heads.fitted(tables.gallery(kept), SEEDS)))
    counts, out = g.groupBy("label").agg(F.count("*").alias("n")), []
    for df, raw in ((x, True), (centred(x, tables.gallery(x), "head"), False)):
        top = similarity.matches(tables.id_queries(df), tables.gallery(df), 60, within="head").withColumn("sim", F.round("sim", 9))
        mean, one = ("logmeanexp", "raw") if raw else ("centered_logmeanexp", "centered")
        out.append(similarity.settled(top, counts, "head", (5, 20, 50), (0.03, 0.07, 0.2)).withColumn("mode", F.when(F.col("mean"), mean).otherwise(one)))
    return _union(out).select(*SETTING, "q_id", "q_label", "pred")


def grid(spark, sf) -> DataFrame:
    """head, mode, m, tau, macro on the validation half."""
    return metrics.macro(grid_predictions(spark, sf), SETTING).select(*SETTING, "macro")


def best_first() -> list[Column]:
    """The order of settings: by accuracy, then the usual ones. A setting without a figure comes last."""
    usual = (F.col("head") == "none").cast("int") + (F.col("m") == 50).cast("int") + (F.col("tau") == TAU).cast("int")
    return [F.desc_nulls_last(F.round("macro", 9)), F.desc(usual), *map(F.col, SETTING)]


@query(f"{_GRID} SELECT head, mode, m, tau, round(macro, 6) AS macro FROM a")
def hyperparam_grid(spark, sf):
    return grid(spark, sf).select(*SETTING, _r("macro"))


@query(f"{_GRID} SELECT head, mode, m, tau, round(macro, 6) AS macro, row_number() OVER (ORDER BY {_BEST}) = 1 AS selected FROM a")
def select_best_config(spark, sf):
    first = F.row_number().over(Window.orderBy(*best_first()))  # a row a setting
    return grid(spark, sf).select(*SETTING, _r("macro"), ((first == 1) & F.col("macro").isNotNull()).alias("selected"))


@query(f"""{_GRID}, s AS (SELECT head, mode, m, tau FROM a ORDER BY {_BEST} LIMIT 1), sx AS (SELECT hx.item_id, hx.label, hx.v, s.* FROM hx JOIN s USING (head)), sp AS (SELECT * FROM sx WHERE label > 7 AND item_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY item_id) <= 10),
gv AS (SELECT 'base' AS size, * FROM sx WHERE label <= 7 AND item_id % 2 = 0 UNION ALL SELECT 'big', * FROM sx WHERE label <= 7 AND item_id % 2 = 0 UNION ALL SELECT 'big', * FROM sp), qv AS (SELECT 'base' AS size, * FROM sx WHERE label > 7 OR item_id % 2 = 1 UNION ALL SELECT 'big', * FROM sx WHERE item_id % 2 = 1),
gm AS (SELECT size, list(m ORDER BY i) AS c FROM (SELECT size, i, avg(x) AS m FROM (SELECT size, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM gv) GROUP BY ALL) GROUP BY size), tw AS (SELECT 'g' AS side, * FROM gv UNION ALL SELECT 'q', * FROM qv),
va AS (SELECT side, size, item_id, label, mode, m, tau, CASE WHEN starts_with(mode, 'centered') THEN list_transform(list_zip(v, c), lambda z: z[1] - z[2]) ELSE v END AS v FROM tw JOIN gm USING (size)), vl AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM va),
sm AS (SELECT x.size, x.item_id AS q_id, x.label AS q_label, y.label AS g_label, x.mode, x.m, x.tau, round(list_dot_product(x.v, y.v) / (x.l * y.l), 9) AS sim, row_number() OVER (PARTITION BY x.size, x.item_id ORDER BY round(list_dot_product(x.v, y.v) / (x.l * y.l), 9) DESC, y.item_id) AS rank FROM vl x JOIN vl y ON x.side = 'q' AND y.side = 'g' AND x.size = y.size QUALIFY rank <= x.m),
gn AS (SELECT size, label, count(*) AS n FROM gv GROUP BY ALL), sb AS (SELECT *, max(sim) OVER (PARTITION BY size, q_id, g_label) AS best FROM sm), sc AS (SELECT size, q_id, q_label, g_label AS label, mode, max(best) / tau + ln(sum(exp((sim - best) / tau))) AS score FROM sb GROUP BY size, q_id, q_label, g_label, mode, tau),
sd AS (SELECT sc.size, q_id, q_label, sc.label, CASE WHEN contains(mode, 'logmeanexp') THEN score - ln(n) ELSE score END AS score FROM sc JOIN gn USING (size, label)), sf AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY size, q_id ORDER BY round(score, 7) DESC, label) = 1),
ac AS (SELECT CASE WHEN size = 'base' THEN 'r1' WHEN q_label <= 7 THEN 'old' ELSE 'new' END AS metric, q_label, avg((label = q_label)::INT) AS x FROM sf LEFT JOIN vs USING (q_id) WHERE (size = 'base' AND NOT val) OR size = 'big' GROUP BY ALL),
z AS (SELECT 0 AS one, (q_label > 7)::INT AS pos, 1 - sim AS score, 1 AS w FROM sm WHERE size = 'base' AND rank = 1), {_CURVES.format(c="cv", by="one", rows="z").replace("score, sum(w", "round(score, 9) AS score, sum(w")}
SELECT metric, round(avg(x), 6) AS value FROM ac GROUP BY metric UNION ALL SELECT 'auroc', round(auroc, 6) FROM cvr UNION ALL SELECT 'fpr', round(fpr, 6) FROM cvr""")
def selected_config_eval(spark, sf):
    """The selected setting on all measures: accuracy of the queries that didn't select it (r1), novelty, and old and new labels once ten rows
    of each novel label have joined the gallery. The setting, one row, comes to the driver."""
    s = grid(spark, sf).orderBy(*best_first()).first()
    items, _, q, _ = _roles(spark, sf)
    x = items.withColumn("head", F.lit("none")) if s["head"] == "none" else headed(spark, sf).where(F.col("head") == s["head"])
    half = splits.placed(q, ["label"]).where(F.col("place") > F.floor(F.col("n") / 2)).select(F.col("item_id").alias("q_id"))
    preds, curve = [], None
    for size in ("base", "big"):
        g, o = tables.gallery(x), tables.ood_queries(x)
        g = with_novel(g, o) if size == "big" else g
        ask = tables.id_queries(x).unionByName(o if size == "base" else o.where("item_id % 2 = 1"))
        if s["mode"].startswith("centered"):
            g, ask = centred(g, g), centred(ask, g)
        counts = g.groupBy("label").agg(F.count("*").alias("n")) if "logmeanexp" in s["mode"] else None
        top = tables.staged(_near(ask, g, s["m"]), "near") if size == "base" else _near(ask, g, s["m"])
        best = similarity.best_class(similarity.class_scores(top, s["tau"], counts).withColumn("score", F.round("score", 7)))
        if size == "base":
            curve = metrics.roc(top.where("rank = 1").select(_novel().alias("positive"), F.round(1 - F.col("sim"), 9).alias("score")))
            best = best.join(half, "q_id", "left_semi")
        preds.append(best.select(F.when(F.lit(size == "base"), "r1").when(_novel(), "new").otherwise("old").alias("metric"), "q_label", "pred"))
    rows = metrics.macro(_union(preds), ["metric"]).select("metric", F.col("macro").alias("value"))
    return rows.unionByName(curve.select(F.lit(1).alias("one"), "auroc", "fpr").unpivot("one", ["auroc", "fpr"], "metric", "value").drop("one")).select("metric", _r("value"))


@query(f"""WITH {E}, p AS (SELECT * FROM q UNION ALL SELECT * FROM o), {_sims('p')}, nl AS (SELECT label, row_number() OVER (ORDER BY md5('42:' || label)) <= greatest(1, floor(0.2::DOUBLE * count(*) OVER ())) AS val FROM (SELECT DISTINCT label FROM o)),
z AS (SELECT rank AS k, (q_label > 7)::INT AS pos, round(1 - sim, 9) AS score, 1 AS w FROM r LEFT JOIN nl ON label = q_label WHERE rank IN {_NEIGHBOURS} AND coalesce(val, true)), {_CURVES.format(c="cv", by="k", rows="z")}
SELECT k::BIGINT AS k, round(auroc, 6) AS auroc, round(fpr, 6) AS fpr, row_number() OVER (ORDER BY round(auroc, 9) DESC, k) = 1 AS selected FROM cvr""")
def select_best_k(spark, sf):
    """Which neighbour's distance tells novel queries best, by the validation labels' curve; of equal ones the nearest."""
    _, g, q, o = _roles(spark, sf)
    top = similarity.matches(q.unionByName(o), g, max(_NEIGHBOURS)).where(F.col("rank").isin(*_NEIGHBOURS))
    rows = top.join(novel_validation(o).withColumnRenamed("label", "q_label"), "q_label", "left").where("coalesce(val, true)")
    m = metrics.roc(rows.select(F.col("rank").cast("long").alias("k"), _novel().alias("positive"), F.round(1 - F.col("sim"), 9).alias("score")), ["k"])
    first = F.row_number().over(Window.orderBy(F.desc(F.round("auroc", 9)), "k"))  # a row a neighbour
    return m.select("k", _r("auroc"), _r("fpr"), (first == 1).alias("selected"))
