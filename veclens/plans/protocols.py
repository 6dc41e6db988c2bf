"""Evaluation protocols, samplers and resampling as registered queries. Repeats, grids and draws are rows, not loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import registry
from ..functions import vectors
from ..operators import metrics, similarity, splits, statistics
from ..sources import tables
from .queries import _CENTROIDS, _SCORES, QUERIES, WITH, E, _placed, _r, _roles, _sims, centroids, query

TAU = 0.07


def unchecked(f):
    """Registers a query that SQL can't say."""
    QUERIES[f.__name__] = f
    return f


# ---- logits: similarities to the known labels' centroids, over a temperature

_LOGITS = f"{_CENTROIDS}, y AS (SELECT q_id, list(sim / 0.07::DOUBLE ORDER BY g_id) AS x FROM r GROUP BY q_id), t AS (SELECT q_id, x, list_max(x) AS top, list_sum(list_transform(x, lambda z: exp(z - list_max(x)))) AS s FROM y)"


def logits(spark, sf) -> DataFrame:
    """q_id, x: a logit for each known label."""
    _, g, q, _ = _roles(spark, sf)
    sims = similarity.matches(q, centroids(g), None)
    return sims.groupBy("q_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("g_id", "sim"))), lambda s: s["sim"] / TAU).alias("x"))


@query(f"{_LOGITS} SELECT q_id, round(1 - 1 / s, 6) AS msp, round(-(top + ln(s)), 6) AS energy FROM t")
def energy_score(spark, sf):
    return logits(spark, sf).select("q_id", _r(vectors.one_minus_top_softmax("x"), "msp"), _r(vectors.energy("x"), "energy"))


@query(f"{_LOGITS}, pr AS (SELECT q_id, g_id AS label, exp(sim / 0.07::DOUBLE - top) / s AS p FROM r JOIN t USING (q_id)) SELECT q_id, label::BIGINT AS label, round(p, 6) AS p FROM pr")
def softmax_scores(spark, sf):
    at = logits(spark, sf).select("q_id", "x", vectors.log_sum_exp("x").alias("all"))
    return at.select("q_id", "all", F.posexplode("x").alias("label", "z")).select("q_id", F.col("label").cast("long").alias("label"), _r(F.exp(F.col("z") - F.col("all")), "p"))


@query(f"""{_LOGITS}, mk AS (SELECT k, q_id, 1 - 1 / list_sum(list_transform(x, lambda z: exp((z - top) / k))) AS score FROM t, (SELECT unnest([1, 10, 100, 1000]) AS k)) SELECT k, round(avg(score), 6) AS mean FROM mk GROUP BY k""")
def msp_temperature_grid(spark, sf):
    grid = logits(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, (1, 10, 100, 1000)))))
    at = grid.withColumn("x", F.transform("x", lambda z: z / F.col("k")))
    return at.groupBy("k").agg(_r(F.avg(vectors.one_minus_top_softmax("x")), "mean"))


@query(f"{WITH} SELECT q_id, round(-(max(sim) + 0.07::DOUBLE * ln(sum(exp((sim - top) / 0.07::DOUBLE)))), 6) AS energy FROM (SELECT *, max(sim) OVER (PARTITION BY q_id) AS top FROM r WHERE rank <= 50) GROUP BY q_id")
def retrieval_energy(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    return similarity.matches(q, g, 50).groupBy("q_id").agg(F.collect_list("sim").alias("x")).select("q_id", _r(vectors.retrieval_energy("x"), "energy"))


# ---- scorers

_MIX = f"""{_CENTROIDS.replace("c AS (SELECT label AS", "ce AS (SELECT label AS").replace("FROM c)", "FROM ce)")}, {_sims('q', 'g', 'rg')}{_SCORES.replace("FROM r", "FROM rg")},
mixed AS (SELECT r.q_id, r.q_label, r.g_label AS label, a, a * coalesce(c.score, r.sim / 0.07::DOUBLE) + (1 - a) * r.sim / 0.07::DOUBLE AS score FROM r LEFT JOIN c ON c.q_id = r.q_id AND c.label = r.g_label, (SELECT unnest([0, 0.25, 0.5, 0.75, 1]::DOUBLE[]) AS a))"""


def mixed_scores(spark, sf, alphas=(0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """a, q_id, q_label, label, score: nearest rows' scores and centroids' similarities mixed; a class with no near row has its centroid's."""
    _, g, q, _ = _roles(spark, sf)
    own = similarity.class_scores(similarity.matches(q, g, 50)).select("q_id", "label", F.col("score").alias("near"))
    grid = similarity.matches(q, centroids(g), None).select("q_id", "q_label", F.col("g_label").alias("label"), (F.col("sim") / TAU).alias("proto"))
    both = grid.join(own, ["q_id", "label"], "left").withColumn("a", F.explode(F.array(*map(F.lit, alphas))))
    return both.select("a", "q_id", "q_label", "label", (F.col("a") * F.coalesce("near", "proto") + (1 - F.col("a")) * F.col("proto")).alias("score"))


@query(f"{_MIX} SELECT q_id, label, round(score, 6) AS score FROM mixed WHERE a = 0.5")
def score_proto_mix(spark, sf):
    return mixed_scores(spark, sf, (0.5,)).select("q_id", "label", _r("score"))


@query(f"""{_MIX}, b AS (SELECT *, row_number() OVER (PARTITION BY a, q_id ORDER BY round(score, 9) DESC, label) AS k FROM mixed), l AS (SELECT a, q_label, avg((label = q_label)::INT) AS x FROM b WHERE k = 1 GROUP BY ALL) SELECT a, round(avg(x), 6) AS macro FROM l GROUP BY a""")
def proto_alpha_sweep(spark, sf):
    place = F.row_number().over(Window.partitionBy("a", "q_id").orderBy(F.desc(F.round("score", 9)), "label"))
    best = mixed_scores(spark, sf).withColumn("k", place).where("k = 1").withColumnRenamed("label", "pred")
    return metrics.macro(best, ["a"]).select("a", _r("macro"))


@query(f"""{WITH}, t AS (SELECT q_id, g_label AS label, exp((sim - max(sim) OVER (PARTITION BY q_id)) / 0.07::DOUBLE) AS w FROM r WHERE rank <= 50), c AS (SELECT q_id, label, sum(w) AS w FROM t GROUP BY ALL),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY q_id) AS p FROM c) SELECT q_id, round(max(p), 6) AS confidence, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY q_id""")
def soft_retrieval_eval(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    top = similarity.matches(q, g, 50)
    w = F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy("q_id"))) / TAU)
    c = top.withColumn("w", w).groupBy("q_id", F.col("g_label").alias("label")).agg(F.sum("w").alias("w"))
    p = c.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("q_id")))
    return p.groupBy("q_id").agg(_r(F.max("p"), "confidence"), _r(-F.sum(F.col("p") * F.log("p")), "entropy"))


# ---- spaces, scopes and facets


def spaces(items: DataFrame) -> dict[str, DataFrame]:
    """Every registered space's items; the vectors' halves and the whole are."""
    return {name: space.build(items) for name, space in registry.SPACES.items()}


_SPACES = "WITH e AS (SELECT s AS space, vec_id AS item_id, label, (CASE s WHEN 'A' THEN embedding[1:32] WHEN 'B' THEN embedding[33:64] ELSE embedding END)::DOUBLE[] AS v FROM embeddings, (SELECT unnest(['A', 'B', 'Full']) AS s)), n AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM e)"


_BYSOURCE = f"WITH {E}, p AS (SELECT * FROM q UNION ALL SELECT * FROM o), {_sims('p')}, s0 AS (SELECT q_id, (q_label > 7)::INT AS pos, 'src' || q_id % 3 AS source, round(1 - sim, 9) AS score FROM r WHERE rank = 1)"


@query(f"""{_BYSOURCE}, z AS (SELECT source, pos, score FROM s0 UNION ALL SELECT 'POOLED', pos, score FROM s0), c AS (SELECT source, score, sum(pos)::BIGINT AS pos, sum(1 - pos)::BIGINT AS neg FROM z GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER (PARTITION BY source ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY source ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY source) AS p, sum(neg) OVER (PARTITION BY source) AS n FROM c)
SELECT source, round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / max(p) / max(n), 6) AS auroc, round(min(fp) FILTER (tp >= 0.95::DOUBLE * p) / max(n)::DOUBLE, 6) AS fpr FROM k GROUP BY source""")
def rollup_pooled(spark, sf):
    _, g, q, o = _roles(spark, sf)
    near = similarity.nearest(q.unionByName(o), g).select((F.col("q_label") > 7).alias("positive"), F.concat(F.lit("src"), (F.col("q_id") % 3).cast("string")).alias("source"), F.round(1 - F.col("sim"), 9).alias("score"))
    both = near.withColumn("source", F.explode(F.array("source", F.lit("POOLED"))))
    return metrics.roc(both, ["source"]).select("source", _r("auroc"), _r("fpr"))


@query(f"""WITH {E}, pool AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY label ORDER BY item_id) AS k FROM o WHERE item_id % 2 = 0) WHERE k <= 10), big AS (SELECT item_id, label, v, l FROM g UNION ALL SELECT item_id, label, v, l FROM pool),
asked AS (SELECT * FROM q UNION ALL SELECT * FROM o WHERE item_id % 2 = 1), {_sims('asked', 'big')}, a AS (SELECT q_label, avg((q_label = g_label)::INT) AS x FROM r WHERE rank = 1 GROUP BY q_label)
SELECT q_label > 7 AS novel, round(avg(x), 6) AS macro, count(*) AS labels FROM a GROUP BY 1""")
def gallery_expansion(spark, sf):
    _, g, q, o = _roles(spark, sf)
    place = F.row_number().over(Window.partitionBy("label").orderBy("item_id"))
    pool = o.where("item_id % 2 = 0").withColumn("k", place).where("k <= 10").drop("k")
    found = similarity.nearest(q.unionByName(o.where("item_id % 2 = 1")), g.unionByName(pool)).withColumn("novel", F.col("q_label") > 7)
    return metrics.macro(found, ["novel"]).select("novel", _r("macro"), "labels")


# ---- pivots, selection and audits

_TWO = f"""{_SPACES}, r AS (SELECT q.space, q.label AS q_label, g.label AS g_label, row_number() OVER (PARTITION BY q.space, q.item_id ORDER BY list_dot_product(q.v, g.v) / (q.l * g.l) DESC, g.item_id) AS rank
FROM n q JOIN n g ON q.space = g.space AND q.item_id % 2 = 1 AND g.item_id % 2 = 0 AND q.label <= 7 AND g.label <= 7), a AS (SELECT space, q_label, avg((q_label = g_label)::INT) AS x FROM r WHERE rank = 1 GROUP BY ALL),
w AS (SELECT q_label, max(x) FILTER (space = 'A') AS a, max(x) FILTER (space = 'B') AS b, max(x) FILTER (space = 'Full') AS whole FROM a GROUP BY q_label)"""


def label_table(spark, sf) -> DataFrame:
    """q_label, a, b, whole: accuracy of each label in each space."""
    rows = [metrics.per_label(similarity.nearest(tables.id_queries(s), tables.gallery(s))).withColumn("space", F.lit(n)) for n, s in spaces(tables.read_embeddings(spark, sf)).items()]
    wide = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("q_label").pivot("space", ["A", "B", "Full"]).agg(F.max("accuracy"))
    return wide.select("q_label", F.col("A").alias("a"), F.col("B").alias("b"), F.col("Full").alias("whole"))


@query(f"{_TWO} SELECT q_label, round(a, 6) AS a, round(b, 6) AS b, round(whole, 6) AS whole, round(whole - a, 6) AS gain FROM w")
def per_label_pivot(spark, sf):
    return label_table(spark, sf).select("q_label", _r("a"), _r("b"), _r("whole"), _r(F.col("whole") - F.col("a"), "gain"))


@query(f"""{_TWO}, t AS (SELECT *, round(whole - a, 9) AS d FROM w) SELECT * FROM (SELECT 'gain' AS tag, q_label, round(d, 6) AS delta FROM t ORDER BY d DESC, q_label LIMIT 3) UNION ALL SELECT * FROM (SELECT 'loss', q_label, round(d, 6) FROM t ORDER BY d, q_label LIMIT 3)""")
def largest_gains(spark, sf):
    t = label_table(spark, sf).select("q_label", F.round(F.col("whole") - F.col("a"), 9).alias("d"))
    best = lambda tag, order: t.orderBy(order, "q_label").limit(3).select(F.lit(tag).alias("tag"), "q_label", _r("d", "delta"))
    return best("gain", F.desc("d")).unionByName(best("loss", F.asc("d")))


@query("""SELECT s.p_brand, count(*) AS n, count(*) FILTER (k.p_name IS NOT NULL) AS in_train FROM part s LEFT JOIN (SELECT DISTINCT p_name FROM part WHERE p_partkey % 5 = 0) k USING (p_name) GROUP BY 1""")
def train_mask(spark, sf):
    part = tables.read(spark, sf, "part").select("p_name", "p_brand", "p_partkey")
    seen = part.where("p_partkey % 5 = 0").select("p_name").distinct().withColumn("seen", F.lit(True))
    return part.join(seen, "p_name", "left").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("seen").isNotNull()).alias("in_train"))


@query("""WITH m AS (SELECT p_name, min(p_brand) AS split FROM part GROUP BY p_name) SELECT m.split, count(*) AS n FROM part JOIN m USING (p_name) GROUP BY m.split""")
def split_map_join(spark, sf):
    part = tables.read(spark, sf, "part").select("p_name", "p_brand")
    return part.join(part.groupBy("p_name").agg(F.min("p_brand").alias("split")), "p_name").groupBy("split").agg(F.count("*").alias("n"))


# ---- further splits and samplers


@query(f"SELECT item_id, label, CASE WHEN place <= least(5, greatest(1, n // 2)) THEN 'support' WHEN place <= least(5, greatest(1, n // 2)) + least(10, greatest(1, n - least(5, greatest(1, n // 2)))) THEN 'query' ELSE 'left' END AS split FROM ({_placed('label')})")
def split_support_query_capped(spark, sf):
    items = splits.placed(tables.read_embeddings(spark, sf).select("item_id", "label"), ["label"])
    s = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    q = F.least(F.lit(10), F.greatest(F.lit(1), F.col("n") - s))
    return items.select("item_id", "label", F.when(F.col("place") <= s, "support").when(F.col("place") <= s + q, "query").otherwise("left").alias("split"))


@query("""WITH l AS (SELECT label, row_number() OVER (ORDER BY md5('42:' || label)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings))
SELECT vec_id AS item_id, label, CASE WHEN place <= greatest(1, floor(0.2::DOUBLE * n)) THEN 'val' ELSE 'test' END AS split FROM embeddings JOIN l USING (label)""")
def split_novel_val_test(spark, sf):
    items = tables.read_embeddings(spark, sf).select("item_id", "label")
    labels = items.select("label").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(tables.shuffled(42, "label"))  # a row a label
    placed = labels.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return items.join(placed, "label").select("item_id", "label", F.when(F.col("place") <= splits.part(0.2, 1), "val").otherwise("test").alias("split"))


@query(f"""WITH l AS (SELECT source, label, n, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || source || ':' || label)) AS place, count(*) OVER (PARTITION BY source) AS labels FROM (SELECT 'src' || vec_id % 3 AS source, label, count(*) AS n FROM embeddings GROUP BY ALL) WHERE n >= 4),
k AS (SELECT *, least(greatest(2, round_even(0.3::DOUBLE * labels, 0)), labels - 2) AS n_ood FROM l WHERE labels >= 8)
SELECT source, label, n, CASE WHEN place <= n_ood THEN 'OOD' ELSE 'ID' END AS side, least(5, greatest(1, n // 2))::BIGINT AS refs FROM k""")
def split_within_source(spark, sf):
    rows = tables.read_embeddings(spark, sf).select("label", F.concat(F.lit("src"), (F.col("item_id") % 3).cast("string")).alias("source"))
    l = rows.groupBy("source", "label").agg(F.count("*").alias("n")).where("n >= 4")  # noqa: E741
    own = Window.partitionBy("source")
    l = l.withColumn("place", F.row_number().over(own.orderBy(tables.shuffled(42, "source", "label")))).withColumn("labels", F.count("*").over(own)).where("labels >= 8")  # noqa: E741
    n_ood = F.least(F.greatest(F.lit(2), F.bround(F.lit(0.3) * F.col("labels"), 0)), F.col("labels") - 2)
    return l.select("source", "label", "n", F.when(F.col("place") <= n_ood, "OOD").otherwise("ID").alias("side"), F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("n") / 2))).cast("long").alias("refs"))


_EPISODES = 20


@query(f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 6), w AS (SELECT episode, label FROM (SELECT episode, label, row_number() OVER (PARTITION BY episode ORDER BY md5('7:' || episode || ':' || label)) AS k FROM c, (SELECT unnest(range({_EPISODES})) AS episode)) WHERE k <= 5),
p AS (SELECT episode, label, vec_id AS item_id, row_number() OVER (PARTITION BY episode, label ORDER BY md5('7:' || episode || ':' || label || ':' || vec_id)) AS k FROM w JOIN embeddings USING (label))
SELECT episode, label, item_id, CASE WHEN k <= 2 THEN 'support' ELSE 'query' END AS part FROM p WHERE k <= 6""")
def episode_sampler(spark, sf):
    items = tables.read_embeddings(spark, sf).select("item_id", "label")
    labels = items.groupBy("label").agg(F.count("*").alias("n")).where("n >= 6").withColumn("episode", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_EPISODES - 1).cast("long"))))
    ways = labels.withColumn("k", F.row_number().over(Window.partitionBy("episode").orderBy(tables.shuffled(7, "episode", "label")))).where("k <= 5").select("episode", "label")
    rows = ways.join(items, "label").withColumn("k", F.row_number().over(Window.partitionBy("episode", "label").orderBy(tables.shuffled(7, "episode", "label", "item_id")))).where("k <= 6")
    return rows.select("episode", "label", "item_id", F.when(F.col("k") <= 2, "support").otherwise("query").alias("part"))


@query("""WITH n AS (SELECT vec_id AS item_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || label || ':' || vec_id)) AS j, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
l AS (SELECT label, row_number() OVER (ORDER BY md5('5:' || label)) - 1 AS k, count(*) OVER () AS labels FROM (SELECT DISTINCT label FROM embeddings)), b AS (SELECT label, k // 4 AS batch FROM l WHERE k // 4 < labels // 4),
d AS (SELECT label, batch, unnest(range(8)) AS slot FROM b) SELECT batch, label, slot, item_id FROM d JOIN n USING (label) WHERE j = slot % n + 1""")
def pk_sampler(spark, sf):
    items = statistics.numbered(tables.read_embeddings(spark, sf).select("item_id", "label", tables.shuffled(5, "label", "item_id").alias("h")), ["label"], ["h"])
    every = Window.partitionBy(F.lit(0))  # a row a label
    labels = items.select("label").distinct().withColumn("k", F.row_number().over(every.orderBy(tables.shuffled(5, "label"))) - 1).withColumn("labels", F.count("*").over(every))
    full = labels.withColumn("batch", F.floor(F.col("k") / 4)).where(F.col("batch") < F.floor(F.col("labels") / 4))
    slots = full.select("label", "batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("slot"))
    return slots.join(items, "label").where(F.col("j") == F.col("slot") % F.col("n") + 1).select("batch", "label", "slot", "item_id")


# ---- resampling


@query("""WITH r AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY part) AS j, count(*) OVER (PARTITION BY g) AS n FROM (SELECT o_orderpriority AS g, o_custkey % 100 AS part, avg(o_totalprice::DOUBLE) AS x FROM orders GROUP BY ALL)),
d AS (SELECT g, b, ('0x' || substr(md5('42:' || g || ':' || b || ':' || j), 1, 8))::BIGINT % n + 1 AS j FROM r, (SELECT unnest(range(1000)) AS b)), m AS (SELECT d.g, b, avg(x) AS m FROM d JOIN r ON d.g = r.g AND d.j = r.j GROUP BY ALL)
SELECT g, round(avg(m), 3) AS mean, round(quantile_cont(m, 0.025), 3) AS ci_lo, round(quantile_cont(m, 0.975), 3) AS ci_hi FROM m GROUP BY g""")
def bootstrap_mean_ci(spark, sf):
    """An interval of a mean over parts, such as labels or repeats: the parts are drawn anew a thousand times."""
    rows = tables.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 100).alias("part")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("x"))
    return statistics.mean_interval(rows, ["g"], "x", ["part"], 1000).select("g", *(F.round(c, 3).alias(c) for c in ("mean", "ci_lo", "ci_hi")))


@unchecked
def wilcoxon_paired(spark, sf):
    wide = label_table(spark, sf)
    pairs = wide.select(F.lit("whole-a").alias("claim"), "whole", F.col("a").alias("other")).unionByName(wide.select(F.lit("whole-b"), "whole", "b").toDF("claim", "whole", "other"))
    return metrics.holm(statistics.wilcoxon(pairs, ["claim"], "whole", "other").withColumn("family", F.lit("spaces")), ["family"], order="claim").select("claim", "n", _r("statistic"), _r("p_value"), _r("p_holm"))
