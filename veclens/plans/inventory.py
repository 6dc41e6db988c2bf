"""Readers, writers, guards, patches, heads and scorers of the inventory as registered queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import gram, metrics, patches, scorers, similarity
from ..sources import files, tables
from .protocols import _LOGITS, _SPACES, _TWO, TAU, label_table, logits, spaces, unchecked
from .queries import _CENTRED, _SCORES, WITH, E, _r, _roles, _sims, centred, centroids, query

# ---- files


@query("SELECT p_partkey, p_brand FROM part")
def select_by_prefix(spark, sf):
    """Only the columns whose names begin in a stated way."""
    part = tables.read(spark, sf, "part")
    return part.select(files.with_prefixes(part.columns, ("p_part", "p_br")))


@query("SELECT p_name, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY p_name")
def read_csv_tables(spark, sf):
    """A table as CSV with a header, read by its schema."""
    path = files.folder(spark, "csv")
    files.write_results(tables.read(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path, ("csv",))
    return files.read_csv(spark, f"{path}/csv", "p_partkey long, p_name string, p_size int").groupBy("p_name").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("SELECT unnest(['csv', 'json', 'parquet']) AS format, count(*) AS n, sum(n)::BIGINT AS rows FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def write_results(spark, sf):
    """A table of results in every format, and what reads back."""
    results = tables.read_embeddings(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    paths = files.write_results(results, files.folder(spark, "results"))
    back = [(spark.read.schema("label long, n long").options(**({"header": "true"} if f == "csv" else {})).format(f).load(p) if f != "parquet" else spark.read.parquet(p)).select(F.lit(f).alias("format"), F.col("n").cast("long").alias("n")) for f, p in paths.items()]
    return back[0].unionByName(back[1]).unionByName(back[2]).groupBy("format").agg(F.count("*").alias("n"), F.sum("n").alias("rows"))


@query("""SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 GROUP BY p_brand""")
def expand_folders(spark, sf):
    """Paths listed in one text cell, a row for each image file that is there."""
    path = F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".txt").otherwise(".JPG"))
    part = tables.read(spark, sf, "part").select("p_brand", "p_partkey", path.alias("path"))
    lists = part.groupBy("p_brand").agg(F.concat(F.lit("['"), F.array_join(F.sort_array(F.collect_list("path")), "', '"), F.lit("']")).alias("list"))
    there = part.where("p_partkey % 5 <> 0").select("path")
    return lists.select("p_brand", F.explode(files.image_files(F.col("list"))).alias("path")).join(there, "path").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'train' END AS dir, p_name AS label, 'scale_' || (256 * (1 + p_size % 3)) AS scale, CASE length(p_name) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM part WHERE p_partkey % 7 <> 0)
SELECT split, label, scale, count(*) AS n FROM t WHERE (dir = 'train' AND split IN ('train', 'val')) OR (dir = 'test' AND split = 'test') GROUP BY ALL""")
def scan_patch_tree(spark, sf):
    """{train,test}/label/scale_N/file: image files of the folders and splits that go together, split by the label's map."""
    part, key = tables.read(spark, sf, "part"), F.col("p_partkey")
    path = F.concat_ws("/", F.lit("root"), F.when(key % 4 == 0, "test").otherwise("train"), "p_name", F.concat(F.lit("scale_"), (256 * (1 + F.col("p_size") % 3)).cast("string")), F.concat(key.cast("string"), F.when(key % 7 == 0, ".txt").otherwise(".png")))
    n = F.char_length("p_name") % 3
    known = part.select(F.col("p_name").alias("label"), F.when(n == 0, "train").when(n == 1, "val").otherwise("test").alias("split")).distinct()
    listed = part.select(path.alias("path")).where(F.col("path").rlike(r"(?i)/(train|test)/[^/]+/scale_\d+/[^/]+\.(jpg|jpeg|png)$"))
    parts = listed.select(files.path_part("path", -4).alias("dir"), files.path_part("path", -3).alias("label"), files.path_part("path", -2).alias("scale"))
    allowed = ((F.col("dir") == "train") & F.col("split").isin("train", "val")) | ((F.col("dir") == "test") & (F.col("split") == "test"))
    return parts.join(known, "label").where(allowed).groupBy("split", "label", "scale").agg(F.count("*").alias("n"))


@query("SELECT label, 'a' || label AS method, unnest(['auroc', 'r1']) AS metric, unnest([n + 1, n])::DOUBLE AS value FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def read_result_shapes(spark, sf):
    """Results as a list of objects or an object of methods, metrics as numbers or with their mean."""
    n, label = F.col("n").cast("string"), F.col("label").cast("string")
    listed = F.concat(F.lit('[{"method": "a'), label, F.lit('", "r1": '), n, F.lit(', "note": "x", "auroc": {"mean": '), (F.col("n") + 1).cast("string"), F.lit(', "ci_lo": 0}}]'))
    keyed = F.concat(F.lit('{"a'), label, F.lit('": {"r1": {"mean": '), n, F.lit('}, "auroc": '), (F.col("n") + 1).cast("string"), F.lit("}}"))
    texts = tables.read_embeddings(spark, sf).groupBy("label").agg(F.count("*").alias("n")).select("label", F.when(F.col("label") % 2 == 0, listed).otherwise(keyed).alias("text"))
    return files.result_rows(texts, "text")


@query("SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first FROM embeddings GROUP BY label")
def aligned_join(spark, sf):
    """Labels and vectors joined by id; a row without its one partner would fail the query."""
    items = tables.read_embeddings(spark, sf)
    both = files.require_aligned(items.select("item_id", "label"), items.select("item_id", F.col("vec")[0].alias("x")), "item_id")
    return both.groupBy("label").agg(F.count("*").alias("n"), _r(F.avg("x"), "first"))


@query("SELECT CASE WHEN vec_id % 2 = 0 THEN 'gallery' ELSE 'query' END AS split, count(DISTINCT label) AS labels, 0::BIGINT AS shared FROM embeddings WHERE label <= 7 GROUP BY 1")
def ood_disjointness(spark, sf):
    """No novel label is in either split, or the query fails with some of them."""
    items = tables.read_embeddings(spark, sf).select("item_id", "label")
    novel = tables.ood_queries(items)
    known = items.where(F.col("label") <= tables.LAST_KNOWN).withColumn("split", F.when(F.col("item_id") % 2 == 0, "gallery").otherwise("query"))
    for split in ("gallery", "query"):
        files.require_disjoint(known.where(F.col("split") == split), novel, "label", split)
    shared = F.count_distinct(F.when(F.col("novel"), F.col("label")))
    marked = known.join(novel.select("label").distinct().withColumn("novel", F.lit(True)), "label", "left")
    return marked.groupBy("split").agg(F.count_distinct("label").alias("labels"), shared.alias("shared"))


# ---- patches

_SIZES = """s AS (SELECT p_partkey, 200 + p_size * 60 AS w, 180 + p_size * 50 AS h, least(200 + p_size * 60, 180 + p_size * 50) AS side FROM part),
l AS (SELECT *, CASE WHEN side >= 256 THEN range(256, least(side, 1024) + 1, 256) ELSE []::BIGINT[] END AS steps FROM s),
f AS (SELECT *, CASE WHEN side > 1024 THEN list_transform(list_filter(list_transform(range(1, 41), lambda k: steps[-1] * power(1.5::DOUBLE, k)), lambda x: x <= side), lambda x: round_even(x, 0)::BIGINT) ELSE []::BIGINT[] END AS far FROM l),
z AS (SELECT p_partkey, w, h, unnest(CASE WHEN len(list_distinct(list_concat(steps, far))) <= 1 THEN (CASE WHEN side < 256 THEN [side::BIGINT] ELSE list_distinct([256, side::BIGINT]) END) ELSE list_distinct(list_concat(steps, far)) END) AS size FROM f),
n AS (SELECT *, ceil(w / size::DOUBLE)::BIGINT AS nx, ceil(h / size::DOUBLE)::BIGINT AS ny FROM z),
t AS (SELECT p_partkey, size, i, j, CASE WHEN nx > 1 THEN floor(i * ((w - size) / (nx - 1)::DOUBLE))::BIGINT ELSE 0 END AS l, CASE WHEN ny > 1 THEN floor(j * ((h - size) / (ny - 1)::DOUBLE))::BIGINT ELSE 0 END AS tp FROM (SELECT *, unnest(range(nx)) AS i FROM n) a, unnest(range(ny)) AS b(j))"""


@query(f"WITH {_SIZES} SELECT size::BIGINT AS size, count(DISTINCT p_partkey) AS images, count(*) AS tiles, sum(l)::BIGINT AS lefts, sum(tp)::BIGINT AS tops FROM t GROUP BY size")
def tile_grid(spark, sf):
    """Sizes by steps, then by factors, and the places of the overlapping tiles of each."""
    images = tables.read(spark, sf, "part").select("p_partkey", (200 + F.col("p_size") * 60).alias("width"), (180 + F.col("p_size") * 50).alias("height"))
    t = patches.tiles(images)
    return t.groupBy(F.col("size").cast("long").alias("size")).agg(F.count_distinct("p_partkey").alias("images"), F.count("*").alias("tiles"), F.sum("left").alias("lefts"), F.sum("top").alias("tops"))


def _images(spark, sf) -> DataFrame:
    """Vectors as grey images of eight by eight pixels."""
    grey = F.transform("vec", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x * 8 + 1) * 127.5).cast("int"))))
    return tables.read_embeddings(spark, sf).select(F.col("item_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), grey.alias("pixels"))


_PIXELS = """WITH img AS (SELECT vec_id AS image_id, list_transform(embedding::DOUBLE[], lambda x: least(255, greatest(0, floor((x * 8 + 1) * 127.5::DOUBLE)::INT))) AS px FROM embeddings),
pt AS (SELECT * FROM (VALUES {0}) AS t(s, i, j, l, tp)),
pix AS (SELECT image_id, s, i, j, px[(tp + r) * 8 + l + c + 1] AS v, px[(tp + abs(r - 1)) * 8 + l + c + 1] + px[(tp + s - 1 - abs(s - 2 - r)) * 8 + l + c + 1] + px[(tp + r) * 8 + l + abs(c - 1) + 1] + px[(tp + r) * 8 + l + s - 1 - abs(s - 2 - c) + 1] - 4 * px[(tp + r) * 8 + l + c + 1] AS lap
FROM img, pt, (SELECT unnest(range(8))::INT AS r) a, (SELECT unnest(range(8))::INT AS c) b WHERE r < s AND c < s),
bw AS (SELECT image_id, s, i, j, avg((v < 30)::INT) AS black, var_pop(lap) AS sharpness FROM pix GROUP BY ALL),
en AS (SELECT image_id, s, i, j, -sum(p * log2(p)) AS entropy FROM (SELECT image_id, s, i, j, count(*) / (s * s)::DOUBLE AS p FROM pix GROUP BY image_id, s, i, j, v) GROUP BY ALL)"""


@query(_PIXELS.format("(8, 0, 0, 0, 0)") + " SELECT image_id, round(black, 6) AS black, round(sqrt(sharpness), 4) AS sharpness_root, round(entropy, 6) AS entropy FROM bw JOIN en USING (image_id, s, i, j)")
def patch_metrics(spark, sf):
    whole = patches.measured(_images(spark, sf).select("*", F.lit(8).alias("size"), F.lit(0).alias("left"), F.lit(0).alias("top")))
    return whole.select("image_id", _r("black"), F.round(F.sqrt("sharpness"), 4).alias("sharpness_root"), _r("entropy"))


@query(_PIXELS.format("(4, 0, 0, 0, 0), (4, 0, 1, 0, 4), (4, 1, 0, 4, 0), (4, 1, 1, 4, 4), (8, 0, 0, 0, 0)") + """ SELECT image_id, s::BIGINT AS size, i::BIGINT AS i, j::BIGINT AS j, CASE WHEN black > 0.1 THEN 'black_ratio' WHEN sharpness < 60000 THEN 'low_sharpness' WHEN entropy < 3.5 THEN 'low_entropy' ELSE 'good' END AS reason,
CASE WHEN black > 0.1 OR sharpness < 60000 OR entropy < 3.5 THEN 'removed' ELSE 'kept' END AS status FROM bw JOIN en USING (image_id, s, i, j)""")
def image_patch_source(spark, sf):
    """Images cut into patches of every size, each with what the quality rules say."""
    found = patches.judged(patches.measured(patches.tiles(_images(spark, sf), base=4)), black=0.1, sharpness=60000.0)
    return found.select("image_id", F.col("size").cast("long").alias("size"), "i", "j", F.regexp_replace("reason", "_[0-9.]+$", "").alias("reason"), "status")


# ---- vectors and heads


@query(f"""WITH {E}, m AS (SELECT i, avg(x) AS m, count(*) AS n FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM g) GROUP BY i), x AS (SELECT item_id, i, x FROM (SELECT item_id, unnest(v) AS x, unnest(range(1, 65)) AS i FROM g))
SELECT a.i::INT AS i, b.i::INT AS j, round(sum((a.x - ma.m) * (b.x - mb.m)) / max(ma.n) + CASE WHEN a.i = b.i THEN 1e-4 ELSE 0 END, 6) AS value FROM x a JOIN x b USING (item_id) JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i GROUP BY a.i, b.i""")
def covariance(spark, sf):
    """All cells of the gallery's covariance, with its ridge."""
    _, g, _, _ = _roles(spark, sf)
    return gram.covariance(g).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), _r("value"))


@unchecked
def coral_align(spark, sf):
    """Novel queries whitened by their own covariance and coloured by the gallery's, then their nearest rows of it."""
    _, g, _, o = _roles(spark, sf)
    return similarity.nearest(gram.coloured(o, g), g).select("q_id", "g_id", _r("sim"))


@query(f"""WITH {E}, w AS (SELECT row_number() OVER (ORDER BY item_id) AS k, v FROM g), b AS (SELECT e.item_id, list(list_dot_product(e.v, w.v) ORDER BY k) AS b FROM e, w WHERE k <= 8 GROUP BY 1), h AS (SELECT e.item_id, list(greatest(list_dot_product(e.v, w.v), 0) ORDER BY k) AS h FROM e, w WHERE k BETWEEN 9 AND 24 GROUP BY 1),
d AS (SELECT item_id, list(list_dot_product(h, w.v[1:16]) ORDER BY k) AS d FROM h, w WHERE k BETWEEN 25 AND 32 GROUP BY 1),
y AS (SELECT item_id, list_transform(list_zip(b, d), lambda z: z[1] / greatest(sqrt(list_dot_product(b, b)), 1e-12) + 0.1::DOUBLE * z[2] / greatest(sqrt(list_dot_product(d, d)), 1e-12)) AS y FROM b JOIN d USING (item_id))
SELECT item_id, round(y[1] / sqrt(list_dot_product(y, y)), 6) AS first, round(y[8] / sqrt(list_dot_product(y, y)), 6) AS last FROM y""")
def residual_project(spark, sf):
    """Vectors through a stored residual head. Its weights, bounded by its size, are a table; here some gallery rows stand for one."""
    items, g, _, _ = _roles(spark, sf)
    w = np.array([r.vec for r in g.orderBy("item_id").limit(32).select("vec").collect()])
    base, hidden, out = w[:8], w[8:24], w[24:32, :16]
    y = gram.mapped(items.select("item_id", "vec"), lambda x: gram.residual_head(x, base, hidden, out, 0.1))
    return y.select("item_id", _r(F.col("vec")[0], "first"), _r(F.element_at("vec", -1), "last"))


# ---- scorers


@query(f"""{_CENTRED}{_SCORES}, pu AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(list_transform(v, lambda x: x / l)) AS x, unnest(range(1, 65)) AS i FROM cg) GROUP BY ALL), pc AS (SELECT label, list(m ORDER BY i) AS v FROM pu GROUP BY label),
pg AS (SELECT a.item_id AS q_id, pc.label, list_dot_product(a.v, pc.v) / (a.l * greatest(sqrt(list_dot_product(pc.v, pc.v)), 1e-12)) / 0.07::DOUBLE AS p FROM cq a, pc) SELECT pg.q_id, pg.label, round(0.5::DOUBLE * coalesce(c.score, p) + 0.5::DOUBLE * p, 6) AS score FROM pg LEFT JOIN c ON c.q_id = pg.q_id AND c.label = pg.label""")
def score_centered_mix(spark, sf):
    items, g, _, _ = _roles(spark, sf)
    own = centred(items, g)
    return scorers.mixed(tables.id_queries(own), tables.gallery(own)).select("q_id", "label", _r("score"))


@query(f"""{WITH}, t AS (SELECT *, max(sim) OVER (PARTITION BY q_id) AS top FROM r WHERE rank <= 50), w AS (SELECT q_id, g_label, sum(exp((sim - top) / 0.07::DOUBLE)) AS w FROM t GROUP BY ALL), p AS (SELECT q_id, w / sum(w) OVER (PARTITION BY q_id) AS p FROM w),
z AS (SELECT q_id, -sum(p * ln(p)) AS entropy, list_sort(list(p), 'DESC') AS ps FROM p GROUP BY q_id) SELECT q_id, round(1 - max(sim), 6) AS d1, round(1 - avg(sim) FILTER (rank <= 5), 6) AS d5, round(1 - avg(sim) FILTER (rank <= 10), 6) AS d10,
round(-(max(top) + 0.07::DOUBLE * ln(sum(exp((sim - top) / 0.07::DOUBLE)))), 6) AS energy, round(max(entropy), 6) AS entropy, round(max(ps[1] - coalesce(ps[2], 0)), 6) AS gap FROM t JOIN z USING (q_id) GROUP BY q_id""")
def density_features(spark, sf):
    """What a gate sees of a query: distances to the nearest rows, energy, entropy of classes, and the lead of the first class."""
    _, g, q, _ = _roles(spark, sf)
    top = similarity.matches(q, g, 50).withColumn("w", F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy("q_id"))) / TAU))
    mean = lambda k, name: _r(1 - F.avg(F.when(F.col("rank") <= k, F.col("sim"))), name)
    near = top.groupBy("q_id").agg(mean(1, "d1"), mean(5, "d5"), mean(10, "d10"), _r(-(F.max("sim") + TAU * F.log(F.sum("w"))), "energy"))
    share = top.groupBy("q_id", "g_label").agg(F.sum("w").alias("w")).withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("q_id")))
    ps = F.sort_array(F.collect_list("p"), asc=False)
    return near.join(share.groupBy("q_id").agg(_r(-F.sum(F.col("p") * F.log("p")), "entropy"), _r(ps[0] - F.coalesce(F.get(ps, 1), F.lit(0.0)), "gap")), "q_id")


@query(f"""{_LOGITS}, {_sims('q', 'g', 'rg')}, so AS (SELECT q_id, g_label AS label, sum(exp((sim - top) / 0.07::DOUBLE)) AS w FROM (SELECT *, max(sim) OVER (PARTITION BY q_id) AS top FROM rg WHERE rank <= 50) GROUP BY ALL), sp AS (SELECT q_id, label, w / sum(w) OVER (PARTITION BY q_id) AS p FROM so),
w AS (SELECT q_id, 1 / (1 + exp(top - 10)) AS w, top, s FROM t) SELECT r.q_id, r.g_label AS label, round(w * exp(r.sim / 0.07::DOUBLE - top) / s + (1 - w) * coalesce(sp.p, 0), 6) AS score FROM r JOIN w USING (q_id) LEFT JOIN sp ON sp.q_id = r.q_id AND sp.label = r.g_label""")
def gate_mix(spark, sf):
    """Experts' class scores under the weights that each query has in a stored table: centroids and soft retrieval."""
    _, g, q, _ = _roles(spark, sf)
    at = similarity.matches(q, centroids(g), None).select("q_id", F.col("g_label").alias("label"), (F.col("sim") / TAU).alias("z"))
    best = F.max("z").over(Window.partitionBy("q_id"))
    e = at.withColumn("best", best).withColumn("e", F.exp(F.col("z") - F.col("best")))
    proto = e.select("q_id", "label", F.lit("proto").alias("expert"), (F.col("e") / F.sum("e").over(Window.partitionBy("q_id"))).alias("p"))
    w = similarity.matches(q, g, 50).withColumn("w", F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy("q_id"))) / TAU)).groupBy("q_id", F.col("g_label").alias("label")).agg(F.sum("w").alias("w"))
    soft = w.select("q_id", "label", F.lit("soft").alias("expert"), (F.col("w") / F.sum("w").over(Window.partitionBy("q_id"))).alias("p"))
    own = 1 / (1 + F.exp(F.max("z") - 10))
    weights = at.groupBy("q_id").agg(own.alias("proto"), (1 - own).alias("soft")).unpivot("q_id", ["proto", "soft"], "expert", "weight")
    return proto.unionByName(soft).join(weights, ["q_id", "expert"]).groupBy("q_id", "label").agg(_r(F.sum(F.col("p") * F.col("weight")), "score"))


@query(f"""{_LOGITS}, b AS (SELECT q.label AS q_label, q_id % 4 = 1 AS cal, list_max(x[1:6]) AS old, list_max(x[7:8]) AS new FROM t JOIN q ON q.item_id = q_id),
s AS (SELECT gamma, avg((old >= new - gamma)::INT) FILTER (cal AND q_label <= 5) AS a, avg((old < new - gamma)::INT) FILTER (cal AND q_label > 5) AS n, avg((old >= new - gamma)::INT) FILTER (NOT cal AND q_label <= 5) AS ta, avg((old < new - gamma)::INT) FILTER (NOT cal AND q_label > 5) AS tn
FROM b, (SELECT unnest(range(241)) * 0.25::DOUBLE - 30 AS gamma) GROUP BY gamma) SELECT gamma, round(sqrt(a * n), 6) AS balance, round(ta, 6) AS test_old, round(tn, 6) AS test_new, row_number() OVER (ORDER BY round(sqrt(a * n), 9) DESC, gamma) = 1 AS selected FROM s""")
def bias_calibration(spark, sf):
    """The shift of the new labels' logits (6 and 7) that balances old and new accuracy on calibration rows, and what each does to the others."""
    _, _, q, _ = _roles(spark, sf)
    at = logits(spark, sf).select("q_id", F.array_max(F.slice("x", 1, 6)).alias("old"), F.array_max(F.slice("x", 7, 2)).alias("new"))
    rows = at.join(q.select(F.col("item_id").alias("q_id"), F.col("label").alias("q_label")), "q_id").withColumn("gamma", F.explode(F.transform(F.sequence(F.lit(0), F.lit(240)), lambda k: k * 0.25 - 30)))
    stays, cal, is_old = F.col("old") >= F.col("new") - F.col("gamma"), F.col("q_id") % 4 == 1, F.col("q_label") <= 5
    rate = lambda c, ok, name: F.avg(F.when(c, ok.cast("int"))).alias(name)
    s = rows.groupBy("gamma").agg(rate(cal & is_old, stays, "a"), rate(cal & ~is_old, ~stays, "n"), rate(~cal & is_old, stays, "ta"), rate(~cal & ~is_old, ~stays, "tn"))
    first = F.row_number().over(Window.orderBy(F.desc(F.round(F.sqrt(F.col("a") * F.col("n")), 9)), "gamma"))  # a row a shift
    return s.select("gamma", _r(F.sqrt(F.col("a") * F.col("n")), "balance"), _r("ta", "test_old"), _r("tn", "test_new"), (first == 1).alias("selected"))


# ---- reports


@query(f"""{WITH}, s AS (SELECT round(sim, 6) AS e, (q_label = g_label)::INT AS ok FROM r WHERE rank = 1), t AS (SELECT unnest(list_distinct([min(e), quantile_cont(e, 0.25), quantile_cont(e, 0.5), quantile_cont(e, 0.75), quantile_cont(e, 0.9)])) AS threshold FROM s)
SELECT round(threshold, 6) AS threshold, round(100.0::DOUBLE * count(*) FILTER (e >= threshold) / count(*), 6) AS coverage_pct, round(avg(ok) FILTER (e >= threshold), 6) AS accuracy, round(100.0::DOUBLE * count(*) FILTER (e < threshold) / count(*), 6) AS flagged_pct, count(*) FILTER (e >= threshold) AS kept, count(*) AS total FROM s, t GROUP BY t.threshold""")
def operating_points(spark, sf):
    """What each threshold of evidence decides by itself. Evidence is kept to six places, so that its table of values has a bound."""
    _, g, q, _ = _roles(spark, sf)
    s = similarity.nearest(q, g).select(F.round("sim", 6).alias("e"), metrics.hit("correct").alias("ok")).groupBy("e").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    points = s.agg(F.percentile("e", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 0.9))), F.col("n")).alias("t")).select(F.explode(F.array_distinct("t")).alias("threshold"))
    on = lambda c: F.sum(F.when(F.col("e") >= F.col("threshold"), F.col(c)))
    share = 100.0 * on("n") / F.sum("n")
    return s.crossJoin(F.broadcast(points)).groupBy("threshold").agg(_r(share, "coverage_pct"), _r(on("ok") / on("n"), "accuracy"), _r(100.0 - share, "flagged_pct"), on("n").alias("kept"), F.sum("n").alias("total")).withColumn("threshold", F.round("threshold", 6))  # five thresholds


@query(f"""{WITH}, t AS (SELECT q_label, q_label // 2 AS q_group, (q_label = g_label)::INT AS ok, (q_label // 2 = g_label // 2)::INT AS gok FROM r WHERE rank = 1), x AS (SELECT avg(a) AS macro FROM (SELECT avg(ok) AS a FROM t GROUP BY q_label)), y AS (SELECT avg(a) AS macro FROM (SELECT avg(gok) AS a FROM t GROUP BY q_group))
SELECT round(avg(ok), 6) AS micro, round(avg(gok), 6) AS group_micro, round(max(x.macro), 6) AS macro, round(max(y.macro), 6) AS group_macro, round(avg(gok) - avg(ok), 6) AS micro_gain, round(max(y.macro) - max(x.macro), 6) AS macro_gain, count(*) AS n FROM t, x, y""")
def group_level_accuracy(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    t = similarity.nearest(q, g).withColumn("q_group", F.floor(F.col("q_label") / 2)).withColumn("gok", (F.col("q_group") == F.floor(F.col("pred") / 2)).cast("int"))
    per = t.groupBy("q_group", "q_label").agg(F.count("*").alias("n"), F.sum(metrics.hit("correct")).alias("ok"), F.sum("gok").alias("gok"))
    whole = per.agg((F.sum("ok") / F.sum("n")).alias("micro"), (F.sum("gok") / F.sum("n")).alias("group_micro"), F.avg(F.col("ok") / F.col("n")).alias("macro"), F.sum("n").alias("n"))
    groups = per.groupBy("q_group").agg((F.sum("gok") / F.sum("n")).alias("a")).agg(F.avg("a").alias("group_macro"))
    both = whole.crossJoin(groups)  # a row each
    return both.select(_r("micro"), _r("group_micro"), _r("macro"), _r("group_macro"), _r(F.col("group_micro") - F.col("micro"), "micro_gain"), _r(F.col("group_macro") - F.col("macro"), "macro_gain"), "n")


@query(f"""{_SPACES}, r AS (SELECT q.space, q.item_id AS q_id, q.label AS q_label, g.label AS pred, row_number() OVER (PARTITION BY q.space, q.item_id ORDER BY list_dot_product(q.v, g.v) / (q.l * g.l) DESC, g.item_id) AS rank FROM n q JOIN n g ON q.space = g.space AND q.item_id % 2 = 1 AND g.item_id % 2 = 0 AND q.label <= 7 AND g.label <= 7),
w AS (SELECT space, q_label, pred, count(*) AS n, min(q_id) AS example FROM r WHERE rank = 1 AND q_label <> pred GROUP BY ALL), a AS (SELECT space, q_label, count(*) AS total FROM r WHERE rank = 1 GROUP BY ALL)
SELECT space, q_label, pred, n, round(n / total::DOUBLE, 6) AS error_rate, example FROM w JOIN a USING (space, q_label) QUALIFY row_number() OVER (PARTITION BY space, q_label ORDER BY n DESC, pred) <= 5""")
def confusion_pairs(spark, sf):
    """The five labels that each label is most taken for, in each space."""
    out = None
    for name, s in spaces(tables.read_embeddings(spark, sf)).items():
        one = similarity.nearest(tables.id_queries(s), tables.gallery(s)).select(F.lit(name).alias("space"), "q_id", "q_label", "pred", "correct")
        out = one if out is None else out.unionByName(one)
    w = out.groupBy("space", "q_label", "pred", "correct").agg(F.count("*").alias("n"), F.min("q_id").alias("example"))
    w = w.withColumn("total", F.sum("n").over(Window.partitionBy("space", "q_label"))).where("not correct")
    w = w.withColumn("k", F.row_number().over(Window.partitionBy("space", "q_label").orderBy(F.desc("n"), "pred"))).where("k <= 5")
    return w.select("space", "q_label", "pred", "n", _r(F.col("n") / F.col("total"), "error_rate"), "example")


@query(f"""{_TWO} SELECT 'accuracy' AS series, q_label::VARCHAR AS x, s AS part, round(CASE s WHEN 'a' THEN a WHEN 'b' THEN b ELSE whole END, 6) AS y FROM w, (SELECT unnest(['a', 'b', 'whole']) AS s)
UNION ALL SELECT 'macro', space, 'all', round(avg(x), 6) FROM a GROUP BY space UNION ALL SELECT 'rows', label::VARCHAR, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END, count(*) FROM embeddings GROUP BY ALL""")
def figure_series(spark, sf):
    """The long form behind the charts: series, x, part, y."""
    wide = label_table(spark, sf)
    long = wide.unpivot("q_label", ["a", "b", "whole"], "part", "y")
    first = long.select(F.lit("accuracy").alias("series"), F.col("q_label").cast("string").alias("x"), "part", _r("y"))
    names = F.when(F.col("part") == "whole", "Full").otherwise(F.upper("part"))
    second = long.groupBy(names.alias("x")).agg(_r(F.avg("y"), "y")).select(F.lit("macro").alias("series"), "x", F.lit("all").alias("part"), "y")
    third = tables.read_embeddings(spark, sf).groupBy(F.col("label").cast("string").alias("x"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("part")).agg(F.count("*").cast("double").alias("y")).select(F.lit("rows").alias("series"), "x", "part", "y")
    return first.unionByName(second).unionByName(third)
