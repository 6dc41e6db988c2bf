"""Further registered queries: single metrics, preparation of reference tables, selection, ablations and fitted classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, vectors
from ..operators import attributes, metrics, similarity, splits
from ..sources import files, tables
from .protocols import unchecked
from .queries import _CENTRED, _CENTROIDS, _FULL, _SCORES, WITH, E, _r, _roles, _scores, _sims, centroids, query

# ---- preparation


@query("""WITH i AS (SELECT CASE WHEN vec_id % 10 < 7 THEN 'meta-train' WHEN vec_id % 10 = 7 THEN 'meta-val' ELSE 'meta-test' END AS split, 'gallery/' || label || '/' || vec_id // 2 || '.jpg' AS path, 's' || label AS label FROM embeddings) SELECT split, count(*) AS images, count(DISTINCT path) AS paths, count(DISTINCT label) AS labels FROM i GROUP BY split""")
def read_manifest(spark, sf):
    """Images, paths and labels of each split of a manifest of nested lists, written as JSON first: a part of it for each hundred items."""
    at = F.col("vec_id") % 10
    split = F.when(at < 7, "meta-train").when(at == 7, "meta-val").otherwise("meta-test").alias("split")
    path = F.concat(F.lit("gallery/"), "label", F.lit("/"), F.floor(F.col("vec_id") / 2), F.lit(".jpg"))
    rows = tables.read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("part"), split, F.array(path, F.concat(F.lit("s"), "label")).alias("item"))
    lists = rows.groupBy("part", "split").agg(F.collect_list("item").alias("items")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("split", "items"))).alias("m"))
    where = files.folder(spark, "manifest")
    lists.select(F.to_json("m").alias("value")).write.text(where)
    return files.manifest_counts(files.manifest_items(spark.read.text(where)))


@query("SELECT event_type, split_ord, count(*) AS n FROM (SELECT event_type, 0::BIGINT AS split_ord FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_type, 1 FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_type, 2 FROM events WHERE event_id % 3 = 2) GROUP BY ALL")
def manifest_union(spark, sf):
    events = tables.read(spark, sf, "events")
    parts = [events.where(F.col("event_id") % 3 == k).select("event_type", F.lit(k).cast("long").alias("split_ord")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("event_type", "split_ord").agg(F.count("*").alias("n"))


@query("""SELECT split_part(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/', 1) AS folder, count(*) AS files, count(DISTINCT url) AS distinct_files FROM pages GROUP BY 1""")
def scan_folders(spark, sf):
    folder = F.split(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), "/")[0]
    return tables.read(spark, sf, "pages").groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.countDistinct("url").alias("distinct_files"))


@query("""SELECT page_id, string_split(url, '/')[-2] AS scale FROM pages WHERE string_split(url, '/')[-2] IN ('en', 'de')""")
def scale_from_path(spark, sf):
    """The name of the folder above, and the rows of the chosen ones."""
    return tables.read(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "/"), -2).alias("scale")).where(F.col("scale").isin("en", "de"))


@query("""WITH v AS (SELECT p_partkey, p_name, CASE p_name WHEN 'red widget' THEN 'ruber artifex' ELSE p_name END AS known FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN split_part(known, ' ', 1) || ' sp.' ELSE known END AS binomial FROM v""")
def canonical_binomial(spark, sf):
    """Local names replaced, then the binomial of what was accepted; every fourth name is unresolved, every fourth open."""
    local = F.coalesce(F.element_at(F.create_map(F.lit("red widget"), F.lit("ruber artifex")), F.col("p_name")), F.col("p_name"))
    part = tables.read(spark, sf, "part").select("p_partkey", local.alias("known"))
    accepted = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.initcap("known"), F.lit(" L.")))
    asked = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.substring_index("known", " ", 1), F.lit(" sp"))).otherwise(F.col("known"))
    return part.select("p_partkey", names.binomial(accepted, asked).alias("binomial"))


@query("""SELECT l_suppkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'R' THEN 1.0 ELSE NULL END::DOUBLE AS code, count(*) AS n FROM lineitem GROUP BY ALL""")
def attr_code(spark, sf):
    letter = F.when(F.col("l_returnflag") == "R", "p").when(F.col("l_returnflag") == "A", " A").otherwise("?")
    return tables.read(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber", names.code(letter).alias("code")).agg(F.count("*").alias("n"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN 'kept_diverse' WHEN l.quality = 1 THEN 'removed_redundant' ELSE 'rejected' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status""")
def diverse_status(spark, sf):
    docs, labels = tables.read(spark, sf, "documents").select("doc_id"), tables.read(spark, sf, "labels").select("doc_id", "quality")
    status = F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), "kept_diverse").when(F.col("quality") == 1, "removed_redundant").otherwise("rejected")
    return docs.join(labels, "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS kept FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return tables.read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("kept"))


_ROUNDED = "CASE WHEN avg({0}) <= 0.25 THEN 0.0 WHEN avg({0}) >= 0.75 THEN 1.0 ELSE 0.5 END::DOUBLE"


@query(f"""SELECT l_partkey, {_ROUNDED.format("(l_quantity > 13)::INT")} AS large, {_ROUNDED.format("(l_returnflag <> 'R')::INT")} AS kept, {_ROUNDED.format("(l_tax < 0.07)::INT")} AS taxed, NULL::DOUBLE AS unknown FROM lineitem GROUP BY l_partkey""")
def attr_drop_uninformative(spark, sf):
    """A matrix of six attributes of parts without the two that none or all of them have; one that nobody knows stays."""
    flags = {"large": F.col("l_quantity") > 13, "kept": F.col("l_returnflag") != "R", "always": F.col("l_quantity") > 0, "never": F.col("l_quantity") < 0, "taxed": F.col("l_tax") < 0.07, "unknown": F.lit(None).cast("boolean")}
    matrix = tables.read(spark, sf, "lineitem").groupBy("l_partkey").agg(*(F.avg(metrics.hit(c)).alias(n) for n, c in flags.items()))
    return attributes.informative(matrix.select("l_partkey", *(names.rounded(F.col(n)).alias(n) for n in flags)), ["l_partkey"])


@query("SELECT label, item_id FROM (SELECT label, vec_id AS item_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT * FROM embeddings WHERE vec_id % 3 = 0)) WHERE k = 1")
def distinct_ordered(spark, sf):
    items = tables.read_embeddings(spark, sf).select("label", "item_id")
    both = items.where("item_id % 2 = 0").unionByName(items.where("item_id % 3 = 0"))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("item_id"))).where("k = 1").select("label", "item_id")


@query(f"""WITH s AS (SELECT DISTINCT label, item_id FROM (SELECT vec_id // 2 AS item_id, label FROM embeddings)), k AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || item_id)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM s))
SELECT item_id, CASE WHEN place <= ceil(0.3::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM k""")
def split_images_70_30(spark, sf):
    """By image, not by patch: two items in a row share one."""
    images = tables.read_embeddings(spark, sf).select(F.floor(F.col("item_id") / 2).alias("item_id")).distinct()
    # the place of an image among all: those of each of 256 hash prefixes are placed apart, and start where the prefixes before end
    order = tables.shuffled(42, "item_id")
    rows = images.withColumn("h", order).withColumn("p", F.substring("h", 1, 2))
    starts = rows.groupBy("p").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("p")) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    place = F.row_number().over(Window.partitionBy("p").orderBy("h")) + F.col("before")
    return rows.join(F.broadcast(starts), "p").select("item_id", F.when(place <= F.ceil(F.lit(0.3) * F.col("n")), "test").otherwise("train").alias("split"))


# ---- single metrics


def _top(spark, sf) -> DataFrame:
    _, g, q, _ = _roles(spark, sf)
    return similarity.nearest(q, g)


@query(f"{WITH} SELECT round(avg((q_label = g_label)::INT), 6) AS micro FROM r WHERE rank = 1")
def micro_accuracy(spark, sf):
    return _top(spark, sf).agg(_r(F.avg(metrics.hit("correct")), "micro"))


@query(f"{WITH}, f AS (SELECT q_id, min(rank) FILTER (q_label = g_label) AS first FROM r GROUP BY q_id) SELECT k, round(avg((coalesce(first, 1000000) <= k)::INT), 6) AS recall FROM f, (SELECT unnest([1, 5, 10]) AS k) GROUP BY k")
def recall_at_k_micro(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    first = similarity.matches(q, g, 10).groupBy("q_id").agg(F.min(F.when(F.col("q_label") == F.col("g_label"), F.col("rank"))).alias("first"))
    return first.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10))))).groupBy("k").agg(_r(F.avg(metrics.hit(F.coalesce("first", F.lit(1_000_000)) <= F.col("k"))), "recall"))


_OOD = f"WITH {E}, p AS (SELECT * FROM q UNION ALL SELECT * FROM o), {_sims('p')}, z AS (SELECT (q_label > 7)::INT AS pos, round(1 - sim, 9) AS score FROM r WHERE rank = 1)"


def _ood(spark, sf) -> DataFrame:
    _, g, q, o = _roles(spark, sf)
    return similarity.nearest(q.unionByName(o), g).select("q_id", (F.col("q_label") > 7).alias("positive"), F.round(1 - F.col("sim"), 9).alias("score"))


@query(f"{_OOD} SELECT round(avg(score) FILTER (pos = 1) - avg(score) FILTER (pos = 0), 6) AS separation FROM z")
def score_separation(spark, sf):
    mean = lambda c: F.avg(F.when(c, F.col("score")))
    return _ood(spark, sf).agg(_r(mean(F.col("positive")) - mean(~F.col("positive")), "separation"))


_CURVE = f"{_OOD}, c AS (SELECT score, sum(pos)::BIGINT AS pos, sum(1 - pos)::BIGINT AS neg FROM z GROUP BY score), k AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"


@query(f"{_CURVE} SELECT target, round(min(fp) FILTER (tp >= target * p) / max(n)::DOUBLE, 6) AS fpr FROM k, (SELECT unnest([0.8, 0.9, 0.95]::DOUBLE[]) AS target) GROUP BY target")
def fpr_at_tpr(spark, sf):
    at = metrics.steps(_ood(spark, sf), []).withColumn("target", F.explode(F.array(*map(F.lit, (0.8, 0.9, 0.95)))))
    return at.groupBy("target").agg(F.round(F.min(F.when(F.col("tp") >= F.col("target") * F.col("p"), F.col("fp"))) / F.max("n"), 6).alias("fpr"))


@query(f"{_CURVE} SELECT round(sum(pos * tp / (tp + fp)::DOUBLE) / max(p), 6) AS aupr FROM k")
def aupr(spark, sf):
    return metrics.roc(_ood(spark, sf)).select(_r("aupr"))


@query(f"{_FULL} SELECT q_label, round(avg(mrr), 6) AS mrr, round(avg(first_rank), 6) AS mean_first_rank, round(avg(hit10), 6) AS hit10, round(avg(purity5), 6) AS purity5 FROM y GROUP BY q_label")
def mean_first_rank(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    y = metrics.quality(similarity.relevant_quality(q, g, depth=5))
    return y.groupBy("q_label").agg(_r(F.avg("mrr"), "mrr"), _r(F.avg(F.coalesce("first_rank", F.col("gallery") + 1)), "mean_first_rank"), _r(F.avg("hit10"), "hit10"), _r(F.avg("purity5"), "purity5"))


@query(f"""SELECT rep, label, item_id FROM (SELECT rep, label, vec_id AS item_id, row_number() OVER (PARTITION BY rep, label ORDER BY md5('42:' || rep || ':' || label || ':' || vec_id)) AS k FROM embeddings, (SELECT unnest(range(10)) AS rep)) WHERE k <= 5""")
def rank_sample(spark, sf):
    return splits.sampled(tables.read_embeddings(spark, sf).select("item_id", "label"), ["label"], 5, 10).select(F.col("rep").cast("long").alias("rep"), "label", "item_id")


@query(f"""WITH {E}, u AS (SELECT item_id, label, 'gallery' AS part FROM g UNION ALL SELECT item_id, label, 'reference' FROM o WHERE item_id % 2 = 0) SELECT label, part, count(*) AS n FROM u GROUP BY ALL""")
def union_gallery(spark, sf):
    _, g, _, o = _roles(spark, sf)
    return g.withColumn("part", F.lit("gallery")).unionByName(o.where("item_id % 2 = 0").withColumn("part", F.lit("reference"))).groupBy("label", "part").agg(F.count("*").alias("n"))


# ---- scores and classifiers


@query(f"{_CENTRED}{_SCORES}, z AS (SELECT label, count(*) AS n FROM cg GROUP BY label) SELECT q_id, c.label, round(score - ln(n), 6) AS score FROM c JOIN z USING (label)")
def score_centered_lme(spark, sf):
    return _scores(spark, sf, centre=True, by_size=True).select("q_id", "label", _r("score"))


@query(f"""{_CENTROIDS.replace("c AS (SELECT label AS", "ce AS (SELECT label AS").replace("FROM c)", "FROM ce)")}, {_sims('q', 'g', 'rg')}{_SCORES.replace("FROM r", "FROM rg")},
x AS (SELECT q_id, label, exp(score - max(score) OVER (PARTITION BY q_id)) AS w FROM c), s AS (SELECT q_id, label, w / sum(w) OVER (PARTITION BY q_id) AS p FROM x),
h AS (SELECT a, r.q_id, r.q_label, r.g_label AS label, a * coalesce(p, 0) + (1 - a) * r.sim AS score FROM r LEFT JOIN s ON s.q_id = r.q_id AND s.label = r.g_label, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS a)),
b AS (SELECT *, row_number() OVER (PARTITION BY a, q_id ORDER BY round(score, 9) DESC, label) AS k FROM h), l AS (SELECT a, q_label, avg((label = q_label)::INT) AS x FROM b WHERE k = 1 GROUP BY ALL) SELECT a, round(avg(x), 6) AS macro FROM l GROUP BY a""")
def score_hybrid(spark, sf):
    """Softmaxed scores and centroid similarities mixed."""
    _, g, q, _ = _roles(spark, sf)
    own = similarity.class_scores(similarity.matches(q, g, 50))
    w = own.withColumn("w", F.exp(F.col("score") - F.max("score").over(Window.partitionBy("q_id"))))
    p = w.select("q_id", "label", (F.col("w") / F.sum("w").over(Window.partitionBy("q_id"))).alias("p"))
    grid = similarity.matches(q, centroids(g), None).select("q_id", "q_label", F.col("g_label").alias("label"), "sim")
    mixed = grid.join(p, ["q_id", "label"], "left").withColumn("a", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75)))))
    mixed = mixed.withColumn("score", F.col("a") * F.coalesce("p", F.lit(0.0)) + (1 - F.col("a")) * F.col("sim"))
    place = F.row_number().over(Window.partitionBy("a", "q_id").orderBy(F.desc(F.round("score", 9)), "label"))
    return metrics.macro(mixed.withColumn("k", place).where("k = 1").withColumnRenamed("label", "pred"), ["a"]).select("a", _r("macro"))


@query(f"""WITH {E}, old AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || label || ':' || item_id)) AS k FROM g) WHERE k <= 10), new AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || label || ':' || item_id)) AS k FROM o WHERE item_id % 2 = 0) WHERE k <= 10),
u AS (SELECT label, v FROM old UNION ALL SELECT label, v FROM new), m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM u) GROUP BY ALL), c AS (SELECT label AS item_id, label, list(m ORDER BY i) AS v FROM m GROUP BY label), ce AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM c),
asked AS (SELECT * FROM q UNION ALL SELECT * FROM o WHERE item_id % 2 = 1), {_sims('asked', 'ce')}, a AS (SELECT q_label, avg((q_label = g_label)::INT) AS x FROM r WHERE rank = 1 GROUP BY q_label) SELECT q_label > 7 AS novel, round(avg(x), 6) AS macro FROM a GROUP BY 1""")
def exemplar_mean_classifier(spark, sf):
    """Nearest mean of ten exemplars of each old and new label, the means taken before anything is scaled."""
    _, g, q, o = _roles(spark, sf)
    rows = splits.placed(g.unionByName(o.where("item_id % 2 = 0")), ["label"]).where("place <= 10")
    means = vectors.mean_vector(rows, ["label"]).select(F.col("label").cast("long").alias("item_id"), "label", "vec")
    found = similarity.nearest(q.unionByName(o.where("item_id % 2 = 1")), means).withColumn("novel", F.col("q_label") > 7)
    return metrics.macro(found, ["novel"]).select("novel", _r("macro"))


@unchecked
def native_classifier(spark, sf):
    """Macro accuracy of a multinomial logistic regression on the gallery's vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    _, g, q, _ = _roles(spark, sf)
    rows = lambda df: df.select("item_id", F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features"))
    model = LogisticRegression(maxIter=30, regParam=0.01, family="multinomial").fit(rows(g))
    found = model.transform(rows(q)).select(F.col("label").alias("q_label"), F.col("prediction").alias("pred"))
    return metrics.macro(found).select(_r("macro"), "labels")


# ---- selection, ablations and reports

@query(f"""{WITH}, a AS (SELECT q_label, avg((q_label = g_label)::INT) AS x FROM r WHERE rank = 1 GROUP BY q_label), s AS (SELECT a.item_id AS q_id, a.label AS q_label, b.label AS g_label, row_number() OVER (PARTITION BY a.item_id ORDER BY list_dot_product(a.v, b.v) / (a.l * b.l) DESC, b.item_id) AS rank FROM q a, g b WHERE a.label <= 3 AND b.label <= 3),
b AS (SELECT q_label, avg((q_label = g_label)::INT) AS x FROM s WHERE rank = 1 GROUP BY q_label) SELECT round((SELECT avg(x) FROM a), 6) AS whole, round((SELECT avg(x) FROM b), 6) AS small, (SELECT avg(x) FROM a) < (SELECT avg(x) FROM b) AS ok""")
def cardinality_check(spark, sf):
    """More labels in the gallery can't make the task easier."""
    _, g, q, _ = _roles(spark, sf)
    whole = metrics.macro(similarity.nearest(q, g)).select(F.col("macro").alias("whole"))
    small = metrics.macro(similarity.nearest(q.where("label <= 3"), g.where("label <= 3"))).select(F.col("macro").alias("small"))
    return whole.crossJoin(small).select(_r("whole"), _r("small"), (F.col("whole") < F.col("small")).alias("ok"))  # a row each


