"""Scopes of a gallery side by side, and where labels fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from ..operators import metrics, similarity, splits
from ..operators.scorers import TAU, centred
from ..sources import files, tables
from .protocols import _SPACES, _TWO, label_table, spaces
from .queries import WITH, E, _r, _roles, query
from .suites import _CURVES

#: Labels that a gallery of the first two scopes has to have, and the labels of the third.
LEAST_LABELS, FEW = 8, 3
SCOPES = ("full", "ce_train", "id_only")
RECALLS = (1, 5, 20, 100)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def marked(g: DataFrame) -> DataFrame:
    """g with in_train: the rows that the heads' training saw, 65 % of each label's."""
    return splits.placed(g, ["label"]).withColumn("in_train", F.col("place") <= splits.part(0.65, 1)).drop("place", "n")


_TRAIN = "row_number() OVER (PARTITION BY {0} ORDER BY md5('42:' || label || ':' || item_id)) <= greatest(1, floor(0.65::DOUBLE * count(*) OVER (PARTITION BY {0})))"


@query(f"""WITH {E}, m AS (SELECT *, {_TRAIN.format("label")} AS t FROM g) SELECT scope, label, count(*) AS n FROM (SELECT 'full' AS scope, label FROM m UNION ALL SELECT 'ce_train', label FROM m WHERE t UNION ALL SELECT 'id_only', label FROM m WHERE label <= {FEW}) GROUP BY ALL""")
def gallery_scope(spark, sf):
    """Rows of each label in each scope; a scope with too few labels, or of an unknown name, fails."""
    _, g, q, _ = _roles(spark, sf)
    known, own = q.where(F.col("label") <= FEW), marked(g)
    counts = [files.scoped(own, s, known, LEAST_LABELS).groupBy("label").agg(F.count("*").alias("n")).withColumn("scope", F.lit(s)) for s in SCOPES]
    return _union(counts).select("scope", "label", "n")


def sides(spark, sf, names: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Gallery, and known and novel queries: item_id, label, vec, part, for each space, scope and mode; part is `space:scope:mode`. Modes are
    raw, and centred by the mean of the scope's gallery. All parts are searched in one pass, each in itself."""
    items = tables.read_embeddings(spark, sf)
    own, known, few = marked(tables.gallery(items)), tables.id_queries(items).where(F.col("label") <= FEW), F.col("label") <= FEW
    held = tables.staged(_union([files.scoped(own, s, known, LEAST_LABELS).select("item_id", F.lit(s).alias("scope")) for s in SCOPES]), "scopes")
    gs, qs = [], []
    for name, s in spaces(items).items():
        if names and name not in names:
            continue
        part = F.concat(F.lit(f"{name}:"), "scope").alias("part")
        asked = F.when(few | (F.col("label") > tables.LAST_KNOWN), F.array(*map(F.lit, SCOPES))).otherwise(F.array(F.lit("full"), F.lit("ce_train")))
        gs.append(tables.gallery(s).join(held, "item_id").select("item_id", "label", "vec", part))
        qs.append(tables.id_queries(s).unionByName(tables.ood_queries(s)).withColumn("scope", F.explode(asked)).select("item_id", "label", "vec", part))
    raw = [tables.staged(_union(gs), "gallery"), tables.staged(_union(qs), "queries")]
    mid = [centred(x, raw[0], "part").select(*raw[0].columns) for x in raw]
    both = lambda a, b: a.withColumn("part", F.concat("part", F.lit(":raw"))).unionByName(b.withColumn("part", F.concat("part", F.lit(":centred"))))
    return both(raw[0], mid[0]), both(raw[1], mid[1])


def nearest_of(q: DataFrame, g: DataFrame, m: int) -> DataFrame:
    """The m nearest rows of each query's own part, similarities to nine places, with space, scope and mode."""
    found = similarity.matches(q, g, m + 10, within="part").withColumn("sim", F.round("sim", 9))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("part", "q_id").orderBy(F.desc("sim"), "g_id"))).where(F.col("rank") <= m)
    return found.select("*", *(F.split("part", ":")[i].alias(c) for i, c in enumerate(("space", "scope", "mode"))))


_PARTS = f"""{_SPACES}, tr AS (SELECT space, item_id, {_TRAIN.format("space, label")} AS t FROM n WHERE item_id % 2 = 0 AND label <= 7),
sg AS (SELECT space, scope, item_id, label, v FROM n JOIN tr USING (space, item_id), (SELECT unnest({list(SCOPES)}) AS scope) WHERE CASE scope WHEN 'full' THEN true WHEN 'ce_train' THEN t ELSE label <= {FEW} END), sq AS (SELECT space, scope, item_id, label, v FROM n, (SELECT unnest({list(SCOPES)}) AS scope) WHERE label > 7 OR (item_id % 2 = 1 AND (scope <> 'id_only' OR label <= {FEW}))),
mu AS (SELECT space, scope, list(m ORDER BY i) AS c FROM (SELECT space, scope, i, avg(x) AS m FROM (SELECT space, scope, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM sg) GROUP BY ALL) GROUP BY ALL), sd AS (SELECT 'g' AS side, * FROM sg UNION ALL SELECT 'q', * FROM sq),
va AS (SELECT 'raw' AS mode, * FROM sd UNION ALL SELECT 'centred', side, space, scope, item_id, label, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) FROM sd JOIN mu USING (space, scope)), vl AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM va),
nr AS (SELECT a.space, a.scope, a.mode, a.item_id AS q_id, a.label AS q_label, b.label AS g_label, round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) AS sim, row_number() OVER (PARTITION BY a.space, a.scope, a.mode, a.item_id ORDER BY round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) DESC, b.item_id) AS rank FROM vl a JOIN vl b ON a.side = 'q' AND b.side = 'g' AND a.space = b.space AND a.scope = b.scope AND a.mode = b.mode QUALIFY rank <= 100)"""


@query(f"""{_PARTS}, ac AS (SELECT space, scope, mode, avg(x) AS r1 FROM (SELECT space, scope, mode, q_label, avg((q_label = g_label)::INT) AS x FROM nr WHERE rank = 1 AND q_label <= 7 GROUP BY ALL) GROUP BY ALL), z AS (SELECT space, scope, mode, (q_label > 7)::INT AS pos, round(1 - sim, 9) AS score, 1 AS w FROM nr WHERE rank = 1), {_CURVES.format(c="cv", by="space, scope, mode", rows="z")},
j AS (SELECT space, scope, mode, r1, auroc, fpr FROM ac JOIN cvr USING (space, scope, mode)) SELECT space, scope, """ + ", ".join(f"round(max({c}) FILTER (mode = 'raw'), 6) AS {c}_raw, round(max({c}) FILTER (mode = 'centred'), 6) AS {c}_centred, round(max({c}) FILTER (mode = 'centred') - max({c}) FILTER (mode = 'raw'), 6) AS {c}_delta" for c in ("r1", "auroc", "fpr")) + " FROM j GROUP BY ALL")
def centering_ablation(spark, sf):
    """What centring does to accuracy and novelty, in every space and scope."""
    g, q = sides(spark, sf)
    top = tables.staged(nearest_of(q, g, 1).select("space", "scope", "mode", "q_label", "g_label", "sim"), "nearest")
    by, novel = ["space", "scope", "mode"], F.col("q_label") > tables.LAST_KNOWN
    r1 = metrics.macro(top.where(~novel).withColumn("pred", F.col("g_label")), by).select(*by, F.col("macro").alias("r1"))
    rows = r1.join(metrics.roc(top.select(*by, novel.alias("positive"), F.round(1 - F.col("sim"), 9).alias("score")), by), by)
    of = lambda c, mode: F.max(F.when(F.col("mode") == mode, F.col(c)))
    each = [x for c in ("r1", "auroc", "fpr") for x in (_r(of(c, "raw"), f"{c}_raw"), _r(of(c, "centred"), f"{c}_centred"), _r(of(c, "centred") - of(c, "raw"), f"{c}_delta"))]
    return rows.groupBy("space", "scope").agg(*each)


def recalls(top: DataFrame, sizes: DataFrame, by: list[str], ks: tuple[int, ...] = RECALLS) -> DataFrame:
    """by, k, recall: the share of a label's queries with a row of their label among the k nearest, the mean of labels. top: matches with rank;
    sizes: by, rows of the gallery; a k that is no less than these is left out."""
    first = top.groupBy(*by, "q_id", "q_label").agg(F.min(F.when(F.col("q_label") == F.col("g_label"), F.col("rank"))).alias("first"))
    at = first.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy(*by, "k", "q_label").agg(F.avg(metrics.hit(F.coalesce("first", F.lit(2**31 - 1)) <= F.col("k"))).alias("x"))
    macro = at.groupBy(*by, "k").agg(F.avg("x").alias("recall"))
    known = macro.join(sizes, by) if by else macro.crossJoin(F.broadcast(sizes))  # one row
    return known.where(F.col("k") < F.col("rows")).drop("rows")


_FIRST = "fi AS (SELECT scope, mode, q_id, q_label, min(rank) FILTER (q_label = g_label) AS first FROM nr WHERE space = 'Full' AND q_label <= 7 GROUP BY ALL), kr AS (SELECT scope, mode, k, avg(x) AS recall FROM (SELECT scope, mode, k, q_label, avg((coalesce(first, 1000000) <= k)::INT) AS x FROM fi, (SELECT unnest([1, 5, 20, 100]) AS k) GROUP BY ALL) GROUP BY ALL), kk AS (SELECT kr.* FROM kr WHERE k < (SELECT count(*) FROM sg WHERE sg.space = 'Full' AND sg.scope = kr.scope))"


@query(f"{_PARTS}, {_FIRST} SELECT mode, k, round(recall, 6) AS recall FROM kk WHERE scope = 'full'")
def recall_at_k_macro(spark, sf):
    """Recall among the k nearest of the whole gallery, raw and centred; no k that takes in the whole gallery."""
    g, q = (x.where(F.col("part").startswith("Full:full:")) for x in sides(spark, sf, ("Full",)))
    sizes = g.groupBy(F.split("part", ":")[2].alias("mode")).agg(F.count("*").alias("rows"))
    return recalls(nearest_of(q, g, max(RECALLS)).where(F.col("q_label") <= tables.LAST_KNOWN), sizes, ["mode"]).select("mode", "k", _r("recall"))


@query(f"""{_PARTS}, {_FIRST}, pu AS (SELECT scope, mode, label, i, avg(x) AS m FROM (SELECT scope, mode, label, unnest(list_transform(v, lambda x: x / l)) AS x, unnest(range(1, 65)) AS i FROM vl WHERE side = 'g' AND space = 'Full') GROUP BY ALL), pc AS (SELECT scope, mode, label, list(m ORDER BY i) AS v FROM pu GROUP BY ALL),
pb AS (SELECT a.scope, a.mode, a.label AS q_label, pc.label AS g_label FROM vl a JOIN pc USING (scope, mode) WHERE a.side = 'q' AND a.space = 'Full' AND a.label <= 7 QUALIFY row_number() OVER (PARTITION BY a.scope, a.mode, a.item_id ORDER BY round(list_dot_product(a.v, pc.v) / (a.l * sqrt(list_dot_product(pc.v, pc.v))), 9) DESC, pc.label) = 1),
lo AS (SELECT a.item_id, a.label AS q_label, b.label AS g_label FROM vl a JOIN vl b ON a.side = 'g' AND b.side = 'g' AND a.space = 'Full' AND b.space = 'Full' AND a.scope = 'full' AND b.scope = 'full' AND a.mode = 'raw' AND b.mode = 'raw' AND a.item_id <> b.item_id QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) DESC, b.item_id) = 1)
SELECT scope, mode, 'r@' || k AS metric, round(recall, 6) AS value FROM kk UNION ALL SELECT scope, mode, 'proto', round(avg(x), 6) FROM (SELECT scope, mode, q_label, avg((q_label = g_label)::INT) AS x FROM pb GROUP BY ALL) GROUP BY ALL UNION ALL SELECT 'full', 'raw', 'leave one out', round(avg(x), 6) FROM (SELECT q_label, avg((q_label = g_label)::INT) AS x FROM lo GROUP BY ALL)""")
def scope_diagnosis(spark, sf):
    """Each scope's centroids and recalls, raw and centred, and the gallery's own rows against each other."""
    g, q = sides(spark, sf, ("Full",))
    q, cut = q.where(F.col("label") <= tables.LAST_KNOWN), F.split("part", ":")
    sizes = g.groupBy(cut[1].alias("scope"), cut[2].alias("mode")).agg(F.count("*").alias("rows"))
    recall = recalls(nearest_of(q, g, max(RECALLS)), sizes, ["scope", "mode"]).select("scope", "mode", F.concat(F.lit("r@"), "k").alias("metric"), F.col("recall").alias("value"))
    means = vectors.mean_vector(vectors.scaled(g), ["part", "label"]).select(F.col("label").cast("long").alias("item_id"), "label", "vec", "part")
    macro = lambda df, name: metrics.macro(df.withColumn("pred", F.col("g_label")), ["scope", "mode"]).select("scope", "mode", F.lit(name).alias("metric"), F.col("macro").alias("value"))
    whole = tables.gallery(tables.read_embeddings(spark, sf))
    near = similarity.matches(whole, whole, 11, skip_self=True).withColumn("sim", F.round("sim", 9))
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "g_id"))).where("at = 1").withColumns({"scope": F.lit("full"), "mode": F.lit("raw")})
    return recall.unionByName(macro(nearest_of(q, means, 1), "proto")).unionByName(macro(near, "leave one out")).select("scope", "mode", "metric", _r("value"))


@query(f"""{_SPACES}, c AS (SELECT space, count(*) FILTER (item_id % 2 = 0 AND label <= 7) AS gallery_rows, count(DISTINCT label) FILTER (item_id % 2 = 0 AND label <= 7) AS gallery_labels, count(DISTINCT label) FILTER (item_id % 2 = 1 AND label <= 7) AS id_labels, count(DISTINCT label) FILTER (label > 7) AS ood_labels FROM n GROUP BY space) SELECT *, gallery_labels >= {LEAST_LABELS} AS is_full FROM c""")
def protocol_audit(spark, sf):
    """What each space is measured on, and whether its gallery has all labels."""
    g, q, o = F.expr("item_id % 2 = 0 and label <= 7"), F.expr("item_id % 2 = 1 and label <= 7"), F.col("label") > 7
    items = _union([s.select("item_id", "label", F.lit(name).alias("space")) for name, s in spaces(tables.read_embeddings(spark, sf)).items()])
    labels = lambda c, name: F.countDistinct(F.when(c, F.col("label"))).alias(name)
    rows = items.groupBy("space").agg(F.count_if(g).alias("gallery_rows"), labels(g, "gallery_labels"), labels(q, "id_labels"), labels(o, "ood_labels"))
    return rows.withColumn("is_full", F.col("gallery_labels") >= LEAST_LABELS)


@query(f"""{WITH}, t AS (SELECT q_id, g_label AS label, exp((sim - max(sim) OVER (PARTITION BY q_id)) / 0.07::DOUBLE) AS w FROM r WHERE rank <= 50), c AS (SELECT q_id, label, sum(w) AS w FROM t GROUP BY ALL) SELECT q_id, label, round(w / sum(w) OVER (PARTITION BY q_id), 6) AS p FROM c""")
def soft_retrieval(spark, sf):
    """Each label's share of the softmax over a query's fifty nearest rows."""
    _, g, q, _ = _roles(spark, sf)
    top = similarity.matches(q, g, 50)
    w = F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy("q_id"))) / TAU)
    c = top.withColumn("w", w).groupBy("q_id", F.col("g_label").alias("label")).agg(F.sum("w").alias("w"))
    return c.select("q_id", "label", _r(F.col("w") / F.sum("w").over(Window.partitionBy("q_id")), "p"))


_TAGS = {"hard": ("whole", "whole IS NOT NULL", 1), "gain": ("round(whole - a, 9)", "whole IS NOT NULL AND a IS NOT NULL", -1), "loss": ("round(whole - a, 9)", "whole IS NOT NULL AND a IS NOT NULL", 1)}


@query(f"""{_TWO}, {{0}}, tg AS ({" UNION ALL ".join(f"SELECT * FROM (SELECT '{tag}' AS tag, q_label, {x} AS value, row_number() OVER (ORDER BY {sign} * {x}, q_label) AS place FROM w WHERE {cond}) WHERE place <= 10" for tag, (x, cond, sign) in _TAGS.items())})
SELECT tag, place::INT AS place, tg.q_label, round(value, 6) AS value, a, b, whole, n, wrong, confused_with, example FROM tg JOIN cf USING (q_label) JOIN (SELECT q_label, round(a, 6) AS a, round(b, 6) AS b, round(whole, 6) AS whole FROM w) USING (q_label)""".replace("{0}", """fr AS (SELECT q.item_id AS q_id, q.label AS q_label, g.label AS g_label FROM n q JOIN n g ON q.space = 'Full' AND g.space = 'Full' AND q.item_id % 2 = 1 AND g.item_id % 2 = 0 AND q.label <= 7 AND g.label <= 7 QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY list_dot_product(q.v, g.v) / (q.l * g.l) DESC, g.item_id) = 1),
pr AS (SELECT q_label, g_label, count(*) AS c, min(q_id) AS example FROM fr GROUP BY ALL), cf AS (SELECT q_label, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (q_label <> g_label), 0)::BIGINT AS wrong, arg_min(g_label, g_label - 100 * c) FILTER (q_label <> g_label) AS confused_with, arg_min(example, g_label - 100 * c) FILTER (q_label <> g_label) AS example FROM pr GROUP BY q_label)"""))
def failure_taxonomy(spark, sf):
    """Three tagged lists of ten labels, the hardest, those that the whole space gains most, and least or loses: each with its accuracies, its
    errors, the label it is most taken for, and an example."""
    _, g, q, _ = _roles(spark, sf)
    pairs = similarity.nearest(q, g).groupBy("q_label", "pred").agg(F.count("*").alias("c"), F.min("q_id").alias("example"))
    other = F.col("q_label") != F.col("pred")
    worst = F.min(F.when(other, F.struct((-F.col("c")).alias("c"), "pred", "example")))
    errors = pairs.groupBy("q_label").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(other, F.col("c"))), F.lit(0)).alias("wrong"), worst.alias("w"))
    t = label_table(spark, sf).withColumn("delta", F.round(F.col("whole") - F.col("a"), 9))
    first = lambda tag, c, order: t.where(F.col(c).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(tag)).orderBy(order, "q_label"))).where("place <= 10").withColumns({"tag": F.lit(tag), "value": F.col(c)})  # noqa: E731  a row a label
    rows = _union([first("hard", "whole", F.asc("whole")), first("gain", "delta", F.desc("delta")), first("loss", "delta", F.asc("delta"))]).join(errors, "q_label")
    return rows.select("tag", "place", "q_label", _r("value"), _r("a"), _r("b"), _r("whole"), "n", "wrong", F.col("w.pred").alias("confused_with"), F.col("w.example").alias("example"))


@query("""WITH n AS (SELECT p_name AS label, split_part(p_name, ' ', 1) AS grp, bool_or(p_partkey < 5) AS known FROM part WHERE p_partkey % 7 < 2 GROUP BY p_name), f AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM n WHERE NOT known),
r AS (SELECT label, grp, n, row_number() OVER (PARTITION BY grp ORDER BY md5('42:' || grp || ':' || label)) AS k FROM f WHERE n >= 3), h AS (SELECT grp, row_number() OVER (ORDER BY md5('42:' || grp)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM f WHERE n < 3)),
a AS (SELECT label, grp, k, n FROM r UNION ALL SELECT f.label, f.grp, h.k, h.n FROM f JOIN h USING (grp)) SELECT label, grp, CASE WHEN k <= round_even(0.6::DOUBLE * n, 0) THEN 'train' WHEN k <= round_even(0.6::DOUBLE * n, 0) + round_even(0.1::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split FROM a UNION ALL SELECT label, grp, 'test' FROM n WHERE known""")
def split_meta(spark, sf):
    """Known labels are tested on; groups of three labels and more are shared out inside, smaller ones as wholes, 60 / 10 / 30."""
    part = tables.read(spark, sf, "part").where("p_partkey % 7 < 2")
    labels = part.groupBy(F.col("p_name").alias("label")).agg(F.max(F.col("p_partkey") < 5).alias("known")).withColumn("grp", F.substring_index("label", " ", 1))
    return splits.meta(labels).select("label", "grp", "split")
