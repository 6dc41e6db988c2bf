"""The registered queries of the retrieval and evaluation operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, vectors
from ..operators import metrics, openset, similarity, splits
from ..operators.scorers import centred
from ..sources import files, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _roles(spark, sf):
    items = tables.read_embeddings(spark, sf)
    return items, tables.gallery(items), tables.id_queries(items), tables.ood_queries(items)


def _r(c, name=None):
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6).alias(name or c)


E = """e AS (SELECT vec_id AS item_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM e),
g AS (SELECT * FROM n WHERE item_id % 2 = 0 AND label <= 7), q AS (SELECT * FROM n WHERE item_id % 2 = 1 AND label <= 7), o AS (SELECT * FROM n WHERE label > 7)"""


def _sims(q: str = "q", g: str = "g", name: str = "r", where: str = "true") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, g_id) AS rank FROM (
SELECT a.item_id AS q_id, a.label AS q_label, b.item_id AS g_id, b.label AS g_label, list_dot_product(a.v, b.v) / (a.l * b.l) AS sim FROM {q} a, {g} b WHERE {where}))"""


WITH = f"WITH {E}, {_sims()}"

# ---- sources


@query("SELECT vec_id AS item_id, label, len(embedding)::INT AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def read_embeddings(spark, sf):
    return tables.read_embeddings(spark, sf).select("item_id", "label", F.size("vec").alias("dim"), _r(vectors.norm("vec"), "length"))


@query("SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, sum(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS in_gallery FROM embeddings GROUP BY label")
def embedding_provenance(spark, sf):
    return tables.read_embeddings(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"), F.sum((F.col("item_id") % 2 == 0).cast("int")).alias("in_gallery"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 >= 3")
def incremental_append(spark, sf):
    orders = tables.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return tables.incremental(orders, orders.where("o_orderkey % 10 < 3"), "o_orderkey")


@query("""SELECT p.p_partkey, p.p_name, coalesce(c.status, 'Not found (offline)') AS status FROM part p
LEFT JOIN (SELECT p_name, min(p_brand) AS status FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name) c USING (p_name)""")
def lookup_cached(spark, sf):
    part = tables.read(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    cache = part.where("p_partkey % 3 <> 0").groupBy("p_name").agg(F.min("p_brand").alias("status"))
    return tables.lookup(part.select("p_partkey", "p_name"), cache, "p_name", "status", "Not found (offline)")


@query("""SELECT url, ord, page_id FROM (SELECT url, page_id, page_id % 2 AS ord, row_number() OVER (PARTITION BY url ORDER BY page_id % 2, page_id) AS k FROM pages) WHERE k = 1""")
def collect_paths_dedup(spark, sf):
    pages = tables.read(spark, sf, "pages").select("url", "page_id")
    both = pages.where("page_id % 2 = 0").withColumn("ord", F.lit(0).cast("long")).unionByName(pages.where("page_id % 2 = 1").withColumn("ord", F.lit(1).cast("long")))
    first = F.row_number().over(Window.partitionBy("url").orderBy("ord", "page_id"))
    return both.withColumn("k", first).where("k = 1").select("url", "ord", "page_id")


@query("""SELECT page_id, replace(url, 'https://', 'http://') AS new_url, replace(url, 'https://', 'http://') <> url AS changed FROM pages""")
def rewrite_prefix(spark, sf):
    new = F.replace(F.col("url"), F.lit("https://"), F.lit("http://"))
    return tables.read(spark, sf, "pages").select("page_id", new.alias("new_url"), (new != F.col("url")).alias("changed"))


@query("""SELECT coalesce(regexp_extract(url, '^[a-z]+://([^/]+)/', 1), '') AS source, count(*) AS pages FROM pages GROUP BY 1""")
def source_from_path(spark, sf):
    return tables.read(spark, sf, "pages").groupBy(F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1), F.lit("")).alias("source")).agg(F.count("*").alias("pages"))


@query("""WITH f AS (SELECT vec_id AS item_id, label, (CASE vec_id % 3 WHEN 0 THEN '256' WHEN 1 THEN '512' ELSE '768' END) AS facet FROM embeddings),
p AS (SELECT label FROM f GROUP BY label HAVING count(DISTINCT facet) = 3)
SELECT facet, label, count(*) AS n FROM (SELECT facet, label FROM f UNION ALL SELECT 'pool', label FROM f SEMI JOIN p USING (label)) GROUP BY 1, 2""")
def facet_pool(spark, sf):
    items = tables.read_embeddings(spark, sf).select("label", F.element_at(F.array(*map(F.lit, ("256", "512", "768"))), (F.col("item_id") % 3 + 1).cast("int")).alias("facet"))
    whole = items.groupBy("label").agg(F.countDistinct("facet").alias("k")).where("k = 3").select("label")
    return items.unionByName(items.join(whole, "label", "left_semi").withColumn("facet", F.lit("pool"))).groupBy("facet", "label").agg(F.count("*").alias("n"))


# ---- names and other columns


@query("""SELECT p_partkey, trim(lower(replace(p_name, ' ', '_')), chr(9) || chr(10) || chr(13)) AS label,
split_part(lower(replace(p_name, ' ', '_')), '_', 1) AS label_group, coalesce(lower(trim(p_name)), '') AS canonical FROM part""")
def canonical_label(spark, sf):
    label = names.canonical_label("p_name")
    return tables.read(spark, sf, "part").select("p_partkey", label.alias("label"), F.substring_index(label, "_", 1).alias("label_group"), F.coalesce(F.lower(F.trim("p_name")), F.lit("")).alias("canonical"))


@query("""SELECT p_partkey, trim(regexp_replace(replace(trim(lower(p_partkey || '-' || p_name)), '_', ' '), '^[0-9]+-?', '')) AS std,
regexp_extract(p_name, '^(\\S+ \\S+)', 1) AS binomial FROM part""".replace("\\\\", "\\"))
def std_name(spark, sf):
    raw = F.concat(F.col("p_partkey").cast("string"), F.lit("-"), F.translate("p_name", "eiou", "ęíöů"))
    return tables.read(spark, sf, "part").select("p_partkey", names.standard_name(raw).alias("std"), names.without_authority(F.lower("p_name")).alias("binomial"))


@query(r"""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN split_part(p_name, ' ', 1) || ' spp. ' || p_partkey WHEN 1 THEN p_name || ' ' || p_partkey WHEN 2 THEN split_part(p_name, ' ', 1) || ' sp' ELSE p_name END AS name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) THEN split_part(name, ' ', 1) || ' sp' WHEN regexp_matches(name, '^\w+ \w+ [0-9]+$') THEN regexp_replace(name, ' [0-9]+$', '') ELSE name END AS query,
CASE WHEN p_partkey % 4 = 0 THEN 'spp. ' || p_partkey WHEN p_partkey % 4 = 2 THEN 'spp.' WHEN regexp_matches(name, '^\w+ \w+ [0-9]+$') THEN 'specimen ' || regexp_extract(name, '([0-9]+)$', 1) ELSE '' END AS variant FROM v""".replace("\\\\", "\\"))
def handle_variants(spark, sf):
    key = F.col("p_partkey")
    first = F.substring_index("p_name", " ", 1)
    name = F.when(key % 4 == 0, F.concat(first, F.lit(" spp. "), key.cast("string"))).when(key % 4 == 1, F.concat(F.col("p_name"), F.lit(" "), key.cast("string"))).when(key % 4 == 2, F.concat(first, F.lit(" sp"))).otherwise(F.col("p_name"))
    return tables.read(spark, sf, "part").withColumn("v", names.variant(name)).select("p_partkey", "v.query", "v.variant")


@query("""SELECT p_partkey, p_name, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey < 5) AND p_name <> '' THEN 'ID' ELSE 'OOD' END AS distribution FROM part""")
def in_out_distribution(spark, sf):
    part = tables.read(spark, sf, "part").select("p_partkey", "p_name")
    known = part.where("p_partkey < 5").select("p_name").distinct().withColumn("known", F.lit(True))
    return part.join(known, "p_name", "left").select("p_partkey", "p_name", F.when(F.col("known") & (F.col("p_name") != ""), "ID").otherwise("OOD").alias("distribution"))


@query("SELECT p_partkey, p_name, (dense_rank() OVER (ORDER BY p_name) - 1)::INT AS label_id FROM part")
def label_index(spark, sf):
    part = tables.read(spark, sf, "part").select("p_partkey", "p_name")
    ids = part.select("p_name").distinct().withColumn("label_id", F.row_number().over(Window.orderBy("p_name")) - 1)  # a row a label
    return part.join(ids, "p_name").select("p_partkey", "p_name", "label_id")


_ATTR = "SELECT l_suppkey, avg(CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0 ELSE 0.5 END) AS a, avg(CASE l_linestatus WHEN 'O' THEN 1.0::DOUBLE ELSE 0 END) AS b FROM lineitem GROUP BY l_suppkey"


def _attributes(spark, sf):
    flags = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.0).otherwise(0.5)
    return tables.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(flags).alias("a"), F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).alias("b"))


@query(f"SELECT l_suppkey, CASE WHEN a <= 0.25 THEN 0.0 WHEN a >= 0.75 THEN 1.0 ELSE 0.5 END::DOUBLE AS flag, CASE WHEN b <= 0.25 THEN 0.0 WHEN b >= 0.75 THEN 1.0 ELSE 0.5 END::DOUBLE AS status FROM ({_ATTR})")
def attr_matrix(spark, sf):
    return _attributes(spark, sf).select("l_suppkey", names.rounded(F.col("a")).alias("flag"), names.rounded(F.col("b")).alias("status"))


@query(f"""SELECT attribute, count(*) FILTER (x = 1) AS present, count(*) FILTER (x = 0) AS absent, count(*) FILTER (x = 0.5) AS variable, round(avg((x = 1)::INT), 6) AS present_rate FROM (
SELECT unnest(['flag', 'status']) AS attribute, unnest([CASE WHEN a <= 0.25 THEN 0 WHEN a >= 0.75 THEN 1 ELSE 0.5 END, CASE WHEN b <= 0.25 THEN 0 WHEN b >= 0.75 THEN 1 ELSE 0.5 END]) AS x FROM ({_ATTR})) GROUP BY attribute""")
def attr_stats(spark, sf):
    long = _attributes(spark, sf).select("l_suppkey", names.rounded(F.col("a")).alias("flag"), names.rounded(F.col("b")).alias("status")).unpivot("l_suppkey", ["flag", "status"], "attribute", "x")
    return long.groupBy("attribute").agg(F.count_if(F.col("x") == 1).alias("present"), F.count_if(F.col("x") == 0).alias("absent"), F.count_if(F.col("x") == 0.5).alias("variable"), _r(F.avg((F.col("x") == 1).cast("int")), "present_rate"))


_GATE = "CASE WHEN digits > 0.02 THEN 'black' WHEN n_chars < 200 THEN 'blurred' WHEN distinct_chars < 20 THEN 'flat' ELSE 'kept' END"


@query(f"""SELECT doc_id, {_GATE} AS status FROM (SELECT doc_id, n_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS digits,
len(list_distinct(string_split(text, ''))) AS distinct_chars FROM documents)""")
def quality_gate(spark, sf):
    text = F.coalesce("text", F.lit(""))
    docs = tables.read(spark, sf, "documents").select("doc_id", "n_chars", (F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.char_length(text), F.lit(1))).alias("digits"), F.size(F.array_distinct(F.split(text, ""))).alias("distinct_chars"))
    return docs.select("doc_id", F.expr(_GATE).alias("status"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source ORDER BY n DESC, lang, source LIMIT 50")
def label_counts_topn(spark, sf):
    return tables.read(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source").limit(50)


@query("""SELECT p_name, array_to_string(list_sort(list(p_brand)), ',') AS brands, sum(p_size)::BIGINT AS total_size, count(*) AS n, min_by(p_type, p_partkey) AS first_type FROM part GROUP BY p_name""")
def collection_rollup(spark, sf):
    part = tables.read(spark, sf, "part")
    return part.groupBy("p_name").agg(F.array_join(F.sort_array(F.collect_list("p_brand")), ",").alias("brands"), F.sum("p_size").cast("long").alias("total_size"), F.count("*").alias("n"), F.min_by("p_type", "p_partkey").alias("first_type"))


# ---- vectors


@query(f"WITH {E} SELECT item_id, round(v[1] / l, 6) AS first, round(v[64] / l, 6) AS last FROM n")
def l2_normalize(spark, sf):
    return vectors.scaled(tables.read_embeddings(spark, sf)).select("item_id", _r(F.col("vec")[0], "first"), _r(F.element_at("vec", -1), "last"))


@query(f"""WITH {E}, h AS (SELECT item_id, v[1:32] AS a, v[33:64] AS b FROM e)
SELECT item_id, round(a[1] / sqrt(list_dot_product(a, a)) / sqrt(2::DOUBLE), 6) AS first, round(b[32] / sqrt(list_dot_product(b, b)) / sqrt(2::DOUBLE), 6) AS last FROM h""")
def fuse(spark, sf):
    items = tables.read_embeddings(spark, sf).select("item_id", F.slice("vec", 1, 32).alias("a"), F.slice("vec", 33, 32).alias("b"))
    return items.select("item_id", vectors.fused("a", "b").alias("x")).select("item_id", _r(F.col("x")[0], "first"), _r(F.element_at("x", -1), "last"))


_MEAN = "SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM {0}) GROUP BY ALL"


@query(f"WITH {E}, m AS ({_MEAN.format('g')}) SELECT label, i::INT AS pos, round(m, 6) AS mean FROM m")
def vector_mean(spark, sf):
    _, g, _, _ = _roles(spark, sf)
    return vectors.mean_vector(g, ["label"]).select("label", F.posexplode("vec").alias("pos", "mean")).select("label", (F.col("pos") + 1).alias("pos"), _r("mean"))


_CENTRED = f"""WITH {E}, m AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM g) GROUP BY i)),
cv AS (SELECT item_id, label, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS v FROM n, m), cl AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM cv),
cg AS (SELECT * FROM cl WHERE item_id % 2 = 0 AND label <= 7), cq AS (SELECT * FROM cl WHERE item_id % 2 = 1 AND label <= 7), {_sims('cq', 'cg')}"""


@query(f"{_CENTRED} SELECT q_id, g_id, round(sim, 6) AS sim FROM r WHERE rank = 1")
def center_by_gallery(spark, sf):
    items, g, _, _ = _roles(spark, sf)
    own = centred(items, g)
    return similarity.nearest(tables.id_queries(own), tables.gallery(own)).select("q_id", "g_id", _r("sim"))


@query(f"""WITH {E}, mg AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM g) GROUP BY i), mo AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM o) GROUP BY i),
d AS (SELECT list(mg.x - mo.x ORDER BY i) AS d FROM mg JOIN mo USING (i)), s AS (SELECT item_id, list_transform(list_zip(v, d), lambda z: z[1] + z[2]) AS v FROM o, d)
SELECT item_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM s""")
def mean_shift_align(spark, sf):
    _, g, _, o = _roles(spark, sf)
    both = vectors.mean_vector(g, [], name="to").crossJoin(vectors.mean_vector(o, [], name="from"))
    moved = vectors.scaled(o.crossJoin(F.broadcast(both)).withColumn("vec", vectors.shifted("vec", "from", "to")))
    return moved.select("item_id", _r(F.col("vec")[0], "first"), _r(F.element_at("vec", -1), "last"))


# ---- similarity joins

_TOP1 = "SELECT q_id, q_label, g_id, g_label AS pred, round(sim, 6) AS sim, q_label = g_label AS correct FROM r WHERE rank = 1"


@query(f"{WITH} {_TOP1}")
def nn_top1(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    return similarity.nearest(q, g).withColumn("sim", F.round("sim", 6))


@query(f"{WITH} SELECT q_id, g_id, g_label, rank::INT AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 10")
def topm_join(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    return similarity.matches(q, g, 10).select("q_id", "g_id", "g_label", "rank", _r("sim"))


@query(f"WITH {E}, {_sims('g', 'g', where='a.item_id <> b.item_id')} {_TOP1}")
def self_join_loo(spark, sf):
    _, g, _, _ = _roles(spark, sf)
    return similarity.nearest(g, g, skip_self=True).withColumn("sim", F.round("sim", 6))


_CENTROIDS = f"""WITH {E}, u AS (SELECT label, list_transform(v, lambda x: x / l) AS v FROM g), m AS ({_MEAN.format('u')}),
c AS (SELECT label AS item_id, label, list(m ORDER BY i) AS v FROM m GROUP BY label), k AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM c), {_sims('q', 'k')}"""


def centroids(g: DataFrame) -> DataFrame:
    """A row of item_id, label, vec for each label: the mean of its unit vectors."""
    return openset.class_means(g)


@query(f"{_CENTROIDS} SELECT q_id, q_label, g_label AS pred, round(sim, 6) AS sim FROM r WHERE rank = 1")
def centroid_join(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    return similarity.nearest(q, centroids(g)).select("q_id", "q_label", "pred", _r("sim"))


@query(f"WITH {E}, p AS (SELECT * FROM q UNION ALL SELECT * FROM o), {_sims('p')} SELECT q_id, q_label > 7 AS novel, round(1 - sim, 6) AS score FROM r WHERE rank = 10")
def knn_kth_distance(spark, sf):
    _, g, q, o = _roles(spark, sf)
    return similarity.matches(q.unionByName(o), g, 10).where("rank = 10").select("q_id", (F.col("q_label") > 7).alias("novel"), _r(1 - F.col("sim"), "score"))


@query(f"""{WITH}, v AS (SELECT q_id, q_label, g_label, count(*) AS n, max(sim) AS best FROM r WHERE rank <= 5 GROUP BY ALL)
SELECT q_id, q_label, g_label AS pred, n FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, best DESC, g_label) AS k FROM v) WHERE k = 1""")
def knn_vote(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    return similarity.votes(similarity.matches(q, g, 5))


@query(f"""{WITH}, t AS (SELECT * FROM r WHERE rank <= 10),
a AS (SELECT q_id, i, avg(x) AS m FROM (SELECT q_id, unnest(g.v) AS x, unnest(range(1, 65)) AS i FROM t JOIN g ON g.item_id = g_id) GROUP BY ALL),
y AS (SELECT a.q_id, list(0.5::DOUBLE * q.v[a.i] + 0.5::DOUBLE * a.m ORDER BY a.i) AS v FROM a JOIN q ON q.item_id = a.q_id GROUP BY a.q_id)
SELECT q_id, round(v[1], 6) AS first, round(v[64], 6) AS last FROM y""")
def query_expansion(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    near = similarity.matches(q, g, 10).select("q_id", F.col("g_id").alias("item_id")).join(g, "item_id")
    mean = vectors.mean_vector(near, ["q_id"], name="mean")
    out = q.withColumnRenamed("item_id", "q_id").join(mean, "q_id").withColumn("vec", F.zip_with("vec", "mean", lambda x, y: 0.5 * x + 0.5 * y))
    return out.select("q_id", _r(F.col("vec")[0], "first"), _r(F.element_at("vec", -1), "last"))


@query(f"""{WITH} SELECT q_id, b.g_label AS pred, b.g_id AS evidence_id, round(b.sim, 6) AS evidence_sim FROM r a JOIN r b USING (q_id) WHERE a.rank = 1 AND b.g_label = a.g_label
QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY b.sim DESC, b.g_id) = 1""")
def evidence_row(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    top = similarity.matches(q, g, 50)
    pred = similarity.nearest(q, g).select("q_id", "pred")
    inside = top.join(pred, "q_id").where("g_label = pred")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "g_id"))
    return inside.withColumn("k", place).where("k = 1").select("q_id", "pred", F.col("g_id").alias("evidence_id"), _r("sim", "evidence_sim"))


# ---- class scores

_SCORES = """, t AS (SELECT *, max(sim) OVER (PARTITION BY q_id, g_label) AS best FROM r WHERE rank <= 50),
c AS (SELECT q_id, q_label, g_label AS label, max(best) / 0.07::DOUBLE + ln(sum(exp((sim - best) / 0.07::DOUBLE))) AS score FROM t GROUP BY ALL)"""


def _scores(spark, sf, centre: bool = False, by_size: bool = False):
    items, g, q, _ = _roles(spark, sf)
    if centre:
        own = centred(items, g)
        g, q = tables.gallery(own), tables.id_queries(own)
    counts = g.groupBy("label").agg(F.count("*").alias("n")) if by_size else None
    return similarity.class_scores(similarity.matches(q, g, 50), counts=counts)


@query(f"{WITH}{_SCORES} SELECT q_id, label, round(score, 6) AS score FROM c")
def score_raw(spark, sf):
    return _scores(spark, sf).select("q_id", "label", _r("score"))


@query(f"{_CENTRED}{_SCORES} SELECT q_id, label, round(score, 6) AS score FROM c")
def score_centered(spark, sf):
    return _scores(spark, sf, centre=True).select("q_id", "label", _r("score"))


@query(f"{WITH}{_SCORES}, z AS (SELECT label, count(*) AS n FROM g GROUP BY label) SELECT q_id, c.label, round(score - ln(n), 6) AS score FROM c JOIN z USING (label)")
def score_logmeanexp(spark, sf):
    return _scores(spark, sf, by_size=True).select("q_id", "label", _r("score"))


_PREDICT = "SELECT q_id, q_label, label AS pred, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, label) AS k FROM c) WHERE k = 1"


@query(f"{_CENTRED}{_SCORES} {_PREDICT}")
def score_predict(spark, sf):
    return similarity.best_class(_scores(spark, sf, centre=True)).select("q_id", "q_label", "pred", _r("score"))


# ---- metrics

_ACC = "SELECT q_label, count(*) AS n, avg((q_label = g_label)::INT) AS accuracy FROM r WHERE rank = 1 GROUP BY q_label"


@query(f"{WITH} SELECT q_label, n, round(accuracy, 6) AS accuracy FROM ({_ACC})")
def per_label_accuracy(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    return metrics.per_label(similarity.nearest(q, g)).select("q_label", "n", _r("accuracy"))


@query(f"{WITH} SELECT round(avg(accuracy), 6) AS macro, count(*) AS labels FROM ({_ACC})")
def macro_accuracy(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    return metrics.macro(similarity.nearest(q, g)).select(_r("macro"), "labels")


_ROC = """, c AS (SELECT {by} score, sum(pos)::BIGINT AS pos, sum(1 - pos)::BIGINT AS neg FROM z GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {part} ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY {part}) AS p, sum(neg) OVER (PARTITION BY {part}) AS n FROM c)
SELECT {by} round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / max(p) / max(n), 6) AS auroc, round(min(fp) FILTER (tp >= 0.95::DOUBLE * p) / max(n)::DOUBLE, 6) AS fpr, round(sum(pos * tp / (tp + fp)::DOUBLE) / max(p), 6) AS aupr FROM k {group}"""


@query("WITH z AS (SELECT d.lang, floor(n_chars / 500) AS score, quality AS pos FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL)" + _ROC.format(by="lang,", part="lang", group="GROUP BY lang"))
def auroc(spark, sf):
    docs, labels = tables.read(spark, sf, "documents"), tables.read(spark, sf, "labels").where("quality is not null")
    scores = docs.join(labels, "doc_id").select("lang", F.floor(F.col("n_chars") / 500).alias("score"), (F.col("quality") == 1).alias("positive"))
    return metrics.roc(scores, ["lang"]).select("lang", _r("auroc"), _r("fpr"), _r("aupr"))


@query(f"WITH {E}, p AS (SELECT * FROM q UNION ALL SELECT * FROM o), {_sims('p')}, z AS (SELECT (q_label > 7)::INT AS pos, round(1 - sim, 9) AS score FROM r WHERE rank = 1)" + _ROC.format(by="", part="1", group=""))
def ood_detection(spark, sf):
    _, g, q, o = _roles(spark, sf)
    near = similarity.nearest(q.unionByName(o), g).select((F.col("q_label") > 7).alias("positive"), F.round(1 - F.col("sim"), 9).alias("score"))
    return metrics.roc(near).select(_r("auroc"), _r("fpr"), _r("aupr"))


_FULL = f"""{WITH}, h AS (SELECT *, (q_label = g_label)::INT AS rel, sum((q_label = g_label)::INT) OVER (PARTITION BY q_id ORDER BY rank) AS seen FROM r),
y AS (SELECT q_id, q_label, avg(seen / rank::DOUBLE) FILTER (rel = 1) AS ap, 1.0::DOUBLE / min(rank) FILTER (rel = 1) AS mrr, max(rel) FILTER (rank <= 1) AS hit1, max(rel) FILTER (rank <= 5) AS hit5, max(rel) FILTER (rank <= 10) AS hit10,
avg(rel) FILTER (rank <= 5) AS purity5, coalesce(min(rank) FILTER (rel = 1), count(*) + 1) AS first_rank FROM h GROUP BY ALL)"""


@query(f"{_FULL} SELECT q_id, round(ap, 6) AS ap, round(mrr, 6) AS mrr, round(purity5, 6) AS purity5, first_rank FROM y")
def map_query(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    ranked = metrics.quality(similarity.relevant_quality(q, g))
    return ranked.select("q_id", _r("ap"), _r("mrr"), _r("purity5"), F.coalesce(F.col("first_rank").cast("long"), F.col("gallery") + 1).alias("first_rank"))


@query(f"{_FULL} SELECT round(avg(ap), 6) AS map, round(avg(mrr), 6) AS mrr, round(avg(hit1) FILTER (ap IS NOT NULL), 6) AS hit1, round(avg(hit5) FILTER (ap IS NOT NULL), 6) AS hit5, round(avg(hit10) FILTER (ap IS NOT NULL), 6) AS hit10, round(avg(purity5), 6) AS purity5, round(avg(first_rank), 6) AS mean_first_rank FROM y")
def retrieval_quality(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    y = metrics.quality(similarity.relevant_quality(q, g))
    some = lambda c: _r(F.avg(F.when(F.col("ap").isNotNull(), F.col(c))), c)
    return y.agg(_r(F.avg("ap"), "map"), _r(F.avg("mrr"), "mrr"), some("hit1"), some("hit5"), some("hit10"), _r(F.avg("purity5"), "purity5"), _r(F.avg(F.coalesce("first_rank", F.col("gallery") + 1)), "mean_first_rank"))


@query(f"{WITH} SELECT round(coalesce(avg(sim) FILTER (q_label = g_label), 0) - coalesce(avg(sim) FILTER (q_label <> g_label), 0), 6) AS gap FROM r WHERE rank = 1")
def similarity_gap(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("sim"))), F.lit(0.0))
    return similarity.nearest(q, g).agg(_r(mean(F.col("correct")) - mean(~F.col("correct")), "gap"))


@query("""WITH x AS (SELECT o_orderpriority AS g, o_totalprice::DOUBLE AS x, (o_orderkey % 7)::DOUBLE AS y FROM orders),
k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0::DOUBLE AS ry FROM x)
SELECT g, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY g""")
def spearman(spark, sf):
    rows = tables.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").cast("double").alias("x"), (F.col("o_orderkey") % 7).cast("double").alias("y"))
    return metrics.spearman(rows, "x", "y", ["g"]).select("g", "n", _r("rho"))


@query("""WITH p AS (SELECT c_mktsegment AS claim, c_custkey AS pair, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE round((c_custkey * 37 % 1000) / 20000.0::DOUBLE, 6) END AS p_value FROM customer),
k AS (SELECT *, least(1, (count(*) OVER (PARTITION BY claim) - row_number() OVER (PARTITION BY claim ORDER BY p_value, pair) + 1) * p_value) AS raw FROM p WHERE p_value IS NOT NULL)
SELECT claim, pair, round(max(raw) OVER (PARTITION BY claim ORDER BY p_value, pair), 6) AS p_holm FROM k UNION ALL SELECT claim, pair, NULL FROM p WHERE p_value IS NULL""")
def holm_adjust(spark, sf):
    p = F.when(F.col("c_custkey") % 9 != 0, F.round((F.col("c_custkey") * 37 % 1000) / 20000.0, 6))
    rows = tables.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("claim"), F.col("c_custkey").alias("pair"), p.alias("p_value"))
    return metrics.holm(rows, ["claim"]).select("claim", "pair", _r("p_holm"))


@query(f"{WITH} SELECT q_label, n, round(accuracy, 6) AS accuracy FROM ({_ACC}) ORDER BY accuracy, q_label LIMIT 5")
def hard_labels(spark, sf):
    _, g, q, _ = _roles(spark, sf)
    return metrics.per_label(similarity.nearest(q, g)).orderBy("accuracy", "q_label").limit(5).select("q_label", "n", _r("accuracy"))


# ---- sets and splits


@query("SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT DISTINCT p_name FROM part WHERE p_partkey % 3 = 0")
def label_intersect(spark, sf):
    part = tables.read(spark, sf, "part")
    return part.where("p_partkey % 2 = 0").select("p_name").intersect(part.where("p_partkey % 3 = 0").select("p_name"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 10)")
def label_except(spark, sf):
    part = tables.read(spark, sf, "part").select("p_partkey", "p_name")
    top = part.groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(10)
    return part.join(top, "p_name", "left_anti").select("p_partkey", "p_name")


@query("""WITH a AS (SELECT label FROM embeddings WHERE vec_id % 2 = 0 INTERSECT SELECT label FROM embeddings WHERE vec_id % 3 = 0)
SELECT side, label, count(*) AS n FROM (SELECT 'a' AS side, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'b', label FROM embeddings WHERE vec_id % 3 = 0) WHERE label IN (SELECT label FROM a) GROUP BY ALL""")
def common_label_semi(spark, sf):
    items = tables.read_embeddings(spark, sf).select("item_id", "label")
    a, b = items.where("item_id % 2 = 0"), items.where("item_id % 3 = 0")
    both = a.select("label").intersect(b.select("label"))
    sides = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    return sides.join(both, "label", "left_semi").groupBy("side", "label").agg(F.count("*").alias("n"))


_DONE = "(o_orderpriority LIKE '1%' OR (o_orderstatus = 'F' AND o_orderpriority < '4') OR o_orderkey % 10 < 3)"


@query(f"""WITH s AS (SELECT e.o_orderpriority AS part, e.o_orderstatus AS source, count(*) AS e, count(p.o_orderkey) AS p FROM orders e LEFT JOIN (SELECT o_orderkey FROM orders WHERE {_DONE}) p USING (o_orderkey) GROUP BY ALL),
c AS (SELECT part, count(*) AS sources, count(*) FILTER (e = p) AS found, sum(e)::BIGINT AS expected, sum(p)::BIGINT AS produced FROM s GROUP BY part) SELECT *, CASE WHEN found = sources THEN 'FOUND' WHEN found = 0 THEN 'MISSING' ELSE found || ' of ' || sources END AS status FROM c""")
def coverage_report(spark, sf):
    """What is produced of each part, and how many of its sources are whole."""
    orders = tables.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("part"), F.col("o_orderstatus").alias("source"))
    done = tables.read(spark, sf, "orders").where(_DONE).select("o_orderkey")
    return files.coverage(orders, done, "o_orderkey")


def _placed(by: str, seed: int = 42, source: str = "embeddings") -> str:
    keys = by.split(", ")
    text = " || ':' || ".join([f"'{seed}'", *(f"{k}::VARCHAR" for k in keys), "item_id::VARCHAR"])
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5({text})) AS place, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT vec_id AS item_id, label, 'src' || vec_id % 3 AS source FROM embeddings)"


@query(f"""SELECT item_id, label, CASE WHEN place <= a THEN 'train' WHEN place <= a + b THEN 'val' ELSE 'test' END AS split FROM (SELECT *, greatest(1, floor(0.65::DOUBLE * n)) AS a, greatest(0, floor(0.15::DOUBLE * n)) AS b FROM ({_placed('label, source')}))""")
def split_65_15_20(spark, sf):
    items = tables.read_embeddings(spark, sf).select("item_id", "label", F.concat(F.lit("src"), (F.col("item_id") % 3).cast("string")).alias("source"))
    return splits.train_val_test(items, ["label", "source"]).select("item_id", "label", "split")


@query(f"SELECT item_id, label, CASE WHEN place <= greatest(1, floor(0.8::DOUBLE * n)) THEN 'train' ELSE 'val' END AS split FROM ({_placed('label')})")
def split_80_20(spark, sf):
    return splits.two_way(tables.read_embeddings(spark, sf).select("item_id", "label"), ["label"], splits.part(0.8, 1), ("train", "val"))


@query(f"SELECT item_id, label, CASE WHEN place <= greatest(1, floor(0.05::DOUBLE * n)) THEN 'held' ELSE 'kept' END AS split FROM ({_placed('label')})")
def holdout_5pct(spark, sf):
    return splits.two_way(tables.read_embeddings(spark, sf).select("item_id", "label"), ["label"], splits.part(0.05, 1), ("held", "kept"))


@query(f"SELECT item_id, label, CASE WHEN place <= least(10, n // 2) THEN 'query' ELSE 'pool' END AS split FROM ({_placed('label')}) WHERE label > 7")
def split_query_pool(spark, sf):
    items = tables.ood_queries(tables.read_embeddings(spark, sf)).select("item_id", "label")
    return splits.two_way(items, ["label"], F.least(F.lit(10), F.floor(F.col("n") / 2)), ("query", "pool"))


@query(f"SELECT item_id, label, CASE WHEN place <= least(5, n - 1) THEN 'support' ELSE 'query' END AS split FROM ({_placed('label')}) WHERE n >= 2")
def split_support_query(spark, sf):
    items = splits.placed(tables.read_embeddings(spark, sf).select("item_id", "label"), ["label"]).where("n >= 2")
    return items.select("item_id", "label", F.when(F.col("place") <= F.least(F.lit(5), F.col("n") - 1), "support").otherwise("query").alias("split"))


@query(f"""SELECT split, count(*) AS items, count(DISTINCT label) AS labels, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM embeddings), 6) AS pct FROM (SELECT label, CASE WHEN place <= greatest(1, floor(0.8::DOUBLE * n)) THEN 'train' ELSE 'val' END AS split FROM ({_placed('label')})) GROUP BY split""")
def split_summary(spark, sf):
    rows = split_80_20(spark, sf)
    total = Window.partitionBy(F.lit(0))  # a row a split
    return rows.groupBy("split").agg(F.count("*").alias("items"), F.countDistinct("label").alias("labels")).withColumn("pct", F.round(100.0 * F.col("items") / F.sum("items").over(total), 6))
