"""The rest of the inventory: names, guards, reports and protocols that compose what the other modules have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, vectors
from ..operators import metrics, openset, resampling, similarity, splits, statistics
from ..sources import tables
from .more import _ood
from .protocols import _BYSOURCE, _LOGITS, _SPACES, _TWO, label_table, logits, spaces, unchecked
from .queries import _FULL, _placed, _r, _roles, query

# ---- names


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) || ' var. ' || lower(split_part(p_type, ' ', 1)) ELSE lower(p_name) END AS name FROM part""")
def strip_authority(spark, sf):
    """Authors after a binomial or a variety go."""
    kind = F.lower(F.split("p_type", " ")[0])
    full = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("  Var. "), kind, F.lit(" (L.)"))).otherwise(F.concat("p_name", F.lit("\tMichx.")))
    return tables.read(spark, sf, "part").select("p_partkey", names.without_authority(full).alias("name"))


_LOCAL = {"red widget": "ruber artifex", "blue gizmo": "caeruleus artifex"}


@query("""SELECT p_partkey, CASE p_name WHEN 'red widget' THEN 'ruber artifex' WHEN 'blue gizmo' THEN 'caeruleus artifex' ELSE p_name END AS name FROM part""")
def apply_local_names(spark, sf):
    return tables.read(spark, sf, "part").select("p_partkey", names.replaced(F.col("p_name"), _LOCAL).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'grevillea robusta' WHEN 1 THEN 'cinnamomum camphora' ELSE p_name END AS name FROM part""")
def correct_spelling(spark, sf):
    kind = F.col("p_partkey") % 3
    given = F.when(kind == 0, "grevilea robusta").when(kind == 1, "cinnamomum czmphora").otherwise(F.col("p_name"))
    return tables.read(spark, sf, "part").select("p_partkey", names.replaced(given, names.SPELLING).alias("name"))


@query("""SELECT p_partkey, coalesce(d.to_name, p_name) AS name FROM part LEFT JOIN (SELECT p_brand, p_name, min(p_type) AS to_name FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL) d USING (p_brand, p_name)""")
def dialect_lookup(spark, sf):
    """A map of names by source."""
    part = tables.read(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    own = part.where("p_partkey % 4 = 0").groupBy("p_brand", "p_name").agg(F.min("p_type").alias("to_name"))
    return part.join(own, ["p_brand", "p_name"], "left").select("p_partkey", F.coalesce("to_name", "p_name").alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'quercus robur' WHEN 1 THEN p_name WHEN 2 THEN 'shorea sp' WHEN 3 THEN 'cordia alliodora' WHEN 4 THEN 'grevillea robusta' ELSE 'dab' END AS query,
CASE WHEN p_partkey % 6 = 2 THEN 'spp.' ELSE '' END AS variant, CASE p_partkey % 6 WHEN 0 THEN 'quercus robur' WHEN 1 THEN p_name WHEN 2 THEN 'shorea sp.' WHEN 3 THEN 'cordia alliodora' WHEN 4 THEN 'grevillea robusta' ELSE 'dab' END AS std FROM part""")
def preprocess_name(spark, sf):
    """Names as collections write them: marks, numbers, authors, vernacular of one source, local names, misspellings, open names."""
    kind, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    raw = F.when(kind.isin(0, 5), F.concat(key, F.lit("-Dąb"))).when(kind == 1, F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("_")), F.lit(" (L.) "), F.col("p_size").cast("string")))
    raw = raw.when(kind == 2, F.concat(F.lit("Shorea sp. "), key)).when(kind == 3, F.lit(" Nogal_cafetero\t")).otherwise(F.lit("Grevilea robusta R.Br."))
    return names.preprocessed(tables.read(spark, sf, "part"), raw, kind == 0).select("p_partkey", "query", "variant", "std")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY ALL""")
def sorted_exports(spark, sf):
    return tables.read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy("l_returnflag", "l_linestatus")


# ---- single measures of a ranking


def _ranked(spark, sf) -> DataFrame:
    _, g, q, _ = _roles(spark, sf)
    return metrics.quality(similarity.relevant_quality(q, g, depth=5))


@query(f"{_FULL} SELECT q_id, round(mrr, 6) AS mrr FROM y WHERE mrr IS NOT NULL")
def mrr_query(spark, sf):
    return _ranked(spark, sf).where("mrr is not null").select("q_id", _r("mrr"))


@query(f"{_FULL} SELECT q_id, hit1, hit5, hit10 FROM y")
def hit_at_k(spark, sf):
    return _ranked(spark, sf).select("q_id", "hit1", "hit5", "hit10")


@query(f"{_FULL} SELECT q_label, round(avg(purity5), 6) AS purity5 FROM y GROUP BY q_label")
def purity_at_5(spark, sf):
    return _ranked(spark, sf).groupBy("q_label").agg(_r(F.avg("purity5"), "purity5"))


# ---- comparisons and reports


@query(f"{_TWO} SELECT q_label, round(whole, 6) AS anchor, round(a, 6) AS other, round(whole - a, 6) AS delta FROM w WHERE whole IS NOT NULL AND a IS NOT NULL")
def paired_labels(spark, sf):
    return label_table(spark, sf).dropna().select("q_label", _r("whole", "anchor"), _r("a", "other"), _r(F.col("whole") - F.col("a"), "delta"))


@unchecked
def all_pairs_vs_anchor(spark, sf):
    """The whole space against each other space, label by label, with its test."""
    long = label_table(spark, sf).unpivot(["q_label", "whole"], ["a", "b"], "space", "other")
    return statistics.wilcoxon(long, ["space"], "whole", "other").select("space", "n", _r("statistic"), _r("p_value"))


@query("""SELECT o_orderpriority AS metric, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS std, round(min(x), 4) AS least, round(max(x), 4) AS most, count(*) AS n FROM (SELECT o_orderpriority, o_custkey % 10 AS rep, avg(o_totalprice::DOUBLE) AS x FROM orders GROUP BY ALL) GROUP BY 1""")
def run_summary(spark, sf):
    """Mean, spread and bounds of a metric over repeats."""
    x = tables.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_custkey") % 10).agg(F.avg(F.col("o_totalprice").cast("double")).alias("x"))
    four = lambda c, name: F.round(c, 4).alias(name)
    return x.groupBy("metric").agg(four(F.avg("x"), "mean"), four(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), "std"), four(F.min("x"), "least"), four(F.max("x"), "most"), F.count("*").alias("n"))


# ---- scores


def _rehearsal(spark, sf) -> DataFrame:
    """q_id, q_label, novel, and of the old and of the new labels the one of the greatest margin (old_label, new_label) with that margin
    (old, new), by a linear head on ten exemplars of each label."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    _, g, q, o = _roles(spark, sf)
    rows = lambda df: df.select("item_id", F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features"))
    kept = splits.placed(g.unionByName(o.where("item_id % 2 = 0")), ["label"]).where("place <= 10")
    model = LogisticRegression(maxIter=30, regParam=0.01, family="multinomial").fit(rows(kept))
    found = model.transform(rows(q.unionByName(o.where("item_id % 2 = 1")))).withColumn("raw", vector_to_array("rawPrediction"))
    last = tables.LAST_KNOWN + 1
    top = lambda x, first: F.array_max(F.transform(x, lambda m, i: F.struct(m.alias("m"), (i + first).alias("label"))))
    at = found.select(F.col("item_id").alias("q_id"), F.col("label").alias("q_label"), top(F.slice("raw", 1, last), 0).alias("a"), top(F.slice("raw", F.lit(last + 1), F.greatest(F.size("raw") - last, F.lit(0))), last).alias("b"))
    return at.select("q_id", "q_label", (F.col("q_label") >= last).alias("novel"), F.col("a.m").alias("old"), F.col("a.label").alias("old_label"), F.col("b.m").alias("new"), F.col("b.label").alias("new_label"))


def _shifted(rows: DataFrame) -> DataFrame:
    """rows with pred, the new labels' margins less gamma."""
    stays = F.col("new").isNull() | (F.col("old") >= F.col("new") - F.col("gamma"))
    return rows.withColumn("pred", F.when(stays, F.col("old_label")).otherwise(F.col("new_label")).cast("double"))


@unchecked
def rehearsal_head(spark, sf):
    """A linear head on ten exemplars of each old and new label, tested on both."""
    return metrics.macro(_shifted(_rehearsal(spark, sf).withColumn("gamma", F.lit(0.0))), ["novel"]).select("novel", _r("macro"))


@unchecked
def rehearsal_calibrated(spark, sf):
    """The same head with the new labels' margins shifted by what balances old and new accuracy on half of the test rows, tested on the
    others. A row's part in all shifts is summed in its task."""
    rows = _rehearsal(spark, sf).withColumn("cal", F.col("q_id") % 4 == 1)
    shifts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(240)), lambda k: k * 0.25 - 30))
    tried = _shifted(rows.where("cal").withColumn("gamma", shifts))
    rate = lambda c: F.avg(F.when(c, (F.col("pred") == F.col("q_label")).cast("int")))
    balance = tried.groupBy("gamma").agg(F.sqrt(rate(~F.col("novel")) * rate(F.col("novel"))).alias("balance"))
    best = balance.orderBy(F.desc(F.round("balance", 9)), F.abs("gamma"), "gamma").limit(1).select("gamma")
    tested = _shifted(rows.where("not cal").crossJoin(F.broadcast(best)))  # one row
    return metrics.macro(tested, ["novel"]).select("novel", _r("macro"))


@unchecked
def diverse_subset(spark, sf):
    """At most eight rows of each label and source: all of a small group, the nearest to each of eight k-means centres of a larger one."""
    items = tables.read_embeddings(spark, sf).withColumn("source", F.col("item_id") % 3)
    return openset.diverse(items, ["label", "source"], 8).select("item_id", "label", "source")


# ---- open-set protocols

@query(f"""{_BYSOURCE}, z AS (SELECT a.source, b.pos, b.score FROM (SELECT DISTINCT source FROM s0 WHERE pos = 1) a, s0 b WHERE b.pos = 0 OR b.source = a.source), c AS (SELECT source, score, sum(pos)::BIGINT AS pos, sum(1 - pos)::BIGINT AS neg FROM z GROUP BY ALL),
k AS (SELECT *, sum(neg) OVER (PARTITION BY source ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY source) AS p, sum(neg) OVER (PARTITION BY source) AS n FROM c) SELECT source, round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / max(p) / max(n), 6) AS auroc FROM k GROUP BY source""")
def ood_by_source(spark, sf):
    """Each source's novel rows against all known ones. Known scores are counted before they are repeated for each source."""
    near = _ood(spark, sf).withColumn("source", F.concat(F.lit("src"), (F.col("q_id") % 3).cast("string")))
    novel = near.where("positive").select("source", "positive", "score")
    sources = novel.select("source").distinct().agg(F.collect_set("source").alias("sources"))  # a row
    known = near.where("not positive").crossJoin(F.broadcast(sources)).select(F.explode("sources").alias("source"), "positive", "score")
    return metrics.roc(novel.unionByName(known), ["source"]).select("source", _r("auroc"))


@query(f"""{_SPACES}, s AS (SELECT q.space, q.item_id, (q.label > 7)::INT AS pos, round(1 - max(list_dot_product(q.v, g.v) / (q.l * g.l)), 9) AS score FROM n q JOIN n g ON q.space = g.space AND g.item_id % 2 = 0 AND g.label <= 7 AND (q.label > 7 OR q.item_id % 2 = 1) WHERE q.space <> 'B' GROUP BY ALL),
{resampling.sql_counts("(SELECT *, item_id AS q_id FROM s)", "space", 2000)},
c AS (SELECT space, b, score, sum(w * pos)::BIGINT AS pos, sum(w * (1 - pos))::BIGINT AS neg FROM z GROUP BY ALL), k AS (SELECT *, sum(pos) OVER (PARTITION BY space, b ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY space, b ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY space, b) AS p, sum(neg) OVER (PARTITION BY space, b) AS n FROM c),
f AS (SELECT space, b, min(fp) FILTER (tp >= 0.95::DOUBLE * p) / max(n)::DOUBLE AS fpr FROM k GROUP BY ALL), x AS (SELECT b, max(fpr) FILTER (space = 'A') - max(fpr) FILTER (space = 'Full') AS d FROM f GROUP BY b)
SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS ci_lo, round(quantile_cont(d, 0.975), 6) AS ci_hi FROM x""")
def bootstrap_fpr_diff(spark, sf):
    """Half the space against the whole, the same draws for both."""
    out = None
    for name, s in spaces(tables.read_embeddings(spark, sf)).items():
        if name != "B":
            near = similarity.nearest(tables.id_queries(s).unionByName(tables.ood_queries(s)), tables.gallery(s))
            one = near.select(F.lit(name).alias("space"), "q_id", (F.col("q_label") > 7).cast("int").alias("pos"), F.round(1 - F.col("sim"), 9).alias("score"))
            out = one if out is None else out.unionByName(one)
    wide = resampling.curves(out, ["space"], 2000).groupBy("b").pivot("space", ["A", "Full"]).agg(F.max("fpr"))
    d = wide.select((F.col("A") - F.col("Full")).alias("d"))
    return d.agg(_r(F.avg("d"), "mean"), _r(F.percentile("d", F.lit(0.025)), "ci_lo"), _r(F.percentile("d", F.lit(0.975)), "ci_hi"))


# ---- further compositions


@query(f"{_LOGITS} SELECT q_id, round(1 - 1 / s, 6) AS msp FROM t")
def msp_score(spark, sf):
    return logits(spark, sf).select("q_id", _r(vectors.one_minus_top_softmax("x"), "msp"))


@query(f"SELECT item_id, label, place <= greatest(1, floor(0.65::DOUBLE * n)) AS in_train FROM ({_placed('label, source')})")
def split_train_65(spark, sf):
    items = tables.read_embeddings(spark, sf).select("item_id", "label", F.concat(F.lit("src"), (F.col("item_id") % 3).cast("string")).alias("source"))
    return splits.placed(items, ["label", "source"]).select("item_id", "label", (F.col("place") <= splits.part(0.65, 1)).alias("in_train"))


@unchecked
def claim_table(spark, sf):
    """Each claim with both means, their difference, its test, the step-down p and an interval of the first mean."""
    wide = label_table(spark, sf)
    long = wide.unpivot(["q_label", "whole"], ["a", "b"], "space", "other")
    means = long.groupBy("space").agg(F.avg("whole").alias("mean"), F.avg("other").alias("other_mean"))
    tests = metrics.holm(statistics.wilcoxon(long, ["space"], "whole", "other").withColumn("family", F.lit("spaces")), ["family"], order="space")
    ci = statistics.mean_interval(wide.select(F.lit("all").alias("g"), "q_label", "whole"), ["g"], "whole", ["q_label"], 5000)
    rows = means.join(tests, "space").crossJoin(F.broadcast(ci.select("ci_lo", "ci_hi")))  # one row
    return rows.select("space", _r("mean"), _r("other_mean"), _r(F.col("mean") - F.col("other_mean"), "delta"), _r("p_value"), _r("p_holm"), _r("ci_lo"), _r("ci_hi"))


@unchecked
def incremental_baselines(spark, sf):
    """Old and new accuracy of the exemplar means, of the rehearsal head and of the calibrated head, a row each."""
    from .more import exemplar_mean_classifier

    out = exemplar_mean_classifier(spark, sf).withColumn("variant", F.lit("exemplar mean"))
    for name, f in (("rehearsal head", rehearsal_head), ("calibrated head", rehearsal_calibrated)):
        out = out.unionByName(f(spark, sf).withColumn("variant", F.lit(name)))
    return out
