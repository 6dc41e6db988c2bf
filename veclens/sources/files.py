"""Reading and writing of files, and guards that fail where tables don't fit together."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for files in between: under spark.checkpoint.dir, which all executors share; a session without a cluster may leave it
    unset and gets a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/veclens-{name}-{uuid.uuid4().hex}"


def write_results(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv", "json", "parquet")) -> dict[str, str]:
    """Writes a table of results in each format; format -> its folder. CSV has a header."""
    paths = {f: f"{path}/{f}" for f in formats}
    for f, p in paths.items():
        df.write.mode("overwrite").options(**({"header": "true"} if f == "csv" else {})).format(f).save(p)
    return paths


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, by a stated schema: no pass over the data guesses it."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)


def with_prefixes(columns: list[str], prefixes: tuple[str, ...]) -> list[str]:
    return [c for c in columns if c.startswith(prefixes)]


def result_rows(df: DataFrame, column: str) -> DataFrame:
    """df's other columns with method, metric, value of result texts: a list of objects that name their method, or an object of methods;
    each metric a number, or an object with its mean. What is neither, is left out."""
    listed = F.from_json(column, "array<map<string,string>>")
    named = F.transform(listed, lambda m: F.struct(m["method"].alias("method"), F.map_filter(m, lambda k, _: k != "method").alias("metrics")))
    keyed = F.transform(F.map_entries(F.from_json(column, "map<string,map<string,string>>")), lambda e: F.struct(e["key"].alias("method"), e["value"].alias("metrics")))
    each = F.when(F.ltrim(column).startswith("["), named).otherwise(keyed)
    rows = df.select(*(c for c in df.columns if c != column), F.explode(each).alias("r")).select("*", F.explode("r.metrics").alias("metric", "text"))
    value = F.coalesce(F.expr("try_cast(text as double)"), F.expr("try_cast(get_json_object(text, '$.mean') as double)"))
    return rows.select(*(c for c in df.columns if c != column), F.col("r.method").alias("method"), "metric", value.alias("value")).where("value is not null")


def path_part(path: Column | str, place: int) -> Column:
    """A part of a path, counted from its end: -1 is the file's name."""
    return F.element_at(F.split(path, "/"), place)


def image_files(lists: Column, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")) -> Column:
    """The image paths of a list that is kept in one text cell as `['a', 'b']`."""
    found = F.transform(F.regexp_extract_all(lists, F.lit("'([^']*)'"), F.lit(1)), lambda x: x)
    return F.filter(found, lambda p: F.lower(p).rlike(rf"\.({'|'.join(extensions)})$"))


def require_disjoint(a: DataFrame, b: DataFrame, key: str, what: str) -> None:
    """Fails, with up to five of them, where a and b share keys."""
    shared = [r[0] for r in a.select(key).intersect(b.select(key)).orderBy(key).limit(5).collect()]
    if shared:
        raise ValueError(f"{what} share labels, such as {shared}")


def require_aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The join of a and b by key; fails where a row of either has no partner or two."""
    sides = a.groupBy(key).agg(F.count("*").alias("a")).join(b.groupBy(key).agg(F.count("*").alias("b")), key, "full")
    odd = sides.where("coalesce(a, 0) <> 1 or coalesce(b, 0) <> 1")
    if n := odd.count():
        raise ValueError(f"{n} keys don't stand once on either side")
    return a.join(b, key)


def scoped(gallery: DataFrame, scope: str, known: DataFrame | None = None, least: int = 1) -> DataFrame:
    """The gallery of a scope: full, ce_train (rows that in_train marks), or id_only (labels of `known`); an unknown scope, or fewer than
    `least` labels in the first two, fails."""
    names = {"full": "full", "full_swi": "full", "all": "full", "ce_train": "ce_train", "ce_train_only": "ce_train", "id_only": "id_only", "id": "id_only"}
    if scope not in names:
        raise ValueError(f"no gallery scope {scope!r}")
    if names[scope] == "id_only":
        return gallery.join(known.select("label").distinct(), "label", "left_semi")
    out = gallery if names[scope] == "full" else gallery.where("in_train")
    if (n := out.agg(F.count_distinct("label")).first()[0]) < least:
        raise ValueError(f"{n} labels in scope {scope!r}, fewer than {least}")
    return out


#: A manifest: split -> list of [path, label].
MANIFEST = "map<string,array<array<string>>>"


def manifest_items(texts: DataFrame, column: str = "value") -> DataFrame:
    """texts' other columns with split, pos, path, label: a row for each item of the nested lists of a manifest, in the order of its list.

    texts: a manifest a row; more rows are more parts of it. An entry that isn't a pair of path and label fails, as does a text that is no
    manifest; a null or empty list has no items.
    """
    parsed = texts.withColumn("splits", F.from_json(column, MANIFEST, {"mode": "FAILFAST"}))
    lists = parsed.select(*(c for c in texts.columns if c != column), F.explode("splits").alias("split", "items"))
    each = lists.select("*", F.posexplode("items").alias("pos", "item")).drop("items")
    label = F.when(F.size("item") == 2, F.col("item")[1]).otherwise(F.raise_error(F.lit("an item of a manifest is a pair of path and label")))
    return each.select(*(c for c in each.columns if c != "item"), F.col("item")[0].alias("path"), label.cast("string").alias("label"))


def manifest_counts(items: DataFrame) -> DataFrame:
    """split, images, paths, labels: items, and different paths and labels, of each split."""
    return items.groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("path").alias("paths"), F.count_distinct("label").alias("labels"))


def coverage(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """part, sources, found, expected, produced, status of each part: which of the sources it is put together from have all their rows.

    expected: part, source, key; produced: key. FOUND: all sources, MISSING: none, else `n of m`. Keys that are produced repeatedly count once;
    those that nobody expects don't count.
    """
    done = produced.select(key).distinct().withColumn("done", F.lit(1))
    each = expected.join(done, key, "left").groupBy("part", "source").agg(F.count("*").alias("e"), F.count("done").alias("p"))
    rows = each.groupBy("part").agg(F.count("*").alias("sources"), F.count_if(F.col("e") == F.col("p")).alias("found"), F.sum("e").alias("expected"), F.sum("p").alias("produced"))
    some = F.concat(F.col("found").cast("string"), F.lit(" of "), F.col("sources").cast("string"))
    return rows.withColumn("status", F.when(F.col("found") == F.col("sources"), "FOUND").when(F.col("found") == 0, "MISSING").otherwise(some))
