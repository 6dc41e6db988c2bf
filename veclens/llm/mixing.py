"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Each source's documents are laid out in a hashed order as one line of words; the line is repeated as often as its target asks for and cut
into blocks of equal words. The blocks that each source owes are an exact quota. A binary tree over the output shards splits the quotas:
at each node the left half draws its blocks from the node's without replacement, source by source. A shard then owns disjoint runs of
each source's permuted blocks, and orders its documents by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, staged

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
BLOCK_WORDS, SHARD_BLOCKS = 16_384, 64
#: Documents of a source that are laid out together, about.
RUN_DOCS = 512
SALTS = 64
#: Runs, or copies, that are handled together.
STRETCH = 1024
#: Rounds of a source's permutation; nodes of the tree from which on it grows in parallel.
SWAPS, WIDE = 32, 256


def sizes(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """doc_id, source, print, copies, size: rows with one doc_id and source are one document, their sizes added.

    by_text: so are only rows that share their text as well; print is its hash, and 0 otherwise.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    print_ = F.xxhash64("text") if by_text else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", print_.alias("print"), size.alias("size"))
    return rows.groupBy("doc_id", "source", "print").agg(F.count("*").alias("copies"), F.sum("size").alias("size"))


def _key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """key, place, docs, source_size, weight, target of each source, a row each: a table as long as the mix has components.

    Sources by code point, null last, take the weights in turn. Sharing out what capped sources leave until none is above its cap has
    one end: target = least(cap * size, level * weight). In order of cap * size / weight the capped ones come first, and the level is
    the greatest of (total - capped before) / (weight from here on).
    """
    rows = sized.groupBy(_key().alias("key")).agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("key").like("0%"), "key")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", turn.cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    above, below = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(above), F.lit(0))
    level = F.max("level").over(every)
    return rows.withColumn("level", left / F.sum("weight").over(below)).withColumn("target", F.least((cap * F.col("source_size")).cast("double"), level * F.col("weight"))).drop("level")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def _hypergeometric(n: Column, q: Column, total: Column, u: Column) -> Column:
    """Of n draws without replacement from `total`, how many fall on q marked: the inverse of the distribution at u.

    Weights follow from their ratios, over all values within 12 standard deviations and 6 of the mean; what lies beyond is less than a
    double can tell from nothing.
    """
    mean = n * q / total
    sd = F.sqrt(F.greatest(mean * (1 - q / total) * (total - n) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    low = F.greatest(F.lit(0), n - (total - q), F.floor(mean - 12 * sd - 6)).cast("long")
    high = F.least(q, n, F.ceil(mean + 12 * sd + 6)).cast("long")
    steps = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    grown = lambda w, k: w * (q - k) * (n - k) / ((k + 1) * (total - q - n + k + 1))

    def add(acc: Column, k: Column) -> Column:
        w = grown(acc["w"], k)
        return F.struct(w.alias("w"), (acc["s"] + w).alias("s"))

    def find(acc: Column, k: Column) -> Column:
        w = grown(acc["w"], k)
        return F.struct(w.alias("w"), (acc["s"] + w).alias("s"), acc["goal"].alias("goal"), F.when(acc["s"] < acc["goal"], k + 1).otherwise(acc["at"]).alias("at"))

    one = F.lit(1.0)
    goal = u * F.aggregate(steps, F.struct(one.alias("w"), one.alias("s")), add)["s"]
    return F.when(total <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.struct(one.alias("w"), one.alias("s"), goal.alias("goal"), low.alias("at")), find)["at"])


def _shuffled(x: Column, n: Column, *seed: Column) -> Column:
    """x among 0..n-1 under a fixed permutation: each round swaps x with its mirror about a keyed place where a hash of the two says so.

    Every place is worked out by itself, so that no order of all places has to be made anywhere.
    """

    def swap(at: Column, turn: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*seed, turn), n) - at, n)
        return F.when(F.xxhash64(*seed, turn, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SWAPS - 1)), x, swap)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """shard, quotas, starts: the node table (quotas array<bigint>, one row) split among `shards` shards, a level of the tree at a time.

    starts: how many blocks of each source the shards before have. The tree is dealt out once it has WIDE nodes.
    """
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quotas", F.transform("quotas", lambda _: F.lit(0).cast("long")).alias("starts"))
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if 1 << level == WIDE:
            nodes = nodes.repartition(WIDE, "lo")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        n_left = F.floor(total * (mid - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).cast("long")

        def draw(acc: Column, q: Column) -> Column:
            x = _hypergeometric(acc["n"], q, acc["total"], _uniform(F.lit(seed), F.col("lo"), F.col("hi"), F.size(acc["taken"])))
            return F.struct((acc["n"] - x).alias("n"), (acc["total"] - q).alias("total"), F.concat(acc["taken"], F.array(x)).alias("taken"))

        start = F.struct(n_left.alias("n"), total.alias("total"), F.array().cast("array<bigint>").alias("taken"))
        cut = nodes.select("lo", "hi", "quotas", "starts", mid.alias("mid"), F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("quotas", start, draw)["taken"]).alias("left"))
        right, after = F.zip_with("quotas", "left", lambda q, x: q - x), F.zip_with("starts", "left", lambda q, x: q + x)
        halves = F.array(
            F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("left").alias("quotas"), F.col("starts")), F.struct(F.col("mid").alias("lo"), F.col("hi"), right.alias("quotas"), after.alias("starts"))
        )
        whole = F.array(F.struct("lo", "hi", "quotas", "starts"))
        nodes = cut.select(F.explode(F.when(F.col("left").isNull(), whole).otherwise(halves)).alias("x")).select("x.*")
    return nodes.select(F.col("lo").alias("shard"), "quotas", "starts")


def draws(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, by_text: bool = False) -> DataFrame:
    """doc_id, source, print, copies, size, source_size, target, pass, words, shard, position: each use of a document in the mix, and one
    row with null pass and no words for each document that the mix leaves out.

    A document is used at most `cap` times; where a source's target ends inside a document, its last use is cut to the words that are
    left, so that a source's words add up to its target, rounded. A null text has size 0; an empty table gives no rows; a null source is
    a source of its own; rows that repeat a doc_id and source (by_text: and text) are one document; equal seeds give equal mixes. Only
    doc_id, source and text are read.
    """
    sized = staged(sizes(docs, by_text), "sizes").withColumn("key", _key())
    goals = targets(sized.drop("key"), weights, cap).withColumn("goal", F.round("target").cast("long"))
    # written, as is the owner of each block, so that no plan holds the windows over sources four times, nor the tree beside the joins
    goals = staged(goals.withColumns({"runs": F.ceil(F.col("docs") / RUN_DOCS).cast("long"), "quota": F.ceil(F.col("goal") / block_words).cast("long")}), "goals")
    shards = max(1, math.ceil((goals.agg(F.sum("quota")).first()[0] or 0) / shard_blocks))

    # the line of each source: runs of a hashed order, then places within a run
    at = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("key"), F.col("print"))
    # a hot source is joined in SALTS parts
    salted = goals.select("key", "source_size", "target", "goal", "runs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lined = sized.withColumn("at", at).withColumn("salt", F.pmod("at", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
    lined = lined.withColumn("run", F.least(F.floor((F.col("at") / float(1 << 64) + 0.5) * F.col("runs")), F.col("runs") - 1))
    # runs are added up in stretches, so that no window holds all runs of a source
    upto = lambda *keys, by: F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = lined.groupBy("key", "run").agg(F.sum("size").alias("words")).withColumn("stretch", F.floor(F.col("run") / STRETCH))
    stretches = runs.groupBy("key", "stretch").agg(F.sum("words").alias("words")).select("key", "stretch", upto("key", by="stretch").alias("before"))
    runs = runs.withColumn("within", upto("key", "stretch", by="run")).join(stretches, ["key", "stretch"]).select("key", "run", (F.col("before") + F.col("within")).alias("run_start"))
    inside = Window.partitionBy("key", "run").orderBy("at", "doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    lined = lined.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(runs, ["key", "run"])
    lined = lined.withColumn("start", F.col("run_start") + F.col("inside"))

    start = lambda p: F.col("start") + p * F.col("source_size")
    words = lambda p: F.least(F.col("size"), F.col("goal") - start(p))
    uses = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda p: F.struct(p.alias("pass"), words(p).alias("words"), F.floor(start(p) / block_words).alias("block"))), lambda x: x["words"] > 0)
    used = lined.select("doc_id", "source", "key", "print", "copies", "size", "source_size", "target", F.explode_outer(uses).alias("u")).select("*", "u.*").drop("u")

    # the tree gives each shard its number of blocks of each source; a source's permuted blocks are dealt in runs
    order = goals.select("key", "quota", "place")
    quotas = order.groupBy().agg(F.sort_array(F.collect_list(F.struct("place", "quota"))).alias("q")).select(F.transform("q", lambda x: x["quota"]).alias("quotas"))
    leaves = split_quotas(quotas, shards, seed).select("shard", F.posexplode(F.arrays_zip("quotas", "starts")).alias("place", "n")).where("n.quotas > 0")
    dealt = leaves.join(order, "place").select("key", "quota", "shard", F.explode(F.sequence(F.col("n.starts"), F.col("n.starts") + F.col("n.quotas") - 1)).alias("rank"))
    owner = staged(dealt.select("key", _shuffled(F.col("rank"), F.col("quota"), F.lit(seed + 1), F.col("key")).alias("block"), "shard"), "owner")

    out = used.join(owner, ["key", "block"], "left")
    local = Window.partitionBy("shard", F.when(F.col("shard").isNull(), F.pmod(F.xxhash64("doc_id"), F.lit(4096)))).orderBy(F.xxhash64(F.lit(seed + 2), F.col("doc_id"), F.col("key"), F.col("print"), F.col("pass")), "doc_id", "print", "pass")
    position = F.when(F.col("shard").isNotNull(), F.row_number().over(local) - 1)
    return out.select("doc_id", "source", "print", "copies", "size", "source_size", "target", "pass", F.coalesce("words", F.lit(0)).cast("long").alias("words"), "shard", position.alias("position"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each use of a document as a row of docs, with mix_pass, mix_words, mix_shard, mix_position and mix_copy beside its columns.

    mix_words tells how many of a text's words, from its first, that use takes; only a source's last use may be cut. Rows that share
    doc_id, source and text are one document of several copies: a use has a row for each, told apart by mix_copy, and the columns of one
    of them stand for all. Rows that share an id alone are documents of their own. A null or empty text has no words and is not in the
    mix; a null doc_id or source is kept; an empty table gives no rows. Columns of docs by the names of the new ones give way.
    """
    # keys without nulls, so that one exchange serves the grouping and the join
    mark = {"__id": F.coalesce(F.col("doc_id"), F.lit(0)), "__none": F.col("doc_id").isNull(), "__key": _key(), "__print": F.col("print")}
    uses = draws(docs, by_text=True, **options).where("shard is not null")
    uses = uses.select(*(c.alias(n) for n, c in mark.items()), (F.col("size") / F.col("copies")).cast("long").alias("one"), *(F.col(c).alias(f"mix_{c}") for c in ("pass", "words", "shard", "position")))
    uses = staged(uses, "uses")  # without texts; so the plan of what places the uses isn't beside that of the texts' joins
    rows = docs.where("text is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("print"))
    new = ["mix_pass", "mix_words", "mix_shard", "mix_position", "mix_copy"]
    own = {f"__own{i}": c for i, c in enumerate(docs.columns) if c not in new}
    rows = rows.groupBy(*(c.alias(n) for n, c in mark.items())).agg(F.first("row").alias("row")).select(*mark, *(F.col("row")[c].alias(n) for n, c in own.items()))
    joined = rows.join(uses, list(mark)).withColumn("rows", F.ceil(F.col("mix_words") / F.col("one")))
    some = joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / STRETCH))))
    each = some.withColumn("mix_copy", F.explode(F.sequence(F.col("part") * STRETCH, F.least(F.col("part") * STRETCH + STRETCH, "rows") - 1)))
    each = each.withColumn("mix_words", F.least("one", F.col("mix_words") - F.col("mix_copy") * F.col("one")))
    return each.select(*(F.col(n).alias(c) for n, c in own.items()), *new)
