"""Secret scans: long runs of key-like characters, judged by a random forest, in DataFrame functions and Spark's own forest only.

Every run of LEAST or more characters is a candidate, however many a word holds; `=` belongs to it only as padding at its end, and key
parts that dots separate, as those of a web token, are one candidate. Its features are its length, its character classes and the transitions between them,
how much of it dictionary words cover, whether it looks like a path, and the words before it. The forest learns from labelled findings;
where no labels are given, clear cases label themselves: a known key format or a value assigned to a secret's name, against runs of
dictionary words, numbers and digests.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, staged

LEAST = 16
_CHAR, _PAD = r"[A-Za-z0-9+/_\-]", r"(?![A-Za-z0-9+/_=\-])"
#: A web token with all its parts; a run with others behind dots, or padded; a run that has LEAST characters with its padding only.
RUN = (
    rf"(?:eyJ{_CHAR}{{{LEAST - 3},}}(?:\.{_CHAR}*){{0,3}}\.{_CHAR}+|{_CHAR}{{{LEAST},}}(?:(?:\.{_CHAR}+){{0,3}}\.{_CHAR}{{{LEAST},}})?(?:={{1,2}}{_PAD})?"
    rf"|{_CHAR}{{{LEAST - 1}}}={{1,2}}{_PAD}|{_CHAR}{{{LEAST - 2}}}=={_PAD})"
)
NAMES = r"(?i)(token|secret|passw|pwd|api|key|auth|bearer|credential)"
DIGESTS = r"(?i)(commit|sha|hash|md5|digest|checksum|uuid|build|version|etag)"
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_](live|test)?[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[A-Za-z0-9_\-]{20,})"
FEATURES = ("n_chars", "digits", "capitals", "smalls", "marks", "changes", "distinct", "clusters", "hex", "covered", "path", "quoted", "named", "assigned", "digest")
#: Labelled findings of each class that the forest learns from at most; words of the dictionary.
CLASS_ROWS, DICT_WORDS = 2000, 1000
#: Characters before and behind a run that tell whether it is part of a path, or which name of several it belongs to.
AROUND = 200
TREES, DEPTH, SEED = 24, 6, 5
THRESHOLD = 0.5
MASK = "[SECRET]"


def dictionary(docs: DataFrame, words: int = DICT_WORDS) -> list[str]:
    """The most frequent words of four to twelve letters in all documents."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,12}"), F.lit(0))).alias("word")
    top = docs.select(word).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return sorted(r.word for r in top.collect())


def _any_of(words: list[str]) -> str:
    """A pattern of any of the words, the longest that is there, each letter of a common beginning looked at once."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [letter + pattern(node[letter]) for letter in sorted(node) if letter]
        return "" if not ways else f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return pattern(tree) or r"\b\B"


def _share(chars: str) -> Column:
    """Part of the run that a character class makes up."""
    return F.regexp_count("run", F.lit(chars)) / F.char_length("run")


def candidates(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, print, place, nth, run and the features of each candidate; print: hash of the text, so that (doc_id, print) tells texts apart.

    place: the word's; nth: the run's in its word, both from 0. A run's name stands between the run before it in its word and itself, or
    is that run; for the first run the two words before count as well.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text").where(F.col("text").rlike(RUN))
    split = texts.select("doc_id", "print", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
    around = lambda w, i: F.struct(i.alias("place"), w.alias("word"), F.get("words", i - 1).alias("before"), F.get("words", i - 2).alias("earlier"))
    found = split.select("doc_id", "print", F.explode(F.filter(F.transform("words", around), lambda x: x["word"].rlike(RUN))).alias("c")).select("doc_id", "print", "c.*")
    runs, gaps = F.regexp_extract_all("word", F.lit(RUN), F.lit(0)), F.split("word", RUN, -1)
    one = lambda r, i: F.struct(i.alias("nth"), r.alias("run"), F.get("gaps", i).alias("gap"), F.get("gaps", i + 1).alias("after"), F.coalesce(F.get("runs", i - 1), F.lit("")).alias("last"))
    found = found.withColumns({"runs": runs, "gaps": gaps}).select("doc_id", "print", "place", "before", "earlier", F.explode(F.transform("runs", one)).alias("r")).select("doc_id", "print", "place", "before", "earlier", "r.*")
    head = F.right(F.concat("last", "gap"), F.lit(AROUND))
    name = F.regexp_extract(head, r"[^,;&{}\[\]|]*$", 0)
    lone = (F.col("nth") == 0) & ((name == F.col("gap")) | ~name.rlike("[A-Za-z0-9]"))
    near = F.when(lone, F.concat_ws(" ", "earlier", "before", "gap")).otherwise(name)
    cut = r"[^\"'`,;&{}\[\]()<>|=]*"
    piece = F.concat(F.regexp_extract(head, cut + "$", 0), "run", F.regexp_extract(F.left("after", F.lit(AROUND)), "^" + cut, 0))
    known = _any_of(words)
    flag = lambda c: c.cast("double")
    return (
        found.withColumns({"near": near, "piece": piece})
        .select(
            "doc_id",
            "print",
            "place",
            "nth",
            "run",
            F.char_length("run").cast("double").alias("n_chars"),
            _share("[0-9]").alias("digits"),
            _share("[A-Z]").alias("capitals"),
            _share("[a-z]").alias("smalls"),
            _share(r"[+/_=.\-]").alias("marks"),
            _share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])").alias("changes"),
            (F.size(F.array_distinct(F.split("run", ""))) / F.least(F.char_length("run"), F.lit(40))).alias("distinct"),
            _share("(?i)[bcdfghjklmnpqrstvwxz]{4,}").alias("clusters"),
            flag(F.col("run").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
            (1 - F.char_length(F.regexp_replace(F.lower("run"), known, "")) / F.char_length("run")).alias("covered"),
            flag(F.col("piece").rlike(r"://|^[./~]|(/[^/]*){2}|\.[a-z]{2,4}$")).alias("path"),
            flag(F.concat("gap", "after").rlike("[\"'`]")).alias("quoted"),
            flag(F.col("near").rlike(NAMES)).alias("named"),
            flag(F.col("near").rlike(r"(=|:|=>)[\"'`\W]*$")).alias("assigned"),
            flag(F.col("near").rlike(DIGESTS)).alias("digest"),
        )
    )


def own_labels(found: DataFrame) -> DataFrame:
    """label 1, 0 or null of candidates whose case is clear by itself."""
    key = F.col("run").rlike(FORMATS) | ((F.col("named") + F.col("assigned") == 2) & (F.col("digits") > 0) & (F.col("covered") < 0.5) & (F.col("digest") == 0))
    plain = (F.col("covered") >= 0.6) | (F.col("digits") >= 0.95) | (F.col("digits") == 0) | (F.col("digest") + F.col("path") > 0)
    return found.withColumn("label", F.when(key, 1.0).when(plain & (F.col("named") + F.col("assigned") < 2), 0.0))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, print, place, nth, run, probability, is_secret of every candidate in every whole text. place: the word's place, nth: the
    run's in the word, from 0.

    labelled: findings with the columns FEATURES and label; else candidates of docs that label themselves. At most CLASS_ROWS of each
    class are learned from, the first by a hash. Where only one class is there, candidates are judged by their own labels alone. A null
    text has no candidates; repeated rows share their findings; a null doc_id is kept; only doc_id and text are read; an empty table
    gives no rows.
    """
    found = staged(candidates(docs, dictionary(docs)), "candidates")
    rows = own_labels(found) if labelled is None else labelled
    order = F.xxhash64(*(["run", "place", "nth"] if labelled is None else list(FEATURES)))
    parts = [rows.where(F.col("label") == k).select("label", *FEATURES, order.alias("h")).orderBy("h", *FEATURES).limit(CLASS_ROWS) for k in (0.0, 1.0)]
    learned = staged(parts[0].unionByName(parts[1]), "findings")
    if learned.select("label").distinct().count() < 2:
        return own_labels(found).select("doc_id", "print", "place", "nth", "run", F.coalesce("label", F.lit(0.0)).alias("probability"), (F.coalesce("label", F.lit(0.0)) > 0).alias("is_secret"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors.transform(learned.repartition(1).sortWithinPartitions("label", "h")))
    judged = forest.transform(vectors.transform(found)).withColumn("probability", vector_to_array("probability")[1])
    return judged.select("doc_id", "print", "place", "nth", "run", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each secret in text replaced by MASK, and n_chars, where there is such a column, counted anew; no row goes.

    Null and empty texts stay as they are; repeated rows are masked alike; a null doc_id is kept; an empty table stays empty. Other
    columns, whatever their names, are left alone.
    """
    own = scan(docs, labelled, threshold).where("is_secret").groupBy(F.col("doc_id").alias("its_id"), F.col("print").alias("its_print"))
    secrets = own.agg(F.sort_array(F.collect_set(F.struct(F.char_length("run").alias("n"), "run")), asc=False).alias("secrets"))  # a text's own, longest first
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("print"))
    joined = rows.join(secrets, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("print") == F.col("its_print")), "left")
    text = F.when(F.col("secrets").isNull(), F.col("text")).otherwise(F.aggregate("secrets", F.col("text"), lambda t, s: F.replace(t, s["run"], F.lit(MASK))))
    kind = dict(docs.dtypes)
    new = {"text": text, "n_chars": F.when(F.col("secrets").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length(text)).cast(kind["n_chars"]) if "n_chars" in kind else None}
    return joined.select(*(new[c].alias(c) if new.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns))
