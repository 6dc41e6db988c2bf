"""Small tables with the odd cases that every operator has to handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, node string, key string"

LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n\x0b\x0c\r", "en", "b"),
    (6, LONG, "de", "a"),
    (7, "don't stop <|endoftext|> now!!'s   x y\x1fz \U0001f600 é naïve", "fr", "c"),
    (8, "one two", "en", None),
    (9, "one two", "en", "c"),
    (10, f"first words here {PASSAGE} and then an end", "en", "c"),
    (11, f"other words there too {PASSAGE} with another ending", "en", "a"),
    (12, f"{PASSAGE}", "en", "a"),
    (13, "a a a a a a a a a a a a a a a a a a a a", "en", "a"),
    (14, "b a a a a a a a a a a a a a a a a a c", "en", "b"),
    (None, "a row without an id " + PASSAGE, "en", "a"),
    (15, "同じ 文章 が 二 回 同じ 文章 が 二 回", "ja", "z"),
]
ROWS = [(i, t, lang, source, len(t or ""), "row", "words", "node", "key") for i, t, lang, source in TEXTS]


def documents(spark, rows=ROWS, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
