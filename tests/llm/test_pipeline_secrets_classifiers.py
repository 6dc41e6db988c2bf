import random
import re
import string
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import ROWS, SCHEMA, documents, empty
from veclens.llm import langid, secrets, toxicity

VOCABULARY = ["river", "stone", "window", "letter", "garden", "market", "summer", "bridge", "number", "silver", "carpet", "doctor"] + [f"wort{c}{d}" for c in "abcdefgh" for d in "aeiou"]


def prose(rng, n=80):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_secrets(spark):
    rng = random.Random(8)
    rows, planted = list(ROWS), {}
    for i in range(1000, 1160):
        words = prose(rng)
        if i % 4 == 0:
            key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            words[10:10] = ["token", "=", f'"{key}"']
            planted[i] = key
        elif i % 4 == 1:
            words[5:5] = ["".join(rng.choice(string.digits) for _ in range(16)), "rivergardenbridgesummer"]
        elif i % 4 == 2:
            words[5:5] = ["commit", "".join(rng.choice("0123456789abcdef") for _ in range(40))]
        rows.append((i, " ".join(words), "en", "a", 0, "", "", "", ""))
    rows.append(rows[-4])
    docs = documents(spark, rows)
    found = secrets.scan(docs).where("is_secret").collect()
    assert {(r.doc_id, r.run) for r in found} == set(planted.items())
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).count() == len(rows) and secrets.redact(docs).columns == docs.columns
    for i, text, *_ in rows:
        assert out[i].text == (text.replace(planted[i], secrets.MASK) if i in planted else text)
    assert secrets.scan(empty(spark)).count() == 0
    assert secrets.scan(documents(spark)).where("is_secret").count() == 0


def test_every_secret_of_a_word(spark):
    rng = random.Random(18)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    both, digit = string.ascii_letters + string.digits, string.digits
    rows, planted = [], {}
    for i in range(1000, 1240):
        words, kind = prose(rng), i % 8
        a, b = pick("0123456789abcdef", 40), "AKIA" + pick(string.ascii_uppercase + digit, 16)
        jwt = ".".join(["eyJ" + pick(both, 30), "eyJ" + pick(both, 60), pick(both, 43)])
        word, own = [
            (f'{{"path":"/srv/apps/reports/2024","key":"{b}"}}', [b]),
            (f"?token={a}&page=2&secret={b}", [a, b]),
            (f"API_KEY={a}", [a]),
            (f"AWS_SECRET_ACCESS_KEY={a}", [a]),
            (jwt, [jwt]),
            (f'{{"api_secret_access_key":"{a}","commit":"{pick("0123456789abcdef", 40)}"}}', [a]),
            ("rivergardenbridgesummer " + pick(digit, 16), []),
            ("commit " + pick("0123456789abcdef", 40), []),
        ][kind]
        words.insert(10, word)
        planted[i] = set(own)
        rows.append((i, " ".join(words), "en", "a", 0, "", "", "", ""))
    docs = documents(spark, rows)
    seen = {}
    for r in secrets.scan(docs).where("is_secret").collect():
        assert r.place == 10
        seen.setdefault(r.doc_id, set()).add(r.run)
    assert seen == {i: own for i, own in planted.items() if own}
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, text, *_ in rows:
        for key in planted[i]:
            text = text.replace(key, secrets.MASK)
        assert out[i] == text


def test_a_forest_of_labelled_findings(spark):
    """Findings whose labels only context tells: a forest learns them on one half and tells them on the other, whatever the rules would say."""
    rng = random.Random(28)
    rows, truth = [], {}
    for i in range(1000, 1400):
        words, run = prose(rng, 30), "".join(rng.choice("0123456789abcdef") for _ in range(32))
        words[10:10] = [f"cache/objects/{run}", "kept"] if i % 2 else ["session", f'"{run}"', "kept"]
        rows.append((i, " ".join(words), "en", "a", 0, "", "", "", ""))
        truth[i] = (run, i % 2 == 0)
    first, second = (documents(spark, [r for r in rows if r[0] // 2 % 2 == k]) for k in (0, 1))
    found = secrets.candidates(first, secrets.dictionary(first))
    mine = {r.doc_id: r for r in found.where("run rlike '[0-9a-f]{32}'").collect()}
    assert all(r.path == (i % 2) and r.quoted == (1 - i % 2) and r.assigned == 0 for i, r in mine.items())
    labels = spark.createDataFrame([(i, float(t)) for i, (_, t) in truth.items()], "own long, label double")
    labelled = found.where("run rlike '[0-9a-f]{32}'").join(labels, F.col("own") == F.col("doc_id")).select(*secrets.FEATURES, "label")
    got = [r for r in secrets.scan(second, labelled).collect() if truth[r.doc_id][0] in r.run]
    assert len(got) == 200 and all(0 <= r.probability <= 1 and r.is_secret == (r.probability >= secrets.THRESHOLD) for r in got)
    assert sum(r.is_secret == truth[r.doc_id][1] for r in got) == 200


def test_runs():
    found = lambda word: re.findall(secrets.RUN, word)
    assert found("a" * 15) == [] and found("a" * 14 + "==") == ["a" * 14 + "=="] and found("a" * 16 + "=b") == ["a" * 16]
    assert found("x=" + "a" * 20 + "==,y=" + "b" * 17) == ["a" * 20 + "==", "b" * 17]
    assert found("a" * 24 + ".abcdef." + "b" * 27 + ".com") == ["a" * 24 + ".abcdef." + "b" * 27]


def test_language(spark):
    rng = random.Random(3)
    tongues = {"aa": ["thal", "merin", "osk", "dunver", "pelly"], "bb": ["quiro", "fenta", "zubal", "hik", "wosmer"]}
    rows = list(ROWS)
    for i in range(1000, 1200):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(rng.choice(tongues[lang]) + rng.choice(tongues[lang]) for _ in range(rng.randrange(4, 900))), lang, "a", 0, "", "", "", ""))
    train = documents(spark, [r for r in rows if r[0] is not None and r[0] % 5])
    got = langid.predict(documents(spark, rows), langid.learn(train)).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if (r.doc_id or 0) >= 1000 and r.doc_id % 5 == 0]
    assert len(unseen) == 40 and all(r.lang_pred == ("aa", "bb")[r.doc_id % 2] for r in unseen)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.predict(documents(spark), langid.learn(empty(spark))).collect()} == {"und"}
    assert langid.predict(empty(spark), langid.learn(empty(spark))).count() == 0
    model = langid.learn(train)
    one, two = (sorted((r.doc_id or 0, r.lang_pred, round(r.score, 9), r.accepted) for r in langid.predict(documents(spark, rows[:60]), model, block=b).collect()) for b in (1, 2))
    assert one == two
    # a row that a third of the table repeats counts once, and a text's end teaches as much as its beginning
    hot = [(1, "thal merin", "aa")] * 300 + [(2, "osk " * 3000 + "dunver " * 3000, "aa"), (3, "quiro", "bb")]
    (a, b) = langid.learn(spark.createDataFrame(hot, "doc_id long, text string, lang string"), dict_bytes=400).orderBy("place").collect()
    assert a.data.count("merin") == 1 and {"osk", "dunver"} <= set(a.data.split()) and len(a.data) <= 400 and b.data == "quiro"


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = list(ROWS), [(3, 1), (None, 1), (1, None)]
    for i in range(1000, 1500):
        words = prose(rng, rng.randrange(5, 200))
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grumbolt", "fizzwick", "snarvel"]))
        rows.append((i, " ".join(words), "en", "a", 0, "", "", "", ""))
        labels.append((i, int(i % 3 == 0)))
    marked = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 as text")
    docs = documents(spark, rows)
    got = toxicity.score_texts(docs, toxicity.learn(docs, marked)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if (r.doc_id or 0) >= 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 90 and sum(r.predicted == (r.doc_id % 3 == 0) for r in held) > 0.97 * len(held)
    assert all(r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert toxicity.learn(docs, marked.limit(0)) is None
    assert toxicity.learn(documents(spark, [rows[30]] * 400 + rows[31:34]), marked) is not None
    assert {r.score for r in toxicity.score_texts(docs, None).collect()} == {0.0}


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    item = " ".join(rng.choice(VOCABULARY) for _ in range(30))
    rows = list(ROWS)
    base = [f"{a}{b}" for a in VOCABULARY for b in ("x", "y", "z", "q")]
    text = lambda n: [rng.choice(base) for _ in range(n)]
    for i in range(1000, 1060):
        rows.append((i, " ".join(text(120)), "en", ("a", "b")[i % 2], 0, "", "", "", ""))
    rows.append((2000, rows[-1][1] + " end", "en", "a", 0, "", "", "", ""))
    rows.append((2001, rows[-1][1], "en", "b", 0, "", "", "", ""))
    rows.append((2002, " ".join(text(40) + [item] + text(40)), "en", "b", 0, "", "", "", ""))
    for i in range(2003, 2013):
        rows.append((i, " ".join(text(60) + ["token", "=", '"0123456789abcdef0123456789abcdef01234567"'] + text(40)), "en", ("a", "b")[i % 2], 0, "", "", "", ""))
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {2000, 2001, 2002} and len(ids & set(range(1000, 1060))) > 40
    assert all(r.mix_words > 0 for r in out)
    assert all("0123456789abcdef" not in r.text for r in out) and len(ids & set(range(2003, 2013))) > 3 and all("[SECRET]" in r.text for r in out if r.doc_id in range(2003, 2013))
    clash = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows[:20] + rows[-10:]], f"{SCHEMA}, once int, run int, print int, h int, mix_words int")
    for name, table in (("clash", clash), ("none", clash.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert set(clash.columns) < set(out.columns) and (out.count() > 0) == (name == "clash")
