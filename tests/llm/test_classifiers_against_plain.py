"""The classifiers' arithmetic against plain versions of it."""

import math
import random
import re

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tests.llm.cases import ROWS, documents
from veclens.llm import langid, secrets, toxicity


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network(rng, 5)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    for side in "fb":
        net.p[f"c{side}"] = rng.standard_normal(net.p[f"c{side}"].shape) * 0.1
    x = rng.standard_normal((6, 4, toxicity.WORD_DIM + toxicity.GRAM_DIM))
    size, label = np.array([6, 3, 1, 5]), np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        logit = net.run({s: x @ net.p[f"x{s}"] + net.p[f"c{s}"] for s in "fb"}, size).astype(float)
        return float(np.mean(np.log1p(np.exp(logit)) - label * logit))

    given, dx = net.gradient(x, size, label)
    for name, values, grad in [*((k, v, given[k]) for k, v in net.p.items() if k not in ("word", "gram")), ("x", x, dx)]:
        flat = values.reshape(-1)
        for i in rng.choice(flat.size, min(12, flat.size), replace=False):
            kept, step = flat[i], 1e-2
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * step) - grad.reshape(-1)[i]) < 1e-4, name


def test_sizes_against_plain_compression(spark):
    rng = random.Random(4)
    tongues = {"aa": ["thal", "merin", "osk", "dunver"], "bb": ["quiro", "fenta", "zubal", "hik"], "cc": ["thal", "fenta", "mur", "osk"]}
    text = lambda lang, n: " ".join(rng.choice(tongues[lang]) + rng.choice(tongues[lang]) for _ in range(n))
    learned = langid.learn(documents(spark, [(i, text(lang, 60), lang, "a", 0, "", "", "", "") for i, lang in enumerate(["aa", "bb", "cc"] * 20)]))
    rows = [*ROWS, *((1000 + i, text(rng.choice("abc") * 2, rng.choice([1, 5, 1200])), None, None, 0, "", "", "", "") for i in range(60))]
    model = [(r.lang, r.data.encode()) for r in learned.orderBy("place").collect()]
    got = {(r.doc_id, round(r.score, 9), r.lang_pred, r.accepted) for r in langid.predict(documents(spark, rows), learned).collect()}
    want = set()
    for doc_id, given, *_ in rows:
        raw = langid.plain(given or "")
        if not raw:
            want.add((doc_id, 0.0, "und", False))
            continue
        sizes = []
        for _, data in model:
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(raw[k : k + langid.CHUNK])) for k in range(0, len(raw), langid.CHUNK)))
        low, after = sorted(sizes)[:2]
        share = 1 / math.fsum(2.0 ** max(low - s, -1000) for s in sizes)
        want.add((doc_id, round(share, 9), model[sizes.index(low)][0], after - low >= max(langid.MARGIN * low, 1)))
    assert got == want


def test_features_against_plain_counts(spark):
    runs = ["0123456789abcdef0123456789abcdef", "AKIA" + "Q7W2" * 4, "riverStoneGarden42windowX", "a" * 20, "Zm9vYmFyYmF6cXV4eA==", "x_y-z+" * 4]
    texts = [f'see {lead}{r}{tail} now' for r in runs for lead, tail in (("", ""), ('token="', '"'), ("commit ", ""), ("/srv/app/", ".json"), ("sha1: ", ""))]
    words = ["river", "stone", "garden", "window"]
    docs = documents(spark, [(i, t, "en", "a", 0, "", "", "", "") for i, t in enumerate(texts)])
    got = {(r.doc_id, r.place, r.nth): r for r in secrets.candidates(docs, words).collect()}
    seen = 0
    for i, t in enumerate(texts):
        for place, word in enumerate(t.split()):
            for nth, run in enumerate(re.findall(secrets.RUN, word)):
                r, n = got[(i, place, nth)], len(run)
                seen += 1
                share = lambda ok: sum(map(ok, run)) / n
                kind = lambda c: "d" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else ""
                pairs = [kind(a) + kind(b) for a, b in zip(run, run[1:])]
                left, low = run.lower(), 0
                while low < len(left):  # dictionary words, from the left
                    hit = max((w for w in words if left.startswith(w, low)), key=len, default="")
                    left, low = left[:low] + left[low + len(hit) :], low + (not hit)
                want = {
                    "run": run,
                    "n_chars": n,
                    "digits": share(str.isdigit),
                    "capitals": share(str.isupper),
                    "smalls": share(str.islower),
                    "marks": share("+/_=.-".__contains__),
                    "changes": sum(p in ("Ud", "ld", "dU", "dl", "lU", "Ul") for p in pairs) / n,
                    "distinct": len(set(run)) / min(n, 40),
                    "clusters": len(re.findall("(?i)[bcdfghjklmnpqrstvwxz]{4,}", run)) / n,
                    "hex": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", run))),
                    "covered": 1 - len(left) / n,
                    "quoted": float('"' in word),
                    "named": float("token" in t),
                    "digest": float("commit" in t or "sha1" in t),
                }
                assert {k: r[k] if k == "run" else round(r[k], 9) for k in want} == {k: v if k == "run" else round(v, 9) for k, v in want.items()}, (t, run)
    assert seen == len(got) >= len(texts) - 5
    assert {r.path for (i, *_), r in got.items() if "/srv/" in texts[i]} == {1.0}
    assert secrets.candidates(docs.where(F.lit(False)), words).count() == 0
