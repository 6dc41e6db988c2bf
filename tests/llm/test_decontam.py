import random
import re

import pytest

from tests.llm.cases import ROWS, documents, empty
from veclens.llm import decontam


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
        best = row
    return best[-1]


def test_common_words():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        assert decontam.common_words(a, b) == lcs(a, b)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_leaks(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = [f"wort{i}" for i in range(400)] + ["the", "of", "and"] * 60
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(15, 55)))) for i in range(20)] + [(50, None), (51, ""), (52, "  "), (None, " ".join(text(20)))]
    rows, want = list(ROWS), set()
    for i in range(1000, 1080):
        words = text(rng.randrange(5, 300))
        if i % 4 == 0:
            key, item = items[rng.randrange(20)]
            item = item.split()
            if i % 8 == 0:  # a paraphrase: an eighth of the words are others, marks are added
                item = [rng.choice(vocabulary) if rng.random() < 0.12 else w.upper() + "," for w in item]
            at = rng.randrange(len(words))
            words[at:at] = item
            want.add((i, key))
        rows.append((i, " ".join(words), "en", "a", 0, "", "", "", ""))
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = decontam.find_leaks(documents(spark, rows), benchmark, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    by_id = {r[0]: re.findall(r"\S+", r[1] or "") for r in rows}
    for r in got:
        assert 0.6 <= r.common <= 1 and r.first_word + r.n_words <= len(by_id[r.doc_id])
    if block_bytes > 1500:
        assert decontam.find_leaks(empty(spark), benchmark).count() == 0
        assert decontam.find_leaks(documents(spark), benchmark.limit(0)).count() == 0
