import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, limit):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    found = []
    for item, ts in wanted.items():
        scores = []
        for doc, c in counted:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // total if n else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        for rank, (score, known, doc) in enumerate(sorted(scores)[:limit], 1):
            found.append((item, rank, doc if known else None, -score))
    return found


@pytest.fixture(scope="module")
def cases(rows):
    draw = random.Random(2)
    docs = [(r[0], r[1]) for r in rows]
    docs += [(5000 + k, text) for k, text in enumerate([
        "Naïve café\x00tail", "ÉCOLE école ecole", "日本語 テスト", "a_b-c'd", "x" * 50_000, "İstanbul ISTANBUL",
        " lead", "trail ", "\x7fdel\x80ctl", "the " * 30_000])]
    docs += [(9_000_000_000_000_000_001, "naïve the x"), (None, "naïve the x")]
    items = [(1, "one TWO a"), (2, "the naïve École"), (3, ""), (4, None), (None, "words ISTANBUL"),
             (5, "日本語 tail c d"), (5, "lead\x80 trail"), (6, "nothing-of-this-kind qqqq"),
             (2 ** 60, " ".join(draw.choice(terms(rows[14][1])) for _ in range(40)))]
    return docs, items


def _frames(spark, cases):
    docs = spark.createDataFrame(cases[0], "doc_id long, text string").withColumn(
        "item", F.lit("clash")).withColumn("score", F.lit(1)).repartition(4)
    return docs, spark.createDataFrame(cases[1], "item_id long, text string").withColumn(
        "terms", F.lit("clash"))


@pytest.mark.parametrize("limit, block", [(50, 16 << 20), (3, 16 << 20), (7, 300)])
def test_search(spark, cases, limit, block):
    got = lexical.search(*_frames(spark, cases), limit=limit, block_bytes=block).collect()
    key = repr
    assert sorted(map(tuple, got), key=key) == sorted(brute(*cases, limit), key=key)


def test_best_rows_are_kept_in_small_steps(spark, cases, monkeypatch):
    best = lexical._Best(2, 2)
    import numpy as np
    draw = random.Random(1)
    every = []
    for k in range(60):
        score = np.array([[draw.randrange(4), draw.randrange(3)]])
        best.offer(score, np.array([1]), np.array([k]))
        best.settle()
        every += [(i, -int(score[0, i]), k) for i in range(2) if score[0, i]]
    item, score, _, ids = best.settle()
    want = [x for i in range(2) for x in sorted(e for e in every if e[0] == i)[:2]]
    assert sorted(zip(item.tolist(), (-score).tolist(), ids.tolist())) == sorted(want)


def test_nothing(spark, cases):
    docs, items = _frames(spark, cases)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items.filter("text is null")).count() == 0
