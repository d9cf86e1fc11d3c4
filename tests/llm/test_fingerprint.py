import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import fingerprint as fp


def shingled(text, length=fp.LENGTH):
    return {text[i:i + length] for i in range(max(1, len(text) - length + 1))} if text else set()


def brute(rows):
    """(doc_id, n_chars, edited text, next text) of rows (doc_id, text) by plain sorting."""
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (doc, text) in enumerate(ordered):
        after, half = ordered[(i + 1) % len(ordered)][1], len(text) // 2
        out.append((doc, text, text[:len(text) - half] + after[:half], after))
    return out


def check(got, want):
    assert len(got) == len(want)
    by = {r.doc_id: r for r in got}
    for doc, text, edited, after in want:
        r = by[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), doc
        mine, other, nxt = (fp.sketch(t) for t in (text, edited, after))
        assert r.fingerprint == fp.encoded(mine) and r.edited_fingerprint == fp.encoded(other)
        assert (r.near_edited, r.kept_in_edited) == fp.compared(mine, other)[:2]
        assert (r.near_next, r.kept_in_next) == fp.compared(mine, nxt)[:2]


@pytest.fixture(scope="module")
def single(rows):
    """One row an id, NULL text and NULL id among them, ids beyond 2^53 next to each other."""
    first = {r[0]: (r[0], r[1]) for r in reversed(rows)}
    first |= {2 ** 60 + k: (2 ** 60 + k, f"far away text number {k}") for k in range(3)}
    return list(first.values())


def test_next_likeness(spark, single):
    docs = spark.createDataFrame(single, "doc_id long, text string").withColumn(
        "part", F.lit("clash")).withColumn("key", F.lit(1)).repartition(5)
    check(fp.next_likeness(docs).collect(), brute(single))


def test_rows_that_share_an_id_are_split_and_keep_their_order(spark):
    rows = [(7, f"text number {k} of a common id") for k in range(300)] + [(None, f"no id {k}") for k in range(200)]
    rows += [(k, f"own id {k}") for k in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fp.next_likeness(docs).collect()
    assert len(got) == len(rows)
    tie = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1]]))
    want = []
    for i, (doc, text) in enumerate(ordered):
        after, half = ordered[(i + 1) % len(ordered)][1], len(text) // 2
        want.append((doc, hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted((d or -1, h) for d, h in want)
    parts = fp._placed(docs, 8).groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < len(rows) // 2


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")
    check(fp.next_likeness(one).collect(), brute([(3, "abcdef")]))
    assert fp.next_likeness(one.limit(0)).count() == 0
    two = spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string")
    assert {(r.near_edited, r.near_next, r.fingerprint) for r in fp.next_likeness(two).collect()} == {(1.0, 1.0, "")}


def test_sketch_holds_what_lies_below_the_threshold(single):
    for _, text in single:
        hashes = set(map(int, fp.shingle_hashes(text or "")))
        assert len(hashes) == len(shingled(text or ""))
        held = {h for h in hashes if h <= (2 ** 64 - 1) // fp.SCALE}
        assert set(map(int, fp.sketch(text or ""))) == (held or ({min(hashes)} if hashes else set()))


def test_estimates_follow_the_texts(rows):
    a, b = next(r[1] for r in rows if r[1] and len(r[1]) > 60_000), rows[12][1]
    whole = a + " " + b
    share = fp.compared(fp.sketch(b), fp.sketch(whole))[1]
    assert share > 0.95
    exact = len(shingled(a[:50_000]) & shingled(a[25_000:])) / len(shingled(a[:50_000]) | shingled(a[25_000:]))
    assert abs(fp.compared(fp.sketch(a[:50_000]), fp.sketch(a[25_000:]))[0] - exact) < 0.05


def test_merged_sketches_tell_containment(spark, docs, rows):
    prints = docs.select("source", fp.fingerprint_of("text").alias("fingerprint"))
    merged = fp.merged(prints, "source")
    got = {}
    for r in merged.collect():
        got.setdefault(r.group, set()).add(r.hash)
    most = np.uint64((2 ** 64 - 1) // fp.SCALE)
    for source, hashes in got.items():
        texts = [t or "" for _, t, _, s, _ in rows if s == source]
        want = set().union(*[{int(h) for h in fp.sketch(t) if h <= most} for t in texts])
        assert {h for h in hashes} == want
    s1, every = merged.filter("group = 's1'"), merged
    shares = {r.group: r for r in fp.share_held(every, s1).collect()}
    assert shares["s1"].share == 1.0 and shares["s2"].share < 1.0
    assert shares["s2"].n_hashes == len(got["s2"])


def test_likeness_column(spark):
    texts = spark.createDataFrame([("abcdefghij klmnop", "abcdefghij klmnop"), (None, "x"), (None, None)],
                                  "a string, b string")
    got = texts.select(fp.likeness_of(fp.fingerprint_of("a"), fp.fingerprint_of("b")).alias("l")).collect()
    assert [r.l.resemblance for r in got] == [1.0, 0.0, 1.0]
