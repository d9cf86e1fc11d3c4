"""Common passages, crowded keys and near copies, against plain sets."""

import itertools
import random
from collections import Counter

import brute
import pytest

from panelwright.llm import ngram_join as nj
from panelwright.llm.common import in_few, stored
from panelwright.llm.components import components

SCHEMA = "doc_id long, text string"


def words(draw, n):
    return [f"w{draw.randrange(10 ** 9)}" for _ in range(n)]


def with_passage(draw, passage, n):
    own = words(draw, n)
    at = draw.randrange(n + 1)
    return " ".join(own[:at] + passage + own[at:])


def edited(draw, text, n):
    parts = text.split(" ")
    for i in draw.sample(range(len(parts)), n):
        parts[i] = f"e{draw.randrange(10 ** 9)}"
    return " ".join(parts)


def found(spark, rows, **how):
    got = nj.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), **how).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


@pytest.fixture
def compared(monkeypatch):
    """Rows of all joins of pairs that are looked at."""
    seen = []
    similar = nj._similar
    monkeypatch.setattr(nj, "_similar", lambda pairs, *a: seen.append(pairs.count()) or similar(pairs, *a))
    return seen


@pytest.mark.parametrize("n, own", [(300, 90), (1500, 90), (300, 70), (900, 70), (300, 45)])
def test_a_shared_passage_makes_no_square(spark, compared, n, own):
    draw = random.Random(n + own)
    passage = words(draw, 300)
    rows = [(i, with_passage(draw, passage, own)) for i in range(n)]
    got = found(spark, rows)
    assert Counter(c for _, c in got.values()).most_common(1)[0][1] == 1
    assert sum(compared) <= 5 * n


def test_passages_and_copies_together(spark):
    draw = random.Random(11)
    passage, other = words(draw, 200), words(draw, 150)
    rows = []
    for own in (20, 25, 40, 60, 120, 250):
        rows += [with_passage(draw, passage, own) for _ in range(25)]
        rows += [with_passage(draw, other, own) for _ in range(10)]
    rows += [" ".join(passage), " ".join(passage[:190]), " ".join(passage[15:]), " ".join(passage + other)]
    for base in rows[3:150:12]:
        rows += [edited(draw, base, k) for k in (1, 2, 4, 6, 8, 11)]
    origin = " ".join(words(draw, 300))
    rows += [edited(draw, origin, draw.randrange(1, 14)) for _ in range(120)]
    short = " ".join(words(draw, 24))
    rows += [edited(draw, short, draw.randrange(2)) for _ in range(40)]
    rows += [" ".join(words(draw, 12) + short.split(" ")[:14]) for _ in range(40)]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute.classes(rows)
    for limit in (1, 3, 8, 10 ** 6):
        assert found(spark, rows, group_limit=limit) == want, limit


def test_sets_that_agree_in_empty_segments_only(spark, monkeypatch):
    """Indexed segments that are mostly empty lose no link."""
    draw = random.Random(5)
    rows = []
    for k in range(40):
        base = " ".join(words(draw, draw.randrange(50, 140)))
        rows += [base, edited(draw, base, draw.randrange(1, 4)), edited(draw, base, draw.randrange(1, 5))]
    rows = list(enumerate(rows))
    monkeypatch.setattr(nj, "plain_keys", lambda s, band: nj._signature(
        *[x[:0] for x in nj.segments(s, band)[:2]], band, 0))
    described = nj._described
    monkeypatch.setattr(nj, "_described", lambda *a: described(*a).selectExpr(
        "doc_id", "n_shingles", "rec", "key2", "cells",
        "transform(large, x -> named_struct('slot', x.slot, 'empty', 1000, 'slack', x.slack)) as large"))
    assert found(spark, rows) == brute.classes(rows)


def test_members_of_a_heavy_key_and_of_others(spark):
    rows = stored(spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id div 4 + 100 END AS key", "id AS rec", "1 AS slot"), "test-rows")
    count = Counter(r["key"] for r in rows.collect())
    found = nj._members(rows).collect()
    assert sorted((r["key"], r["rec"], r["slot"], r["sets"]) for r in found) == sorted(
        (r["key"], r["rec"], 1, count[r["key"]]) for r in rows.collect() if count[r["key"]] > 1)
    assert nj._members(rows.limit(0)).count() == 0


def mixes(draw, n):
    """Texts of five out of ten common passages each, of which no two are alike."""
    parts = [words(draw, 40) for _ in range(10)]
    chosen = draw.sample(list(itertools.combinations(range(10), 5)), n)
    return [" ".join(w for k in c for w in parts[k]) for c in chosen]


def test_crowded_groups_take_few_rounds(spark, monkeypatch):
    draw = random.Random(17)
    rows = mixes(draw, 90)
    rows += [edited(draw, rows[k], 2) for k in range(0, 90, 9)]
    rows = list(enumerate(rows))
    turns = []
    across = nj._across
    monkeypatch.setattr(nj, "_FIRST_LEADERS", 2)
    monkeypatch.setattr(nj, "_LEADERS", 4)
    monkeypatch.setattr(nj, "_across", lambda x, y: turns.append(1) or across(x, y))
    assert found(spark, rows) == brute.classes(rows)
    assert len(turns) <= 4
    monkeypatch.setattr(nj, "_ROUND_PAIRS", 1)
    monkeypatch.setattr(nj, "_LEADERS", 30)
    assert found(spark, rows) == brute.classes(rows)


def test_links_are_added_to_known_components(spark):
    draw = random.Random(23)
    links = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)]
    old = spark.createDataFrame(links[:50], "a long, b long")
    new = spark.createDataFrame(links[50:], "a long, b long")
    want = {r.rec: r.root for r in components(old.unionByName(new)).collect()}
    known = components(old)
    got = components(new, known).collect()
    assert len(got) == len({r.rec for r in got})
    assert {r.rec: r.root for r in got} == want
    assert sorted(components(old.limit(0), known).collect()) == sorted(known.collect())


def test_small_tables_are_written_in_few_files(spark):
    spread = spark.range(1000).repartition(16)
    assert in_few(spread, 1000).rdd.getNumPartitions() == 1
    assert in_few(spread, 1000, 100).rdd.getNumPartitions() == 10
    assert in_few(spread, 10 ** 9).rdd.getNumPartitions() == 16
    assert sorted(r.id for r in in_few(spread, 1000, 300).collect()) == list(range(1000))
