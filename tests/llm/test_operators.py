"""Each operator against a plain statement of its result, on rows with every odd case."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

import brute
from panelwright.llm import (
    attention, decontaminate, language_id, license_scan, line_dedup, lm_scoring, ngram_join, packing,
    quality_rules, sharding, url_filters,
)
from panelwright.llm.queries import RULES


def test_quality_counts_and_verdicts(docs, rows):
    got = quality_rules.quality(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *brute.quality_counts(r[1])) for r in rows)
    assert Counter((r.doc_id, *[r[c] for c in quality_rules.COUNTS]) for r in got) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    texts = dict((r[0], r[1]) for r in rows)
    verdict = {r.doc_id: r.kept for r in got}
    assert not any(verdict[i] for i, t in texts.items() if t and t.startswith(("spam", "# *")))


def test_quality_filter_keeps_rows_whole(docs, rows, nothing):
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    good = Counter(r.doc_id for r in quality_rules.quality(docs).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == good
    assert quality_rules.quality(nothing).count() == 0


def test_buckets_are_monotonous(spark):
    low = spark.range(0, 20_000).select("id", quality_rules.bucket("id").alias("b")).select(
        "id", "b", quality_rules.bucket_low(F.col("b")).alias("low")).orderBy("id").collect()
    assert all(x.b <= y.b for x, y in zip(low, low[1:]))
    assert all(r.low <= r.id <= r.low * 33 / 32 + 1 for r in low)


def test_near_duplicates(docs, rows, nothing):
    got = ngram_join.near_duplicates(docs, group_limit=6)
    want = brute.classes({r[0]: (r[0], r[1]) for r in rows if r[0] is not None}.values())
    found = got.collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {
        (i, n, c) for i, (n, c) in want.items()}
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_one_of_each(docs, rows):
    want = brute.classes({r[0]: (r[0], r[1]) for r in rows if r[0] is not None}.values())
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(i for i in ids if i is not None) == Counter(i for i, (_, c) in want.items() if i == c)


def test_bands_cover_all_partners():
    for size in range(4, 3000):
        for partner in range(-(-4 * size // 5), size):
            own = {b.number for b in ngram_join.bands_of(size)}
            other = ngram_join.bands_of(partner)
            if other:
                assert other[0].number in own
                differ = (size + partner) // 9
                assert other[0].differ >= differ


def test_shards_are_even_and_keep_groups(docs, rows, nothing):
    got = sharding.sharded(docs, 5).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    groups = defaultdict(set)
    for r in got:
        if r.text_crc32:
            groups[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.sharded(nothing, 5).count() == 0


def test_a_group_beyond_a_quota_is_cut_at_quotas_only(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(900)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 9).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes.values()) == {100}
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) <= 4


@pytest.mark.parametrize("groups", [10, 90])
def test_units_are_cut_at_quota_ends_only(spark, groups):
    """Groups that fill all of 20,000 rows: units are whole but for one cut a shard."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("text "), (F.col("id") % groups).cast("string")).alias("text"))
    got = sharding.sharded(docs, 24)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 1
    part = max(sizes) // 8
    n = F.count("*").over(Window.partitionBy("text_crc32"))
    chunk = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.ceil(n / part))
    units = got.withColumn("chunk", chunk).groupBy("text_crc32", "chunk").agg(
        F.count_distinct("shard").alias("n")).agg(F.count("*"), F.sum("n")).head()
    assert units[1] <= units[0] + 23


def test_line_dedup(docs, rows, nothing):
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest())
                   for i, n, d, t in brute.kept_lines([r[:2] for r in rows]))
    got = line_dedup.kept_lines(docs, batches=3, fan_in=2)
    assert Counter((r.doc_id, r._n_lines, r._n_dropped, hashlib.sha256(r._kept.encode()).hexdigest())
                   for r in got.select("doc_id", "_n_lines", "_n_dropped", "_kept").collect()) == want
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in out.select("text", "n_chars").collect())
    assert line_dedup.kept_lines(nothing).count() == 0


def test_line_runs_leave_no_tables(docs, spark):
    line_dedup.kept_lines(docs, batches=2).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.fixture(scope="module")
def urls(spark):
    return [None, "", "no scheme", "http://", "https://org", "https://org/", "http://A.Example.ORG/es/x",
            "http://example.org/es", "http://example.org/en/1", "http://example.org/en/2?x=/es/",
            "http://badexample.org/es/", "x://com/fr/1", "x://com/de/#a", "x://COM/de", "a://b://c/d",
            "http://x.com/de/1", "http://x.com/de/1", "ftp://h?q#f", "http://x.net:80/fr/"]


@pytest.mark.parametrize("max_bits", [1 << 16, 0])
def test_url_filters(spark, urls, max_bits):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn(
        "verdict", F.lit(1)).withColumn("html", F.lit(""))
    got = url_filters.judge_urls(pages, RULES, max_bits=max_bits).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {
        i: brute.url_rule(u, RULES) for i, u in enumerate(urls)}
    assert len(got) == len(urls)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge_urls(empty, RULES).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.pmod(F.xxhash64("key"), F.lit(9)) == 0)
    cascade = url_filters.build_cascade(listed, universe, bits_per_key=4, hashes=2)
    assert len(cascade.levels) > 2
    found = universe.filter(cascade.contains(F.col("key")))
    assert found.exceptAll(listed).count() == 0 and listed.exceptAll(found).count() == 0


def test_cascade_follows_the_list_not_the_universe(spark):
    universe = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.col("key").isin([f"k{i}" for i in range(5)]))
    cascade = url_filters.build_cascade(listed, universe, max_bits=1 << 10)
    assert cascade is not None
    found = universe.filter(cascade.contains(F.col("key")))
    assert {r.key for r in found.collect()} == {f"k{i}" for i in range(5)}


def test_language_id(spark, docs, nothing):
    draw = np.random.default_rng(1)
    parts = {"en": "the and ing tion ent", "de": "der und sch keit ung", "fr": "les eau eux ment que",
             "es": "los cion mente ado que"}
    rows = [(k * 4 + j, " ".join(draw.choice(v.split(), 40)), lang)
            for j, (lang, v) in enumerate(parts.items()) for k in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(labelled.filter("doc_id % 5 > 0"), sample_rows=120)
    got = language_id.identify(labelled, model, ["doc_id", "lang"]).filter("doc_id % 5 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = language_id.identify(docs, model, ["doc_id", "text"]).collect()
    for r in odd:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language_id.train(nothing) is None
    assert {r.lang_pred for r in language_id.identify(docs, None, ["doc_id"]).collect()} == {"und"}
    one = language_id.train(labelled.filter("lang = 'de'"))
    assert {r.lang_pred for r in language_id.identify(labelled, one, ["doc_id"]).collect()} == {"de"}


def test_packing_round_trip(docs, rows, nothing, tokenizer):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer)
    got = packing.pack_documents(docs, tokenizer, window=256, with_ids=True).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for i, t in {(r[0], r[1]) for r in rows}:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        copies = sum(1 for r in rows if (r[0], r[1]) == (i, t))
        pieces = Counter((r.start, bytes(r.ids)) for r in by_doc[i, len(ids)])
        raw = np.array(ids, "<u4")
        for start in range(0, len(ids), 256):
            assert pieces[start, raw[start:start + 256].tobytes()] >= copies
    assert sum(r.length for r in got) == sum(
        len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    windows = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(nothing, tokenizer).count() == 0


def test_best_fit_decreasing_matches_a_plain_search():
    draw = np.random.default_rng(3)
    for window in (7, 64, 100):
        lengths = draw.integers(1, window + 1, 300)
        bins, offsets = packing.best_fit_decreasing(lengths, window)
        left: list[int] = []
        for k in np.argsort(-lengths, kind="stable"):
            fit = [c for c in left if c >= lengths[k]]
            before = window - (left[bins[k]] if bins[k] < len(left) else window)
            if fit:
                assert left[bins[k]] == min(fit)
            else:
                assert bins[k] == len(left)
                left.append(window)
            assert offsets[k] == before
            left[bins[k]] -= lengths[k]


def test_licences(spark, nothing):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/LICENSE", mit), ("a/x.py", None), ("a/b/y.py", "some text"), ("a/b/z.py", "code\n" + gpl + "\nmore"),
            ("c/d.py", ""), ("LICENSE", gpl), ("a/b/COPYING", "nothing here"), (None, "x"), ("a/x.py", None),
            ("e", "the work of this mit der public version")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit("x"))
    is_file = F.coalesce(F.col("path").rlike("(LICENSE|COPYING)$"), F.lit(False))
    got = Counter(tuple(r) for r in license_scan.scan(files, [], is_file).select(
        "path", "licence", "origin", "licence_path").collect())
    assert got == Counter([
        ("a/LICENSE", "MIT", "own", "a/LICENSE"), ("a/x.py", "MIT", "inherited", "a/LICENSE"),
        ("a/x.py", "MIT", "inherited", "a/LICENSE"), ("a/b/y.py", "MIT", "inherited", "a/LICENSE"),
        ("a/b/z.py", "GPL-3.0", "own", "a/b/z.py"), ("c/d.py", "GPL-3.0", "inherited", "LICENSE"),
        ("LICENSE", "GPL-3.0", "own", "LICENSE"), ("a/b/COPYING", "MIT", "inherited", "a/LICENSE"),
        (None, None, "none", None), ("e", "GPL-3.0", "inherited", "LICENSE")])
    empty = nothing.withColumn("path", F.col("source"))
    assert license_scan.scan(empty, ["doc_id"], F.lit(False)).count() == 0


def test_licences_in_shared_and_wrapped_lines(spark):
    fill = " ".join(f"word{k}" for k in range(40))
    texts = {"proprietary": "Copyright 2020 Acme Corp. All rights reserved.",
             "GPL-3.0": f"{fill} This work is licensed under the GNU General Public License, version 3. {fill}",
             "Apache-2.0": "# one two Licensed under the Apache\n# License, Version 2.0. three four",
             "MIT": f"{fill} " * 50 + "Released under the MIT License. " + fill, "none": fill}
    files = spark.createDataFrame([(f"{k}/f", t) for k, t in texts.items()], "path string, text string")
    got = license_scan.scan(files, [], F.lit(False)).collect()
    assert {r.path: r.licence for r in got} == {
        f"{k}/f": None if k == "none" else k for k in texts}


def test_anchors_lose_no_line():
    found = {t: 50 for t in ("the", "under", "this", "is", "by")}
    weights = license_scan.Weights.of(license_scan.HEADERS, 1000, found)
    anchors = set(weights.anchors(0.7))
    for vector in weights.vectors.values():
        rest = sum(w * w for t, w in vector.items() if t not in anchors)
        assert rest < 0.7 ** 2


def test_lm_base_scores(docs, rows, nothing, tokenizer):
    got = lm_scoring.scored(docs, tokenizer, frequent=20, rate=2, rounds=1).collect()
    want = defaultdict(list)
    for i, *rest in brute.base_scores([r[:2] for r in rows]):
        want[i].append(tuple(rest))
    assert len(got) == len(rows)
    for r in got:
        match = [w for w in want[r.doc_id] if w[0] == r.n_tokens]
        assert any((r.n_known, r.train_tokens) == w[1:3] and r.base_score == pytest.approx(w[3])
                   for w in match)
        assert r.held_out == (r.doc_id is not None and not brute.learns(r.doc_id, 7, 2))
        assert np.isfinite(r.score) and r.score < 0
    assert lm_scoring.scored(nothing, tokenizer).count() == 0


def _plain_log_probability(p, v, ids, start_id, end_id):
    """One token after another, with all visible keys in turn."""
    inputs, targets, total = [start_id, *ids], [*ids, end_id], 0.0
    x = p["embed"][v.row[inputs]].astype(float)
    q, k, val = x @ p["query"], x @ p["key"], x @ p["value"]
    for t in range(len(inputs)):
        first = max(0, (t // attention.SPAN - 1) * attention.SPAN)
        s = np.array([q[t] @ k[u] * attention.WIDTH ** -0.5 + p["distance"][t - u]
                      for u in range(first, t + 1)])
        a = np.exp(s - s.max())
        h = x[t] + (a / a.sum()) @ val[first:t + 1]
        z = h @ p["out"] + p["bias"]
        z = z - z.max() - np.log(np.exp(z - z.max()).sum())
        total += z[v.classed[targets[t]]] + v.log_share[targets[t]]
    return total


@pytest.fixture(scope="module")
def vocabulary():
    draw = np.random.default_rng(5)
    return attention.Vocabulary.from_counts(draw.integers(0, 1000, 3000))


def test_attention_scores_each_token_once(vocabulary):
    p = attention.unflat(attention.flat(attention.fresh_parameters(2)))
    draw = np.random.default_rng(6)
    lengths = [0, 1, 15, 16, 17, 40, 200]
    ids = draw.integers(0, 3000, sum(lengths))
    before = np.concatenate([[0], np.cumsum(lengths)])
    for at_once in (3, 2048):
        got = attention.log_probabilities(p, vocabulary, ids, before, 2998, 2999, at_once)
        want = [_plain_log_probability(p, vocabulary, ids[a:b].tolist(), 2998, 2999)
                for a, b in zip(before, before[1:])]
        np.testing.assert_allclose(got, want, rtol=1e-4)


def test_probabilities_add_up(vocabulary):
    share = np.bincount(vocabulary.classed, np.exp(vocabulary.log_share.astype(float)), attention.CLASSES)
    np.testing.assert_allclose(share[share > 0], 1.0, rtol=1e-4)


def test_gradient_matches_differences(vocabulary):
    draw = np.random.default_rng(8)
    p = {k: v.astype(np.float64) for k, v in attention.fresh_parameters(4).items()}
    rows = draw.integers(0, 3000, (4, attention.SPAN))
    classes = draw.integers(0, attention.CLASSES, (4, attention.SPAN))
    real = draw.random((4, attention.SPAN)) < 0.8
    first = np.array([True, False, True, False])
    _, g = attention.gradient(p, rows, classes, real, first)
    for name, at in (("query", (1, 2)), ("key", (3, 0)), ("value", (2, 2)), ("distance", (3,)),
                     ("out", (4, 5)), ("bias", (7,)), ("embed", (int(rows[1, 3]), 1))):
        losses = []
        for shift in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += shift
            losses.append(attention.gradient(q, rows, classes, real, first)[0])
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(float(g[name][at]), rel=1e-2, abs=1e-6)


def test_a_step_takes_each_exponential_once(monkeypatch):
    draw = np.random.default_rng(10)
    shape, taken = (6, attention.SPAN), []
    plain = np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: (taken.append(np.size(x)), plain(x, *a, **k))[1])
    attention.gradient(attention.fresh_parameters(3), draw.integers(0, 3000, shape),
                       draw.integers(0, attention.CLASSES, shape), np.ones(shape, bool), np.arange(6) % 3 == 0)
    assert sum(taken) == 6 * attention.SPAN * (attention.CLASSES + 2 * attention.SPAN)


@pytest.mark.parametrize("name,factor", [("out", 300), ("query", 300), ("distance", 90)])
def test_large_parameters_do_not_overflow(vocabulary, name, factor):
    p = attention.fresh_parameters(2)
    p["distance"] += np.linspace(0, -1, 2 * attention.SPAN, dtype=np.float32)
    p[name] *= factor
    ids = np.random.default_rng(7).integers(0, 3000, 120)
    before = np.array([0, 0, 20, 120])
    got = attention.log_probabilities(p, vocabulary, ids, before, 2998, 2999)
    want = [_plain_log_probability(p, vocabulary, ids[a:b].tolist(), 2998, 2999)
            for a, b in zip(before, before[1:])]
    np.testing.assert_allclose(got, want, rtol=1e-4)
    blocks = ids[:96].reshape(-1, attention.SPAN)
    loss, g = attention.gradient(p, vocabulary.row[blocks], vocabulary.classed[blocks],
                                 np.ones(blocks.shape, bool), np.arange(len(blocks)) % 2 == 0)
    assert np.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())


def test_training_lowers_the_loss(vocabulary):
    draw = np.random.default_rng(9)
    p = attention.fresh_parameters(1)
    rows = np.tile(draw.integers(0, 50, attention.SPAN), (64, 1))
    batch = (rows, np.roll(rows, -1, 1), np.ones(rows.shape, bool), np.ones(64, bool))
    after = attention.trained(p, [batch] * 40)
    assert attention.gradient(after, *batch)[0] < 0.5 * attention.gradient(p, *batch)[0]


def test_every_training_id_is_a_target_once(docs, tokenizer):
    learnt = docs.select("doc_id", "text").filter(lm_scoring.trains(F.col("doc_id"), 7, 2))
    found = lm_scoring.gathered(learnt, tokenizer, 49406, 49407, 1).toPandas()
    used = found[found["kind"] == 1].groupby("key")["n"].sum()
    counts = np.zeros(49_408, np.int64)
    counts[used.index] = used
    plain = attention.Vocabulary(np.arange(49_408), np.arange(49_408), np.zeros(49_408))
    runs, seen = found[found["kind"] == 2], np.zeros(49_408, np.int64)
    assert runs["n"].max() == 1
    for _, targets, real, _ in lm_scoring._batches(runs["ids"].tolist(), runs["n"].to_numpy(), plain):
        seen += np.bincount(targets[real], minlength=49_408)
    assert (seen == counts).all()


def test_training_beats_the_base_on_left_out_texts(spark, tokenizer):
    """Texts in which each word is followed by one of two words."""
    draw = np.random.default_rng(4)
    names = ("the and for you are not with this that from have was but all can "
             "out one his her who").split()
    texts = []
    for i in range(400):
        at, text = int(draw.integers(20)), []
        for _ in range(90):
            text.append(names[at])
            at = (at * 3 + 1 + int(draw.integers(2))) % 20
        texts.append((i, " ".join(text)))
    got = lm_scoring.scored(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer)
    sums = got.filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert sums[0] > 0.5 * sums[1]


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    long = max((r[1] for r in rows if r[1] and r[1].startswith("q")), key=len)
    items = [(1, " ".join(long.split(" ")[:40])), (2, "one two three four five six"), (3, None),
             (4, "too short"), (5, " ".join(f"w{k}" for k in range(30))), (5, ""), (6, "alpha beta gamma delta eps")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, docs, rows, benchmark, nothing):
    item = [f"w{k}" for k in range(30)]
    spoiled = [w if k % 7 else "other" for k, w in enumerate(item)]
    own = [(9001, "before it " + " ".join(item).upper() + " after it"), (9002, "x " + " ".join(spoiled)),
           (9003, " ".join(item[:9])), (9004, "so one two three four five six it is"),
           (9005, " ".join(reversed(item))), (9006, "alpha beta gamma delta eps"), (9006, "clean text")]
    more = spark.createDataFrame(own, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(both, benchmark).collect()}
    want = {(r[0], 1) for r in rows if r[1] and r[1].startswith("q") and r[0] is not None}
    assert got == want | {(9001, 5), (9002, 5), (9004, 2), (9006, 6)}
    clean = decontaminate.without_benchmark(both, benchmark)
    assert clean.columns == both.columns
    left = clean.filter("doc_id > 9000").collect()
    assert {(r.doc_id, r.text) for r in left} == {o for o in own if o[0] in (9003, 9005)} | {(9006, "clean text")}
    assert clean.count() == both.count() - len([1 for r in rows if (r[0], 1) in want]) - 4
    assert decontaminate.contaminated(nothing, benchmark).count() == 0
    assert decontaminate.without_benchmark(docs, benchmark.limit(0)).count() == len(rows)


def _plain_overlap(equal):
    best = 0
    for a in range(len(equal)):
        for b in range(a + 1, len(equal) + 1):
            n = sum(equal[a:b])
            if n >= 4 * (b - a - n):
                best = max(best, n)
    return best


def test_overlap_has_the_most_matches():
    """Single replaced words at every place, and spread ones, in items of 5 to 30 words."""
    draw = np.random.default_rng(3)
    for n in range(5, 31):
        item = np.arange(n, dtype=np.uint64)
        spread = [draw.choice(n, k, replace=False) for k in (2, 3, 4, 5, 6) for _ in range(8) if k <= n]
        for replaced in [[i] for i in range(n)] + spread + [np.arange(4, n, 5)]:
            doc = np.concatenate([item[:3] + 500, item, item[:3] + 500])
            doc[3 + np.asarray(replaced)] += 1000
            first, length, equal = decontaminate.overlap(doc, item, 3)
            assert equal == _plain_overlap((doc[3:3 + n] == item).tolist())
            inside = doc[first:first + length] == item[first - 3:first - 3 + length]
            assert inside.sum() == equal >= 4 * (length - equal)
            assert not equal or inside[0] and inside[-1]


@pytest.mark.parametrize("words, replaced", [(9, 1), (10, 2), (15, 3), (20, 4), (25, 5)])
def test_masks_lose_no_overlap(words, replaced):
    choices = np.array(list(combinations(range(words), replaced)))
    differ = (1 << choices).sum(axis=1)
    hit = np.zeros(len(differ), bool)
    for mask in decontaminate.MASKS:
        shape = sum(1 << i for i, c in enumerate(mask) if c == "1")
        for at in range(words - len(mask) + 1):
            hit |= differ & (shape << at) == 0
    assert hit.all()


def test_replaced_words_are_found(spark):
    """Items of 10 to 30 words with every place replaced, and with a fifth replaced."""
    draw = np.random.default_rng(5)
    items, texts, want = [], [], set()
    for n in range(10, 31):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for gone in [[i] for i in range(n)] + [list(range(2, n, 5)), draw.choice(n, n // 5, False).tolist()]:
            text = [f"new{k}" if k in gone else w for k, w in enumerate(words)]
            equal = _plain_overlap([k not in gone for k in range(n)])
            if equal >= min(12, -(-4 * n // 5)):
                want.add((len(texts), n, equal))
            texts.append((len(texts), " ".join(["before", *text, "after"])))
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_equal) for r in got.collect()} == want


def test_short_items_with_a_replaced_word_are_found(spark):
    """Items of five to nine words, whole, with each word replaced or left out at an end, and with two."""
    items, texts, want = [], [], set()
    for n in range(5, 10):
        words = [f"s{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        found = [words, words[1:], words[:-1]] + [words[:i] + ["new"] + words[i + 1:] for i in range(n)]
        for text in [*found, ["new", *words[1:-1], "new"]]:
            want |= {(len(texts) + k, n) for k in (0, 1) if text in found}
            texts += [(len(texts), " ".join(text)), (len(texts) + 1, " ".join(["it", *text, "is"]))]
    items.append((4, "s4x0 s4x1 s4x2 s4x3"))
    texts.append((len(texts), "it s4x0 s4x1 s4x2 s4x3 is"))
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_pipeline_by_stages(spark, sf):
    """Every stage on the smallest tables against the plain statements."""
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = cp.keep_good(spark, docs, sf)
    failed = {r.doc_id for r in docs.collect() if (
        lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0])(brute.quality_counts(r.text))}
    assert not failed & {r.doc_id for r in good.collect()}
    lines = cp.drop_common_lines(spark, good, sf)
    want = Counter((i, t) for i, _, _, t in brute.kept_lines([(r.doc_id, r.text) for r in good.collect()]))
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert Counter(rows) == want
    single = cp.drop_near_copies(spark, lines, sf)
    kept = {i for i, (_, c) in brute.classes(rows).items() if i == c}
    assert Counter(r.doc_id for r in single.collect()) == Counter(kept)
    clean = cp.drop_leaks(spark, single, sf)
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in single.collect() if any(
        " ".join(i) in " ".join(r.text.lower().split()) for i in items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    assert [c for c, _ in cp.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join",
                                        "benchmark decontamination", "packing"]
    for stage in (good, lines, single, clean):
        assert stage.columns == docs.columns
    assert {r.doc_id for r in cp.pack(spark, clean, sf).collect()} == {r.doc_id for r in clean.collect()}
