import collections
import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as some

from pyspark.sql import functions as F

from panelwright.operators import ordering as od, summary as sm
from panelwright.runtime import scratch_path, shared_folder, stored


def _frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v double").repartition(6)


PROBS = [0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1]


@pytest.mark.parametrize("case", ["random", "hot", "one", "two", "equal", "negative"])
def test_quantiles_equal_numpy(spark, case):
    rng = random.Random(5)
    values = {
        "random": [rng.gauss(0, 10) for _ in range(3000)],
        "hot": [7.0] * 2000 + [rng.random() for _ in range(3000)],
        "one": [3.5], "two": [1.0, 2.0], "equal": [4.0] * 50,
        "negative": [-1e9, -5.5, -5.5, 0.0, 1e-9]}[case]
    found = od.column_quantiles(_frame(spark, values), ["v"], PROBS)["v"]
    assert found == pytest.approx(list(np.percentile(values, [100 * p for p in PROBS])), abs=1e-12)


def test_quantiles_of_several_columns_skip_missing(spark):
    rows = spark.createDataFrame(
        [(1.0, 5.0), (2.0, None), (3.0, float("nan")), (4.0, 6.0)], "a double, b double")
    found = od.column_quantiles(rows, ["a", "b"], [0.5])
    assert found == {"a": [2.5], "b": [5.5]}


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert od.column_quantiles(empty, ["v"], [0.5]) == {}


def test_rows_outside_the_brackets_are_only_counted(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(size=40_000), np.full(20_000, 0.25)])
    rows = spark.createDataFrame(
        [(float(v), float(-v)) for v in values], "a double, b double").repartition(6)
    kept = []
    write = od.stored
    monkeypatch.setattr(od, "stored", lambda df: kept.append(write(df)) or kept[-1])
    probs = [0, 0.1, 0.5, 0.6, 0.99, 1]
    found = od.column_quantiles(rows, ["a", "b"], probs)
    assert found["a"] == pytest.approx(list(np.percentile(values, [100 * p for p in probs])), abs=1e-12)
    assert found["b"] == pytest.approx(list(np.percentile(-values, [100 * p for p in probs])), abs=1e-12)
    assert len(kept) == 1 and kept[0].count() < 1000


def test_a_missed_bracket_falls_back_to_all_rows(spark, monkeypatch):
    rows = _frame(spark, [float(i) for i in range(100)])
    monkeypatch.setattr(od, "brackets_around", lambda *a: [(90.0, 95.0)])
    assert od.column_quantiles(rows, ["v"], [0.5]) == {"v": [49.5]}


@pytest.mark.parametrize("at_hand, pivots", [(200, 16), (20, 4)])
def test_kept_values_are_cut_finer_until_few_are_left(spark, monkeypatch, at_hand, pivots):
    rng = np.random.default_rng(12)
    values = np.concatenate([rng.normal(size=9_000), np.full(3_000, 0.25), np.full(500, -1.5)])
    rows = spark.createDataFrame([(float(v), float(v * v)) for v in values], "a double, b double").repartition(5)
    monkeypatch.setattr(od, "_AT_HAND", at_hand)
    monkeypatch.setattr(od, "_PIVOTS", pivots)
    monkeypatch.setattr(od, "brackets_around", lambda *a: [(-math.inf, math.inf)])
    cuts = []
    cut = od._cut_finer
    monkeypatch.setattr(od, "_cut_finer", lambda *a: cuts.append(1) or cut(*a))
    found = od.column_quantiles(rows, ["a", "b"], [0, 0.3, 0.5, 0.51, 1])
    for name, data in (("a", values), ("b", values * values)):
        assert found[name] == pytest.approx(list(np.percentile(data, [0, 30, 50, 51, 100])), abs=1e-12)
    assert len(cuts) >= 2


def test_sketches_of_many_tasks_bracket_what_they_should(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=60_000)
    wide = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(70)
    edges = od.bracket_edges([0.1, 0.5, 0.9])
    (moments, at), = od.sketched(wide, edges).values()
    assert moments.n == 60_000 and moments.mean == pytest.approx(values.mean(), abs=1e-12)
    assert moments.deviation == pytest.approx(values.std(ddof=1), rel=1e-12)
    for p, (low, high) in zip([0.1, 0.5, 0.9], zip(edges[::2], edges[1::2])):
        assert at[low] <= np.quantile(values, p) <= at[high]


def test_split_cut_over_several_prefixes(spark, monkeypatch):
    monkeypatch.setattr(od, "_HEX_STEP", 1)
    rows = spark.range(777).withColumnRenamed("id", "k")
    sample, _ = od.keyed_split(rows, "k", 0.35, 37)
    by_hash = sorted(range(777), key=lambda k: hashlib.md5(f"{k}:37".encode()).hexdigest())
    assert {r["k"] for r in sample.collect()} == set(by_hash[:271])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(some.lists(some.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_ranged_quantiles_equal_numpy_on_any_list(spark, values):
    found = od.column_quantiles(_frame(spark, values), ["v"], [0.1, 0.5, 0.77])["v"]
    assert found == pytest.approx(list(np.percentile(values, [10, 50, 77])), rel=1e-12, abs=1e-9)


def test_global_rank_equals_sorting(spark):
    rng = random.Random(1)
    values = [rng.choice([1.0, 1.0, 1.0, rng.random()]) for _ in range(2000)]
    ranked = od.ranked_with_count(_frame(spark, values), ["v", "k"])[0].collect()
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    expected = {k: r for r, k in enumerate(order, start=1)}
    assert {r["k"]: r["rank"] for r in ranked} == expected
    assert ranked[0].asDict().keys() == {"k", "v", "rank"}


def test_a_value_shared_by_a_third_of_the_rows_is_split(spark):
    rows = spark.range(60_000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("v"))
    sizes = [r["n"] for r in rows.repartitionByRange(8, "v", "k").groupBy(
        F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 60_000 / 8
    ranked = od.ranked_with_count(rows, ["v", "k"])[0]
    facts = ranked.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(facts) == (1, 60_000, 60_000)
    median = od.column_quantiles(rows, ["v"], [0.5])["v"][0]
    assert median == 0.5


def test_global_rank_needs_no_single_partition(spark):
    ranked = od.ranked_with_count(_frame(spark, [float(i) for i in range(100)]), ["v", "k"])[0]
    assert "SinglePartition" not in ranked._jdf.queryExecution().toString()


@pytest.mark.parametrize("n,drawn", [(1, 0), (4, 0), (5, 1), (1003, 200)])
def test_split_is_exact_disjoint_and_complete(spark, n, drawn):
    rows = spark.range(n).withColumnRenamed("id", "k")
    sample, rest = od.keyed_split(rows, "k", 0.2, 37)
    inside, outside = {r["k"] for r in sample.collect()}, {r["k"] for r in rest.collect()}
    assert len(inside) == drawn and inside | outside == set(range(n)) and not inside & outside
    by_hash = sorted(range(n), key=lambda k: hashlib.md5(f"{k}:37".encode()).hexdigest())
    assert inside == set(by_hash[:drawn])


def test_split_does_not_depend_on_partitioning(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    first = {r["k"] for r in od.keyed_split(rows.repartition(7), "k", 0.3, 1)[0].collect()}
    second = {r["k"] for r in od.keyed_split(rows.coalesce(1), "k", 0.3, 1)[0].collect()}
    assert first == second and len(first) == 150


def test_whole_sample(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    sample, rest = od.keyed_split(rows, "k", 1.0)
    assert sample.count() == 10 and rest.count() == 0


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_folder(spark))
    assert stored(spark.range(3)).count() == 3


# ------------------------------------------------------------------ summaries

def test_describe_equals_numpy(spark):
    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    found = {r["statistic"]: r["v"] for r in sm.describe(_frame(spark, values), ["v"]).collect()}
    assert found == pytest.approx({
        "count": 8, "mean": np.mean(values), "std": np.std(values, ddof=1), "min": 1, "max": 9,
        "25%": np.percentile(values, 25), "50%": 3.5, "75%": np.percentile(values, 75)})


def test_describe_of_an_empty_column(spark):
    rows = spark.createDataFrame([(None, 1.0)], "a double, b double")
    found = {r["statistic"]: (r["a"], r["b"]) for r in sm.describe(rows, ["a", "b"]).collect()}
    assert found["count"] == (0.0, 1.0) and found["mean"] == (None, 1.0)


def test_trim_keeps_the_limit(spark):
    kept = sm.trim_above(_frame(spark, [float(i) for i in range(11)]), "v", 0.9)
    assert sorted(r["v"] for r in kept.collect()) == [float(i) for i in range(10)]


def test_top_edge_falls_in_the_last_bin(spark):
    rows = _frame(spark, [-5.0, -4.99, 0.0, 4.99, 5.0, 5.01, -5.01])
    found = {r["bin"]: r["count"] for r in sm.histogram(rows, "v", -5, 5, 10).collect()}
    assert found == {-1: 1, 0: 2, 5: 1, 9: 2, 10: 1}


def test_one_value_is_one_bin(spark):
    found = sm.histogram(_frame(spark, [2.0, 2.0, float("nan")]), "v", 2, 2, 10).collect()
    assert [(r["bin"], r["count"]) for r in found] == [(0, 2)]


def test_density_of_nothing_has_no_rows(spark):
    assert sm.density(spark.createDataFrame([], "v double"), "v").collect() == []


def test_a_repeated_key_at_the_cut_is_refused(spark):
    rows = spark.range(100).select((F.col("id") % 2).cast("string").alias("k"))
    with pytest.raises(ValueError, match="repeats"):
        od.keyed_split(rows, "k", 0.2)


def test_heatmap_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random(500), rng.normal(size=500)
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    counts, _, _ = np.histogram2d(x, y, bins=[4, 6], range=[[0, 1], [-3, 3]])
    found = {(r["x_bin"], r["y_bin"]): r["count"]
             for r in sm.heatmap(rows, {"x": (0, 1)}, "y", (-3, 3), 4, 6).collect()}
    assert sum(found.values()) == 500
    found = {k: n for k, n in found.items() if 0 <= k[1] < 6}
    assert found == {(i, j): int(c) for (i, j), c in np.ndenumerate(counts) if c}


def _own_cells(values, bins):
    """Cells by trying every power of two."""
    least = math.frexp(max(map(abs, values)))[1] - 53
    k = next(k for k in range(least, 1024)
             if math.floor(math.ldexp(max(values), -k)) - math.floor(math.ldexp(min(values), -k)) < bins)
    counts = collections.Counter(math.floor(math.ldexp(v, -k)) for v in values)
    return {(math.ldexp(c, k), math.ldexp(c + 1, k)): n for c, n in counts.items()}


@pytest.mark.parametrize("bins", [2, 7, 50])
@pytest.mark.parametrize("case", ["wide", "shifted", "tiny next to huge", "around zero", "two"])
def test_own_histogram_equals_one_task(spark, case, bins):
    rng = np.random.default_rng(5)
    values = {"wide": rng.lognormal(0, 6, 2000), "shifted": 1e6 + rng.random(2000),
              "tiny next to huge": np.append(rng.random(500) * 1e-300, [1e300, -3.0, 0.0]),
              "around zero": rng.normal(size=2000), "two": np.array([-1.0, 1.0])}[case].tolist()
    rows = _frame(spark, [*values, float("nan"), float("inf"), None]).repartition(7)
    found = sm.own_histogram(rows, "v", bins).collect()
    assert len(found) <= bins
    assert {(r["bin_from"], r["bin_to"]): r["count"] for r in found} == _own_cells(values, bins)


def test_own_histogram_of_one_value_and_of_none(spark):
    for value in (0.0, 3.0, -1e200):
        (row,) = sm.own_histogram(_frame(spark, [value] * 5).repartition(3), "v").collect()
        assert row["count"] == 5 and row["bin_from"] == value
    assert sm.own_histogram(_frame(spark, [None, float("nan")]), "v").collect() == []
    assert sm.own_histogram(spark.createDataFrame([], "v double"), "v").columns == ["bin_from", "bin_to", "count"]
    with pytest.raises(ValueError, match="two bins"):
        sm.own_histogram(_frame(spark, [1.0]), "v", 1)


def test_own_heatmap_has_its_bins_from_whole_points(spark):
    rng = np.random.default_rng(6)
    points = [(float(a), float(b)) for a, b in zip(rng.random(400), rng.normal(size=400))]
    rows = spark.createDataFrame([*points, (1e9, None), (None, 1e9)], "x double, y double").repartition(5)
    found = sm.own_heatmap(rows, ["x"], "y", 8, 16).collect()
    assert sum(r["count"] for r in found) == 400
    for low, high, values, bins in (("x_from", "x_to", [p[0] for p in points], 8),
                                    ("y_from", "y_to", [p[1] for p in points], 16)):
        sums = collections.Counter()
        for r in found:
            sums[r[low], r[high]] += r["count"]
        assert sums == _own_cells(values, bins)


def test_density_follows_the_direct_sum(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=800)
    rows = _frame(spark, values.tolist())
    found = sm.density(rows, "v", points=101).orderBy("x").collect()
    assert len(found) == 101
    q1, q3 = np.percentile(values, [25, 75])
    h = sm.rule_of_thumb_bandwidth(800, values.std(ddof=1), q3 - q1)
    for r in found[::10]:
        direct = np.exp(-0.5 * ((r["x"] - values) / h) ** 2).sum() / (800 * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(direct, abs=1e-12)
    step = found[1]["x"] - found[0]["x"]
    assert sum(r["density"] for r in found) * step == pytest.approx(1, abs=5e-3)


@pytest.mark.parametrize("terms", [4, 8, 18])
def test_density_keeps_the_stated_bound(spark, terms):
    values = [0.0, 0.1, 0.49, 3.0, 3.0, 50.0]
    found = sm.density(_frame(spark, values), "v", points=64, bandwidth=0.7, terms=terms).collect()
    peak = 1 / (0.7 * math.sqrt(2 * math.pi))
    for r in found:
        direct = sum(math.exp(-0.5 * ((r["x"] - v) / 0.7) ** 2) for v in values) * peak / len(values)
        assert abs(r["density"] - direct) <= sm.expansion_error(terms) * peak + 1e-15


def test_geometric_mean_and_squares(spark):
    rows = _frame(spark, [1.0, 2.0, 4.0])
    found = rows.agg(sm.geometric_mean("v"), sm.squared_deviations("v")).first()
    assert found[0] == pytest.approx(2.0) and found[1] == pytest.approx(np.var([1, 2, 4]) * 3)


def test_value_ranges(spark):
    rows = spark.createDataFrame([(1.0, 5), (-2.0, 9)], "a double, b int")
    assert sm.value_ranges(rows, ["a", "b"]) == {"a": (-2.0, 1.0), "b": (5.0, 9.0)}


def test_percentile_grid_has_every_fifth(spark):
    grid = sm.percentile_grid(_frame(spark, [float(i) for i in range(101)]), ["v"])
    found = {r["percentile"]: r["value"] for r in grid.collect()}
    assert found == pytest.approx({p: float(p) for p in range(0, 101, 5)})
