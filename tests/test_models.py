import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.functions.normal import log_normal_tail
from panelwright.operators import (
    boxcox, diagnostics, feeds, leastsquares as ls, scoring, selection, subsets,
)
from panelwright.operators.ordering import keyed_hash

NAMES = ["a", "b", "c", "d"]
EFFECTS = np.array([2.0, -3.0, 0.0, 0.05])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 4)) * [1, 10, 1, 3] + [0, 5, -2, 100]
    y = 50 + x @ EFFECTS + rng.normal(size=900)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    rows = [(k, *map(float, row), float(v), "even" if k % 2 == 0 else "odd")
            for k, (row, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(
        rows, "k long, a double, b double, c double, d double, y double, g string").repartition(5).cache()


def _lstsq(x, y):
    full = np.column_stack([np.ones(len(x)), x])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    left = y - full @ beta
    return beta, float(left @ left), full


def test_fit_equals_direct_solution(frame, data):
    x, y = data
    beta, rss, full = _lstsq(x, y)
    model = ls.fit(frame, "y", NAMES)
    assert list(model.coefficients.values()) == pytest.approx(list(beta), rel=1e-10)
    assert model.rss == pytest.approx(rss, rel=1e-12)
    assert model.n == 900 and model.df_residual == 895 and model.rank == 5
    sigma2 = rss / 895
    errors = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * sigma2)
    assert list(model.std_errors.values()) == pytest.approx(list(errors), rel=1e-9)
    tss = ((y - y.mean()) ** 2).sum()
    assert model.r_squared == pytest.approx(1 - rss / tss, rel=1e-12)
    assert model.f_statistic == pytest.approx(((tss - rss) / 4) / sigma2, rel=1e-10)
    assert model.adj_r_squared == pytest.approx(1 - sigma2 / (tss / 899), rel=1e-12)
    assert model.aic == pytest.approx(900 * math.log(rss / 900) + 10)


def test_submodels_come_from_the_triangle(frame, data):
    x, y = data
    model = ls.fit(frame, "y", NAMES)
    for size in range(5):
        for names in itertools.combinations(NAMES, size):
            _, rss, _ = _lstsq(x[:, [NAMES.index(n) for n in names]], y)
            assert model.subset(names).rss == pytest.approx(rss, rel=1e-11)


def test_partitioning_does_not_matter(frame):
    many, one = (ls.fit(frame.repartition(n), "y", NAMES) for n in (31, 1))
    assert list(many.coefficients.values()) == pytest.approx(list(one.coefficients.values()), rel=1e-11)


def test_aliased_columns_have_no_coefficient(frame):
    doubled = frame.withColumn("twice", F.col("a") * 2).withColumn("rest", 1 - F.col("a") - F.col("b"))
    model = ls.fit(doubled, "y", ["a", "twice", "b", "rest", "c"])
    assert model.coefficients["twice"] is None and model.coefficients["rest"] is None
    assert model.rank == 4
    clean = ls.fit(frame, "y", ["a", "b", "c"])
    assert model.rss == pytest.approx(clean.rss, rel=1e-11)
    scored = model.score(doubled).agg(F.sum(F.col("residual") ** 2)).first()[0]
    assert scored == pytest.approx(clean.rss, rel=1e-9)


def test_nearly_collinear_shares_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    shares = np.round(rng.dirichlet([2, 2, 2], size=400), 3)
    y = shares @ [1.0, 2.0, 3.0] + rng.normal(size=400) * 1e-3
    rows = spark.createDataFrame([(*map(float, s), float(v)) for s, v in zip(shares, y)],
                                 "p double, q double, r double, y double").repartition(4)
    model = ls.fit(rows, "y", ["p", "q", "r"])
    beta, rss, _ = _lstsq(shares, y)
    assert list(model.coefficients.values()) == pytest.approx(list(beta), rel=1e-7)
    assert model.rss == pytest.approx(rss, rel=1e-10)


def test_incomplete_rows_are_left_out_and_counted(spark):
    rows = spark.createDataFrame(
        [(1.0, 1.0), (2.0, 2.5), (3.0, 2.9), (None, 1.0), (4.0, float("nan")), (5.0, 5.2)],
        "x double, y double")
    model = ls.fit(rows, "y", ["x"])
    assert (model.n, model.dropped) == (4, 2)
    with pytest.raises(ValueError):
        ls.fit(rows.filter("x IS NULL"), "y", ["x"])


def test_scoring_keeps_keys_and_sums(frame, data):
    x, y = data
    model = ls.fit(frame, "y", NAMES)
    scored = model.score(frame)
    sums = scoring.fit_sums(scored, "y", "residual").first()
    assert sums["rss"] == pytest.approx(model.rss, rel=1e-9)
    assert sums["tss"] == pytest.approx(model.tss, rel=1e-9)
    error = scored.agg(scoring.rmspe("y", "yhat")).first()[0]
    assert error == pytest.approx(math.sqrt(model.rss / 900), rel=1e-9)
    by_key = {r["k"]: r["residual"] for r in scored.collect()}
    beta, _, full = _lstsq(x, y)
    assert by_key[17] == pytest.approx(float(y[17] - full[17] @ beta), abs=1e-9)
    found = model.residual_quantiles(frame)
    assert found == pytest.approx(list(np.percentile(y - full @ beta, [0, 25, 50, 75, 100])), abs=1e-9)


def test_group_r_squared(frame, data):
    x, y = data
    scored = ls.fit(frame, "y", NAMES).score(frame)
    beta, _, full = _lstsq(x, y)
    left = y - full @ beta
    even = np.arange(900) % 2 == 0
    expected = {g: 1 - (left[m] ** 2).sum() / ((y[m] - y[m].mean()) ** 2).sum()
                for g, m in (("even", even), ("odd", ~even))}
    table = scoring.results_table(scored, "k", "g", "y", {"rsq": "residual"})
    found = {r["g"]: r["rsq"] for r in table.collect()}
    assert found == pytest.approx(expected, rel=1e-9) and table.count() == 900


def test_group_of_equal_values_has_no_r_squared(spark):
    rows = spark.createDataFrame([("g", 2.0, 0.1), ("g", 2.0, -0.1)], "g string, y double, e double")
    assert scoring.group_r_squared(rows, "g", "y", {"r": "e"}).first()["r"] is None


def test_nested_f_test(frame):
    big = ls.fit(frame, "y", NAMES)
    small = big.subset(["a", "b"])
    found = diagnostics.nested_f_test(small, big)
    assert found.statistic == pytest.approx(((small.rss - big.rss) / 2) / (big.rss / 895))
    assert found.p_value == pytest.approx((big.rss / small.rss) ** (895 / 2), rel=1e-9)
    same = diagnostics.nested_f_test(big, big)
    assert same.statistic is None and same.p_value is None


def test_brown_forsythe_by_hand(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=301), 1)
    e = rng.normal(size=301) * (1 + (x > 0))
    rows = spark.createDataFrame(list(zip(e.tolist(), x.tolist())), "e double, x double")
    found = diagnostics.brown_forsythe(rows, "e", "x")
    low = x <= np.median(x)
    d1, d2 = (np.abs(e[m] - np.median(e[m])) for m in (low, ~low))
    pooled = math.sqrt((((d1 - d1.mean()) ** 2).sum() + ((d2 - d2.mean()) ** 2).sum()) / 299)
    t = (d1.mean() - d2.mean()) / (pooled * math.sqrt(1 / len(d1) + 1 / len(d2)))
    assert found.statistic == pytest.approx(t, rel=1e-10) and found.df2 == 299
    assert 0 < found.p_value < 1e-3


def _brown_forsythe(e, x):
    low = x <= np.median(x)
    d1, d2 = (np.abs(e[m] - np.median(e[m])) for m in (low, ~low))
    pooled = math.sqrt((((d1 - d1.mean()) ** 2).sum() + ((d2 - d2.mean()) ** 2).sum()) / (len(e) - 2))
    return (d1.mean() - d2.mean()) / (pooled * math.sqrt(1 / len(d1) + 1 / len(d2)))


@pytest.mark.parametrize("case", ["plain", "even", "common median", "common residual", "three values"])
def test_brown_forsythe_settles_all_medians_in_one_read(spark, monkeypatch, case):
    rng = np.random.default_rng(len(case))
    n = 20_000 if case == "even" else 20_001
    x, e = rng.normal(size=n), rng.normal(size=n) + 100
    e *= 1 + 0.2 * (x > 0)
    if case == "common median":
        x[rng.random(n) < 0.34] = np.median(x)
    if case == "common residual":
        e[rng.random(n) < 0.5] = 100.0
    if case == "three values":
        x = np.round(np.clip(x, -1, 1))
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(e, x)], "e double, x double").repartition(9)
    monkeypatch.setattr(diagnostics, "_halves_by_medians", lambda rows: None)
    found = diagnostics.brown_forsythe(rows, "e", "x")
    assert found.statistic == pytest.approx(_brown_forsythe(e, x), rel=1e-9)


def test_brown_forsythe_without_a_bracket_takes_the_medians_in_turn(spark, monkeypatch):
    rng = np.random.default_rng(1)
    e, x = rng.normal(size=300), rng.normal(size=300)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(e, x)], "e double, x double")
    monkeypatch.setattr(diagnostics, "brackets_around", lambda *a: [(5.0, 6.0)])
    assert diagnostics.brown_forsythe(rows, "e", "x").statistic == pytest.approx(_brown_forsythe(e, x), rel=1e-9)


def test_brown_forsythe_without_two_groups(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "e double, x double")
    assert diagnostics.brown_forsythe(rows, "e", "x").statistic is None


def test_shapiro_published_example(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(weights)], "k long, v double")
    found = diagnostics.shapiro_wilk(rows, "v", "k")
    assert found.statistic == pytest.approx(0.78881, abs=5e-6)
    assert found.p_value == pytest.approx(0.006704, abs=5e-7)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 12])
def test_shapiro_of_few_values(spark, n):
    rows = spark.createDataFrame([(i, float(i * i)) for i in range(n)], "k long, v double")
    found = diagnostics.shapiro_wilk(rows, "v", "k")
    assert 0.75 < found.statistic <= 1 and 0 < found.p_value <= 1


def test_shapiro_limits(spark):
    flat = spark.createDataFrame([(i, 1.0) for i in range(9)], "k long, v double")
    assert diagnostics.shapiro_wilk(flat, "v", "k").statistic is None
    many = spark.range(5001).select(F.col("id").alias("k"), F.randn(3).alias("v"))
    found = diagnostics.normality(many, "v", "k")
    assert found.shapiro.statistic > 0.99 and found.shapiro.p_value is None
    assert 0.001 < found.anderson.p_value <= 1


def _anderson(values):
    """Directly from the definition."""
    v = np.sort(values)
    z = (v - v.mean()) / v.std(ddof=1)
    n = len(v)
    below = [math.log(0.5 * math.erfc(-x / math.sqrt(2))) for x in z]
    above = [math.log(0.5 * math.erfc(x / math.sqrt(2))) for x in z]
    return -n - sum((2 * i + 1) * (below[i] + above[n - 1 - i]) for i in range(n)) / n


@pytest.mark.parametrize("draw", ["normal", "uniform", "exponential", "ties", "outlier"])
def test_anderson_equals_the_definition(spark, draw):
    rng = np.random.default_rng(8)
    values = {"normal": rng.normal(size=700), "uniform": rng.random(700),
              "exponential": rng.exponential(size=700), "ties": rng.integers(0, 4, 700).astype(float),
              "outlier": np.append(rng.normal(size=300), 1e3)}[draw]
    rows = spark.createDataFrame(list(enumerate(values.tolist())), "k long, v double")
    found = diagnostics.anderson_darling(rows, "v", "k")
    assert found.statistic == pytest.approx(_anderson(values), rel=1e-11)
    assert found.df2 == len(values)
    assert found.p_value > 0.05 if draw == "normal" else found.p_value < 1e-6


def test_anderson_p_of_published_points():
    # Upper points of the corrected statistic with both parameters estimated.
    for point, p in ((0.561, 0.15), (0.631, 0.10), (0.752, 0.05), (0.873, 0.025), (1.035, 0.01)):
        assert diagnostics.anderson_p(point, 10 ** 9) == pytest.approx(p, rel=0.04)
    falling = [diagnostics.anderson_p(a / 50, 10 ** 6) for a in range(1, 5000)]
    assert all(0 <= b <= a + 1e-3 for a, b in zip(falling, falling[1:]))
    assert diagnostics.anderson_p(0.5, 7) is None


def test_anderson_share_of_rejections_holds_beyond_5000_values():
    rng = np.random.default_rng(2)
    rejected = sum(diagnostics.anderson_p(_anderson(rng.normal(size=6000)), 6000) < 0.05 for _ in range(200))
    assert 2 <= rejected <= 20


def test_log_normal_tail(spark):
    zs = [-40.0, -8.0, -1.0, -0.0, 0.0, 0.3, 1.0, 5.0, 12.0, 36.0, 37.5, 60.0, 1e4]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", log_normal_tail("z").alias("tail"))
    for z, tail in rows.collect():
        if z < 37:
            want = math.log(0.5 * math.erfc(z / math.sqrt(2))) if z > -8 else -0.5 * math.erfc(-z / math.sqrt(2))
        else:       # log of the asymptotic series of the tail's ratio to the density
            want = -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) - 1 / z ** 2 + 2.5 / z ** 4
        assert tail == pytest.approx(want, rel=1e-11 if z >= 37 else 2e-13, abs=2e-13)


def test_normal_pairs_of_few_and_many(spark):
    def scores(n):
        rows = spark.createDataFrame([(i, float(-i)) for i in range(n)], "k long, v double")
        return [r["position"] for r in diagnostics.normal_pairs(rows, "v", "k").orderBy("rank").collect()]
    assert scores(4) == pytest.approx([(i - 0.375) / 4.25 for i in range(1, 5)])
    assert scores(20) == pytest.approx([(i - 0.5) / 20 for i in range(1, 21)])


# ------------------------------------------------------------------ transformations

def _sse(x, y, lam):
    g = math.exp(np.log(y).mean())
    w = g * np.log(y) if lam == 0 else (y ** lam - 1) / (lam * g ** (lam - 1))
    return _lstsq(x, w)[1]


def test_profile_equals_the_textbook_form(spark):
    rng = np.random.default_rng(6)
    x = rng.random(size=(500, 2))
    y = np.exp(1 + x @ [0.5, -0.2] + rng.normal(size=500) * 0.2)
    rows = spark.createDataFrame([(*map(float, r), float(v) - 3) for r, v in zip(x, y)],
                                 "p double, q double, y double").repartition(3)
    grid = boxcox.exponent_grid(-20, 20, 10)
    found = boxcox.profile(rows, "y", ["p", "q"], grid, shift=3)
    expected = [(lam, _sse(x, y, lam)) for lam in grid]
    for (lam, sse), (_, wanted) in zip(found.points, expected):
        assert sse == pytest.approx(wanted, rel=1e-8), lam
    assert found.best == min(expected, key=lambda p: p[1])[0]
    rounds = boxcox.refine(rows, "y", ["p", "q"], shift=3)
    assert [len(p.points) for p in rounds] == [61, 41, 41]
    assert abs(rounds[2].best - rounds[0].best) < 0.25
    assert min(s for _, s in rounds[2].points) <= min(s for _, s in rounds[0].points)
    with pytest.raises(ValueError, match="shift"):
        boxcox.profile(rows, "y", ["p", "q"], grid)


@pytest.mark.parametrize("agreement", [1e-9, -1.0])
def test_refinement_of_several_shifts_reads_twice_and_equals_direct_profiles(spark, monkeypatch, agreement):
    rng = np.random.default_rng(3)
    x = rng.random(size=(400, 2))
    y = (3 + x @ [2.0, -1.0] + rng.normal(size=400) * 0.4) ** 1.7 - 2
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                                 "p double, q double, y double").repartition(3).cache()
    reads = []
    monkeypatch.setattr(boxcox, "accumulate", lambda *a, **b: reads.append(1) or ls.accumulate(*a, **b))
    monkeypatch.setattr(boxcox, "_AGREEMENT", agreement)   # below 0 nothing agrees
    found = boxcox.refine_shifts(rows, "y", ["p", "q"], [3.0, 8.0])
    assert len(reads) == (2 if agreement > 0 else 6)
    for shift, rounds in found.items():
        assert [len(r.points) for r in rounds] == [61, 41, 41]
        for r in rounds:
            for e, sse in r.points[::10]:
                assert sse == pytest.approx(_sse(x, y + shift, e), rel=1e-9)
        centre = round(rounds[0].best * 10) * 10
        assert [e for e, _ in rounds[1].points] == boxcox.exponent_grid(centre - 20, centre + 20, 100)


def test_a_perfect_fit_is_refined_from_the_rows(spark):
    rows = spark.createDataFrame([(float(i), (2.0 + i) ** 2) for i in range(30)], "x double, y double")
    assert boxcox.refine(rows, "y", ["x"])[-1].best == pytest.approx(0.5, abs=2e-3)


def test_exponent_grid_hits_zero():
    grid = boxcox.exponent_grid(-30, 30, 10)
    assert len(grid) == 61 and 0.0 in grid and grid[0] == -3.0


# ------------------------------------------------------------------ selection

def _aic(x, y):
    _, rss, full = _lstsq(x, y)
    return len(y) * math.log(rss / len(y)) + 2 * full.shape[1]


def test_backward_elimination_by_brute_force(frame, data):
    x, y = data
    final, path = selection.backward_by_aic(ls.fit(frame, "y", NAMES))
    live, score = list(range(4)), _aic(x, y)
    while live:
        options = [(_aic(x[:, [j for j in live if j != i]], y), i) for i in live]
        if min(options)[0] >= score:
            break
        score, gone = min(options)
        live.remove(gone)
    assert final.predictors == [NAMES[i] for i in live]
    assert path[-1].aic == pytest.approx(score)
    assert all(later.aic < earlier.aic for earlier, later in zip(path, path[1:]))


def test_aliased_predictors_go_first(frame):
    doubled = frame.withColumn("twice", F.col("a") * 2)
    final, path = selection.backward_by_aic(ls.fit(doubled, "y", ["a", "twice", "b"]))
    assert path[1].dropped == "twice" and final.predictors == ["a", "b"]


def test_best_subsets_by_brute_force(spark, frame, data):
    x, y = data
    replicates, seed = 7, 5
    found = selection.best_subset_cv(frame, "y", NAMES, "k", replicates, seed)
    draw = {r["k"]: r["d"] for r in frame.select(
        "k", selection.row_number_in_draw("k", seed).alias("d")).collect()}
    limit = int(selection.training_share(900) * selection.DRAW_MODULUS)
    errors = np.zeros((replicates, 5))
    for r, (a, b) in enumerate(selection.draw_constants(replicates, seed)):
        train = np.array([(a * draw[k] + b) % selection.DRAW_MODULUS < limit for k in range(900)])
        for size in range(5):
            best = min(itertools.combinations(range(4), size),
                       key=lambda c: _lstsq(x[train][:, list(c)], y[train])[1])
            beta, _, _ = _lstsq(x[train][:, list(best)], y[train])
            test = np.column_stack([np.ones((~train).sum()), x[~train][:, list(best)]])
            errors[r, size] = ((y[~train] - test @ beta) ** 2).mean()
    assert [e for _, e, _ in found.errors] == pytest.approx(list(errors.mean(axis=0)), rel=1e-8)
    assert found.size == int(errors.mean(axis=0).argmin())
    whole = min(itertools.combinations(range(4), found.size),
                key=lambda c: _lstsq(x[:, list(c)], y)[1])
    assert found.model.predictors == [NAMES[i] for i in whole]


def test_best_subsets_with_an_aliased_predictor(frame):
    doubled = frame.withColumn("twice", F.col("a") * 2)
    found = selection.best_subset_cv(doubled, "y", ["a", "twice", "b"], "k", 5)
    plain = selection.best_subset_cv(frame, "y", ["a", "b"], "k", 5)
    assert found.model.predictors == plain.model.predictors
    assert [e for _, e, _ in found.errors] == pytest.approx([e for _, e, _ in plain.errors], rel=1e-9)


def test_best_subsets_need_the_rows_of_the_rule(frame):
    found = selection.best_subset_cv(frame.filter("k < 15"), "y", ["a", "b"], "k", 20)
    assert found.size in (1, 2) and len(found.errors) == 3
    with pytest.raises(selection.TooFewRows):
        selection.best_subset_cv(frame.filter("k < 7"), "y", ["a"], "k")


def _gram(rng, n, p, mixing=0.0):
    x = rng.normal(size=(n, p)) @ (np.eye(p) + mixing * rng.normal(size=(p, p)))
    weights = rng.normal(size=p) * np.where(rng.random(p) < 0.5, 0.4, 0.03)
    z = np.column_stack([x, x @ weights + rng.normal(size=n) * 2])
    z = z - z.mean(axis=0)
    return z.T @ z


@pytest.mark.parametrize("p, mixing", [(1, 0.0), (2, 0.3), (7, 0.0), (11, 0.4), (15, 0.2)])
def test_tree_finds_what_the_full_search_finds(p, mixing):
    gram = _gram(np.random.default_rng(p), 300, p, mixing)
    found = subsets.best_of_each_size(gram)
    assert [len(s) for s, _, _ in found] == list(range(p + 1))
    least = np.full(p + 1, np.inf)
    for size in range(p + 1):
        index = np.array(list(itertools.combinations(range(p), size)), int).reshape(math.comb(p, size), size)
        inner = gram[index[:, :, None], index[:, None, :]]
        target = gram[index, p]
        beta = np.linalg.solve(inner, target[..., None])[..., 0] if size else target
        least[size] = (gram[p, p] - np.einsum("ij,ij->i", beta, target)).min()
    assert [rss for _, _, rss in found] == pytest.approx(list(least), rel=1e-9)


def test_branches_together_are_the_tree():
    gram = _gram(np.random.default_rng(4), 400, 12, 0.3)
    whole = subsets.best_of_each_size(gram)
    best = {}
    for branch in range(12):
        tree = subsets.SubsetTree(gram)
        tree.search({branch})
        for size, rss, subset in tree.found():
            best[size] = min(best.get(size, (math.inf, ())), (rss, subset))
    assert [best[k][1] for k in range(13)] == [s for s, _, _ in whole]


def test_forty_predictors_are_searched_without_a_cap():
    rng = np.random.default_rng(8)
    gram = _gram(rng, 4000, 40, 0.05)
    tree = subsets.SubsetTree(gram)
    tree.search()
    assert tree.nodes < 1 << 20
    for size in (3, 20, 37):
        at = set(tree.subset[size])
        for _ in range(300):                   # no exchange of two predictors does better
            drop = rng.choice(sorted(at), 2, replace=False)
            add = rng.choice(sorted(set(range(40)) - at), 2, replace=False)
            other = tuple(sorted((at - set(drop.tolist())) | set(add.tolist())))
            assert subsets.coefficients(gram, other)[1] >= tree.least[size] * tree.unit * (1 - 1e-9)


def test_subset_search_survives_singular_blocks():
    x = np.random.default_rng(0).normal(size=(40, 2))
    x = np.column_stack([x, x[:, 0], np.zeros(40)])
    y = x[:, 1] + 0.1 * x[:, 0]
    z = np.column_stack([x, y])
    z = z - z.mean(axis=0)
    sizes = subsets.best_of_each_size(z.T @ z)
    assert sizes[1][0] == (1,) and sizes[2][2] == pytest.approx(0, abs=1e-9)


def test_many_predictors_through_the_cluster(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 24))
    y = x[:, :6] @ [3, -2, 2, 1.5, -1, 1] + rng.normal(size=500)
    names = [f"x{i}" for i in range(24)]
    rows = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))],
                                 ["k", *names, "y"]).repartition(4)
    found = selection.best_subset_cv(rows, "y", names, "k", 5)
    assert found.subsets[6] == names[:6] and set(names[:6]) <= set(found.model.predictors)


def test_task_results_merge_in_levels(spark, frame, monkeypatch):
    whole = ls.fit(frame, "y", NAMES)
    monkeypatch.setattr(ls, "_FAN_IN", 2)
    many = ls.fit(frame.repartition(13), "y", NAMES)
    assert many.rss == pytest.approx(whole.rss, rel=1e-12)
    rows = spark.range(40).selectExpr("1 as part", "cast(id as int) as slot", "1L as n")
    schema = pa.schema([("part", pa.int32()), ("slot", pa.int32()), ("n", pa.int64())])

    def merge(t):
        return pa.Table.from_pydict({"part": [1], "slot": [t["slot"][0].as_py()],
                                     "n": [sum(t["n"].to_pylist())]}, schema=schema)

    left = ls.merged_in_levels(rows, merge, "part int, slot int, n long", "part").collect()
    assert len(left) == 10 and sum(r["n"] for r in left) == 40


def test_plot_rows_are_a_sample_with_residuals(frame):
    scored = ls.fit(frame, "y", NAMES).score(frame)
    rows = feeds.model_plot_rows(scored, "k", "y", "yhat", "residual").collect()
    assert len(rows) == 90
    assert all(r["abs_residual"] == abs(r["observed"] - r["fitted"]) for r in rows)


def test_hash_depends_on_seed(frame):
    row = frame.select(keyed_hash("k", 1).alias("a"), keyed_hash("k", 2).alias("b")).first()
    assert row["a"] != row["b"]
