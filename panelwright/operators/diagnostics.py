"""Residual diagnostics and model comparison."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.normal import inverse_normal, log_normal_tail
from panelwright.functions.tails import f_upper, normal_quantile, normal_upper, t_two_sided
from panelwright.operators.leastsquares import LinearModel
from panelwright.operators.ordering import (
    SLACK, Bracket, Moments, bracket_edges, brackets_around, column_quantiles, interpolate, median_of,
    ranked_with_count, ranks_around, select_ranks, sketched, usable, zone,
)
from panelwright.runtime import stored

# Royston (1995), algorithm AS R94. Coefficients ascend.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)
SHAPIRO_FITTED_TO = 5000

# D'Agostino and Stephens (1986), table 4.9, the law of A squared with both parameters
# estimated. Corrections by 1 / n and 1 / n^2; then, for statistics below each limit, the exponent of p or 1 - p.
ANDERSON_CORRECTION = (1.0, 0.75, 2.25)
ANDERSON_REST = ((0.2, (-13.436, 101.14, -223.73)), (0.34, (-8.318, 42.796, -59.938)))
ANDERSON_TAIL = ((0.6, (0.9177, -4.279, -1.38)), (10.0, (1.2937, -5.709, 0.0186)))
ANDERSON_LEAST = 8


@dataclass(frozen=True)
class TestResult:
    statistic: float | None
    df1: float | None
    df2: float | None
    p_value: float | None

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [tuple(None if v is None else float(v) for v in
                   (self.statistic, self.df1, self.df2, self.p_value))],
            "statistic double, df1 double, df2 double, p_value double")


def nested_f_test(small: LinearModel, big: LinearModel) -> TestResult:
    """Does the bigger of two nested models fit better? Undefined for equal models."""
    df1, df2 = small.df_residual - big.df_residual, big.df_residual
    if df1 <= 0 or df2 <= 0 or big.rss <= 0:
        return TestResult(None, df1, df2, None)
    statistic = ((small.rss - big.rss) / df1) / (big.rss / df2)
    return TestResult(statistic, df1, df2, f_upper(statistic, df1, df2))


def brown_forsythe(df: DataFrame, residual: str, by: str) -> TestResult:
    """Is the residual spread the same below and above the median of ``by``?

    A pooled two-sample t test on absolute deviations from the group medians; values equal
    to the median count as below.

    Three reads for all three medians and the deviations. A sketch brackets the median of ``by``; then
    residuals are sketched apart for rows below, inside and above that bracket, which brackets the
    median of either half; the third read keeps the rows inside a bracket and sums up all others per
    zone. The kept rows, few unless a value is common, settle the medians, and the zones' counts, sums
    and squares give the deviations from them.
    """
    rows = (df.select(F.col(residual).cast("double").alias("e"), F.col(by).cast("double").alias("x"))
            .filter(usable("e") & usable("x")))
    seen = sketched(rows.select("x"), bracket_edges([0.5]))
    if not seen:
        return TestResult(None, None, None, None)
    (low, high), = brackets_around([0.5], *seen["x"])
    n = seen["x"][0].n
    halves = _halves_in_one_read(rows, n, low, high)
    if halves is None:      # a bracket missed: the medians one after another
        halves = _halves_by_medians(rows)
    if halves is None:
        return TestResult(None, None, None, None)
    (n_low, mean_low, ss_low), (n_high, mean_high, ss_high) = halves
    freedom = n_low + n_high - 2
    if freedom <= 0:
        return TestResult(None, None, freedom, None)
    pooled = math.sqrt((ss_low + ss_high) / freedom)
    if pooled == 0:
        return TestResult(None, None, freedom, None)
    t = (mean_low - mean_high) / (pooled * math.sqrt(1 / n_low + 1 / n_high))
    return TestResult(t, None, freedom, t_two_sided(t, freedom))


_Spread = tuple[int, float, float]      # rows, mean and squared deviations of absolute deviations


def _halves_by_medians(rows: DataFrame) -> tuple[_Spread, _Spread] | None:
    middle = median_of(rows, "x")
    is_low = F.col("x") <= F.lit(middle)
    sides = {"low": F.when(is_low, F.col("e")), "high": F.when(~is_low, F.col("e"))}
    centres = column_quantiles(rows, sides, [0.5])
    if len(centres) < 2:
        return None
    found = sketched(rows.select(*[F.abs(e - F.lit(centres[k][0])).alias(k) for k, e in sides.items()]))
    return tuple((found[k][0].n, found[k][0].mean, found[k][0].squares) for k in ("low", "high"))


# Shares of a half at which its residuals are sketched: 1, 2, 4, ... slacks around its median.
_LADDER = [2.0 ** k for k in range(9)]


def _half_bracket(moments: Moments, at: Mapping[float, float], moved: int) -> Bracket:
    """Where the median lies if up to ``moved`` of the sketched rows belong to the half or not."""
    for step in _LADDER:
        if SLACK * step >= SLACK + moved / (2 * moments.n):
            return brackets_around([0.5], moments, at, SLACK * step)[0]
    return -math.inf, math.inf


def _halves_in_one_read(rows: DataFrame, n: int, low: float, high: float
                        ) -> tuple[_Spread, _Spread] | None:
    """Both halves if the median of x lies in the bracket (low, high) and those of e in theirs.

    Two reads: one to bracket the residuals, one for everything else.
    """
    x, e = F.col("x"), F.col("e")
    edges = [edge for step in _LADDER for edge in bracket_edges([0.5], SLACK * step)]
    sizes = sketched(rows.select(F.when(x <= high, e).alias("upto"), F.when(x > high, e).alias("above"),
                                 F.when(x.between(low, high), e).alias("inside")), edges)
    if len(sizes) < 3:
        return None
    n_upto, n_inside = sizes["upto"][0].n, sizes["inside"][0].n
    ranks = ranks_around(n, [0.5])
    if not n_upto - n_inside <= ranks[0] <= ranks[-1] < n_upto:
        return None
    settled = low == high       # one value: it is the median, and the halves are known
    moved = 0 if settled else n_inside
    brackets = [_half_bracket(*sizes[k], moved) for k in ("upto", "above")]
    centre = [sizes[k][0].mean for k in ("upto", "above")]
    side = F.when(x > high, 2).when((x < low) | F.lit(settled), 0).otherwise(1)
    place = F.when(F.col("side") == 0, zone(e, brackets[:1])).when(F.col("side") == 2, zone(e, brackets[1:]))
    kept = (F.col("side") == 1) | (F.col("zone") == 1)
    shifted = e - F.when(F.col("side") == 2, centre[1]).otherwise(centre[0])
    cells = stored(
        rows.withColumn("side", side).withColumn("zone", place)
        .groupBy("side", "zone", F.when(F.col("side") == 1, x).alias("x"), F.when(kept, e).alias("value"))
        .agg(F.count("*").alias("copies"), F.sum(shifted).alias("s1"), F.sum(shifted * shifted).alias("s2")))

    middle = low
    if not settled:
        places = select_ranks(
            cells.groupBy(F.lit(0).alias("variable"), F.col("side").alias("zone"), F.col("x").alias("value"))
            .agg(F.sum("copies").alias("copies")), {0: ranks})
        if places is None:
            return None
        middle = interpolate(places[0, ranks[0]], places[0, ranks[-1]], (n - 1) / 2)
    half = F.when(F.col("side") == 1, F.when(F.col("x") <= F.lit(middle), 0).otherwise(1)).otherwise(
        F.col("side") / 2).cast("int")
    halves = cells.withColumn("variable", half)
    own = F.when(F.col("variable") == 0, zone(F.col("value"), brackets[:1])).otherwise(
        zone(F.col("value"), brackets[1:]))
    halves = halves.withColumn("zone", F.when(F.col("side") == 1, own).otherwise(F.col("zone")))
    counts = {r["variable"]: r["n"] for r in halves.groupBy("variable").agg(F.sum("copies").alias("n")).collect()}
    if len(counts) < 2:
        return None
    wanted = {v: ranks_around(counts[v], [0.5]) for v in (0, 1)}
    inside = F.when(F.col("zone") % 2 == 1, F.col("value"))
    places = select_ranks(halves.groupBy("variable", "zone", inside.alias("value")).agg(
        F.sum("copies").alias("copies")), wanted)
    if places is None:
        return None
    medians = [interpolate(places[v, wanted[v][0]], places[v, wanted[v][-1]], (counts[v] - 1) / 2)
               for v in (0, 1)]
    median = F.when(F.col("variable") == 0, medians[0]).otherwise(medians[1])
    gap = median - F.when(F.col("side") == 2, centre[1]).otherwise(centre[0])
    away = F.when(F.col("value").isNotNull(), F.abs(F.col("value") - median) * F.col("copies")).otherwise(
        (F.col("s1") - F.col("copies") * gap) * (F.col("zone") - 1))
    squares = F.when(F.col("value").isNotNull(), F.pow(F.col("value") - median, 2) * F.col("copies")).otherwise(
        F.col("s2") - 2 * gap * F.col("s1") + F.col("copies") * gap * gap)
    sums = {r["variable"]: r for r in halves.groupBy("variable").agg(
        F.sum(away).alias("away"), F.sum(squares).alias("squares")).collect()}
    return tuple((counts[v], sums[v]["away"] / counts[v],
                  max(0.0, sums[v]["squares"] - sums[v]["away"] ** 2 / counts[v])) for v in (0, 1))


def normal_pairs(df: DataFrame, value: str, key: str) -> DataFrame:
    """Every value with its rank, plotting position and normal score."""
    rows = (df.select(key, F.col(value).cast("double").alias(value)).filter(usable(value)))
    ranked, n = ranked_with_count(rows, [value, key])
    offset = 0.375 if n <= 10 else 0.5
    position = (F.col("rank") - F.lit(offset)) / F.lit(n + 1 - 2 * offset)
    return (ranked.withColumn("position", position)
            .withColumn("score", inverse_normal("position")))


def _poly(x: float, ascending: tuple[float, ...]) -> float:
    return sum(c * x ** i for i, c in enumerate(ascending))


def _shapiro_p(w: float, n: int) -> float | None:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1.0:
        return 1.0
    if n <= 11:
        gamma = _poly(n, SMALL_GAMMA)
        if math.log1p(-w) >= gamma:
            return 1e-99
        y = -math.log(gamma - math.log1p(-w))
        mean, spread = _poly(n, SMALL_MEAN), math.exp(_poly(n, SMALL_SPREAD))
    else:
        log_n = math.log(n)
        y = math.log1p(-w)
        mean, spread = _poly(log_n, LARGE_MEAN), math.exp(_poly(log_n, LARGE_SPREAD))
    return normal_upper((y - mean) / spread)


def anderson_p(statistic: float, n: int) -> float | None:
    """p-value of A squared against a normal law of unknown mean and spread.

    The correction for n fades out, so the law holds for any number of values from 8 on. Beyond a corrected
    statistic of 10 (p below 1e-23) the exponent goes on along its tangent.
    """
    if n < ANDERSON_LEAST:
        return None
    a = statistic * _poly(1 / n, ANDERSON_CORRECTION)
    for limit, exponent in ANDERSON_REST:
        if a < limit:
            return -math.expm1(_poly(a, exponent))
    for limit, exponent in ANDERSON_TAIL:
        if a < limit:
            return math.exp(_poly(a, exponent))
    slope = exponent[1] + 2 * exponent[2] * limit
    return math.exp(_poly(limit, exponent) + slope * (a - limit))


@dataclass(frozen=True)
class Normality:
    """Two tests of the same values. ``df2`` is their number."""

    shapiro: TestResult
    anderson: TestResult


def shapiro_wilk(df: DataFrame, value: str, key: str) -> TestResult:
    """Normality test. p is None beyond 5000 values, up to which its approximation was fitted."""
    return normality(df, value, key).shapiro


def anderson_darling(df: DataFrame, value: str, key: str) -> TestResult:
    """Normality test whose p holds for any number of values from 8 on."""
    return normality(df, value, key).anderson


def normality(df: DataFrame, value: str, key: str) -> Normality:
    """Shapiro-Wilk and Anderson-Darling from one ranking.

    Both statistics are None for fewer than three values or when all are equal. NULL and NaN are left out.
    """
    rows = (df.select(key, F.col(value).cast("double").alias("v")).filter(usable("v")))
    ranked, n = ranked_with_count(rows, ["v", key])
    facts = ranked.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
                       F.min("v").alias("low"), F.max("v").alias("high")).first()
    if n < 3 or facts["low"] == facts["high"]:
        return Normality(TestResult(None, None, n, None), TestResult(None, None, n, None))
    score = inverse_normal((F.col("rank") - 0.375) / F.lit(n + 0.25))
    centred = F.col("v") - F.lit(facts["mean"])
    z = centred / F.lit(facts["sd"])
    # Rank i adds ln P(below) once for every pair it is the lower part of, and ln P(above) for the others.
    logs = ((2 * F.col("rank") - 1) * log_normal_tail(-z)
            + (2 * (F.lit(n) - F.col("rank")) + 1) * log_normal_tail(z))
    # The two largest weights have their own formula, so their terms are kept apart.
    tails = {1: 0.0, 2: 0.0, n - 1: 0.0, n: 0.0}
    sums = ranked.agg(
        F.sum(score * score).alias("mm"),
        F.sum(centred * centred).alias("ss"),
        F.sum(F.when(F.col("rank").between(3, n - 2), score * centred)).alias("middle"),
        F.sum(logs / F.lit(n) + 1).alias("excess"),
        *[F.sum(F.when(F.col("rank") == r, centred)).alias(f"x{r}") for r in tails]).first()
    w = _shapiro_w(sums, n)
    p = _shapiro_p(w, n) if n <= SHAPIRO_FITTED_TO else None
    a = -sums["excess"]
    return Normality(TestResult(w, None, n, p), TestResult(a, None, n, anderson_p(a, n)))


def _shapiro_w(sums: Mapping[str, float], n: int) -> float:
    mm = sums["mm"]
    if n == 3:
        last = math.sqrt(0.5)
        top = last * (sums["x3"] - sums["x1"])
    else:
        def m(rank: int) -> float:
            return normal_quantile((rank - 0.375) / (n + 0.25))

        u = 1 / math.sqrt(n)
        last = _poly(u, LAST_WEIGHT) + m(n) / math.sqrt(mm)
        if n > 5:
            following = _poly(u, NEXT_WEIGHT) + m(n - 1) / math.sqrt(mm)
            phi = ((mm - 2 * m(n) ** 2 - 2 * m(n - 1) ** 2)
                   / (1 - 2 * last ** 2 - 2 * following ** 2))
            outer = following * (sums[f"x{n - 1}"] - sums["x2"])
            middle = sums["middle"] or 0.0
        else:
            phi = (mm - 2 * m(n) ** 2) / (1 - 2 * last ** 2)
            # With four or five values only the outermost pair has its own formula.
            outer = m(n - 1) * (sums[f"x{n - 1}"] - sums["x2"]) / math.sqrt(phi)
            middle = sums["middle"] or 0.0
        top = last * (sums[f"x{n}"] - sums["x1"]) + outer + middle / math.sqrt(phi)
    return min(1.0, top * top / sums["ss"])
