"""Least squares, diagnostics, transformations, selection and validation.

The regression sample is one row per order: the order's gross value against quantity,
summed discount, summed tax and number of lines. The checking SQL solves the normal
equations with the sweep operator, independently of the QR used by the queries.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelwright.functions.shares import power
from panelwright.functions.normal import (
    CENTRE_DEN, CENTRE_NUM, SHOULDER_DEN, SHOULDER_NUM, TAIL_DEN, TAIL_NUM,
)
from panelwright.operators import boxcox, diagnostics, feeds, leastsquares as ls, scoring, selection
from panelwright.operators.ordering import keyed_split
from panelwright.plans import dataset as ds, study
from panelwright.runtime import scratch_path, stored
from panelwright.sources import files
from workload import sqlkit, standins as st
from workload.registry import query, round_all, rounded, table

Y = "gross"
X = ["quantity", "discount", "tax", "lines"]
_OLS = sqlkit.ols_ctes("facts", Y, X)
_FIT = sqlkit.fitted(X)
_SCORED = f"""{st.FACTS_SQL}, {_OLS},
scored AS (SELECT facts.*, {_FIT} AS yhat, gross - ({_FIT}) AS residual FROM facts, ols)"""


def _facts(spark, sf):
    return st.order_facts(spark, sf)


def _stored_facts(spark, sf):
    """The sample as a table, for queries that read it several times."""
    return stored(_facts(spark, sf), "facts")


def _model(spark, sf, predictors=None):
    return ls.fit(_facts(spark, sf), Y, predictors or X)


def _scored(spark, sf):
    facts = _stored_facts(spark, sf)
    return ls.fit(facts, Y, X).score(facts)


_WIDTH = len(X) + 1


def _coefficient_sql() -> str:
    spread = " + ".join(f"m_{a} * m_{b} * -a[{i * _WIDTH + j + 1}]"
                        for i, a in enumerate(X) for j, b in enumerate(X))
    parts = [f"SELECT '(Intercept)' AS term, b0 AS estimate, "
             f"sqrt(rss / (n - {_WIDTH}) * (1 / n + {spread})) AS std_error FROM ols"]
    for i, x in enumerate(X):
        diagonal = f"a[{i * _WIDTH + i + 1}]"
        parts.append(f"SELECT '{x}', b{i + 1}, sqrt(rss / (n - {_WIDTH}) * -({diagonal})) FROM ols")
    return " UNION ALL ".join(parts)


def _t_tail_sql(source: str) -> str:
    """CTE ``tail``: two-sided t probability by Simpson's rule over the density (columns t, df)."""
    density = ("exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) "
               "* pow(1 + pow(abs(t) * i / 4000, 2) / df, -(df + 1) / 2)")
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""tail AS (
  SELECT t, df, 1 - 2 * sum({weight} * {density}) * abs(t) / 12000 AS p
  FROM {source}, range(0, 4001) x(i) GROUP BY t, df)"""


# Beyond 40 the probability is 0 in every digit shown, and the rule's steps would be too long.
@query("I1 I2 I17", f"""
WITH {st.FACTS_SQL}, {_OLS}, c AS ({_coefficient_sql()}),
t AS (SELECT c.*, least(abs(estimate / std_error), 40) AS t, (n - {_WIDTH})::DOUBLE AS df FROM c, ols),
{_t_tail_sql('t')}
SELECT term, round(estimate, 4) + 0.0 AS estimate, round(std_error, 5) + 0.0 AS std_error,
       round(estimate / std_error, 4) + 0.0 AS t_value, abs(round(p, 6)) + 0.0 AS p_value
FROM t JOIN tail USING (t, df)""")
def ols_fit(spark, sf):
    rows = _model(spark, sf).coefficient_frame(spark)
    return rows.select(
        "term", rounded("estimate", 4).alias("estimate"), rounded("std_error", 5).alias("std_error"),
        rounded("t_value", 4).alias("t_value"), rounded("p_value", 6).alias("p_value"))


@query("I2 I5 I19", f"""
WITH {st.FACTS_SQL}, {_OLS},
s AS (SELECT n::DOUBLE AS n, 4 AS p, rss, tss, 1 - rss / tss AS r2 FROM ols),
q AS (SELECT *, n - p - 1 AS df FROM s)
SELECT 'n' AS measure, n AS value FROM q UNION ALL SELECT 'df_residual', df FROM q
UNION ALL SELECT 'sigma', round(sqrt(rss / df), 4) + 0.0 FROM q
UNION ALL SELECT 'r_squared', round(r2, 8) + 0.0 FROM q
UNION ALL SELECT 'adj_r_squared', round(1 - (1 - r2) * (n - 1) / df, 8) + 0.0 FROM q
UNION ALL SELECT 'f_statistic', round(((tss - rss) / p) / (rss / df), 2) + 0.0 FROM q
UNION ALL SELECT 'f_p_value', round(pow(rss / tss, df / 2) * (1 + df / 2 * (1 - rss / tss)), 8) + 0.0 FROM q
UNION ALL SELECT 'deviance_per_row', round(rss / n, 2) + 0.0 FROM q""")
def ols_summary(spark, sf):
    m = _model(spark, sf)
    rows = [("n", float(m.n)), ("df_residual", float(m.df_residual)), ("sigma", round(m.sigma, 4)),
            ("r_squared", round(m.r_squared, 8)), ("adj_r_squared", round(m.adj_r_squared, 8)),
            ("f_statistic", round(m.f_statistic, 2)), ("f_p_value", round(m.f_p_value, 8)), ("deviance_per_row", round(m.deviance / m.n, 2))]
    return spark.createDataFrame(rows, "measure string, value double")


@query("I2", f"""
WITH {_SCORED}
SELECT unnest(['min', 'q1', 'median', 'q3', 'max']) AS point,
       unnest([round(x, 3) + 0.0 for x in quantile_cont(residual, [0, 0.25, 0.5, 0.75, 1])]) AS residual FROM scored""")
def residual_quantiles(spark, sf):
    facts = _stored_facts(spark, sf)
    found = ls.fit(facts, Y, X).residual_quantiles(facts)
    return round_all(spark.createDataFrame(
        list(zip(("min", "q1", "median", "q3", "max"), found)), "point string, residual double"), 3)


@query("I3 I4 I18 D10", f"""
WITH {_SCORED}
SELECT order_key, round(yhat, 2) + 0.0 AS yhat, round(residual, 2) + 0.0 AS residual FROM scored""")
def ols_score(spark, sf):
    return round_all(_scored(spark, sf).select("order_key", "yhat", "residual"), 2)


@query("I5 E11", f"""
WITH {_SCORED}
SELECT count(*) AS n, round(sum(residual * residual) / count(*), 2) + 0.0 AS rss_per_row,
       round(var_pop(gross), 2) + 0.0 AS tss_per_row,
       round(1 - sum(residual * residual) / (var_pop(gross) * count(*)), 8) + 0.0 AS r_squared FROM scored""")
def r_squared(spark, sf):
    sums = scoring.fit_sums(_scored(spark, sf), Y, "residual")
    return sums.select("n", rounded(F.col("rss") / F.col("n"), 2).alias("rss_per_row"),
                       rounded(F.col("tss") / F.col("n"), 2).alias("tss_per_row"),
                       rounded("r_squared", 8).alias("r_squared"))


@query("I16", f"""
WITH {_SCORED},
g AS (SELECT flag, 1 - sum(residual * residual) / (var_pop(gross) * count(*)) AS r FROM scored GROUP BY 1)
SELECT order_key, flag, round(r, 8) + 0.0 AS rsq_flag FROM scored JOIN g USING (flag)""")
def r_squared_by_group(spark, sf):
    found = scoring.results_table(_scored(spark, sf), "order_key", "flag", Y, {"rsq_flag": "residual"})
    return round_all(found, 8)


@query("A12 E3 I16", f"""
WITH {_SCORED},
g AS (SELECT flag, 1 - sum(residual * residual) / (var_pop(gross) * count(*)) AS r FROM scored GROUP BY 1),
t AS (SELECT r FROM scored JOIN g USING (flag))
{' UNION ALL '.join(f"SELECT 'rsq_flag' AS variable, {p}::INTEGER AS percentile, round(quantile_cont(r, {p / 100}), 8) + 0.0 AS value FROM t" for p in range(0, 101, 5))}""")
def results_percentiles(spark, sf):
    """Results table written, read back as a table, and summarised."""
    from panelwright.operators.summary import percentile_grid
    found = scoring.results_table(_scored(spark, sf), "order_key", "flag", Y, {"rsq_flag": "residual"})
    path = scratch_path(spark, "results")
    found.write.parquet(path)
    return round_all(percentile_grid(spark.read.parquet(path), ["rsq_flag"]), 8)


@query("A13 D10", f"""
WITH {_SCORED}
SELECT order_key, round(residual, 2) + 0.0 AS residual, round(yhat, 2) + 0.0 AS yhat FROM scored""")
def residual_sink(spark, sf):
    """Residuals and predictions written to CSV under their keys, read back and joined."""
    written = files.write_model_outputs(
        _scored(spark, sf), "order_key", {"residuals": "residual", "predict": "yhat"},
        scratch_path(spark, "outputs"), "primary")
    left = files.read_keyed_csv(spark, written["residuals"], ["order_key"], {"residual": "double"}, exact=True)
    right = files.read_keyed_csv(spark, written["predict"], ["order_key"], {"yhat": "double"}, exact=True)
    both = left.join(right, "order_key")
    return round_all(both.withColumn("order_key", F.col("order_key").cast("long")), 2)


_OLS_SMALL = sqlkit.ols_ctes("facts", Y, X[:2], "small")


@query("I6", f"""
WITH {st.FACTS_SQL}, {_OLS}, {_OLS_SMALL},
d AS (SELECT small.rss AS r0, ols.rss AS r1, (ols.n - 5)::DOUBLE AS df FROM ols, small)
SELECT round(((r0 - r1) / 2) / (r1 / df), 3) + 0.0 AS statistic, 2.0::DOUBLE AS df1, df AS df2,
       round(pow(r1 / r0, df / 2), 8) + 0.0 AS p_value FROM d""")
def f_test(spark, sf):
    big = _model(spark, sf)
    found = diagnostics.nested_f_test(big.subset(X[:2]), big)
    return round_all(found.frame(spark), 3, p_value=8)


@query("I7 C9 E6", f"""
WITH {_SCORED},
h AS (SELECT residual AS e, yhat <= (SELECT median(yhat) FROM scored) AS low FROM scored),
m AS (SELECT low, median(e) AS med FROM h GROUP BY 1),
d AS (SELECT low, abs(e - med) AS d FROM h JOIN m USING (low)),
s AS (SELECT low, count(*) AS n, avg(d) AS mean, var_pop(d) * count(*) AS ss FROM d GROUP BY 1),
w AS (SELECT a.n AS n1, b.n AS n2, a.mean - b.mean AS diff, a.ss + b.ss AS ss
      FROM s a, s b WHERE a.low AND NOT b.low),
t AS (SELECT diff / (sqrt(ss / (n1 + n2 - 2)) * sqrt(1 / n1 + 1 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM w),
{_t_tail_sql('t')}
SELECT round(t, 5) + 0.0 AS statistic, df, round(p, 8) + 0.0 AS p_value FROM tail""")
def brown_forsythe(spark, sf):
    found = diagnostics.brown_forsythe(_scored(spark, sf), "residual", "yhat")
    return found.frame(spark).select(rounded("statistic", 5).alias("statistic"), F.col("df2").alias("df"),
                                     rounded("p_value", 8).alias("p_value"))


def _poly_sql(x: str, ascending) -> str:
    highest, *rest = reversed(ascending)
    text = f"{highest!r}::DOUBLE"
    for c in rest:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def _quantile_sql(p: str) -> str:
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    near = f"(0.180625 - {q} * {q})"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly_sql(near, CENTRE_NUM)} / {_poly_sql(near, CENTRE_DEN)} "
            f"WHEN {r} <= 5 THEN sign({q}) * {_poly_sql(f'({r} - 1.6)', SHOULDER_NUM)} / {_poly_sql(f'({r} - 1.6)', SHOULDER_DEN)} "
            f"ELSE sign({q}) * {_poly_sql(f'({r} - 5)', TAIL_NUM)} / {_poly_sql(f'({r} - 5)', TAIL_DEN)} END")


@query("I9 J3", f"""
WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank,
                  count(*) OVER () AS n FROM customer),
p AS (SELECT *, (rank - 0.5)::DOUBLE / n AS position FROM r)
SELECT c_custkey, c_acctbal, rank, round(position, 8) + 0.0 AS position,
       round({_quantile_sql('position')}, 6) + 0.0 AS score FROM p""")
def qq_pairs(spark, sf):
    return round_all(diagnostics.normal_pairs(table(spark, sf, "customer"), "c_acctbal", "c_custkey"),
                     position=8)


_LAST = _poly_sql("u", diagnostics.LAST_WEIGHT)
_NEXT = _poly_sql("u", diagnostics.NEXT_WEIGHT)


@query("I8", f"""
WITH r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank,
                  count(*) OVER () AS n, avg(c_acctbal) OVER () AS mean FROM customer),
p AS (SELECT *, (rank - 0.375)::DOUBLE / (n + 0.25)::DOUBLE AS pos FROM r),
m AS (SELECT *, {_quantile_sql('pos')} AS m FROM p),
t AS (SELECT n, 1 / sqrt(n) AS u, sum(m * m) OVER () AS mm,
             max(m) FILTER (rank = n) OVER () AS mn, max(m) FILTER (rank = n - 1) OVER () AS mp,
             rank, v, mean, m FROM m),
a AS (SELECT *, {_LAST} + mn / sqrt(mm) AS a1, {_NEXT} + mp / sqrt(mm) AS a2 FROM t),
w AS (SELECT *, CASE WHEN rank IN (1, n) THEN sign(m) * a1 WHEN rank IN (2, n - 1) THEN sign(m) * a2
        ELSE m / sqrt((mm - 2 * mn * mn - 2 * mp * mp) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS weight FROM a),
s AS (SELECT pow(sum(weight * v), 2) / sum((v - mean) * (v - mean)) AS statistic,
             any_value(n)::DOUBLE AS n, ln(any_value(n)) AS k FROM w),
z AS (SELECT statistic, n, (ln(1 - statistic) - (-1.5861 - 0.31082 * k - 0.083751 * k * k + 0.0038915 * k * k * k))
             / exp(-0.4803 - 0.082676 * k + 0.0030302 * k * k) AS z FROM s)
SELECT round(statistic, 8) + 0.0 AS statistic, n, CASE WHEN n <= 5000 THEN abs(round(0.5 - sign(z) * sum(
         CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
         * exp(-pow(least(abs(z), 12) * i / 4000, 2) / 2)) * least(abs(z), 12) / 12000 / sqrt(2 * pi()), 8))
         + 0.0 END AS p_value
FROM z, range(0, 4001) x(i) GROUP BY statistic, n, z""")
def shapiro(spark, sf):
    found = diagnostics.shapiro_wilk(table(spark, sf, "customer"), "c_acctbal", "c_custkey")
    return found.frame(spark).select(rounded("statistic", 8).alias("statistic"), F.col("df2").alias("n"),
                                     rounded("p_value", 8).alias("p_value"))


# Simpson's rule for the normal law; the p-value's constants are those of the published table.
@query("I8", """
WITH r AS (SELECT (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z,
                  row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank, count(*) OVER () AS n FROM customer),
c AS (SELECT any_value(rank) AS rank, any_value(n) AS n, 0.5 + sum(
           CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
           * exp(-pow(z * i / 200, 2) / 2)) * z / 600 / sqrt(2 * pi()) AS below
      FROM r, range(0, 201) t(i) GROUP BY rank, z),
s AS (SELECT any_value(n)::DOUBLE AS n, -any_value(n) - sum(
           (2 * rank - 1) * ln(below) + (2 * (n - rank) + 1) * ln(1 - below)) / any_value(n) AS statistic FROM c),
a AS (SELECT *, statistic * (1 + 0.75::DOUBLE / n + 2.25::DOUBLE / (n * n)) AS a FROM s)
SELECT round(statistic, 6) + 0.0 AS statistic, n, round(CASE
         WHEN n < 8 THEN NULL
         WHEN a < 0.2 THEN 1 - exp(-13.436 + 101.14 * a - 223.73 * a * a)
         WHEN a < 0.34 THEN 1 - exp(-8.318 + 42.796 * a - 59.938 * a * a)
         WHEN a < 0.6 THEN exp(0.9177 - 4.279 * a - 1.38 * a * a)
         WHEN a < 10 THEN exp(1.2937 - 5.709 * a + 0.0186 * a * a)
         ELSE exp(1.2937 - 57.09 + 1.86 - 5.337 * (a - 10)) END, 10) + 0.0 AS p_value
FROM a""")
def anderson(spark, sf):
    found = diagnostics.anderson_darling(table(spark, sf, "customer"), "c_acctbal", "c_custkey")
    return found.frame(spark).select(rounded("statistic").alias("statistic"), F.col("df2").alias("n"),
                                     rounded("p_value", 10).alias("p_value"))


# ------------------------------------------------------------------ transformations

_BX = ["quantity", "lines"]
_GRID = boxcox.exponent_grid(-30, 30, 10)


def _values(grid) -> str:
    return "VALUES " + ", ".join(f"({e!r}::DOUBLE)" for e in grid)


def _profile_sql(exponents: str, source: str = "facts", y: str = "gross", xs=_BX,
                 name: str = "profile") -> str:
    """CTE ``name`` (lambda, sse) over a query that lists the exponents."""
    width = len(xs) + 1
    inner, matrix = f"SELECT lam, {sqlkit.gram([*xs, 'w'])} AS a FROM {name}_t GROUP BY lam", "a"
    for k in range(len(xs)):
        inner = f"SELECT lam, {sqlkit.swept(width, str(k), matrix)} AS a FROM ({inner})"
    return f"""
{name}_k AS (SELECT exp(avg(ln({y}))) AS g FROM {source}),
{name}_l(lam) AS ({exponents}),
{name}_t AS (SELECT lam, {', '.join(xs)},
             CASE WHEN lam = 0 THEN g * ln({y}) ELSE g * pow({y} / g, lam) / nullif(lam, 0) END AS w
      FROM {source}, {name}_k, {name}_l),
{name} AS (SELECT lam AS "lambda", a[{width * width}] AS sse FROM ({inner}))"""


def _finer(profile: str, per_unit: int) -> str:
    """Exponents at steps of 1/per_unit around the best of a profile, two former steps either way."""
    return (f'SELECT (round(best * {per_unit // 10}) * 10 + i) / {per_unit}::DOUBLE FROM '
            f'(SELECT min_by("lambda", (sse, "lambda")) AS best FROM {profile}), range(-20, 21) s(i)')


@query("I10 J4 B30", f"""
WITH {st.FACTS_SQL}, {_profile_sql(_values(_GRID))}
SELECT "lambda", round(ln(sse), 6) + 0.0 AS log_sse FROM profile""")
def boxcox_profile(spark, sf):
    found = boxcox.profile(_facts(spark, sf), Y, _BX, _GRID)
    return found.frame(spark).select("lambda", rounded(F.ln("sse"), 6).alias("log_sse"))


@query("G3 I10 B29", f"""
WITH moved AS (SELECT c_acctbal + 1100 AS y, c_custkey::DOUBLE AS x1, c_nationkey::DOUBLE AS x2 FROM customer),
{_profile_sql(_values(_GRID), 'moved', 'y', ['x1', 'x2'])}
SELECT min_by("lambda", (sse, "lambda")) AS best, round(ln(min(sse)), 6) + 0.0 AS log_sse FROM profile""")
def boxcox_best(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    found = boxcox.profile(people, "c_acctbal", ["c_custkey", "c_nationkey"], _GRID, shift=1100)
    frame = found.frame(spark)
    return frame.agg(F.min_by("lambda", F.struct("sse", "lambda")).alias("best"),
                     rounded(F.ln(F.min("sse")), 6).alias("log_sse"))


@query("I11", f"""
WITH {st.FACTS_SQL}, {_profile_sql(_values(_GRID), name='r1')},
{_profile_sql(_finer('r1', 100), name='r2')}, {_profile_sql(_finer('r2', 1000), name='r3')}
{' UNION ALL '.join(f"""
SELECT {i}::INTEGER AS round, round(min_by("lambda", (sse, "lambda")), 6) + 0.0 AS best,
       round(ln(min(sse)), 8) + 0.0 AS log_sse, count(*)::INTEGER AS fits FROM r{i}""" for i in (1, 2, 3))}""")
def boxcox_refine(spark, sf):
    rounds = boxcox.refine(_stored_facts(spark, sf), Y, _BX)
    rows = [(i, p.best, math.log(min(s for _, s in p.points)), len(p.points))
            for i, p in enumerate(rounds, 1)]
    frame = spark.createDataFrame(rows, "round int, best double, log_sse double, fits int")
    return round_all(frame, log_sse=8)


_POWER = 0.55


@query("I12 B30", f"""
WITH {st.FACTS_SQL}, raised AS (SELECT *, pow(gross, {_POWER}) AS y_power FROM facts),
{sqlkit.ols_ctes('raised', 'y_power', X)}
SELECT order_key, round(y_power, 4) + 0.0 AS y_power, round({_FIT}, 4) + 0.0 AS yhat FROM raised, ols""")
def transformed_model(spark, sf):
    raised = _stored_facts(spark, sf).withColumn("y_power", power(Y, _POWER))
    scored = ls.fit(raised, "y_power", X).score(raised)
    return round_all(scored.select("order_key", "y_power", "yhat"), 4)


@query("B27 I1 I17", f"""
WITH {st.FACTS_SQL}, crossed AS (SELECT *, discount * lines AS discount_lines FROM facts),
{sqlkit.ols_ctes('crossed', Y, [*X, 'discount_lines'])}
SELECT 'discount_lines' AS term, round(b5, 4) + 0.0 AS estimate, round(1 - rss / tss, 8) + 0.0 AS r_squared FROM ols""")
def ols_interaction(spark, sf):
    frame, terms = ls.design(_facts(spark, sf), "order_key", Y, X, {"discount_lines": ("discount", "lines")})
    model = ls.fit(frame, Y, terms)
    return spark.createDataFrame(
        [("discount_lines", round(model.coefficients["discount_lines"], 4), round(model.r_squared, 8))],
        "term string, estimate double, r_squared double")


# ------------------------------------------------------------------ selection and validation

_POOL = ["quantity", "discount", "tax", "lines", "open_lines"]
_SUBSETS = sqlkit.subset_ctes("facts", Y, _POOL)
_ALL = (1 << len(_POOL)) - 1


@query("I13", f"""
WITH RECURSIVE {st.FACTS_SQL}, {_SUBSETS},
scores AS (SELECT mask, size, n * ln(rss / n) + 2 * (size + 1) AS aic FROM subsets),
path(step, mask, aic) AS (
  SELECT 0, mask, aic FROM scores WHERE mask = {_ALL}
  UNION ALL
  SELECT step + 1, b.mask, b.aic FROM path,
    LATERAL (SELECT s.mask, s.aic FROM scores s
             WHERE s.mask & path.mask = s.mask AND s.size = bit_count(path.mask) - 1
             ORDER BY s.aic LIMIT 1) b
  WHERE b.aic < path.aic)
SELECT step, round(aic, 5) + 0.0 AS aic, CAST(bit_count(mask) AS INTEGER) AS n_predictors,
       CAST({' + '.join(f"((mask >> {i}) & 1) * {1 << i}" for i in range(len(_POOL)))} AS INTEGER) AS kept FROM path""")
def step_aic(spark, sf):
    _, path = selection.backward_by_aic(_model(spark, sf, _POOL))
    rows = [(i, round(s.aic, 5), len(s.predictors), sum(1 << _POOL.index(p) for p in s.predictors))
            for i, s in enumerate(path)]
    return spark.createDataFrame(rows, "step int, aic double, n_predictors int, kept int")


_REPLICATES = 100
_CONSTANTS = ", ".join(
    f"({r}, {a}::BIGINT, {b}::BIGINT)" for r, (a, b) in enumerate(selection.draw_constants(_REPLICATES, 37)))
_P = len(_POOL)
_W = _P + 1


def _sums(columns, condition: str) -> str:
    """Raw cross-products of (columns, 1) over the rows that meet a condition."""
    full = [*columns, "1.0::DOUBLE"]
    return "[" + ", ".join(f"sum({a} * {b}) FILTER ({condition})" for a in full for b in full) + "]"


def _centre(raw: str, width: int) -> str:
    """Centred matrix of the first ``width`` columns from raw sums of width + 1."""
    q = width + 1
    cells = [f"{raw}[{i * q + j + 1}] - {raw}[{i * q + q}] * {raw}[{j * q + q}] / {raw}[{q * q}]"
             for i in range(width) for j in range(width)]
    return f"[{', '.join(cells)}]"


def _held_out_error() -> str:
    """Mean squared held-out error from raw sums ``v``, swept training matrix ``a`` and means."""
    q = _W + 1
    weights = [f"(CASE WHEN (mask >> {i}) & 1 = 1 THEN a[{i * _W + _W}] ELSE 0 END)" for i in range(_P)]
    weights.append("(-1)")
    shift = " - ".join([f"t[{_P * q + q}] / t[{q * q}]",
                        *[f"{w} * t[{i * q + q}] / t[{q * q}]" for i, w in enumerate(weights[:-1])]])
    weights.append("b0")
    total = " + ".join(f"{weights[i]} * {weights[j]} * v[{i * q + j + 1}]"
                       for i in range(q) for j in range(q))
    return shift, f"({total}) / v[{q * q}]"


_SHIFT, _ERROR = _held_out_error()


_MASK = " + ".join(f"((mask >> {i}) & 1) * {1 << i}" for i in range(_P))
_CHOICE = f"""{st.FACTS_SQL},
size_of AS (SELECT count(*) AS n, ceil(count(*) * (1 - 1 / (ln(count(*)) - 1))) AS d FROM facts),
draws(r, ca, cb) AS (VALUES {_CONSTANTS}),
centred AS (SELECT order_key, {', '.join(f'{c} - avg({c}) OVER () AS {c}' for c in [*_POOL, Y])} FROM facts),
numbered AS (SELECT *, CAST('0x' || substring(md5(CAST(order_key AS VARCHAR) || ':37'), 1, 8) AS BIGINT)
               % 2147483647 AS h FROM centred),
drawn AS (SELECT numbered.*, r, (ca * h + cb) % 2147483647
            < floor((1 - d / n) * 2147483647) AS trains FROM numbered, draws, size_of),
sums AS (SELECT r, {_sums([*_POOL, Y], 'trains')} AS t, {_sums([*_POOL, Y], 'NOT trains')} AS v
         FROM drawn GROUP BY r
         UNION ALL SELECT -1, {_sums([*_POOL, Y], 'true')}, NULL FROM centred),
sweeps(r, mask, k, a) AS (
  SELECT r, CAST(mask AS INTEGER), 0, {_centre('t', _W)} FROM sums, range(0, {1 << _P}) x(mask)
  UNION ALL
  SELECT r, mask, k + 1, CASE WHEN (mask >> k) & 1 = 1 THEN {sqlkit.swept(_W, 'k')} ELSE a END
  FROM sweeps WHERE k < {_P}),
ranked AS (SELECT r, mask, bit_count(mask) AS size, a,
             row_number() OVER (PARTITION BY r, bit_count(mask) ORDER BY a[{_W * _W}]) AS rn
           FROM sweeps WHERE k = {_P}),
whole AS (SELECT size, mask, a FROM ranked WHERE r = -1 AND rn = 1),
scored AS (SELECT mask, a, v, {_SHIFT} AS b0 FROM ranked JOIN sums USING (r) WHERE rn = 1 AND r >= 0),
errors AS (SELECT bit_count(mask) AS size, avg({_ERROR}) AS e, count(*) AS replicates FROM scored GROUP BY 1)"""


@query("I14", f"""
WITH RECURSIVE {_CHOICE}
SELECT CAST(size AS INTEGER) AS size, round(ln(e), 6) + 0.0 AS log_error,
       CAST(replicates AS INTEGER) AS replicates, e = min(e) OVER () AS chosen,
       CAST({_MASK} AS INTEGER) AS kept FROM errors JOIN whole USING (size)""")
def best_subset_cv(spark, sf):
    found = selection.best_subset_cv(_stored_facts(spark, sf), Y, _POOL, "order_key", _REPLICATES)
    kept = F.aggregate("predictors", F.lit(0), lambda total, name: total + F.lit(1).cast("int") * sum(
        F.when(name == p, 1 << i).otherwise(0) for i, p in enumerate(_POOL)))
    return found.frame(spark).select("size", rounded(F.ln("cv_error"), 6).alias("log_error"),
                                     "replicates", "chosen", kept.alias("kept"))


@query("I14 I6", f"""
WITH RECURSIVE {_CHOICE},
best AS (SELECT size, mask, a FROM errors JOIN whole USING (size) ORDER BY e, size LIMIT 1),
fits AS (SELECT best.size, mask, best.a, best.a[{_W * _W}] AS rss, f.a[{_W * _W}] AS rss_full, n
         FROM best, (SELECT a FROM whole WHERE size = {_P}) f, size_of)
{' UNION ALL '.join(
    f"SELECT 'coefficient' AS kind, '{c}' AS name, "
    f"CASE WHEN (mask >> {i}) & 1 = 1 THEN round(a[{i * _W + _W}], 4) + 0.0 END AS value FROM fits"
    for i, c in enumerate(_POOL))}
UNION ALL SELECT 'model', 'size', size::DOUBLE FROM fits
UNION ALL SELECT 'model', 'rss_per_row', round(rss / n, 2) + 0.0 FROM fits
UNION ALL SELECT 'model', 'f_against_all', CASE WHEN size < {_P} THEN
  round(((rss - rss_full) / ({_P} - size)) / (rss_full / (n - {_P} - 1)), 4) + 0.0 END FROM fits""")
def best_subset_model(spark, sf):
    """The winner with its coefficients and the F test against all predictors."""
    facts = _stored_facts(spark, sf)
    model = selection.best_subset_cv(facts, Y, _POOL, "order_key", _REPLICATES).model
    test = diagnostics.nested_f_test(model, ls.fit(facts, Y, _POOL))
    rows = [("coefficient", c, model.coefficients.get(c)) for c in _POOL]
    rows += [("model", "size", float(len(model.predictors))), ("model", "rss_per_row", model.rss / model.n),
             ("model", "f_against_all", test.statistic)]
    places = {"coefficient": 4, "rss_per_row": 2}
    return spark.createDataFrame(
        [(kind, name, None if v is None else round(v, places.get(kind, places.get(name, 4)))) for kind, name, v in rows],
        "kind string, name string, value double")


def _split_facts_sql(seed: int = 37) -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5(CAST(order_key AS VARCHAR) || ':{seed}')) AS rn,
         count(*) OVER () AS total FROM facts),
training AS (SELECT * FROM ranked WHERE rn > floor(total * 0.2)),
validation AS (SELECT * FROM ranked WHERE rn <= floor(total * 0.2))"""


@query("I15 I18 G4 C10", f"""
WITH {st.FACTS_SQL}, {_split_facts_sql()}, {sqlkit.ols_ctes('training', Y, X, 'full_fit')},
{sqlkit.ols_ctes('training', Y, X[:2], 'small_fit')}
SELECT round(sqrt(avg(pow(gross - ({sqlkit.fitted(X, 'full_fit')}), 2))), 4) + 0.0 AS full_model,
       round(sqrt(avg(pow(gross - ({sqlkit.fitted(X[:2], 'small_fit')}), 2))), 4) + 0.0 AS small_model,
       count(*) AS n FROM validation, full_fit, small_fit""")
def rmspe(spark, sf):
    validation, training = keyed_split(_stored_facts(spark, sf), "order_key", 0.2, 37)
    full = ls.fit(training, Y, X)
    small = full.subset(X[:2])
    return validation.agg(
        rounded(scoring.rmspe(Y, full.fitted()), 4).alias("full_model"),
        rounded(scoring.rmspe(Y, small.fitted()), 4).alias("small_model"), F.count("*").alias("n"))


@query("J3 G5 B31", f"""
WITH {_SCORED},
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(order_key AS VARCHAR) || ':101')) AS rn,
                  count(*) OVER () AS total FROM scored)
SELECT order_key, round(gross, 2) + 0.0 AS observed, round(yhat, 2) + 0.0 AS fitted,
       round(residual, 2) + 0.0 AS residual, round(abs(residual), 2) + 0.0 AS abs_residual
FROM ranked WHERE rn <= floor(total * 0.1)""")
def model_plot_feed(spark, sf):
    return round_all(feeds.model_plot_rows(_scored(spark, sf), "order_key", Y, "yhat", "residual"), 2)


def _register_study(variant: str) -> None:
    @query("A14 B25 B26 B27 C10 G4 I1 I2 I5 I6 I7 I8 I10 I11 I12 I13 I14 I15 I16 I17 K3",
           name=f"study_{variant}")
    def run(spark, sf):
        found = ds.build_datasets(st.sources(spark, sf), st.POLICY_DAYS)[variant]
        return round_all(study.analyse(found, variant).report(spark), 4)


for _variant in ds.VARIANTS:
    _register_study(_variant)
