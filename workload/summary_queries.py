"""Summaries, splits, histograms, densities and chart rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import feeds, summary as sm
from panelwright.operators.ordering import column_quantiles, keyed_split, median_of, sample_flag
from workload import standins as st
from workload.registry import query, round_all, rounded, table

_DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _described(statistic: str, form: str) -> str:
    cells = ", ".join(f"round({form.format(c=c)}, 5) + 0.0 AS {c}" for c in _DESCRIBED)
    return f"SELECT '{statistic}' AS statistic, {cells} FROM lineitem"


@query("E2 B33", " UNION ALL ".join(_described(*pair) for pair in (
    ("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"),
    ("min", "min({c})"), ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
    ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})"))))
def describe(spark, sf):
    lines = table(spark, sf, "lineitem").select(*_DESCRIBED)
    return round_all(sm.describe(lines, _DESCRIBED), 5)


_GRID = list(range(0, 101, 5))


def _grid_sql(column: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{column}' AS variable, CAST({p} AS INTEGER) AS percentile, "
        f"round(quantile_cont({column}, {p / 100}), 6) + 0.0 AS value FROM {source}" for p in _GRID)


@query("E3", _grid_sql("p_retailprice", "part") + " UNION ALL " + _grid_sql("p_size", "part"))
def percentile_grid(spark, sf):
    return round_all(sm.percentile_grid(table(spark, sf, "part"), ["p_retailprice", "p_size"]))


@query("E3 E6", _grid_sql("l_extendedprice", "lineitem") + " UNION ALL "
       + _grid_sql("l_quantity", "lineitem"))
def percentile_grid_ranged(spark, sf):
    return round_all(sm.percentile_grid(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]))


@query("C7 C8", """
SELECT p_partkey, p_retailprice FROM part
WHERE p_retailprice <= (SELECT quantile_cont(p_retailprice, 0.9) FROM part)""")
def trim_top_decile(spark, sf):
    return sm.trim_above(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query("E4 E5 E11", """
SELECT o_orderstatus, min(o_totalprice) AS least, max(o_totalprice) AS greatest,
       count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total, round(avg(o_totalprice), 6) + 0.0 AS mean,
       round(var_pop(o_totalprice) * count(*) / 1e9, 4) + 0.0 AS squares
FROM orders GROUP BY 1""")
def group_moments(spark, sf):
    price = "o_totalprice"
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.min(price).alias("least"), F.max(price).alias("greatest"), F.count("*").alias("n"),
        rounded(F.sum(price), 2).alias("total"), rounded(F.avg(price)).alias("mean"),
        rounded(sm.squared_deviations(price) / 1e9, 4).alias("squares"))


@query("E7", "SELECT round(exp(avg(ln(o_totalprice))), 4) + 0.0 AS geo_mean FROM orders")
def geometric_mean(spark, sf):
    return table(spark, sf, "orders").agg(rounded(sm.geometric_mean("o_totalprice"), 4).alias("geo_mean"))


@query("E6 C9", """
SELECT CASE WHEN o_totalprice <= (SELECT median(o_totalprice) FROM orders) THEN 0 ELSE 1 END::INTEGER AS half,
       count(*) AS n, round(median(o_totalprice), 4) + 0.0 AS middle FROM orders GROUP BY 1""")
def median_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice")
    middle = median_of(orders, "o_totalprice")
    halves = orders.withColumn("half", F.when(F.col("o_totalprice") <= middle, 0).otherwise(1))
    side = F.col("o_totalprice") <= middle
    centres = column_quantiles(orders, {"0": F.when(side, F.col("o_totalprice")),
                                        "1": F.when(~side, F.col("o_totalprice"))}, [0.5])
    centre = F.when(F.col("half") == 0, F.lit(centres["0"][0])).otherwise(F.lit(centres["1"][0]))
    return halves.groupBy("half").agg(F.count("*").alias("n"), F.max(rounded(centre, 4)).alias("middle"))


_LOW, _HIGH, _BINS = 0.0, 105000.0, 50
_CELL_SQL = ("CASE WHEN l_extendedprice < 0 THEN -1 WHEN l_extendedprice > 105000 THEN 50 "
             "ELSE least(floor(l_extendedprice / 105000::DOUBLE * 50), 49) END")


@query("E8 J5", f"""
SELECT bin, CASE WHEN bin >= 0 THEN bin * 2100.0::DOUBLE END AS bin_from,
       CASE WHEN bin < 50 THEN (bin + 1) * 2100.0::DOUBLE END AS bin_to, count(*) AS count
FROM (SELECT CAST({_CELL_SQL} AS INTEGER) AS bin FROM lineitem) GROUP BY 1, 2, 3""")
def hist1d(spark, sf):
    return sm.histogram(table(spark, sf, "lineitem"), "l_extendedprice", _LOW, _HIGH, _BINS)


_HEAT = {"l_quantity": (1.0, 50.0), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08)}


def _heat_sql(x: str, low: float, high: float) -> str:
    return f"""
SELECT '{x}' AS variable, CAST(CASE WHEN {x} < {low}::DOUBLE THEN -1 WHEN {x} > {high}::DOUBLE THEN 40
         ELSE least(floor(({x} - {low}::DOUBLE) / {high - low}::DOUBLE * 40), 39) END AS INTEGER) AS x_bin,
       CAST(CASE WHEN l_extendedprice < 1000 THEN -1 WHEN l_extendedprice > 100000 THEN 400
         ELSE least(floor((l_extendedprice - 1000::DOUBLE) / 99000::DOUBLE * 400), 399) END AS INTEGER) AS y_bin,
       count(*) AS count
FROM lineitem GROUP BY 1, 2, 3"""


@query("E9 J5", " UNION ALL ".join(_heat_sql(x, *r) for x, r in _HEAT.items()))
def hist2d(spark, sf):
    return sm.heatmap(table(spark, sf, "lineitem"), _HEAT, "l_extendedprice", (1000.0, 100000.0))


def _power_sql(column: str, bins: int, source: str) -> str:
    """Exponent of the least power of two whose multiples cut a column's range into few enough bins."""
    return (f"(SELECT min(k) FROM range(-60, 60) t(k), (SELECT min({column}) AS low, max({column}) AS high FROM {source}) "
            f"WHERE floor(high / pow(2::DOUBLE, k)) - floor(low / pow(2::DOUBLE, k)) < {bins})")


def _edges_sql(axis: str, cell: str, k: str) -> str:
    return f"{cell} * pow(2::DOUBLE, {k}) AS {axis}_from, ({cell} + 1) * pow(2::DOUBLE, {k}) AS {axis}_to"


@query("E8 J5", f"""
WITH w AS (SELECT {_power_sql('c_acctbal', 50, 'customer')} AS k),
c AS (SELECT floor(c_acctbal / pow(2::DOUBLE, k)) AS cell, k, count(*) AS count FROM customer, w GROUP BY 1, 2)
SELECT {_edges_sql('bin', 'cell', 'k')}, count FROM c""")
def hist1d_own(spark, sf):
    return sm.own_histogram(table(spark, sf, "customer"), "c_acctbal", 50)


def _own_heat_sql(x: str) -> str:
    return f"""
SELECT '{x}' AS variable, {_edges_sql('x', 'cx', 'kx')}, {_edges_sql('y', 'cy', 'ky')}, count FROM (
  SELECT floor({x} / pow(2::DOUBLE, kx)) AS cx, floor(l_extendedprice / pow(2::DOUBLE, ky)) AS cy, kx, ky,
         count(*) AS count
  FROM lineitem, (SELECT {_power_sql(x, 40, 'lineitem')} AS kx, {_power_sql('l_extendedprice', 400, 'lineitem')} AS ky)
  GROUP BY 1, 2, 3, 4)"""


@query("E9 J5", " UNION ALL ".join(_own_heat_sql(x) for x in _HEAT))
def hist2d_own(spark, sf):
    return sm.own_heatmap(table(spark, sf, "lineitem"), list(_HEAT), "l_extendedprice")


@query("E10", """
WITH f AS (SELECT count(*) AS n, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS low, max(c_acctbal) AS high,
                  quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer),
b AS (SELECT *, 0.9::DOUBLE * least(sd, iqr / 1.34::DOUBLE) * power(n, -0.2::DOUBLE) AS bw FROM f),
x AS (SELECT low - 3 * bw + i * ((high - low + 6 * bw) / 511) AS x, n, bw FROM b, range(0, 512) t(i))
SELECT round(x, 4) + 0.0 AS x,
       round(1e6 * sum(exp(-0.5 * pow((x - c_acctbal) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 8) + 0.0 AS density
FROM x, customer GROUP BY x""")
def density_grid(spark, sf):
    found = sm.density(table(spark, sf, "customer"), "c_acctbal")
    return found.select(rounded("x", 4).alias("x"), rounded(F.col("density") * 1e6, 8).alias("density"))


def _split_sql(table_name: str, key: str, seed: int, fraction: float) -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || ':{seed}')) AS rn,
         count(*) OVER () AS total FROM {table_name}),
split AS (SELECT * EXCLUDE (rn, total), rn <= floor(total * {fraction}) AS held_out FROM ranked)"""


@query("G4 C10", f"""
WITH {_split_sql('customer', 'c_custkey', 37, 0.2)}
SELECT c_custkey, c_acctbal, CASE WHEN held_out THEN 'validation' ELSE 'training' END AS part FROM split""")
def split_keyed(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    validation, training = keyed_split(people, "c_custkey", 0.2, 37)
    return (validation.withColumn("part", F.lit("validation"))
            .unionByName(training.withColumn("part", F.lit("training"))))


@query("G5", f"""
WITH {_split_sql('orders', 'o_orderkey', 101, 0.1)}
SELECT o_orderkey, o_totalprice FROM split WHERE held_out""")
def plot_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.filter(sample_flag(orders, "o_orderkey", 0.1, 101))


@query("G1 G2","SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_head(spark, sf):
    return (table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
            .orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10))


@query("G3", """
SELECT l_suppkey, min_by(l_linenumber, (l_extendedprice, l_linenumber)) AS cheapest_line,
       min(l_extendedprice) AS least
FROM lineitem GROUP BY 1""")
def arg_min(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("cheapest_line"),
        F.min("l_extendedprice").alias("least"))


# ------------------------------------------------------------------ chart rows

@query("J1 C7", """
WITH low AS (SELECT l_orderkey, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem
             WHERE l_extendedprice <= 50000)
UNPIVOT low ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value""")
def unpivot_feed(spark, sf):
    low = sm.below(table(spark, sf, "lineitem"), "l_extendedprice", 50000)
    return feeds.scatter_rows(low, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "l_orderkey")


_LONG_SHARES = " UNION ALL ".join(
    f"SELECT round(new_cases_per_10k_difference, 6) + 0.0 AS new_cases_per_10k_difference, "
    f"round(pop_density, 6) + 0.0 AS pop_density, '{c}' AS variable, round({c}, 6) + 0.0 AS value FROM kept"
    for c in st.SHARE_COLUMNS)


def _dataset_sql() -> str:
    from workload.column_queries import DATASET_SQL
    return DATASET_SQL


@query("J1 C7", f"""{_dataset_sql()},
kept AS (SELECT * FROM joined WHERE pop_density <= 153) {_LONG_SHARES}""")
def dataset_scatter(spark, sf):
    from panelwright.plans.dataset import star
    joined = star(st.sources(spark, sf), st.POLICY_DAYS)
    kept = sm.below(joined, "pop_density", 153)
    return round_all(feeds.scatter_rows(
        kept, "new_cases_per_10k_difference", st.SHARE_COLUMNS, "pop_density"))


@query("J2 B32 D9", """
WITH n AS (SELECT n_nationkey, n_name, r_name, avg(c_acctbal) AS balance, count(*) AS people
           FROM customer JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT n_nationkey, round(least(greatest(balance, 4300), 4700), 6) + 0.0 AS colour,
       n_name AS "Name ", r_name AS "Region ", printf('%.4f', balance) AS "Balance ", people AS "People "
FROM n""")
def map_feed(spark, sf):
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    means = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.avg("c_acctbal").alias("balance"), F.count("*").alias("people"))
    rows = means.join(nations, "n_nationkey")
    return round_all(feeds.map_rows(
        rows, "n_nationkey", "balance", (4300.0, 4700.0),
        {"n_name": "Name ", "r_name": "Region ", "balance": "Balance ", "people": "People "},
        {"balance": 4}))
