"""Projections, keys, shares, filters, joins and the dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.keys import (
    fixed_decimals, group_flags, group_label, has_prefix, leading_int, member_flag,
    restore_leading_zero, slice_text, STATE_REGIONS,
)
from panelwright.functions.shares import (
    interactions, power, rate_per, redefine, remainder, row_sum, shares_of_total, shifted,
)
from panelwright.plans import dataset as ds
from panelwright.runtime import stored
from workload import standins as st
from workload.registry import query, round_all, rounded, table


@query("A2 B1 B2 C5", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_quantity <= 5 AND l_discount IS NOT NULL""")
def scan_project(spark, sf):
    return (table(spark, sf, "lineitem").filter("l_quantity <= 5 AND l_discount IS NOT NULL")
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@query("B3 B25", """
SELECT * EXCLUDE (c_name, c_mktsegment) RENAME (c_acctbal AS balance) FROM customer""")
def star_except(spark, sf):
    return (table(spark, sf, "customer").drop("c_name", "c_mktsegment")
            .withColumnRenamed("c_acctbal", "balance"))


@query("B26 B25", "SELECT o_custkey AS x1, o_totalprice AS x2, o_orderpriority AS x3 FROM orders")
def columns_by_position(spark, sf):
    orders = table(spark, sf, "orders")
    picked = [orders.columns[i] for i in (1, 3, 5)]
    return orders.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(picked, start=1)])


@query("B17 B18 B20 B21", """
SELECT c_custkey, CASE WHEN length(CAST(c_custkey * 37 AS VARCHAR)) = 4
         THEN '0' || CAST(c_custkey * 37 AS VARCHAR) ELSE CAST(c_custkey * 37 AS VARCHAR) END AS padded,
       CAST(length(CAST(c_custkey * 37 AS VARCHAR)) AS INTEGER) AS digits
FROM customer""")
def pad_key(spark, sf):
    code = F.col("c_custkey") * 37
    return table(spark, sf, "customer").select(
        "c_custkey", restore_leading_zero(code).alias("padded"),
        F.length(code.cast("string")).alias("digits"))


@query("B19 C6", """
SELECT o_orderkey, substring(o_orderpriority, 3, 4) AS word, substring(o_orderpriority, 30, 2) AS past,
       CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS level
FROM orders WHERE substring(o_orderpriority, 1, 2) = '1-' OR substring(o_orderpriority, 1, 2) = '5-'""")
def key_prefix(spark, sf):
    p = "o_orderpriority"
    return (table(spark, sf, "orders").filter(has_prefix(p, "1-") | has_prefix(p, "5-"))
            .select("o_orderkey", slice_text(p, 3, 4).alias("word"),
                    slice_text(p, 30, 2).alias("past"), leading_int(p, 1).alias("level")))


def _in(codes) -> str:
    return "(" + ", ".join(str(c) for c in codes) + ")"


_REGION_SQL = ", ".join(
    [f"CAST(CASE WHEN state_code IN {_in(c)} THEN 1 ELSE 0 END AS INTEGER) AS {n}"
     for n, c in STATE_REGIONS.items()]
    + ["CASE " + " ".join(f"WHEN state_code IN {_in(c)} THEN '{n}'" for n, c in STATE_REGIONS.items())
       + " ELSE NULL END AS region"])


@query("B14 B15 B18 B19", f"""
WITH k AS (SELECT c_custkey, {st._key_sql('c_custkey')} AS key FROM customer),
s AS (SELECT *, CAST(substring(key, 1, 2) AS INTEGER) AS state_code FROM k)
SELECT c_custkey, key, state_code, {_REGION_SQL} FROM s""")
def region_flags(spark, sf):
    keyed = table(spark, sf, "customer").select("c_custkey", st.county_key("c_custkey").alias("key"))
    coded = keyed.withColumn("state_code", leading_int("key", 2))
    return coded.withColumns({**group_flags("state_code", STATE_REGIONS),
                              "region": group_label("state_code", STATE_REGIONS)})


@query("B16", """
SELECT p_partkey, CAST(CASE WHEN p_size IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS INTEGER) AS small FROM part""")
def flag_threshold(spark, sf):
    return table(spark, sf, "part").select("p_partkey", member_flag("p_size", (1, 2, 3, 4)).alias("small"))


_FLAGS_SQL = """
t AS (SELECT l_suppkey, sum(l_quantity) AS total,
        sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a,
        sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n,
        sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r
      FROM lineitem GROUP BY 1)"""


def _flag_totals(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(q).alias("total"),
        *[F.sum(F.when(F.col("l_returnflag") == f, q).otherwise(0.0)).alias(f.lower()) for f in "ANR"])


@query("B4 B7 B8", f"""
WITH {_FLAGS_SQL}
SELECT l_suppkey, round((a + n) / total, 6) + 0.0 AS a_or_n, round(a / total, 6) + 0.0 AS a,
       round(n / total, 6) + 0.0 AS n, round(r / total, 6) + 0.0 AS r FROM t""")
def share_of_total(spark, sf):
    with_sum = _flag_totals(spark, sf).withColumn("a_or_n", row_sum(["a", "n"]))
    return round_all(shares_of_total(with_sum, ["a_or_n", "a", "n", "r"], "total", drop=["total"]))


@query("B9 B4", f"""
WITH {_FLAGS_SQL} SELECT l_suppkey, total, r, total - (a + n) AS rest, a * 2 AS a, n FROM t""")
def remainder_category(spark, sf):
    totals = _flag_totals(spark, sf)
    rest = totals.select("l_suppkey", "total", "a", "n", "r", remainder("total", ["a", "n"]).alias("rest"))
    return redefine(rest, {"a": F.col("a") * 2})


@query("B6", """
SELECT s_suppkey, round(count(*) * 10000 / nullif(s_acctbal, 0), 6) + 0.0 AS lines_per_10k
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal""")
def rate_per_10k(spark, sf):
    counted = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"))
    suppliers = table(spark, sf, "supplier")
    return (counted.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("s_suppkey", rounded(rate_per("lines", "s_acctbal")).alias("lines_per_10k")))


def _register_recode(variant: str) -> None:
    groups = ds.VARIANTS[variant]
    sums = ", ".join(f"round({' + '.join(old)}, 6) + 0.0 AS {new}" for new, old in groups.items())

    @query("B10 B11 B12 B13 B33 D8" if variant == "primary" else "B11 B12 B13 D8 K3",
           f"WITH {st.SHARES_SQL} SELECT county_fips_code, {sums} FROM shares",
           name=f"recode_{variant}")
    def run(spark, sf):
        return round_all(ds.recoded_shares(st.shares(spark, sf), variant))


for _variant in ("alt1", "alt2", "alt3"):
    _register_recode(_variant)


@query("B27 B28 I17", """
SELECT event_id, value, CAST(event_type = 'click' AS INTEGER) AS clicked,
       round(value * CAST(event_type = 'click' AS INTEGER), 6) + 0.0 AS value_clicked,
       round(value * user_id, 6) + 0.0 AS value_user FROM events""")
def interaction_terms(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "user_id", "value", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("clicked"))
    products = interactions({"value_clicked": ("value", "clicked"), "value_user": ("value", "user_id")})
    return round_all(events.withColumns(products).drop("user_id"))


@query("B29 B30 B31", """
SELECT c_custkey, round(c_acctbal + 1000, 6) + 0.0 AS moved,
       round(power(c_acctbal + 1000, 1.631) / 1000, 4) + 0.0 AS raised,
       round(ln(c_acctbal + 1000), 6) + 0.0 AS logged, abs(c_acctbal) AS size,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END = 1 AS undefined
FROM customer""")
def power_transform(spark, sf):
    moved = shifted("c_acctbal", 1000)
    return table(spark, sf, "customer").select(
        "c_custkey", rounded(moved).alias("moved"), rounded(power(moved, 1.631) / 1000, 4).alias("raised"),
        rounded(power(moved, 0)).alias("logged"), F.abs("c_acctbal").alias("size"),
        F.isnan(power("c_acctbal", 1.631)).alias("undefined"))


@query("B32", """
SELECT l_suppkey, printf('%.4f', avg(l_extendedprice)) AS "Price ",
       printf('%.2f', sum(l_quantity)) AS "Quantity " FROM lineitem GROUP BY 1""")
def fixed_text(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q"))
    return means.select("l_suppkey", fixed_decimals("p", 4).alias("Price "),
                        fixed_decimals("q", 2).alias("Quantity "))


@query("C7", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 953")
def threshold_filter(spark, sf):
    from panelwright.operators.summary import below
    return below(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 953)


# ------------------------------------------------------------------ joins

@query("D2", """
SELECT c_custkey, n_orders, n_events
FROM (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1)
JOIN (SELECT user_id AS c_custkey, count(*) AS n_events FROM events GROUP BY 1) USING (c_custkey)""")
def join_using(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"))
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count("*").alias("n_events"))
    return orders.join(events, "c_custkey")


_POLICY_DAYS_SQL = "(" + ", ".join(f"DATE '{d}'" for d in st.POLICY_DAYS) + ")"
_MAXIMA_SQL = f"""{st.POLICY_SQL},
maxima AS (
  SELECT region_code, {', '.join(f'max({c}) AS {c}' for c in (*ds.POLICY_COLUMNS, *ds.OTHER_POLICY_COLUMNS))}
  FROM policy WHERE substring(region_code, 1, 2) = 'US' AND date IN {_POLICY_DAYS_SQL}
  GROUP BY region_code)"""


@query("C3 C6 E1", f"""
WITH {_MAXIMA_SQL}
SELECT * REPLACE (round(stringency_index, 6) + 0.0 AS stringency_index) FROM maxima""")
def group_max(spark, sf):
    rows = ds.policy_rows(st.policy(spark, sf), st.POLICY_DAYS)
    return round_all(ds.policy_maxima(rows))


@query("D3", f"""
WITH {_MAXIMA_SQL}
SELECT c_custkey, {st._state_sql('c_nationkey')} AS state, school_closing,
       round(stringency_index, 6) + 0.0 AS stringency_index
FROM customer JOIN maxima ON substring(region_code, 4, 2) = {st._state_sql('c_nationkey')}""")
def policy_expand(spark, sf):
    maxima = ds.policy_maxima(ds.policy_rows(st.policy(spark, sf), st.POLICY_DAYS))
    people = table(spark, sf, "customer").select("c_custkey", st.state_of("c_nationkey").alias("state"))
    return round_all(people.join(stored(ds.policy_by_state(maxima), "policies"), "state")
                     .select("c_custkey", "state", "school_closing", "stringency_index"))


@query("D4", """
SELECT o_orderkey, c_custkey, c_acctbal FROM orders
JOIN (SELECT * FROM customer WHERE c_acctbal IS NOT NULL AND c_acctbal > 0) ON o_custkey = c_custkey""")
def join_filtered(spark, sf):
    people = table(spark, sf, "customer").filter("c_acctbal IS NOT NULL AND c_acctbal > 0").select(
        "c_custkey", "c_acctbal")
    return (table(spark, sf, "orders").select("o_orderkey", "o_custkey")
            .join(people, F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "c_custkey", "c_acctbal"))


@query("D5 B14 B15 B17", f"""
WITH {st.DENSITY_SQL}, {st.SHARES_SQL},
k AS (SELECT {st._key_sql('c_custkey')} AS geoid, abs(c_acctbal) / 25 AS pop_density FROM customer),
s AS (SELECT *, CAST(substring(geoid, 1, 2) AS INTEGER) AS state_code FROM k)
SELECT county_fips_code, round(never, 6) + 0.0 AS never, round(pop_density, 6) + 0.0 AS pop_density,
       {_REGION_SQL} FROM shares JOIN s ON geoid = county_fips_code""")
def join_density(spark, sf):
    dim = ds.density_dimension(st.density(spark, sf)).withColumnRenamed("geoid", "county_fips_code")
    return round_all(st.shares(spark, sf).select("county_fips_code", "never")
                     .join(dim.drop("state_code"), "county_fips_code"))


@query("D6 B16 B17", f"""
WITH {st.SHARES_SQL}
SELECT county_fips_code, round(always, 6) + 0.0 AS always,
       CAST(CASE WHEN c_nationkey % 6 + 1 IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS INTEGER) AS metropolitan
FROM shares JOIN customer ON {st._key_sql('c_custkey')} = county_fips_code""")
def join_urban(spark, sf):
    dim = ds.urban_dimension(st.urban(spark, sf)).withColumnRenamed("fips_code", "county_fips_code")
    return round_all(st.shares(spark, sf).select("county_fips_code", "always").join(dim, "county_fips_code"))


@query("D7 B1", """
SELECT o_orderkey, o_totalprice, c_name, n_name, r_name, s.suppliers
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def star_join(spark, sf):
    suppliers = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("suppliers"))
    nations = (table(spark, sf, "nation")
               .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
               .join(suppliers, "n_nationkey"))
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return (table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
            .join(people, F.col("o_custkey") == F.col("c_custkey"))
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "o_totalprice", "c_name", "n_name", "r_name", "suppliers"))


@query("F5 B10", """
SELECT c_custkey, round(avg(c_acctbal) OVER (), 4) + 0.0 AS mu,
       round(stddev_pop(c_acctbal) OVER (), 4) + 0.0 AS sigma,
       round((avg(c_acctbal) OVER () - c_acctbal) / nullif(stddev_pop(c_acctbal) OVER (), 0), 6) + 0.0 AS z
FROM customer""")
def global_zscore(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return round_all(ds.with_global_z(people, "c_acctbal", "mu", "sigma", "z").drop("c_acctbal"),
                     mu=4, sigma=4)


# ------------------------------------------------------------------ dataset

def _sum_of(sex: str) -> str:
    return " + ".join(f"{sex}_{b}" for b in ds.AGE_BANDS)


_CHANGE_SQL = f"""
{st.PANEL_SQL}, {st.CENSUS_SQL},
c_lag AS (
  SELECT *, confirmed_cases - lag(confirmed_cases, 1) OVER (PARTITION BY county_fips_code ORDER BY date)
           AS new_cases,
         (dayofyear(date) - 1 + 7 - ((isodow(date) - 1 - 2 + 7) % 7)) // 7 AS wk
  FROM panel WHERE date BETWEEN '2024-01-02' AND '2024-01-09'
                OR date BETWEEN '2024-01-16' AND '2024-01-23'),
c_mean AS (
  SELECT c_lag.*, avg(new_cases * 10000 / nullif(total_pop, 0))
           OVER (PARTITION BY county_fips_code, wk ORDER BY date) AS mean_rate
  FROM c_lag LEFT JOIN census ON county_fips_code = geo_id WHERE wk IN (1, 3)),
c_diff AS (
  SELECT county_fips_code, county_name, state,
         mean_rate - lag(mean_rate, 1) OVER (PARTITION BY county_fips_code ORDER BY date)
           AS new_cases_per_10k_difference
  FROM c_mean WHERE date IN (DATE '2024-01-09', DATE '2024-01-23')),
change AS (SELECT * FROM c_diff WHERE new_cases_per_10k_difference IS NOT NULL)"""

_PARTS = ("amerindian_pop", "white_pop", "black_pop", "asian_pop", "hispanic_pop",
          "other_not_disclosed", "pop_determined_poverty_status")

DATASET_SQL = f"""
WITH {_CHANGE_SQL}, {st.SHARES_SQL}, {_MAXIMA_SQL}, {st.DENSITY_SQL}, {st.URBAN_SQL},
d0 AS (SELECT CASE WHEN length(CAST(geoid AS VARCHAR)) = 4 THEN '0' || CAST(geoid AS VARCHAR)
                   ELSE CAST(geoid AS VARCHAR) END AS geoid, B01001_calc_PopDensity AS pop_density
       FROM density),
d1 AS (SELECT *, CAST(substring(geoid, 1, 2) AS INTEGER) AS state_code FROM d0),
d AS (SELECT geoid, pop_density, {_REGION_SQL} FROM d1),
u AS (SELECT CASE WHEN length(CAST(fips_code AS VARCHAR)) = 4 THEN '0' || CAST(fips_code AS VARCHAR)
                  ELSE CAST(fips_code AS VARCHAR) END AS fips_code,
             CAST(CASE WHEN _2013_code IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS INTEGER) AS metropolitan
      FROM urban),
joined AS (
  SELECT c.county_fips_code, c.county_name, c.new_cases_per_10k_difference,
         m.never, m.rarely, m.sometimes, m.frequently, m.always,
         {', '.join(f'p.{c}' for c in ds.POLICY_COLUMNS)},
         c.state, d.region, d.Northeast, d.Midwest, d.South, d.West, d.pop_density, u.metropolitan,
         avg(c.new_cases_per_10k_difference) OVER () AS new_cases_mu,
         stddev_pop(c.new_cases_per_10k_difference) OVER () AS new_cases_sigma,
         a.* EXCLUDE (geo_id),
         total_pop - ({' + '.join(ds.GROUP_COLUMNS)}) AS other_not_disclosed
  FROM shares m JOIN change c USING (county_fips_code)
  JOIN maxima p ON substring(p.region_code, 4, 2) = c.state
  JOIN census a ON a.geo_id = c.county_fips_code AND a.median_income IS NOT NULL
  JOIN d ON d.geoid = c.county_fips_code JOIN u ON u.fips_code = c.county_fips_code)"""


def _dataset_select(variant: str) -> str:
    r = lambda e, name: f"round({e}, 6) + 0.0 AS {name}"
    shares = [r(" + ".join(old), new) for new, old in ds.VARIANTS[variant].items()]
    return f"""{DATASET_SQL}
SELECT county_fips_code, county_name, {r('new_cases_per_10k_difference', 'new_cases_per_10k_difference')},
       {', '.join(shares)}, {', '.join(c for c in ds.POLICY_COLUMNS[:-1])},
       {r('stringency_index', 'stringency_index')}, state, region, Northeast, Midwest, South, West,
       {r('pop_density', 'pop_density')}, metropolitan, {r('new_cases_mu', 'new_cases_mu')},
       {r('new_cases_sigma', 'new_cases_sigma')}, {r('median_income', 'median_income')},
       {r('(new_cases_mu - new_cases_per_10k_difference) / nullif(new_cases_sigma, 0)', 'new_cases_z')},
       {r('male_pop / total_pop', 'male_pop')}, {r('female_pop / total_pop', 'female_pop')},
       {r(f'({_sum_of("male")} + {_sum_of("female")}) / total_pop', 'pop_50_and_over')},
       {', '.join(r(f'{c} / total_pop', c) for c in _PARTS)}
FROM joined"""


def _register_dataset(variant: str) -> None:
    @query("B3 B4 B7 B8 B9 B10 D2 D3 D4 D5 D6 D7 D8 F5 G1 K1 K3", _dataset_select(variant),
           name=f"dataset_{variant}")
    def run(spark, sf):
        return round_all(ds.build_datasets(st.sources(spark, sf), st.POLICY_DAYS)[variant])


for _variant in ds.VARIANTS:
    _register_dataset(_variant)
