"""The study's source tables, derived from the test tables.

Counties are customers: the code ``1000 + 370 * key`` plays the county code, whose leading
zero is lost below 10000. States are nations. The daily panel counts a customer's events,
the census sums a customer's order lines, policies are monthly order figures of a nation.
Each builder has its SQL twin below for the checks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.functions.keys import restore_leading_zero
from panelwright.functions.shares import ratio
from panelwright.operators.panel import Period, daily_totals, running_total
from panelwright.plans.dataset import AGE_BANDS, GROUP_COLUMNS, SHARE_COLUMNS, Sources
from panelwright.plans.period_change import period_means
from workload.registry import table

BEFORE = Period(dt.date(2024, 1, 2), dt.date(2024, 1, 9))
AFTER = Period(dt.date(2024, 1, 16), dt.date(2024, 1, 23))
POLICY_DAYS = (dt.date(1996, 3, 1), dt.date(1996, 4, 1), dt.date(1997, 7, 1), dt.date(1997, 8, 1))

# Share columns in order, and the event type each one counts.
SHARE_EVENTS = dict(zip(SHARE_COLUMNS, ("error", "view", "click", "signup", "purchase")))
# Policy counters and the orders they count.
POLICY_PRIORITIES = {
    "school_closing": "1-URGENT", "workplace_closing": "2-HIGH",
    "cancel_public_events": "3-MEDIUM", "restrictions_on_gatherings": "4-NOT SPECIFIED",
    "close_public_transit": "5-LOW"}
POLICY_STATUSES = {
    "stay_at_home_requirements": "F", "restrictions_on_internal_movement": "O",
    "international_travel_controls": "P"}
# Population groups are line numbers 1 to 5; numbers 6 and 7 are what is not disclosed.
GROUP_LINES = dict(zip(GROUP_COLUMNS, range(1, 6)))


def county_code(key: str) -> Column:
    return F.col(key) * 370 + 1000


def county_key(key: str) -> Column:
    return restore_leading_zero(county_code(key))


def state_of(nation_key: str) -> Column:
    return F.concat(F.lit("N"), F.char(F.col(nation_key) + 65))


def panel(spark: SparkSession, sf: str, until: dt.date | None = None) -> DataFrame:
    """Cumulative daily counts per county, with name and state, up to a day.

    Later events change no earlier total, so ``until`` may cut the scan.
    """
    key = "county_fips_code"
    events = table(spark, sf, "events")
    if until is not None:
        next_day = F.lit(until + dt.timedelta(days=1)).cast("timestamp_ntz")
        events = events.filter(F.col("ts") < next_day)
    daily = daily_totals(
        events, ["user_id"], "ts",
        {"cases": F.count("*"), "errors": F.count_if(F.col("event_type") == "error")})
    cumulative = daily.withColumn(key, county_key("user_id")).select(
        key, "date", running_total("cases", key, "date").alias("confirmed_cases"),
        running_total("errors", key, "date").alias("deaths"))
    people = table(spark, sf, "customer").select(
        county_key("c_custkey").alias(key), F.col("c_name").alias("county_name"),
        state_of("c_nationkey").alias("state"))
    return (cumulative.join(people, key)
            .select(key, "county_name", "state", "date", "confirmed_cases", "deaths"))


def balances(spark: SparkSession, sf: str) -> DataFrame:
    """Account balances in the place of populations: one customer in twelve is negative."""
    return table(spark, sf, "customer").select(
        county_key("c_custkey").alias("geo_id"), F.col("c_acctbal").alias("total_pop"))


def shares(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("event_type") == e).alias(c) for c, e in SHARE_EVENTS.items()])
    return counted.select(county_key("user_id").alias("county_fips_code"),
                          *[ratio(c, "n").alias(c) for c in SHARE_COLUMNS])


def policy(spark: SparkSession, sf: str) -> DataFrame:
    """One row per region and month. Nations with key 4 mod 5 lie in another country."""
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    homes = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    country = F.when(F.col("c_nationkey") % 5 == 4, "CA_").otherwise("US_")
    figures = {
        **{c: F.count_if(F.col("o_orderpriority") == p) for c, p in POLICY_PRIORITIES.items()},
        **{c: F.count_if(F.col("o_orderstatus") == s) for c, s in POLICY_STATUSES.items()},
        "stringency_index": F.max("o_totalprice") / 5000, "testing_policy": F.count("*")}
    region = F.concat(country, state_of("c_nationkey")).alias("region_code")
    return (orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey", F.trunc("o_orderdate", "month").alias("date"))
            .agg(*[agg.alias(name) for name, agg in figures.items()])
            .select(region, "date", *figures))


def census(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered quantities per customer: in all, by line status, size band and line number."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", "l_linestatus", "l_linenumber", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    quantity, band = F.col("l_quantity"), F.ceil(F.col("l_quantity") / 5)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, quantity).otherwise(0.0))

    sexes = {"male": F.col("l_linestatus") == "F", "female": F.col("l_linestatus") == "O"}
    sums = {"total_pop": F.sum(quantity)}
    for sex, one in sexes.items():
        sums[f"{sex}_pop"] = total(one)
        for i, name in enumerate(AGE_BANDS, start=1):
            sums[f"{sex}_{name}"] = total(one & (band == i))
    for name, line in GROUP_LINES.items():
        sums[name] = total(F.col("l_linenumber") == line)
    sums["pop_determined_poverty_status"] = total(F.col("l_discount") < 0.05)
    counted = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
               .groupBy("o_custkey").agg(*[agg.alias(name) for name, agg in sums.items()]))
    return (counted.join(people, F.col("o_custkey") == F.col("c_custkey"))
            .select(county_key("c_custkey").alias("geo_id"), *sums,
                    F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("median_income")))


def density(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        county_code("c_custkey").alias("geoid"),
        (F.abs("c_acctbal") / 25).alias("B01001_calc_PopDensity"))


def urban(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        county_code("c_custkey").alias("fips_code"),
        (F.col("c_nationkey") % 6 + 1).alias("_2013_code"))


def sources(spark: SparkSession, sf: str) -> Sources:
    return Sources(
        shares=shares(spark, sf), policy=policy(spark, sf), census=census(spark, sf),
        means=period_means(panel(spark, sf, AFTER.last_day), BEFORE, AFTER),
        density=density(spark, sf), urban=urban(spark, sf))


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Regression sample: order lines folded to one row per order."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.sum("l_extendedprice").alias("gross"), F.sum("l_quantity").alias("quantity"),
        F.sum("l_discount").alias("discount"), F.sum("l_tax").alias("tax"),
        F.count("*").cast("double").alias("lines"),
        F.count_if(F.col("l_linestatus") == "O").cast("double").alias("open_lines"),
        F.min("l_returnflag").alias("flag"))


# ------------------------------------------------------------------ SQL twins

def _key_sql(key: str) -> str:
    code = f"({key} * 370 + 1000)"
    return (f"CASE WHEN length(CAST({code} AS VARCHAR)) = 4 THEN '0' || CAST({code} AS VARCHAR) "
            f"ELSE CAST({code} AS VARCHAR) END")


def _state_sql(key: str) -> str:
    return f"'N' || chr(65 + {key})"


PANEL_SQL = f"""
daily AS (
  SELECT {_key_sql('user_id')} AS county_fips_code, CAST(ts AS DATE) AS date,
         count(*) AS cases, count(*) FILTER (event_type = 'error') AS errors
  FROM events GROUP BY 1, 2),
cumulative AS (
  SELECT county_fips_code, date,
         CAST(sum(cases) OVER w AS BIGINT) AS confirmed_cases,
         CAST(sum(errors) OVER w AS BIGINT) AS deaths
  FROM daily WINDOW w AS (PARTITION BY county_fips_code ORDER BY date)),
panel AS (
  SELECT county_fips_code, c_name AS county_name, {_state_sql('c_nationkey')} AS state, date,
         confirmed_cases, deaths
  FROM cumulative JOIN customer ON county_fips_code = {_key_sql('c_custkey')})"""

BALANCES_SQL = f"""
population AS (
  SELECT {_key_sql('c_custkey')} AS geo_id, c_acctbal AS total_pop FROM customer)"""

SHARES_SQL = f"""
shares AS (
  SELECT {_key_sql('user_id')} AS county_fips_code, {', '.join(
      f"count(*) FILTER (event_type = '{e}') / count(*) AS {c}" for c, e in SHARE_EVENTS.items())}
  FROM events GROUP BY 1)"""

POLICY_SQL = f"""
policy AS (
  SELECT CASE WHEN c_nationkey % 5 = 4 THEN 'CA_' ELSE 'US_' END || {_state_sql('c_nationkey')}
           AS region_code, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, {', '.join(
      [f"count(*) FILTER (o_orderpriority = '{p}') AS {c}" for c, p in POLICY_PRIORITIES.items()]
      + [f"count(*) FILTER (o_orderstatus = '{s}') AS {c}" for c, s in POLICY_STATUSES.items()])},
         max(o_totalprice) / 5000 AS stringency_index, count(*) AS testing_policy
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _sum_sql(condition: str, name: str) -> str:
    return f"sum(CASE WHEN {condition} THEN l_quantity ELSE 0 END) AS {name}"


CENSUS_SQL = f"""
counted AS (
  SELECT o_custkey, sum(l_quantity) AS total_pop, {', '.join(
      [_sum_sql(f"l_linestatus = '{s}'", f"{sex}_pop") for sex, s in (("male", "F"), ("female", "O"))]
      + [_sum_sql(f"l_linestatus = '{s}' AND ceil(l_quantity / 5) = {i}", f"{sex}_{b}")
         for sex, s in (("male", "F"), ("female", "O")) for i, b in enumerate(AGE_BANDS, start=1)]
      + [_sum_sql(f"l_linenumber = {line}", g) for g, line in GROUP_LINES.items()])},
         {_sum_sql('l_discount < 0.05', 'pop_determined_poverty_status')}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
census AS (
  SELECT {_key_sql('c_custkey')} AS geo_id, counted.* EXCLUDE (o_custkey),
         CASE WHEN c_acctbal > 0 THEN c_acctbal END AS median_income
  FROM counted JOIN customer ON o_custkey = c_custkey)"""

DENSITY_SQL = """
density AS (
  SELECT c_custkey * 370 + 1000 AS geoid, abs(c_acctbal) / 25 AS B01001_calc_PopDensity
  FROM customer)"""

URBAN_SQL = """
urban AS (
  SELECT c_custkey * 370 + 1000 AS fips_code, c_nationkey % 6 + 1 AS _2013_code FROM customer)"""

FACTS_SQL = """
facts AS (
  SELECT l_orderkey AS order_key, sum(l_extendedprice) AS gross, sum(l_quantity) AS quantity,
         sum(l_discount) AS discount, sum(l_tax) AS tax, CAST(count(*) AS DOUBLE) AS lines,
         CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS open_lines,
         min(l_returnflag) AS flag
  FROM lineitem GROUP BY 1)"""
