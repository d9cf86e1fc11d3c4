"""Panel stages and period change."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.calendar import month_number, week_number
from panelwright.functions.shares import rate_per
from panelwright.operators.panel import (
    daily_totals, in_spans, on_days, previous_row, running_mean, running_total,
)
from panelwright.plans.dataset import with_previous_stringency
from panelwright.plans.period_change import period_change as change_plan, stages
from workload import standins as st
from workload.registry import query, round_all, rounded, table

_STAGES_SQL = f"""
WITH {st.PANEL_SQL}, {st.BALANCES_SQL},
lagged AS (
  SELECT county_fips_code, county_name, state, date, confirmed_cases,
         lag(confirmed_cases, 1) OVER (PARTITION BY county_fips_code ORDER BY date)
           AS cases_previous_day
  FROM panel WHERE date BETWEEN '2024-01-02' AND '2024-01-09'
                OR date BETWEEN '2024-01-16' AND '2024-01-23'),
new_cases AS (
  SELECT *, CAST((dayofyear(date) - 1 + 7 - ((isodow(date) - 1 - 2 + 7) % 7)) // 7 AS INTEGER)
           AS week, confirmed_cases - cases_previous_day AS new_cases FROM lagged),
unchanged AS (SELECT * FROM new_cases),
whole_weeks AS (SELECT * FROM unchanged WHERE week IN (1, 3)),
with_population AS (
  SELECT county_fips_code, county_name, state, date, week, new_cases, total_pop
  FROM whole_weeks LEFT JOIN population ON county_fips_code = geo_id),
rate AS (
  SELECT * EXCLUDE (new_cases, total_pop),
         new_cases * 10000 / nullif(total_pop, 0) AS new_cases_per_10k FROM with_population),
weekly_mean AS (
  SELECT *, avg(new_cases_per_10k) OVER (PARTITION BY county_fips_code, week ORDER BY date)
           AS avg_new_cases_per_10k FROM rate),
previous_period AS (
  SELECT * EXCLUDE (new_cases_per_10k),
         lag(avg_new_cases_per_10k, 1) OVER (PARTITION BY county_fips_code ORDER BY date)
           AS avg_new_cases_per_10k_prev
  FROM weekly_mean WHERE date = '2024-01-09' OR date = '2024-01-23'),
difference AS (
  SELECT *, avg_new_cases_per_10k - avg_new_cases_per_10k_prev AS new_cases_per_10k_difference
  FROM previous_period),
complete AS (
  SELECT county_fips_code, county_name, state, new_cases_per_10k_difference FROM difference
  WHERE new_cases_per_10k_difference IS NOT NULL)
"""

# Stage, survey lines, and its rounded columns.
_STAGE_LINES = (
    ("lagged", "C1 F1 B3 K2", ()),
    ("new_cases", "B22 B5 B2 K2", ()),
    ("unchanged", "B2 K1 K2", ()),
    ("whole_weeks", "C2 K2", ()),
    ("with_population", "D1 B1 K2", ("total_pop",)),
    ("rate", "B6 B3 G1 K2", ("new_cases_per_10k",)),
    ("weekly_mean", "F2 K2", ("new_cases_per_10k", "avg_new_cases_per_10k")),
    ("previous_period", "C4 F3 K2", ("avg_new_cases_per_10k", "avg_new_cases_per_10k_prev")),
    ("difference", "B5 K2", ("avg_new_cases_per_10k", "avg_new_cases_per_10k_prev",
                             "new_cases_per_10k_difference")),
    ("complete", "C5 G1 K1 K2", ("new_cases_per_10k_difference",)),
)


def _replaced(columns: tuple[str, ...]) -> str:
    if not columns:
        return "*"
    return "* REPLACE (" + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns) + ")"


def _register_stage(position: int, stage: str, covers: str, columns: tuple[str, ...]) -> None:
    @query(covers, f"{_STAGES_SQL} SELECT {_replaced(columns)} FROM {stage}",
           name=f"stage_{position}_{stage}")
    def run(spark, sf):
        listed = stages(st.panel(spark, sf, st.AFTER.last_day), st.balances(spark, sf), [st.BEFORE, st.AFTER])
        label, frame = listed[position]
        assert label == stage
        return round_all(frame)


for _position, (_stage, _covers, _columns) in enumerate(_STAGE_LINES):
    _register_stage(_position, _stage, _covers, _columns)


@query("A2 B5 B6 B22 C1 C2 C4 C5 D1 F1 F2 F3",
       f"{_STAGES_SQL} SELECT {_replaced(('new_cases_per_10k_difference',))} FROM complete")
def period_change(spark, sf):
    """Flagship: change of the mean weekly rate between two periods."""
    panel = st.panel(spark, sf, st.AFTER.last_day)
    return round_all(change_plan(panel, st.balances(spark, sf), st.BEFORE, st.AFTER))


@query("B22", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
       CAST((dayofyear(o_orderdate) - 1 + 7 - ((isodow(o_orderdate) - 1 - 2 + 7) % 7)) // 7 AS INTEGER)
         AS week_from_wednesday,
       CAST((dayofyear(o_orderdate) - 1 + 7 - ((isodow(o_orderdate) - 1 - 6 + 7) % 7)) // 7 AS INTEGER)
         AS week_from_sunday
FROM orders""")
def week_numbers(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return orders.select("o_orderkey", "day", week_number("day").alias("week_from_wednesday"),
                         week_number("day", "sunday").alias("week_from_sunday"))


@query("B23 E4 E5", """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS orders,
       min(o_totalprice) AS least, max(o_totalprice) AS greatest,
       round(avg(o_totalprice), 4) + 0.0 AS mean, round(sum(o_totalprice), 2) + 0.0 AS total
FROM orders GROUP BY 1""")
def month_totals(spark, sf):
    return (table(spark, sf, "orders").groupBy(month_number("o_orderdate").alias("month"))
            .agg(F.count("*").alias("orders"), F.min("o_totalprice").alias("least"),
                 F.max("o_totalprice").alias("greatest"),
                 rounded(F.avg("o_totalprice"), 4).alias("mean"),
                 rounded(F.sum("o_totalprice"), 2).alias("total")))


def _spend(spark, sf):
    return daily_totals(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate",
                        {"spent": F.sum("o_totalprice")})


_SPEND_SQL = """spend AS (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS spent
  FROM orders GROUP BY 1, 2)"""


@query("F1 B5", f"""
WITH {_SPEND_SQL},
c AS (SELECT o_custkey, date, sum(spent) OVER (PARTITION BY o_custkey ORDER BY date) AS total FROM spend),
l AS (SELECT *, lag(total, 1) OVER (PARTITION BY o_custkey ORDER BY date) AS total_before FROM c)
SELECT o_custkey, date, round(total, 2) + 0.0 AS total, round(total_before, 2) + 0.0 AS total_before,
       round(total - total_before, 2) + 0.0 AS added FROM l""")
def lag_cumulative(spark, sf):
    total = _spend(spark, sf).select(
        "o_custkey", "date", running_total("spent", "o_custkey", "date").alias("total"))
    lagged = total.withColumn("total_before", previous_row("total", "o_custkey", "date"))
    return round_all(lagged.withColumn("added", F.col("total") - F.col("total_before")), 2)


@query("F2", f"""
WITH {_SPEND_SQL}
SELECT o_custkey, date, CAST(year(date) AS INTEGER) AS yr,
       round(avg(spent) OVER (PARTITION BY o_custkey, year(date) ORDER BY date), 6) + 0.0 AS mean_so_far
FROM spend""")
def running_means(spark, sf):
    yearly = _spend(spark, sf).withColumn("yr", F.year("date"))
    return yearly.select("o_custkey", "date", "yr",
                         rounded(running_mean("spent", ["o_custkey", "yr"], "date"), 6)
                         .alias("mean_so_far"))


@query("F4 B23", f"""
WITH {st.POLICY_SQL}
SELECT region_code, date, CAST(month(date) AS INTEGER) AS month,
       round(stringency_index, 6) + 0.0 AS stringency_index,
       round(lag(stringency_index) OVER (PARTITION BY region_code, month(date) ORDER BY date), 6) + 0.0
         AS prev_stringency
FROM policy""")
def lag_within_month(spark, sf):
    rows = st.policy(spark, sf).select("region_code", "date", "stringency_index")
    return round_all(with_previous_stringency(rows).select(
        "region_code", "date", "month", "stringency_index", "prev_stringency"))


@query("C1 C3 C4 B24", """
SELECT event_id, user_id, CAST(ts AS DATE) AS day,
       CAST(ts AS DATE) IN (DATE '2024-01-09', DATE '2024-01-23') AS last_day
FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-09'
   OR CAST(ts AS DATE) BETWEEN DATE '2024-01-16' AND DATE '2024-01-23'""")
def date_spans(spark, sf):
    days = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    periods = (st.BEFORE, st.AFTER)
    return (days.filter(in_spans("day", [(p.seed_day, p.last_day) for p in periods]))
            .withColumn("last_day", on_days("day", [p.last_day for p in periods])))


@query("D1 B6", """
SELECT event_id, user_id, round(value * 10000 / nullif(c_acctbal, 0), 6) + 0.0 AS rate
FROM events LEFT JOIN customer ON user_id = c_custkey""")
def left_join_rate(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return (table(spark, sf, "events").select("event_id", "user_id", "value")
            .join(people, F.col("user_id") == F.col("c_custkey"), "left")
            .select("event_id", "user_id", rounded(rate_per("value", "c_acctbal")).alias("rate")))
