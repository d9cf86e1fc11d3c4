"""What the plans must look like to hold at scale."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from panelwright.operators.panel import Period
from panelwright.plans import dataset as ds
from panelwright.plans.period_change import period_change
from workload import standins as st

LAZY = ("period_change", "stage_9_complete", "group_max", "policy_expand", "global_zscore",
        "hist1d", "hist2d", "star_join", "lag_within_month", "running_means", "unpivot_feed",
        "share_of_total", "map_feed", "interaction_terms", "region_flags")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_row_level_exchange_into_one_partition(spark, sf, name):
    plan = _plan(entry.queries()[name](spark, sf))
    # Only the final step of a whole-table aggregate may meet in one place, after partial sums.
    for i, line in enumerate(lines := plan.splitlines()):
        if "SinglePartition" in line:
            assert "partial_" in "".join(lines[i + 1:i + 2]), line
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", LAZY)
def test_no_python_in_the_plan(spark, sf, name):
    plan = _plan(entry.queries()[name](spark, sf))
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("panel")
    rows = [(f"{k:05d}", f"n{k}", "AK", dt.date(2020, 6, 1) + dt.timedelta(days=d), k * d, d, "x")
            for k in range(40) for d in range(60)]
    spark.createDataFrame(
        rows, "county_fips_code string, county_name string, state string, date date, "
              "confirmed_cases long, deaths long, note string").write.parquet(f"{folder}/panel")
    spark.createDataFrame([(f"{k:05d}", 1e4, "x") for k in range(40)],
                          "geo_id string, total_pop double, note string").write.parquet(f"{folder}/people")
    return spark.read.parquet(f"{folder}/panel"), spark.read.parquet(f"{folder}/people")


def test_stored_panel_is_filtered_in_the_scan_and_exchanged_once(stored):
    panel, people = stored
    found = period_change(panel, people, Period(dt.date(2020, 6, 9), dt.date(2020, 6, 16)),
                          Period(dt.date(2020, 7, 14), dt.date(2020, 7, 21)))
    plan = _plan(found)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "date" in line)
    assert "GreaterThanOrEqual(date,2020-06-09)" in scan
    assert "deaths" not in scan and "note" not in scan
    assert plan.count("Exchange hashpartitioning(county_fips_code") == 1
    assert plan.count("Window") == 1
    assert found.count() == 40


def test_bucketed_panel_needs_no_exchange(spark, stored):
    from panelwright.sources.tables import drop_table, load_table, read_table
    panel, people = stored
    load_table(spark, "bucketed_panel", df=panel, buckets=(4, "county_fips_code"))
    load_table(spark, "bucketed_people", df=people, buckets=(4, "geo_id"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        found = period_change(
            read_table(spark, "bucketed_panel"), read_table(spark, "bucketed_people"),
            Period(dt.date(2020, 6, 9), dt.date(2020, 6, 16)),
            Period(dt.date(2020, 7, 14), dt.date(2020, 7, 21)))
        assert "Exchange" not in _plan(found)
        assert found.count() == 40
    finally:
        spark.conf.set(threshold, before)
        drop_table(spark, "bucketed_panel")
        drop_table(spark, "bucketed_people")


def test_policy_filters_and_unused_columns_stay_out_of_the_scan(spark, tmp_path):
    policies = [*ds.POLICY_COLUMNS, *ds.OTHER_POLICY_COLUMNS]
    day = dt.date(2020, 6, 9)
    spark.createDataFrame([("US_AK", day, *[1.0] * 10)],
                          "region_code string, date date, " + ", ".join(f"{p} double" for p in policies)
                          ).write.parquet(str(tmp_path / "tracker"))
    tracker = spark.read.parquet(str(tmp_path / "tracker"))
    rows = ds.with_previous_stringency(ds.policy_rows(tracker, [day]))
    plan = _plan(ds.policy_by_state(ds.policy_maxima(rows)))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "StringStartsWith(region_code,US)" in scan and "In(date" in scan or "EqualTo(date" in scan
    assert "testing_policy" not in scan
    assert "Window" not in plan


def test_whole_table_moments_are_a_scalar_subquery(spark, sf):
    plan = _plan(entry.queries()["global_zscore"](spark, sf))
    assert "Subquery" in plan and "Window" not in plan


def test_event_scan_is_cut_at_the_last_day(spark, sf):
    plan = _plan(st.panel(spark, sf, st.AFTER.last_day))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "ts" in line)
    assert "LessThan(ts,2024-01-24T00:00)" in scan


def test_census_is_read_once(spark, sf):
    plan = _plan(ds.star(st.sources(spark, sf), st.POLICY_DAYS))
    assert sum("FileScan" in line and "l_quantity" in line for line in plan.splitlines()) == 1


def test_rows_are_not_exchanged_on_few_keys(spark, sf):
    """The side with a row per state or flag is stored, so its size decides and it is sent instead."""
    from panelwright.operators.scoring import results_table
    scored = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_returnflag AS flag", "l_quantity AS y", "l_discount AS residual")
    for found in (results_table(scored, "l_orderkey", "flag", "y", {"r": "residual"}),
                  entry.queries()["policy_expand"](spark, sf)):
        plan = _plan(found)
        assert "BroadcastHashJoin" in plan and "BuildRight" in plan
        assert "hashpartitioning(flag" not in plan and "hashpartitioning(state" not in plan


def test_split_flag_moves_no_rows(spark, sf):
    from panelwright.operators.ordering import keyed_split
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    held_out, training = keyed_split(orders.select("o_orderkey", "o_totalprice"), "o_orderkey")
    assert "Exchange" not in _plan(held_out) + _plan(training)
