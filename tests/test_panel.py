import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.operators.panel import Period, daily_totals
from panelwright.plans.period_change import PanelColumns, period_change, show_stages, stages

BEFORE = Period(dt.date(2020, 6, 9), dt.date(2020, 6, 16))
AFTER = Period(dt.date(2020, 7, 14), dt.date(2020, 7, 21))
SPANS = [d + dt.timedelta(days=i) for d in (BEFORE.seed_day, AFTER.seed_day) for i in range(8)]


def _panel(spark, totals: dict):
    rows = [(k, f"name {k}", "AK", day, total, 0)
            for k, series in totals.items() for day, total in series.items()]
    return spark.createDataFrame(
        rows, "county_fips_code string, county_name string, state string, date date, "
              "confirmed_cases long, deaths long")


def _people(spark, sizes: dict):
    return spark.createDataFrame(list(sizes.items()), "geo_id string, total_pop double")


def _steady(before: int, after: int, missing=()):
    total, series = 0, {}
    for day in SPANS:
        total += before if day <= BEFORE.last_day else after
        if day not in missing:
            series[day] = total
    return series


def _both(spark, totals, sizes):
    panel, people = _panel(spark, totals), _people(spark, sizes)
    by_stage = stages(panel, people, [BEFORE, AFTER])[-1][1]
    short = period_change(panel, people, BEFORE, AFTER)
    plain = lambda df: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())
    assert by_stage.columns == short.columns
    assert plain(by_stage) == plain(short)
    return {r[0]: r[3] for r in plain(short)}


def test_weeks_of_the_periods():
    assert (BEFORE.week(), AFTER.week()) == (24, 29)


def test_difference_of_weekly_means(spark):
    found = _both(spark, {"a": _steady(2, 5), "b": _steady(5, 2)}, {"a": 10_000.0, "b": 20_000.0})
    assert found == {"a": 3.0, "b": -1.5}


def test_keys_that_drop_out(spark):
    totals = {
        "unmatched": _steady(1, 2), "no_people": _steady(1, 2),
        "no_last_day": _steady(1, 2, missing=[AFTER.last_day]),
        "no_first_period_end": _steady(1, 2, missing=[BEFORE.last_day]),
        "kept": _steady(1, 2)}
    sizes = {"no_people": 0.0, "no_last_day": 1e4, "no_first_period_end": 1e4, "kept": 1e4}
    assert _both(spark, totals, sizes) == {"kept": 1.0}


def test_missing_day_makes_the_next_lag_longer(spark):
    gap = BEFORE.seed_day + dt.timedelta(days=3)
    found = _both(spark, {"a": _steady(2, 2, missing=[gap])}, {"a": 10_000.0})
    # Six rows carry the same fourteen cases in the first week.
    assert found["a"] == pytest.approx(2 - 14 / 6)


def test_falling_totals_are_kept(spark):
    assert _both(spark, {"a": _steady(-3, 1)}, {"a": 10_000.0}) == {"a": 4.0}


def test_null_totals_are_ignored_by_the_mean(spark):
    series = _steady(2, 5)
    series[BEFORE.seed_day + dt.timedelta(days=4)] = None
    assert _both(spark, {"a": series}, {"a": 10_000.0}) == {"a": 3.0}


def test_first_day_has_no_lag_and_lag_crosses_the_gap(spark):
    panel = _panel(spark, {"a": _steady(2, 5)})
    listed = dict(stages(panel, _people(spark, {"a": 1e4}), [BEFORE, AFTER]))
    lagged = {r["date"]: r for r in listed["new_cases"].collect()}
    assert lagged[BEFORE.seed_day]["cases_previous_day"] is None
    assert lagged[AFTER.seed_day]["cases_previous_day"] == lagged[BEFORE.last_day]["confirmed_cases"]
    weeks = {r["week"] for r in listed["whole_weeks"].collect()}
    assert weeks == {24, 29}
    assert "deaths" not in listed["lagged"].columns


def test_stage_names_in_order(spark):
    listed = stages(_panel(spark, {"a": _steady(1, 1)}), _people(spark, {"a": 1.0}), [BEFORE, AFTER])
    assert [name for name, _ in listed] == [
        "lagged", "new_cases", "unchanged", "whole_weeks", "with_population", "rate",
        "weekly_mean", "previous_period", "difference", "complete"]


def test_stages_can_be_shown(spark, capsys):
    listed = stages(_panel(spark, {"a": _steady(1, 3)}), _people(spark, {"a": 1e4}), [BEFORE, AFTER])
    show_stages(listed)
    assert capsys.readouterr().out.count("stage ") == 10
    show_stages(listed, final_only=True)
    shown = capsys.readouterr().out
    assert shown.startswith("stage 9: complete") and "|a" in shown


def test_other_column_names(spark):
    names = PanelColumns(key="site", date="day", total="total", carried=(), unused=(),
                         population_key="id", population="size", first_weekday="wednesday")
    panel = spark.createDataFrame([("x", d, t) for d, t in _steady(1, 4).items()],
                                  "site string, day date, total long")
    people = spark.createDataFrame([("x", 10_000.0)], "id string, size double")
    assert period_change(panel, people, BEFORE, AFTER, names).collect()[0][1] == 3.0


def test_daily_totals_make_one_row_per_key_and_day(spark):
    stamps = [("k", dt.datetime(2020, 1, 1, h)) for h in range(20)] + [("k", dt.datetime(2020, 1, 2))]
    rows = spark.createDataFrame(stamps, "k string, ts timestamp")
    found = daily_totals(rows, ["k"], "ts", {"n": F.count("*")}).orderBy("date").collect()
    assert [(r["date"], r["n"]) for r in found] == [
        (dt.date(2020, 1, 1), 20), (dt.date(2020, 1, 2), 1)]
