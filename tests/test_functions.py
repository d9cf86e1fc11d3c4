import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from panelwright.functions import calendar, keys, shares, tails
from panelwright.functions.normal import inverse_normal


def _count_weeks(day: dt.date, first: int) -> int:
    weeks, current = 0, dt.date(day.year, 1, 1)
    while current <= day:
        weeks += current.weekday() == first
        current += dt.timedelta(days=1)
    return weeks


@pytest.mark.parametrize("name", ["monday", "wednesday", "sunday"])
def test_week_number_counts_first_weekdays(spark, name):
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=3 * i) for i in range(900)]
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    found = rows.select("d", calendar.week_number("d", name).alias("w")).collect()
    for row in found:
        expected = _count_weeks(row["d"], calendar.WEEKDAYS[name])
        assert row["w"] == expected == calendar.week_of(row["d"], name)


def test_days_before_first_wednesday_are_week_zero(spark):
    row = spark.createDataFrame([(dt.date(2020, 6, 9), dt.date(2020, 6, 10), dt.date(2019, 1, 1))],
                                "a date, b date, c date")
    found = row.select(*[calendar.week_number(c).alias(c) for c in "abc"]).first()
    assert tuple(found) == (22 + 1, 24, 0)


def test_only_four_characters_get_a_zero(spark):
    rows = spark.createDataFrame([(1001,), (56045,), (123,), (100200,), (None,)], "k long")
    found = [r[0] for r in rows.select(keys.restore_leading_zero("k")).collect()]
    assert found == ["01001", "56045", "123", "100200", None]


def test_region_flags_and_label(spark):
    rows = spark.createDataFrame([(9,), (17,), (1,), (2,), (72,), (None,)], "s int")
    found = rows.select(*[c.alias(n) for n, c in keys.group_flags("s", keys.STATE_REGIONS).items()],
                        keys.group_label("s", keys.STATE_REGIONS).alias("label")).collect()
    assert [tuple(r) for r in found] == [
        (1, 0, 0, 0, "Northeast"), (0, 1, 0, 0, "Midwest"), (0, 0, 1, 0, "South"),
        (0, 0, 0, 1, "West"), (0, 0, 0, 0, None), (0, 0, 0, 0, None)]


def test_regions_cover_fifty_one_codes_once():
    codes = [c for group in keys.STATE_REGIONS.values() for c in group]
    assert len(codes) == len(set(codes)) == 51


def test_metropolitan_flag(spark):
    rows = spark.createDataFrame([(1,), (4,), (5,), (None,)], "c int")
    found = [r[0] for r in rows.select(keys.member_flag("c", keys.METROPOLITAN_CLASSES)).collect()]
    assert found == [1, 1, 0, 0]


def test_slices_and_prefix(spark):
    rows = spark.createDataFrame([("US",), ("US_AK",), ("CA_ON",)], "r string")
    found = rows.select(keys.has_prefix("r", "US"), keys.slice_text("r", 4, 2)).collect()
    assert [tuple(r) for r in found] == [(True, ""), (True, "AK"), (False, "ON")]


def test_rates_and_shares_guard_zero(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (5.0, 50.0), (-5.0, 50.0), (None, 50.0)],
                                 "n double, p double")
    found = [r[0] for r in rows.select(shares.rate_per("n", "p")).collect()]
    assert found == [None, 1000.0, -1000.0, None]


def test_row_sum_is_null_when_a_term_is(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 3.0)], "a double, b double, c double")
    assert [r[0] for r in rows.select(shares.row_sum(["a", "b", "c"])).collect()] == [6.0, None]


def test_redefined_columns_move_to_the_end(spark):
    rows = spark.createDataFrame([(1, 2.0, 4.0, 8.0)], "k int, a double, t double, b double")
    found = shares.shares_of_total(rows, ["a", "b"], "t", drop=["t"])
    assert found.columns == ["k", "a", "b"] and tuple(found.first()) == (1, 0.5, 2.0)
    assert shares.redefine(rows, {"a": F.col("a") * 2}).columns == ["k", "t", "b", "a"]


def test_reversed_z_is_positive_below_the_mean(spark):
    row = spark.createDataFrame([(1.0, 3.0, 2.0, 0.0)], "x double, m double, s double, z double")
    found = row.select(shares.reversed_z("x", "m", "s"), shares.reversed_z("x", "m", "z")).first()
    assert tuple(found) == (1.0, None)


def test_power_log_branch_and_negative_base(spark):
    row = spark.createDataFrame([(2.0, -2.0)], "a double, b double")
    found = row.select(shares.power("a", 0), shares.power("a", 1.5), shares.power("b", 1.5)).first()
    assert found[0] == pytest.approx(math.log(2)) and found[1] == pytest.approx(2 ** 1.5)
    assert math.isnan(found[2])


def test_inverse_normal_equals_library(spark):
    probs = [1e-300, 1e-20, 1e-9, 0.001, 0.07, 0.3, 0.5, 0.72, 0.9, 0.99, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in probs], "p double")
    for row in rows.select("p", inverse_normal("p").alias("z")).collect():
        assert row["z"] == pytest.approx(NormalDist().inv_cdf(row["p"]), rel=1e-13, abs=1e-15)
    edges = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(inverse_normal("p")).collect()
    assert [r[0] for r in edges] == [None, None]


def test_tail_probabilities():
    # Table values: t(10) at 2.228139 is 5 %, F(3, 20) at 3.098391 is 5 %.
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(1.7, 2) == pytest.approx(1 - 1.7 / math.sqrt(2 + 1.7 ** 2), rel=1e-13)
    assert tails.t_two_sided(-1.0, 1) == pytest.approx(0.5, abs=1e-14)
    assert tails.f_upper(3.098391, 3, 20) == pytest.approx(0.05, abs=1e-7)
    assert tails.f_upper(4.0, 2, 30) == pytest.approx((1 + 8 / 30) ** -15, rel=1e-12)
    assert tails.t_two_sided(1.96, 1e7) == pytest.approx(2 * tails.normal_upper(1.96), rel=1e-5)
    assert tails.normal_upper(tails.normal_quantile(0.9)) == pytest.approx(0.1, abs=1e-14)
    assert tails.t_two_sided(None, 5) is None and tails.f_upper(1.0, 0, 5) is None


def test_fixed_decimals(spark):
    row = spark.createDataFrame([(1 / 3, -2.0)], "a double, b double")
    assert tuple(row.select(keys.fixed_decimals("a"), keys.fixed_decimals("b", 2)).first()) == (
        "0.3333", "-2.00")
