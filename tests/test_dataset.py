import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.operators.panel import Period
from panelwright.plans import dataset as ds, study
from panelwright.plans.period_change import period_means

DAYS = (dt.date(2020, 6, 9), dt.date(2020, 6, 16), dt.date(2020, 7, 14), dt.date(2020, 7, 21))
BEFORE, AFTER = Period(*DAYS[:2]), Period(*DAYS[2:])

# The dataset's columns in order.
COLUMNS = """county_fips_code county_name new_cases_per_10k_difference never rarely sometimes frequently
always school_closing workplace_closing cancel_public_events restrictions_on_gatherings
close_public_transit stay_at_home_requirements restrictions_on_internal_movement
international_travel_controls stringency_index state region Northeast Midwest South West pop_density
metropolitan new_cases_mu new_cases_sigma median_income new_cases_z male_pop female_pop
pop_50_and_over amerindian_pop white_pop black_pop asian_pop hispanic_pop other_not_disclosed
pop_determined_poverty_status""".split()


def _sources(spark, states=("AL", "AL", "AK", "ZZ", "AL"), regions=("US_AL", "US_AK", "US", "CA_ZZ")):
    keys = ["01001", "01003", "02013", "99001", "01005"]
    panel = spark.createDataFrame(
        [(k, f"n{k}", s, first + dt.timedelta(days=i), (j + 1) * (i + (20 + i if after else 0)), 0)
         for j, (k, s) in enumerate(zip(keys, states))
         for after, first in ((0, DAYS[0]), (1, DAYS[2])) for i in range(8)],
        "county_fips_code string, county_name string, state string, date date, "
        "confirmed_cases long, deaths long")
    shares = spark.createDataFrame([(k, 0.1, 0.1, 0.2, 0.2, 0.4) for k in keys],
                                   "county_fips_code string, never double, rarely double, "
                                   "sometimes double, frequently double, always double")
    policies = [*ds.POLICY_COLUMNS, *ds.OTHER_POLICY_COLUMNS]
    tracker = spark.createDataFrame(
        [(r, day, *[float(i + j) if (i + j) % 3 else None for j in range(10)])
         for r in regions for i, day in enumerate((*DAYS, dt.date(2020, 8, 1)))],
        "region_code string, date date, " + ", ".join(f"{p} double" for p in policies))
    bands = [f"{s}_{b}" for s in ("male", "female") for b in ds.AGE_BANDS]
    counts = ["total_pop", "male_pop", "female_pop", *bands, *ds.GROUP_COLUMNS,
              "pop_determined_poverty_status"]
    sizes = [1000.0, 480.0, 520.0, *[10.0] * 20, 10.0, 700.0, 150.0, 60.0, 90.0, 120.0]
    census = spark.createDataFrame(
        [(k, *sizes, None if k == "01005" else 50_000.0) for k in keys],
        "geo_id string, " + ", ".join(f"{c} double" for c in counts) + ", median_income double")
    density = spark.createDataFrame([(int(k), 100.0) for k in keys],
                                    "geoid long, B01001_calc_PopDensity double")
    urban = spark.createDataFrame([(int(k), i + 3) for i, k in enumerate(keys)],
                                  "fips_code long, _2013_code int")
    return ds.Sources(shares=shares, means=period_means(panel, BEFORE, AFTER), policy=tracker,
                      census=census, density=density, urban=urban)


def test_dataset_rows_and_columns(spark):
    found = ds.build_datasets(_sources(spark), DAYS)
    primary = found["primary"]
    assert primary.columns == COLUMNS and len(COLUMNS) == 39
    rows = {r["county_fips_code"]: r for r in primary.collect()}
    # 99001 has no policy, 01005 no income.
    assert set(rows) == {"01001", "01003", "02013"}
    one = rows["01001"]
    assert one["region"] == "South" and one["South"] == 1 and one["metropolitan"] == 1
    assert rows["02013"]["region"] == "West" and rows["02013"]["metropolitan"] == 0
    assert one["new_cases_per_10k_difference"] == pytest.approx(10.0)
    assert one["pop_50_and_over"] == pytest.approx(0.2) and one["male_pop"] == 0.48
    assert one["other_not_disclosed"] == pytest.approx((1000 - 1010) / 1000)
    values = [r["new_cases_per_10k_difference"] for r in rows.values()]
    mean = sum(values) / 3
    spread = (sum((v - mean) ** 2 for v in values) / 3) ** 0.5
    assert one["new_cases_mu"] == pytest.approx(mean)
    assert one["new_cases_sigma"] == pytest.approx(spread)
    assert one["new_cases_z"] == pytest.approx((mean - values[0]) / spread)
    # Greatest of 0, 1, 2, 3 with every third value missing.
    assert one["school_closing"] == 2.0 and one["workplace_closing"] == 4.0


def test_variants_differ_only_in_their_shares(spark):
    found = ds.build_datasets(_sources(spark), DAYS)
    assert {n: len(d.columns) for n, d in found.items()} == {
        "primary": 39, "alt1": 37, "alt2": 36, "alt3": 36}
    assert found["alt2"].columns[3:5] == ["no_mask", "mask"]
    row = {n: found[n].filter("county_fips_code = '01001'").first() for n in found}
    assert row["alt1"]["sometimes_mask"] == pytest.approx(0.5)
    assert row["alt2"]["mask"] == pytest.approx(0.8) and row["alt3"]["mask"] == pytest.approx(0.6)
    assert row["alt3"]["new_cases_z"] == row["primary"]["new_cases_z"]


def test_two_regions_with_the_same_letters_fan_out(spark):
    found = ds.star(_sources(spark, regions=("US_AL", "USXAL", "US_AK")), DAYS)
    assert found.filter("county_fips_code = '01001'").count() == 2


def test_previous_stringency_stays_inside_region_and_month(spark):
    rows = ds.policy_rows(_sources(spark).policy, DAYS)
    found = ds.with_previous_stringency(rows).filter("region_code = 'US_AL'").orderBy("date").collect()
    assert [r["prev_stringency"] for r in found] == [
        None, found[0]["stringency_index"], None, found[2]["stringency_index"]]
    assert set(r["region_code"] for r in rows.collect()) == {"US_AL", "US_AK", "US"}


def test_z_score_of_equal_values_is_null(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, v double")
    found = ds.with_global_z(rows, "v", "mu", "sigma", "z").collect()
    assert [(r["mu"], r["sigma"], r["z"]) for r in found] == [(5.0, 0.0, None)] * 2


def test_regression_inputs_have_the_expected_width(spark):
    found = ds.build_datasets(_sources(spark), DAYS)
    widths = {n: len(study.regression_input(d).columns) for n, d in found.items()}
    assert widths == {"primary": 34, "alt1": 32, "alt2": 31, "alt3": 31}
    terms = {n: len(study.regression_design(d, n)[1]) for n, d in found.items()}
    assert terms == {"primary": 31, "alt1": 27, "alt2": 23, "alt3": 23}


def test_study_on_a_known_effect(spark):
    rows = spark.range(1500).select(
        F.format_string("%05d", "id").alias(study.KEY), F.concat(F.lit("S"), F.col("id") % 9).alias("state"),
        *[F.rand(i).alias(c) for i, c in enumerate(
            ["no_mask", "mask", *[c for c in study.predictors("alt2") if c != "mask"]])])
    flagged = rows.withColumn("metropolitan", F.round("metropolitan"))
    data = flagged.withColumn(
        study.RESPONSE, 3 * F.col("South") - 2 * F.col("mask") + F.randn(77) * 0.5)
    found = study.analyse(data, "alt2", replicates=10)
    assert found.full.n == 1200 and found.numbers["validation_rows"] == 300
    assert {"South", "mask"} <= set(found.step.predictors)
    assert {"South", "mask"} <= set(found.subsets.model.predictors)
    assert found.errors["step"] == pytest.approx(0.5, abs=0.06)
    assert found.tests["step_f"].p_value > 0.01
    assert set(found.profiles) == {67.0, 100.0}
    assert found.outputs.count() == 1500
    table = found.results.groupBy("state").agg(F.countDistinct("alt2_rsq_state").alias("n")).collect()
    assert len(table) == 9 and all(r["n"] == 1 for r in table)
    raw = study.analyse(data, "alt2", shifts=[67.0], replicates=5, raw_power=True)
    negative = data.filter(f"{study.RESPONSE} < 0").count()
    assert 0 < raw.transformed[67.0].dropped <= negative
    assert found.transformed[67.0].dropped == 0
    sections = {r["section"] for r in found.report(spark).collect()}
    assert {"full", "step", "rmspe", "shapiro", "boxcox_shift_67", "best_subset"} <= sections


def test_skipped_steps_are_reported(spark):
    rows = spark.range(600).select(
        F.format_string("%05d", "id").alias(study.KEY), F.concat(F.lit("S"), F.col("id") % 9).alias("state"),
        *[F.rand(i).alias(c) for i, c in enumerate(
            ["no_mask", "mask", *[c for c in study.predictors("alt2") if c != "mask"]])])
    data = rows.withColumn(study.RESPONSE, 3 * F.col("South") - 2 * F.col("mask") + F.randn(77) * 0.5)
    found = study.analyse(data, "alt2", shifts=[-50.0])
    said = {(r["section"], r["measure"]): r["value"] for r in found.report(spark).collect()
            if r["measure"].startswith("skipped")}
    assert said == {
        ("boxcox_shift_-50", "skipped: least shifted response is not positive"):
            pytest.approx(found.numbers["low"] - 50)}
