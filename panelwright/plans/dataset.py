"""Cross-section from a star of county tables, in four variants.

Every dimension has one row per key, so all joins but one share the key and do not multiply
rows. The policies are joined by state: two region codes with the same state in them give a key
two rows. No side is hinted: Spark broadcasts what it finds small enough and co-partitions the
rest. The policies are stored first, so that their size is known when the join is planned.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.calendar import month_number
from panelwright.functions.keys import (
    METROPOLITAN_CLASSES, STATE_REGIONS, group_flags, group_label, has_prefix, leading_int,
    member_flag, restore_leading_zero, slice_text,
)
from panelwright.functions.shares import (
    recode, remainder, reversed_z, row_sum, shares_of_total,
)
from panelwright.operators.panel import on_days, previous_row
from panelwright.plans.period_change import rate_change
from panelwright.runtime import stored

# Column names of the source tables.
SHARE_COLUMNS = ("never", "rarely", "sometimes", "frequently", "always")
POLICY_COLUMNS = (
    "school_closing", "workplace_closing", "cancel_public_events",
    "restrictions_on_gatherings", "close_public_transit", "stay_at_home_requirements",
    "restrictions_on_internal_movement", "international_travel_controls", "stringency_index",
)
OTHER_POLICY_COLUMNS = ("testing_policy",)
AGE_BANDS = (
    "50_to_54", "55_to_59", "60_to_61", "62_to_64", "65_to_66",
    "67_to_69", "70_to_74", "75_to_79", "80_to_84", "85_and_over",
)
GROUP_COLUMNS = ("amerindian_pop", "white_pop", "black_pop", "asian_pop", "hispanic_pop")

# How each variant collapses the five shares.
VARIANTS: dict[str, dict[str, tuple[str, ...]]] = {
    "primary": {c: (c,) for c in SHARE_COLUMNS},
    "alt1": {
        "no_mask": ("never",),
        "sometimes_mask": ("rarely", "sometimes", "frequently"),
        "always_mask": ("always",),
    },
    "alt2": {
        "no_mask": ("never", "rarely"),
        "mask": ("sometimes", "frequently", "always"),
    },
    "alt3": {
        "no_mask": ("never", "rarely", "sometimes"),
        "mask": ("frequently", "always"),
    },
}


def policy_rows(tracker: DataFrame, days: Sequence[dt.date], prefix: str = "US") -> DataFrame:
    """The tracker's rows of one country on the given days."""
    return (tracker.filter(has_prefix("region_code", prefix) & on_days("date", days))
            .select("region_code", "date", *POLICY_COLUMNS, *OTHER_POLICY_COLUMNS))


def with_previous_stringency(rows: DataFrame) -> DataFrame:
    """The stringency of the region's row before, within the month."""
    dated = rows.withColumn("month", month_number("date"))
    return dated.withColumn(
        "prev_stringency", previous_row("stringency_index", ["region_code", "month"], "date"))


def policy_maxima(rows: DataFrame) -> DataFrame:
    """Each policy's greatest value per region, column by column."""
    return rows.groupBy("region_code").agg(
        *[F.max(c).alias(c) for c in (*POLICY_COLUMNS, *OTHER_POLICY_COLUMNS)])


def policy_by_state(maxima: DataFrame) -> DataFrame:
    """Policies under the two-letter state inside the region code."""
    return maxima.select(slice_text("region_code", 4, 2).alias("state"), *POLICY_COLUMNS)


def density_dimension(density: DataFrame) -> DataFrame:
    """Key with its leading zero, density, region label and region flags."""
    keyed = density.select(restore_leading_zero("geoid").alias("geoid"),
                           F.col("B01001_calc_PopDensity").alias("pop_density"))
    coded = keyed.withColumn("state_code", leading_int("geoid", 2))
    return coded.withColumns({
        **group_flags("state_code", STATE_REGIONS),
        "region": group_label("state_code", STATE_REGIONS),
    })


def urban_dimension(urban: DataFrame) -> DataFrame:
    """Key with its leading zero and the metropolitan flag."""
    return urban.select(restore_leading_zero("fips_code").alias("fips_code"),
                        member_flag("_2013_code", METROPOLITAN_CLASSES).alias("metropolitan"))


def with_global_z(df: DataFrame, value: str, mean: str, spread: str, z: str) -> DataFrame:
    """Mean, population deviation and reversed z-score over all rows, on every row.

    The two moments are one scalar subquery: an ordinary aggregate, not a window over
    everything.
    """
    moments = df.agg(F.struct(F.avg(value).alias("mean"),
                              F.stddev_pop(value).alias("spread")).alias("m")).scalar()
    return (df.withColumn("__moments", moments)
            .withColumn(mean, F.col("__moments.mean")).withColumn(spread, F.col("__moments.spread"))
            .drop("__moments").withColumn(z, reversed_z(value, mean, spread)))


@dataclass(frozen=True)
class Sources:
    """The tables a dataset is made of; ``means`` comes from ``period_means``."""

    shares: DataFrame
    means: DataFrame
    policy: DataFrame
    census: DataFrame
    density: DataFrame
    urban: DataFrame


def star(src: Sources, policy_days: Sequence[dt.date], prefix: str = "US") -> DataFrame:
    """Keys present in every table, with raw counts and all shares.

    The census serves twice, as population of the rates and as dimension, with one join.
    """
    key = "county_fips_code"
    policy = stored(policy_by_state(policy_maxima(policy_rows(src.policy, policy_days, prefix))),
                    "policies")
    bands = [f"{sex}_{band}" for sex in ("male", "female") for band in AGE_BANDS]
    census = src.census.filter(F.col("median_income").isNotNull()).select(
        F.col("geo_id").alias(key), "total_pop", "male_pop", "female_pop", *bands, *GROUP_COLUMNS,
        "median_income", "pop_determined_poverty_status")
    density = density_dimension(src.density).withColumnRenamed("geoid", key)
    urban = urban_dimension(src.urban).withColumnRenamed("fips_code", key)
    change = (src.means.join(census, key)
              .withColumn("new_cases_per_10k_difference", rate_change("total_pop"))
              .filter(F.col("new_cases_per_10k_difference").isNotNull()))
    joined = (change.join(src.shares, key).join(density, key).join(urban, key)
              .join(policy, "state"))
    return joined.select(
        key, "county_name", "new_cases_per_10k_difference", *SHARE_COLUMNS, *POLICY_COLUMNS,
        "state", "region", *STATE_REGIONS, "pop_density", "metropolitan",
        "total_pop", "male_pop", *[b for b in bands if b.startswith("male")],
        "female_pop", *[b for b in bands if b.startswith("female")], *GROUP_COLUMNS,
        remainder("total_pop", GROUP_COLUMNS).alias("other_not_disclosed"),
        "median_income", "pop_determined_poverty_status")


def cross_section(joined: DataFrame) -> DataFrame:
    """Z-score over the joined rows, age sums and shares of the population, 39 columns."""
    male = [f"male_{b}" for b in AGE_BANDS]
    female = [f"female_{b}" for b in AGE_BANDS]
    value = "new_cases_per_10k_difference"
    scored = with_global_z(joined, value, "new_cases_mu", "new_cases_sigma", "new_cases_z")
    aged = scored.withColumn("pop_50_and_over", row_sum([*male, *female]))
    before = [c for c in joined.columns
              if c not in {"total_pop", "median_income", *male, *female}]
    ordered = aged.select(*before, "new_cases_mu", "new_cases_sigma", "median_income",
                          "new_cases_z", "pop_50_and_over", "total_pop")
    return shares_of_total(
        ordered, ["male_pop", "female_pop", "pop_50_and_over", *GROUP_COLUMNS,
                  "other_not_disclosed", "pop_determined_poverty_status"],
        "total_pop", drop=["total_pop"])


def variant(primary: DataFrame, name: str) -> DataFrame:
    """The same rows with the shares collapsed as the variant says, in the shares' place."""
    groups = VARIANTS[name]
    names = list(primary.columns)
    first = names.index(SHARE_COLUMNS[0])
    before = names[:first]
    after = [c for c in names[first:] if c not in SHARE_COLUMNS]
    return primary.select(*before, *[row_sum(old).alias(new) for new, old in groups.items()], *after)


def recoded_shares(shares: DataFrame, name: str, key: str = "county_fips_code") -> DataFrame:
    """Only the key and the variant's shares."""
    return recode(shares, [key], VARIANTS[name])


def build_datasets(src: Sources, policy_days: Sequence[dt.date],
                   prefix: str = "US") -> Mapping[str, DataFrame]:
    """All variants from one joined base.

    The base is written to the shared folder once; z-scores and all variants read it
    from there instead of repeating the joins.
    """
    primary = cross_section(stored(star(src, policy_days, prefix)))
    return {name: variant(primary, name) for name in VARIANTS}
