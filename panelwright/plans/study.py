"""The regression study on one variant of the dataset."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.shares import power
from panelwright.operators import boxcox, diagnostics, leastsquares as ls, selection
from panelwright.operators.ordering import keyed_split
from panelwright.operators.scoring import results_table, rmspe
from panelwright.operators.summary import value_ranges
from panelwright.plans.dataset import GROUP_COLUMNS, POLICY_COLUMNS, SHARE_COLUMNS
from panelwright.runtime import stored

KEY = "county_fips_code"
RESPONSE = "new_cases_per_10k_difference"
GROUP = "state"

# Dataset columns that are not regression inputs.
NOT_EXPORTED = ("county_name", "region", "new_cases_mu", "new_cases_sigma", "new_cases_z")

_COMMON = (
    *(c for c in POLICY_COLUMNS if c != "international_travel_controls"),
    "Midwest", "South", "West", "pop_density", "metropolitan", "median_income",
    "pop_50_and_over", *GROUP_COLUMNS, "pop_determined_poverty_status",
)

# Shares that enter each variant's model, and the products with the urban flag.
MODEL_SHARES = {
    "primary": SHARE_COLUMNS,
    "alt1": ("no_mask", "sometimes_mask", "always_mask"),
    "alt2": ("mask",),
    "alt3": ("mask",),
}
PRODUCTS = {
    "primary": {
        "I_nev_metro": ("never", "metropolitan"), "I_rar_metro": ("rarely", "metropolitan"),
        "I_som_metro": ("sometimes", "metropolitan"), "I_frq_metro": ("frequently", "metropolitan"),
        "I_alw_metro": ("always", "metropolitan")},
    "alt1": {
        "I_no_metro": ("no_mask", "metropolitan"),
        "I_som_metro": ("sometimes_mask", "metropolitan"),
        "I_alw_metro": ("always_mask", "metropolitan")},
    "alt2": {"I_mask_metro": ("mask", "metropolitan")},
    "alt3": {"I_mask_metro": ("mask", "metropolitan")},
}


def predictors(variant: str) -> list[str]:
    return [*MODEL_SHARES[variant], *_COMMON]


def regression_input(dataset: DataFrame) -> DataFrame:
    return dataset.drop(*NOT_EXPORTED)


def regression_design(dataset: DataFrame, variant: str) -> tuple[DataFrame, list[str]]:
    """Key, state, response and all model terms; returns the frame and the terms."""
    names = predictors(variant)
    frame, _ = ls.design(dataset, KEY, RESPONSE, [GROUP, *names], PRODUCTS[variant])
    terms = [*names, *PRODUCTS[variant]]
    return frame, terms


@dataclass
class Study:
    """Everything the study finds: p-sized models and test results, and lazy frames."""

    full: ls.LinearModel
    step: ls.LinearModel
    path: list[selection.Step]
    tests: dict[str, diagnostics.TestResult]
    profiles: dict[float, list[boxcox.Profile]]
    transformed: dict[float, ls.LinearModel]
    subsets: selection.SubsetSearch | None
    errors: dict[str, float | None]
    outputs: DataFrame
    results: DataFrame
    numbers: dict[str, float | None] = field(default_factory=dict)
    skipped: dict[str, tuple[str, float]] = field(default_factory=dict)

    def report(self, spark) -> DataFrame:
        """All single numbers as rows (section, measure, value)."""
        rows: list[tuple[str, str, float | None]] = []
        for name, model in (("full", self.full), ("step", self.step)):
            rows += [(name, measure, value) for measure, value in model.summary_rows()]
        for name, test in self.tests.items():
            rows += [(name, "statistic", test.statistic), (name, "p_value", test.p_value)]
        for shift, rounds in self.profiles.items():
            rows += [(f"boxcox_shift_{shift:g}", f"best_{i}", p.best) for i, p in enumerate(rounds, 1)]
        rows += [("rmspe", name, value) for name, value in self.errors.items()]
        rows += [("response", name, value) for name, value in self.numbers.items()]
        if self.subsets is not None:
            rows.append(("best_subset", "size", float(self.subsets.size)))
        rows += [(name, f"skipped: {why}", value) for name, (why, value) in self.skipped.items()]
        plain = [(s, m, None if v is None else float(v)) for s, m, v in rows]
        return spark.createDataFrame(plain, "section string, measure string, value double")


def analyse(dataset: DataFrame, variant: str, shifts: Sequence[float] = (67.0, 100.0),
            validation: float = 0.2, seed: int = 37, replicates: int = 100,
            raw_power: bool = False) -> Study:
    """Fit, test, transform, select, compare and validate, on one keyed split.

    The design is written to the shared folder once, since every later step reads it.
    A shift that leaves the response non-positive is skipped, and so is the search for best
    subsets when elimination leaves no predictor or there are too few rows for it; the report has a row with the reason for each skipped step. With
    ``raw_power`` the found exponents apply to the response as it is; its negative values
    then have no power, and their rows are left out and counted.
    """
    frame, terms = regression_design(dataset, variant)
    frame = stored(frame)
    held_out, training = keyed_split(frame, KEY, validation, seed)

    full = ls.fit(training, RESPONSE, terms)
    step, path = selection.backward_by_aic(full)
    scored = step.score(full.score(training), "step_yhat", "step_residual")
    low, high = value_ranges(training, [RESPONSE])[RESPONSE]
    usable_shifts = [s for s in shifts if low + s > 0]
    skipped = {f"boxcox_shift_{s:g}": ("least shifted response is not positive", low + s)
               for s in shifts if s not in usable_shifts}

    searched = boxcox.refine_shifts(training, RESPONSE, terms, usable_shifts) if usable_shifts else {}

    def transform(shift: float) -> tuple[list[boxcox.Profile], ls.LinearModel, DataFrame]:
        rounds = searched[shift]
        base = F.col(RESPONSE) + F.lit(0.0 if raw_power else float(shift))
        powered = training.withColumn("y_power", power(base, rounds[-1].best))
        model = ls.fit(powered, "y_power", terms)
        return rounds, model, model.score(powered)

    def best_subsets() -> selection.SubsetSearch | None:
        if not step.predictors:
            skipped["best_subset"] = ("no predictor left", 0.0)
            return None
        try:
            return selection.best_subset_cv(
                training, RESPONSE, step.predictors, KEY, replicates, seed)
        except selection.TooFewRows as few:
            skipped["best_subset"] = (str(few), float(step.n))
            return None

    def constant_spread(rows: DataFrame, residual: str, by: str) -> diagnostics.TestResult:
        return diagnostics.brown_forsythe(rows, residual, by)

    # Steps that do not need each other submit their jobs side by side.
    with ThreadPoolExecutor(4) as pool:
        searching = pool.submit(best_subsets)
        moved = dict(zip(usable_shifts, pool.map(transform, usable_shifts)))
        asked = {
            "brown_forsythe": (constant_spread, scored, "residual", "yhat"),
            "": (diagnostics.normality, scored, "residual", KEY),
            "step_": (diagnostics.normality, scored, "step_residual", KEY)}
        for shift, (_, _, rows) in moved.items():
            asked[f"power_{shift:g}_brown_forsythe"] = (
                constant_spread, rows, "residual", "yhat")
            asked[f"power_{shift:g}_"] = (diagnostics.normality, rows, "residual", KEY)
        pending = {name: pool.submit(*call) for name, call in asked.items()}
        tests = {}
        for name, job in pending.items():
            found = job.result()
            if isinstance(found, diagnostics.Normality):
                tests |= {f"{name}shapiro": found.shapiro, f"{name}anderson": found.anderson}
            else:
                tests[name] = found
        subsets = searching.result()

    tests["step_f"] = diagnostics.nested_f_test(step, full)
    if subsets is not None:
        tests["subset_f"] = diagnostics.nested_f_test(subsets.model, step)
    profiles = {shift: rounds for shift, (rounds, _, _) in moved.items()}
    transformed = {shift: model for shift, (_, model, _) in moved.items()}

    judged = held_out.select(
        rmspe(RESPONSE, full.fitted()).alias("full"), rmspe(RESPONSE, step.fitted()).alias("step"),
        F.count("*").alias("n")).first()
    everywhere = step.score(full.score(frame), "step_yhat", "step_residual")
    results = results_table(everywhere, KEY, GROUP, RESPONSE, {
        f"{variant}_rsq_state": "residual", f"{variant}_step_rsq_state": "step_residual"})
    return Study(full, step, path, tests, profiles, transformed, subsets,
                 {"full": judged["full"], "step": judged["step"]},
                 everywhere.select(KEY, GROUP, RESPONSE, "yhat", "residual", "step_yhat",
                                   "step_residual"),
                 results, {"low": low, "high": high, "range": high - low,
                           "validation_rows": float(judged["n"])}, skipped)
