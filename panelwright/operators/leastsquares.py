"""Least squares by tall-skinny QR: one pass over the rows, a small triangle as the result.

Every task folds its Arrow batches into the triangular factor of ``[1 X]`` together with
the rotated responses and the squared residuals; the factors are merged in groups on the
executors, level by level, and the last few on the driver. The QR form keeps full precision for nearly
collinear predictors, where cross-products lose half of the digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.shares import interactions as product_columns
from panelwright.functions.tails import f_upper, t_two_sided
from panelwright.operators.ordering import column_quantiles

INTERCEPT = "(Intercept)"

# Fixed value: a column whose remaining norm falls below this share of its norm is aliased.
ALIAS_TOLERANCE = 1e-7

# Task results are merged in groups of this many, twice, before the rest is brought together.
_FAN_IN = 128

_FACTOR_SCHEMA = "slot int, n long, dropped long, refused long, logs double, " \
                 "r array<double>, qty array<double>, rss array<double>"


@dataclass
class Factor:
    """Triangle of ``[1 X]``, rotated responses, squared residuals and row counts."""

    r: np.ndarray
    qty: np.ndarray
    rss: np.ndarray
    n: int = 0
    dropped: int = 0
    refused: int = 0
    logs: float = 0.0

    @classmethod
    def empty(cls, width: int, responses: int) -> Factor:
        return cls(np.zeros((width, width)), np.zeros((width, responses)), np.zeros(responses))

    def _fold(self, x: np.ndarray, y: np.ndarray) -> None:
        stacked = np.vstack([self.r, x])
        targets = np.vstack([self.qty, y])
        q, r = np.linalg.qr(stacked)
        qty = q.T @ targets
        left = targets - q @ qty
        self.rss = self.rss + np.einsum("ij,ij->j", left, left)
        self.r, self.qty = r, qty

    def add_rows(self, x: np.ndarray, y: np.ndarray) -> None:
        self._fold(np.column_stack([np.ones(len(x)), x]), y)
        self.n += len(x)

    def merge(self, other: Factor) -> None:
        if other.n:
            self._fold(other.r, other.qty)
        self.rss = self.rss + other.rss
        self.n += other.n
        self.dropped += other.dropped
        self.refused += other.refused
        self.logs += other.logs

    def columns(self, slot: int) -> dict[str, list]:
        return {"slot": [slot], "n": [self.n], "dropped": [self.dropped],
                "refused": [self.refused], "logs": [self.logs],
                "r": [self.r.ravel().tolist()], "qty": [self.qty.ravel().tolist()],
                "rss": [self.rss.tolist()]}

    @classmethod
    def from_row(cls, row: Mapping, width: int) -> Factor:
        return cls(np.array(row["r"], dtype=float).reshape(width, width),
                   np.array(row["qty"], dtype=float).reshape(width, -1),
                   np.array(row["rss"], dtype=float), int(row["n"]), int(row["dropped"]),
                   int(row["refused"]), float(row["logs"]))


def batch_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([
        column.to_numpy(zero_copy_only=False).astype(float, copy=False)
        for column in batch.columns])


def merged_in_levels(rows: DataFrame, merge: Callable[[pa.Table], pa.Table], schema: str,
                     *keys: str, levels: int = 2) -> DataFrame:
    """Task results (slot, ...) merged in a tree: slots of neighbouring tasks, a bounded number a group.

    ``slot`` starts as the number of the task. After two levels there is one row, per ``keys``, for
    every 16,384 tasks.
    """
    for _ in range(levels):
        rows = (rows.withColumn("slot", F.floor(F.col("slot") / _FAN_IN).cast("int"))
                .groupBy(*keys, "slot").applyInArrow(merge, schema))
    return rows


def accumulate(df: DataFrame, response: str, predictors: Sequence[str], responses: int = 1,
               expand: Callable[[np.ndarray], np.ndarray] | None = None,
               positive: bool = False) -> Factor:
    """One distributed pass. ``expand`` turns the response into several response columns.

    With ``positive`` the logs of the response are summed, and rows where it is not positive
    are refused: left out and counted.
    """
    width = len(predictors) + 1
    needed = df.select(*[F.col(c).cast("double").alias(c) for c in (response, *predictors)])
    schema = pa.schema([
        ("slot", pa.int32()), ("n", pa.int64()), ("dropped", pa.int64()),
        ("refused", pa.int64()), ("logs", pa.float64()),
        ("r", pa.list_(pa.float64())), ("qty", pa.list_(pa.float64())),
        ("rss", pa.list_(pa.float64()))])

    def fold(batches: Iterable[pa.RecordBatch]):
        factor = Factor.empty(width, responses)
        for batch in batches:
            rows = batch_matrix(batch)
            whole = np.isfinite(rows).all(axis=1)
            factor.dropped += int((~whole).sum())
            rows = rows[whole]
            if positive:
                above = rows[:, 0] > 0
                factor.refused += int((~above).sum())
                rows = rows[above]
                factor.logs += float(np.log(rows[:, 0]).sum())
            if len(rows) == 0:
                continue
            y = rows[:, :1] if expand is None else expand(rows[:, 0])
            factor.add_rows(rows[:, 1:], y)
        yield pa.RecordBatch.from_pydict(
            factor.columns(TaskContext.get().partitionId()), schema=schema)

    def merge_group(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        merged = Factor.from_row(rows[0], width)
        for row in rows[1:]:
            merged.merge(Factor.from_row(row, width))
        return pa.Table.from_pydict(merged.columns(rows[0]["slot"]), schema=schema)

    merged = merged_in_levels(needed.mapInArrow(fold, _FACTOR_SCHEMA), merge_group, _FACTOR_SCHEMA)
    total = Factor.empty(width, responses)
    for row in sorted(merged.collect(), key=lambda r: r["slot"]):
        total.merge(Factor.from_row(row, width))
    return total


def independent_columns(r: np.ndarray, tolerance: float = ALIAS_TOLERANCE) -> list[int]:
    """Columns, in order, that are not combinations of the ones before them."""
    kept: list[int] = []
    basis = np.zeros((r.shape[0], 0))
    for j in range(r.shape[1]):
        column = r[:, j]
        norm = np.linalg.norm(column)
        rest = column - basis @ (basis.T @ column)
        rest = rest - basis @ (basis.T @ rest)
        size = np.linalg.norm(rest)
        if norm > 0 and size > tolerance * norm:
            kept.append(j)
            basis = np.column_stack([basis, rest / size])
    return kept


@dataclass
class LinearModel:
    """A fitted model. Aliased terms have no coefficient."""

    response: str
    predictors: list[str]
    coefficients: dict[str, float | None]
    n: int
    dropped: int
    rss: float
    tss: float
    std_errors: dict[str, float] = field(default_factory=dict)
    factor: Factor | None = None

    @property
    def rank(self) -> int:
        return sum(v is not None for v in self.coefficients.values())

    @property
    def df_residual(self) -> int:
        return self.n - self.rank

    @property
    def r_squared(self) -> float | None:
        return 1.0 - self.rss / self.tss if self.tss > 0 else None

    @property
    def adj_r_squared(self) -> float | None:
        if self.r_squared is None or self.df_residual <= 0:
            return None
        return 1.0 - (1.0 - self.r_squared) * (self.n - 1) / self.df_residual

    @property
    def sigma(self) -> float | None:
        return math.sqrt(self.rss / self.df_residual) if self.df_residual > 0 else None

    @property
    def f_statistic(self) -> float | None:
        if self.rank < 2 or self.df_residual <= 0 or self.rss <= 0:
            return None
        return ((self.tss - self.rss) / (self.rank - 1)) / (self.rss / self.df_residual)

    @property
    def f_p_value(self) -> float | None:
        return f_upper(self.f_statistic, self.rank - 1, self.df_residual)

    @property
    def deviance(self) -> float:
        """Residual sum of squares."""
        return self.rss

    @property
    def aic(self) -> float:
        return self.n * math.log(self.rss / self.n) + 2 * self.rank if self.rss > 0 else -math.inf

    def coefficient_rows(self) -> list[tuple]:
        rows = []
        for term, estimate in self.coefficients.items():
            error = self.std_errors.get(term)
            t = estimate / error if estimate is not None and error else None
            rows.append((term, estimate, error, t, t_two_sided(t, self.df_residual)))
        return rows

    def coefficient_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.coefficient_rows(),
            "term string, estimate double, std_error double, t_value double, p_value double")

    def summary_rows(self) -> list[tuple[str, float | None]]:
        numbers = {
            "n": self.n, "dropped": self.dropped, "df_residual": self.df_residual,
            "rss": self.rss, "sigma": self.sigma, "r_squared": self.r_squared,
            "adj_r_squared": self.adj_r_squared, "f_statistic": self.f_statistic,
            "f_p_value": self.f_p_value}
        return [(name, None if v is None else float(v)) for name, v in numbers.items()]

    def fitted(self) -> Column:
        """The prediction as a column expression over the predictor columns."""
        total = F.lit(float(self.coefficients[INTERCEPT] or 0.0))
        for name in self.predictors:
            weight = self.coefficients[name]
            if weight is not None:
                total = total + F.lit(float(weight)) * F.col(name)
        return total

    def score(self, df: DataFrame, fitted: str = "yhat", residual: str = "residual") -> DataFrame:
        """Add prediction and residual; keys and other columns stay on the row."""
        return (df.withColumn(fitted, self.fitted())
                .withColumn(residual, F.col(self.response).cast("double") - F.col(fitted)))

    def subset(self, predictors: Sequence[str]) -> LinearModel:
        """The model on fewer predictors, from the same triangle and without the data."""
        if self.factor is None:
            raise ValueError("this model has no factor to refit from")
        at = [0, *[self.predictors.index(p) + 1 for p in predictors]]
        return solve(self.factor, at, self.response, list(predictors))

    def residual_quantiles(self, df: DataFrame) -> list[float]:
        """Least, quartiles and greatest residual."""
        scored = self.score(df).select("residual")
        return column_quantiles(scored, ["residual"], [0, 0.25, 0.5, 0.75, 1])["residual"]


def solve(factor: Factor, at: Sequence[int], response: str, predictors: list[str],
          column: int = 0) -> LinearModel:
    """Coefficients for the chosen columns of a factor (column 0 is the intercept)."""
    full = factor.r[:, list(at)]
    kept = independent_columns(full)
    target = factor.qty[:, column]
    q, r = np.linalg.qr(full[:, kept])
    rotated = q.T @ target
    left = target - q @ rotated
    rss = float(factor.rss[column] + left @ left)
    tss = float(factor.rss[column] + target[1:] @ target[1:])
    beta = np.linalg.solve(r, rotated) if kept else np.zeros(0)
    terms = [INTERCEPT, *predictors]
    coefficients: dict[str, float | None] = {t: None for t in terms}
    errors: dict[str, float] = {}
    freedom = factor.n - len(kept)
    inverse = np.linalg.inv(r) if kept else np.zeros((0, 0))
    for i, j in enumerate(kept):
        coefficients[terms[j]] = float(beta[i])
        if freedom > 0:
            errors[terms[j]] = math.sqrt(rss / freedom) * float(np.linalg.norm(inverse[i]))
    return LinearModel(response, predictors, coefficients, factor.n, factor.dropped, rss, tss,
                       errors, factor if column == 0 and factor.qty.shape[1] == 1 else None)


def fit(df: DataFrame, response: str, predictors: Sequence[str]) -> LinearModel:
    """Ordinary least squares with an intercept. Rows with a NULL or NaN are left out and counted."""
    predictors = list(predictors)
    factor = accumulate(df, response, predictors)
    if factor.n == 0:
        raise ValueError("no complete row to fit")
    return solve(factor, range(len(predictors) + 1), response, predictors)


def design(df: DataFrame, key: str, response: str, predictors: Sequence[str],
           products: Mapping[str, tuple[str, str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Key, response, predictors and product terms by name; returns the frame and the terms."""
    products = dict(products or {})
    frame = df.select(key, response, *predictors).withColumns(product_columns(products))
    return frame, [*predictors, *products]

