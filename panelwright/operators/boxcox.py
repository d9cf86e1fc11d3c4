"""Box-Cox profiles: all exponents in one pass over the data, refined in a second one."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelwright.operators.leastsquares import accumulate, solve

# Chebyshev points of the second read, their reach around the first best (0.2 + 0.02 + ...), and how
# closely the logs of directly known error sums must be met.
_NODES, _REACH, _AGREEMENT = 16, 0.2223, 1e-9


@dataclass(frozen=True)
class Profile:
    """Error sum of squares per exponent, comparable across exponents."""

    points: tuple[tuple[float, float], ...]

    @property
    def best(self) -> float:
        """Exponent with the least error; the smaller exponent on a tie."""
        return min(self.points, key=lambda p: (p[1], p[0]))[0]

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.points), "lambda double, sse double")


def exponent_grid(first: int, last: int, per_unit: int) -> list[float]:
    """Exponents ``first/per_unit`` to ``last/per_unit``. Integers hit zero exactly."""
    return [i / per_unit for i in range(first, last + 1)]


def _log_errors(df: DataFrame, response: str, predictors: Sequence[str],
                asked: Mapping[float, Sequence[float]]) -> dict[float, dict[float, float]]:
    """Log of the comparable error sum per shift and exponent, from one pass over the rows.

    The predictors are factored once, and each power of each shifted response is one more rotated
    column, formed inside the task. The log of the response is a column as well: its mean, which its
    projection on the ones gives, puts the errors on one scale.
    """
    base = min(asked)
    columns = [(shift, e) for shift, exponents in asked.items() for e in dict.fromkeys([0.0, *exponents])]
    moves = np.array([shift - base for shift, _ in columns])
    powers = np.array([e for _, e in columns])
    moved = df.select((F.col(response).cast("double") + F.lit(float(base))).alias(response), *predictors)

    def expand(y: np.ndarray) -> np.ndarray:
        logs = np.log(y[:, None] + moves)
        return np.where(powers == 0.0, logs, np.exp(logs * powers))

    factor = accumulate(moved, response, predictors, len(columns), expand, positive=True)
    if factor.refused:
        raise ValueError(f"{factor.refused} responses are not positive: use a larger shift")
    found: dict[float, dict[float, float]] = {}
    geo_log = {}
    at = range(len(predictors) + 1)
    for i, (shift, exponent) in enumerate(columns):
        if shift not in geo_log:
            geo_log[shift] = float(factor.qty[0, i] / factor.r[0, 0])
        sse = solve(factor, at, response, list(predictors), column=i).rss
        scale = 2 * (1 - exponent) * geo_log[shift]
        if exponent:
            scale -= 2 * math.log(abs(exponent))
        found.setdefault(shift, {})[exponent] = scale + (math.log(sse) if sse > 0 else -math.inf)
    return found


def _profile(logs: Mapping[float, float], exponents: Sequence[float]) -> Profile:
    return Profile(tuple((e, math.exp(logs[e])) for e in exponents))


def profile(df: DataFrame, response: str, predictors: Sequence[str],
            exponents: Sequence[float], shift: float = 0.0) -> Profile:
    """Error sum of every transformed response on the same predictors, in one read."""
    exponents = [float(e) for e in exponents]
    return _profile(_log_errors(df, response, predictors, {shift: exponents})[shift], exponents)


def _interpolated(nodes: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at ``x`` of the polynomial through Chebyshev points of the first kind (barycentric form)."""
    k = np.arange(len(nodes))
    weights = (-1.0) ** k * np.sin((2 * k + 1) * math.pi / (2 * len(nodes)))
    gaps = x[:, None] - nodes
    hit = gaps == 0
    parts = weights / np.where(hit, 1.0, gaps)
    found = (parts @ values) / parts.sum(axis=1)
    return np.where(hit.any(axis=1), values[hit.argmax(axis=1)], found)


def refine_shifts(df: DataFrame, response: str, predictors: Sequence[str], shifts: Sequence[float],
                  first: int = -30, last: int = 30, rounds: int = 3) -> dict[float, list[Profile]]:
    """Ever finer profiles for several shifts from two reads of the rows.

    The first read takes tenths over the whole range. Each further round divides the step by ten and
    reaches two of the former steps either way of the last best, so all of them lie within a quarter
    around the first best. There the log of the error sum is a smooth function of the exponent: the
    second read takes it at Chebyshev points, and the finer rounds are read off the polynomial through
    them. The tenths within the window are known directly and must agree with it; where they do not,
    the rounds are read from the rows one by one.
    """
    tenths = exponent_grid(first, last, 10)
    coarse = _log_errors(df, response, predictors, {s: tenths for s in shifts})
    found = {s: [_profile(coarse[s], tenths)] for s in shifts}
    if rounds < 2:
        return found
    k = np.arange(_NODES)
    unit = np.cos((2 * k + 1) * math.pi / (2 * _NODES))
    nodes = {s: found[s][0].best + _REACH * unit for s in shifts}
    fine = _log_errors(df, response, predictors, {s: nodes[s].tolist() for s in shifts})
    for shift, profiles in found.items():
        values = np.array([fine[shift][x] for x in nodes[shift].tolist()])
        known = [e for e in tenths if abs(e - profiles[0].best) < _REACH]
        seen = np.array([coarse[shift][e] for e in known])
        smooth = np.isfinite(values).all() and np.abs(
            _interpolated(nodes[shift], values, np.array(known)) - seen).max() < _AGREEMENT
        per_unit = 10
        for _ in range(rounds - 1):
            centre = round(profiles[-1].best * per_unit) * 10
            per_unit *= 10
            grid = exponent_grid(centre - 20, centre + 20, per_unit)
            if smooth:
                logs = dict(zip(grid, _interpolated(nodes[shift], values, np.array(grid)).tolist()))
                profiles.append(_profile(logs, grid))
            else:
                profiles.append(profile(df, response, predictors, grid, shift))
    return found


def refine(df: DataFrame, response: str, predictors: Sequence[str], shift: float = 0.0,
           first: int = -30, last: int = 30, rounds: int = 3) -> list[Profile]:
    """``refine_shifts`` for one shift."""
    return refine_shifts(df, response, predictors, [shift], first, last, rounds)[shift]
