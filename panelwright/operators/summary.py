"""Summaries: describe, percentiles, trims, histograms, densities."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.operators.ordering import column_quantiles, moments_and_quantiles, usable
from panelwright.runtime import stored

_STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per statistic."""
    columns = list(columns)
    found = {}
    for name, (m, quartiles) in moments_and_quantiles(df, columns, [0.25, 0.5, 0.75]).items():
        found[name] = {"count": m.n, "mean": m.mean, "std": m.deviation, "min": m.low, "max": m.high,
                       **dict(zip(("25%", "50%", "75%"), quartiles))}

    def cell(statistic: str, column: str) -> float | None:
        value = found.get(column, {"count": 0}).get(statistic)
        return None if value is None else float(value)

    rows = [(s, *[cell(s, c) for c in columns]) for s in _STATISTICS]
    schema = ", ".join(["statistic string", *[f"`{c}` double" for c in columns]])
    return df.sparkSession.createDataFrame(rows, schema)


def percentile_grid(df: DataFrame, columns: Sequence[str], step: int = 5) -> DataFrame:
    """Exact percentiles 0, step, ..., 100 of each column: (variable, percentile, value)."""
    grid = list(range(0, 101, step))
    found = column_quantiles(df, columns, [p / 100 for p in grid])
    rows = [(c, p, v) for c in columns if c in found for p, v in zip(grid, found[c])]
    return df.sparkSession.createDataFrame(rows, "variable string, percentile int, value double")


def below(df: DataFrame, column: str, limit: float) -> DataFrame:
    """Rows up to and including a limit. NULL is dropped."""
    return df.filter(F.col(column) <= F.lit(limit))


def trim_above(df: DataFrame, column: str, prob: float = 0.9) -> DataFrame:
    """Rows at or below the column's own quantile."""
    found = column_quantiles(df, [column], [prob])
    return below(df, column, found[column][0]) if found else df.limit(0)


def geometric_mean(column: str | Column) -> Column:
    return F.exp(F.avg(F.ln(column)))


def squared_deviations(column: str | Column) -> Column:
    """Sum of squared deviations from the mean."""
    return F.var_pop(column) * F.count(column)


def bin_index(value: str | Column, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin.

    Values below the range are in bin -1, those above it in bin ``bins``. A range of one value has
    that value in bin 0. NULL and NaN have no bin.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    width = float(high) - float(low)
    cell = F.floor((v - F.lit(float(low))) / F.lit(width or 1.0) * F.lit(bins))
    inner = F.least(cell, F.lit(bins - 1)).cast("int")
    return F.when(usable(v), F.when(v < low, -1).when(v > high, bins).otherwise(inner))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per bin of a range: (bin, bin_from, bin_to, count). Empty bins are left out.

    The counts add up to the usable values: bins -1 and ``bins`` hold what lies outside, and have
    no outer edge.
    """
    width = (high - low) / bins
    return (
        df.select(bin_index(column, low, high, bins).alias("bin"))
        .filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"))
        .select("bin", F.when(F.col("bin") >= 0, F.lit(float(low)) + F.col("bin") * width).alias("bin_from"),
                F.when(F.col("bin") < bins, F.lit(float(low)) + (F.col("bin") + 1) * width).alias("bin_to"),
                "count"))


def heatmap(df: DataFrame, xs: Mapping[str, tuple[float, float]], y: str,
            y_range: tuple[float, float], x_bins: int = 40, y_bins: int = 400) -> DataFrame:
    """Counts on a grid for several x columns against one y, in one pass.

    ``xs`` maps each column to its range. Result: (variable, x_bin, y_bin, count). Values outside a
    range are in its outer bins, as in ``bin_index``; a view of the ranges is a filter on the bins.
    """
    cells = F.array(*[
        F.struct(F.lit(x).alias("variable"),
                 bin_index(x, low, high, x_bins).alias("x_bin"),
                 bin_index(y, *y_range, y_bins).alias("y_bin"))
        for x, (low, high) in xs.items()])
    return (df.select(F.inline(cells)).filter("x_bin IS NOT NULL AND y_bin IS NOT NULL")
            .groupBy("variable", "x_bin", "y_bin").agg(F.count("*").alias("count")))


# No width is smaller than this power of two; an axis that holds only zeros keeps it while tasks count.
_FINEST = -1074


def _cells(points: np.ndarray, k: int) -> np.ndarray:
    """The i of [i 2^k, (i + 1) 2^k); a negative value too small to be scaled is still below 0."""
    cells = np.floor(np.ldexp(points, -k)).astype(np.int64)
    return np.where((points < 0) & (cells == 0), -1, cells)


def _width(low: float, high: float, bins: int) -> int:
    """Least k for which [low, high] touches at most ``bins`` cells [i 2^k, (i + 1) 2^k).

    Not finer than the last digit of the greater end. A wider range never has a smaller k, and the cells of
    k + 1 are pairs of those of k, so counts taken at different k add up exactly.
    """
    end, ends = max(abs(low), abs(high)), np.array([low, high])
    k = max(_FINEST, math.frexp(end)[1] - 53) if end else _FINEST
    if high > low:
        k = max(k, math.frexp((high - low) / bins)[1] - 1)
    while np.ptp(_cells(ends, k)) >= bins:
        k += 1
    return k


class _Grid:
    """Counts of points in cells whose widths double when an axis runs out of bins."""

    def __init__(self, bins: Sequence[int]):
        self.bins = bins
        self.low = np.full(len(bins), np.inf)
        self.high = np.full(len(bins), -np.inf)
        self.widths: list[int] = []
        self.cells = np.empty((0, len(bins)), dtype=np.int64)
        self.counts = np.empty(0, dtype=np.int64)

    def add(self, points: np.ndarray) -> None:
        points = points[np.isfinite(points).all(axis=1)]
        if not len(points):
            return
        self.low = np.minimum(self.low, points.min(axis=0))
        self.high = np.maximum(self.high, points.max(axis=0))
        widths = [_width(float(a), float(b), n) for a, b, n in zip(self.low, self.high, self.bins)]
        moved = [min(63, new - old) for new, old in zip(widths, self.widths or widths)]
        new = np.column_stack([_cells(points[:, i], k) for i, k in enumerate(widths)])
        cells = np.vstack([self.cells >> np.array(moved, dtype=np.int64), new])
        counts = np.concatenate([self.counts, np.ones(len(new), dtype=np.int64)])
        self.cells, place = np.unique(cells, axis=0, return_inverse=True)
        self.counts = np.bincount(place.ravel(), weights=counts).astype(np.int64)
        self.widths = widths


def _own_grids(df: DataFrame, grids: Mapping[str, Sequence[str | Column]], bins: Sequence[int]) -> DataFrame:
    """Points of several grids in cells found from the data: (variable, k, cell, count).

    One read: each task counts into cells that widen as its range grows, at most the product of ``bins`` a
    grid. Its ends give the common widths, and its cells move up to them.
    """
    if min(bins) < 2:
        raise ValueError("at least two bins: a range around zero never fits into one")
    names, depth = list(grids), len(bins)
    wide = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"c{g}_{i}")
                       for g, axes in enumerate(grids.values()) for i, c in enumerate(axes)])

    def count(batches: Iterable[pa.RecordBatch]):
        found = [_Grid(bins) for _ in names]
        for batch in batches:
            points = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            for g, grid in enumerate(found):
                grid.add(points[:, g * depth:(g + 1) * depth])
        for g, grid in enumerate(found):
            n = len(grid.counts)
            if n:
                yield pa.RecordBatch.from_pydict({
                    "grid": [g] * n, "low": [grid.low.tolist()] * n, "high": [grid.high.tolist()] * n,
                    "k": [grid.widths] * n, "cell": grid.cells.tolist(), "count": grid.counts}, schema)

    schema = pa.schema([("grid", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                        ("k", pa.list_(pa.int32())), ("cell", pa.list_(pa.int64())), ("count", pa.int64())])
    counted = stored(wide.mapInArrow(
        count, "grid int, low array<double>, high array<double>, k array<int>, cell array<bigint>, count bigint"))
    axes = range(depth)
    ends = counted.groupBy("grid").agg(
        *[F.min(F.col("low")[i]).alias(f"low{i}") for i in axes],
        *[F.max(F.col("high")[i]).alias(f"high{i}") for i in axes]).collect()
    widths = {r["grid"]: [_width(r[f"low{i}"], r[f"high{i}"], bins[i]) for i in axes] for r in ends}
    if not widths:
        return df.sparkSession.createDataFrame([], "variable string, k array<int>, cell array<bigint>, count bigint")

    def by_grid(values: Mapping[int, object]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("grid"))

    cell = F.array(*[F.call_function(
        "shiftright", F.col("cell")[i],
        F.least(F.lit(63), by_grid({g: k[i] for g, k in widths.items()}) - F.col("k")[i])) for i in axes])
    return (counted.groupBy("grid", cell.alias("cell")).agg(F.sum("count").alias("count"))
            .select(by_grid(dict(enumerate(names))).alias("variable"),
                    F.array(*[by_grid({g: k[i] for g, k in widths.items()}) for i in axes]).alias("k"),
                    "cell", "count"))


def _edge(i: int, upper: int) -> Column:
    return (F.col("cell")[i] + upper).cast("double") * F.pow(F.lit(2.0), F.col("k")[i])


def own_histogram(df: DataFrame, column: str | Column, bins: int = 50) -> DataFrame:
    """Rows per bin, the bins found from the data: (bin_from, bin_to, count). Empty bins are left out.

    A bin reaches from a multiple of a power of two to the next one, without its upper end; the power is the
    least that needs at most ``bins`` (two or more). NULL, NaN and infinite values have no bin; no usable value, no row.
    """
    return (_own_grids(df, {"x": [column]}, [bins])
            .select(_edge(0, 0).alias("bin_from"), _edge(0, 1).alias("bin_to"), "count"))


def own_heatmap(df: DataFrame, xs: Sequence[str], y: str, x_bins: int = 40, y_bins: int = 400) -> DataFrame:
    """Counts on a grid for several x columns against one y, bins found from the data in one read.

    Result: (variable, x_from, x_to, y_from, y_to, count), bins as in ``own_histogram``. The y bins of a
    variable follow from the rows where both values are usable.
    """
    return (_own_grids(df, {x: [x, y] for x in xs}, [x_bins, y_bins])
            .select("variable", _edge(0, 0).alias("x_from"), _edge(0, 1).alias("x_to"),
                    _edge(1, 0).alias("y_from"), _edge(1, 1).alias("y_to"), "count"))


def value_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each column."""
    row = df.agg(*[f(c).cast("double").alias(f"{f.__name__}_{i}")
                   for i, c in enumerate(columns) for f in (F.min, F.max)]).first()
    return {c: (row[f"min_{i}"], row[f"max_{i}"]) for i, c in enumerate(columns)}


def rule_of_thumb_bandwidth(n: int, deviation: float, iqr: float) -> float:
    """0.9 times the smaller spread estimate times n^(-1/5)."""
    spread = min(deviation, iqr / 1.34) or deviation or 1.0
    return 0.9 * spread * n ** -0.2


def density(df: DataFrame, column: str, points: int = 512, bandwidth: float | None = None,
            terms: int = 18) -> DataFrame:
    """Gaussian kernel density on an even grid: (x, density).

    A fast Gauss transform. The values are read into cells one bandwidth wide, each with the first
    ``terms`` moments of the Hermite expansion of its kernels around the cell's centre, and a grid point
    adds up the expansions of the cells within ``_REACH`` bandwidths. What the expansion cuts off is at
    most ``expansion_error(terms)`` of a kernel's peak (6e-14 for 18), and a cell out of reach adds less
    than 1e-15 of it, so the result is the direct sum over all values to that accuracy.
    """
    facts = moments_and_quantiles(df, [column], [0.25, 0.75])
    if column not in facts:
        return df.sparkSession.createDataFrame([], "x double, density double")
    moments, (q1, q3) = facts[column]
    if bandwidth is None:
        bandwidth = rule_of_thumb_bandwidth(moments.n, moments.deviation or 0.0, q3 - q1)
    start, stop = moments.low - 3 * bandwidth, moments.high + 3 * bandwidth
    step, root = (stop - start) / (points - 1), math.sqrt(2)

    value = F.col(column).cast("double")
    place = (value - F.lit(start)) / F.lit(bandwidth)
    t = (F.col("place") - F.col("cell") - 0.5) / root
    powers = [F.lit(1.0)]
    for _ in range(1, terms):
        powers.append(powers[-1] * F.col("t"))
    cells = (df.filter(usable(value)).select(place.alias("place"))
             .withColumn("cell", F.floor("place")).withColumn("t", t)
             .groupBy("cell").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
             .select("cell", F.array(*[F.col(f"m{k}") / math.factorial(k) for k in range(terms)])
                     .alias("moments")))

    x = F.lit(start) + F.col("i") * F.lit(step)
    middle = F.floor((x - F.lit(start)) / F.lit(bandwidth))
    grid = (df.sparkSession.range(points).select(F.col("id").alias("i"))
            .select("i", x.alias("x"), F.explode(F.sequence(middle - _REACH, middle + _REACH)).alias("cell")))
    s = ((F.col("x") - F.lit(start)) / F.lit(bandwidth) - F.col("cell") - 0.5) / root
    # Hermite polynomials by their recursion, each times its moment.
    zero = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("h"), F.lit(0.0).alias("total"),
                    F.lit(0).alias("k"))
    folded = F.aggregate("moments", zero, lambda a, m: F.struct(
        a["h"].alias("before"), (2 * F.col("s") * a["h"] - 2 * a["k"] * a["before"]).alias("h"),
        (a["total"] + m * a["h"]).alias("total"), (a["k"] + 1).alias("k")))
    peak = 1.0 / (moments.n * bandwidth * math.sqrt(2 * math.pi))
    near = grid.join(cells, "cell", "left").withColumn("s", s)
    total = F.sum(F.coalesce(folded["total"] * F.exp(-F.col("s") * F.col("s")), F.lit(0.0)))
    return near.groupBy("i", "x").agg((total * F.lit(peak)).alias("density")).select("x", "density")


# Cells on either side whose kernels a grid point sees: exp(-9 * 9 / 2) is below 1e-17.
_REACH = 9


def expansion_error(terms: int) -> float:
    """Bound of what a Hermite expansion cut after ``terms`` leaves out, in kernel peaks.

    For values within half a bandwidth of the centre: 1.09 * sum of (1/2)^k / sqrt(k!) from there on.
    """
    return 1.09 * sum(0.5 ** k / math.sqrt(math.factorial(k)) for k in range(terms, terms + 60))
