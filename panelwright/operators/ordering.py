"""Order statistics, ranks and keyed splits without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.runtime import stored

# Size of a sketch, and how far a bracket reaches around its quantile: more than twice the sketch's error.
_SKETCH_SIZE = 16_384
SLACK = 0.001

# Distinct values that may come to the driver to be ranked, and pivots of a zone in a round that cuts them down.
_AT_HAND = 100_000
_PIVOTS = 64

# Sketches of neighbouring tasks are merged in this many groups first.
_SKETCH_GROUPS = 64

_HEX_STEP = 4
_HEX_DIGITS = 32


def usable(value: str | Column) -> Column:
    """Neither NULL nor NaN."""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNotNull() & ~F.isnan(c)


@dataclass(frozen=True)
class Moments:
    """Of a column's usable values. ``squares`` is the sum of squared deviations from the mean."""

    n: int
    mean: float
    squares: float
    low: float
    high: float

    @property
    def deviation(self) -> float | None:
        """Of a sample."""
        return math.sqrt(self.squares / (self.n - 1)) if self.n > 1 else None

    @classmethod
    def merged(cls, parts: Sequence[Mapping]) -> Moments:
        n = sum(p["n"] for p in parts)
        mean = math.fsum(p["n"] * p["mean"] for p in parts) / n
        squares = math.fsum(p["squares"] + p["n"] * (p["mean"] - mean) ** 2 for p in parts)
        return cls(n, mean, squares, min(p["low"] for p in parts), max(p["high"] for p in parts))


Bracket = tuple[float, float]


def _side_by_side(df: DataFrame, columns: Sequence[str] | Mapping[str, Column]) -> DataFrame:
    """The columns as doubles, NaN as NULL."""
    named = columns if isinstance(columns, Mapping) else {c: F.col(f"`{c}`") for c in columns}
    return df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(name)
                       for name, c in named.items()])


def sketched(wide: DataFrame, edges: Sequence[float] = ()
             ) -> dict[str, tuple[Moments, dict[float, float]]]:
    """Moments of every column that has values, and sketched values at ``edges`` (shares of the rows).

    One read for all columns. Each task sketches its rows, sketches of neighbouring tasks are merged in
    groups, and the few that are left in one place.
    """
    edges = sorted(set(edges))
    own, merged = [], []
    for i, name in enumerate(wide.columns):
        v = F.col(f"`{name}`")
        own.append(F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"),
                            (F.var_pop(v) * F.count(v)).alias("squares"),
                            F.min(v).alias("low"), F.max(v).alias("high")).alias(f"m{i}"))
        merged.append(F.collect_list(f"m{i}").alias(f"m{i}"))
        if edges:
            own.append(F.kll_sketch_agg_double(v, F.lit(_SKETCH_SIZE)).alias(f"s{i}"))
            merged.append(F.kll_merge_agg_double(f"s{i}").alias(f"s{i}"))
    grouped = wide.groupBy(F.pmod(F.spark_partition_id(), F.lit(_SKETCH_GROUPS)).alias("g")).agg(*own)
    one = grouped.agg(*merged)
    at = F.array(*[F.lit(float(e)) for e in edges])
    row = one.select(*[f"m{i}" for i in range(len(wide.columns))], *[
        F.when(F.kll_sketch_get_n_double(f"s{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", at))
        .alias(f"s{i}") for i in range(len(wide.columns)) if edges]).head()
    found = {}
    for i, name in enumerate(wide.columns):
        parts = [p for p in row[f"m{i}"] if p["n"]]
        if parts:
            found[name] = (Moments.merged(parts), dict(zip(edges, row[f"s{i}"])) if edges else {})
    return found


def bracket_edges(probs: Sequence[float], slack: float | None = None) -> list[float]:
    slack = SLACK if slack is None else slack
    return [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]


def brackets_around(probs: Sequence[float], moments: Moments, at: Mapping[float, float],
                    slack: float | None = None) -> list[Bracket]:
    """Disjoint value ranges around the wanted quantiles."""
    ends = {**at, 0.0: moments.low, 1.0: moments.high}
    edges = bracket_edges(probs, slack)
    joined: list[Bracket] = []
    for low, high in sorted((ends[a], ends[b]) for a, b in zip(edges[::2], edges[1::2])):
        if joined and low <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
        else:
            joined.append((low, high))
    return joined


def interpolate(low: float, high: float, position: float) -> float:
    return low + (high - low) * (position - math.floor(position))


def ranks_around(n: int, probs: Sequence[float]) -> list[int]:
    """0-based ranks between which the quantiles lie."""
    return sorted({r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})


def moments_and_quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
                          probs: Sequence[float]) -> dict[str, tuple[Moments, list[float]]]:
    """Moments and exact quantiles, interpolated linearly, of every column that has usable values.

    Two reads for all columns together: sketches bracket every wanted quantile, then rows outside the
    brackets are only counted, and the few inside are kept and ranked. The counts prove that each
    wanted rank lies in its bracket; if one did not, all rows would be ranked.
    """
    probs = [float(p) for p in probs]
    wide = _side_by_side(df, columns)
    seen = sketched(wide, bracket_edges(probs))
    brackets = {name: brackets_around(probs, *facts) for name, facts in seen.items()}
    ranks = {name: ranks_around(moments.n, probs) for name, (moments, _) in seen.items()}
    at_rank = values_at_ranks(wide, ranks, brackets)
    if at_rank is None:  # a bracket missed its rank: take every row
        at_rank = values_at_ranks(wide, ranks, {name: [(-math.inf, math.inf)] for name in seen})
    answer = {}
    for name, (moments, _) in seen.items():
        positions = [(moments.n - 1) * p for p in probs]
        answer[name] = (moments, [
            interpolate(at_rank[name, math.floor(h)], at_rank[name, math.ceil(h)], h)
            for h in positions])
    return answer


def _passed(tests: Sequence[Column]) -> Column:
    """How many of the tests hold, of which each implies the ones before it."""
    def among(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(tests[middle], among(middle + 1, last)).otherwise(among(first, middle))

    return among(0, len(tests))


def zone(value: Column, ranges: Sequence[Bracket]) -> Column:
    """Position of a value among sorted brackets: odd inside one, even between them."""
    return _passed([test for low, high in ranges for test in (value >= F.lit(low), value > F.lit(high))])


def values_at_ranks(wide: DataFrame, ranks: Mapping[str, Sequence[int]],
                    brackets: Mapping[str, list[Bracket]]) -> dict[tuple[str, int], float] | None:
    """Values at 0-based ranks of several columns, or None when a rank lies outside the brackets.

    One read: values between the brackets collapse to counts and equal ones inside them to one row
    before anything is exchanged.
    """
    names = [name for name in wide.columns if name in ranks]
    if not names:
        return {}
    # The zone first and apart, so that it is worked out once a value.
    zones = wide.select(*names, *[
        F.when(F.col(f"`{name}`").isNotNull(), zone(F.col(f"`{name}`"), brackets[name])).alias(f"zone {i}")
        for i, name in enumerate(names)])
    cells = F.array(*[F.struct(
        F.lit(i).alias("variable"), F.col(f"zone {i}").alias("zone"),
        F.when(F.col(f"zone {i}") % 2 == 1, F.col(f"`{name}`")).alias("value"))
        for i, name in enumerate(names)])
    counted = (zones.select(F.inline(cells)).filter("zone IS NOT NULL")
               .groupBy("variable", "zone", "value").agg(F.count("*").alias("copies")))
    found = select_ranks(stored(counted), {i: ranks[name] for i, name in enumerate(names)})
    return None if found is None else {(names[i], r): v for (i, r), v in found.items()}


def select_ranks(counted: DataFrame, ranks: Mapping[int, Sequence[int]]
                 ) -> dict[tuple[int, int], float] | None:
    """Values at 0-based ranks of ``counted`` rows (variable, zone, value, copies), or None.

    Odd zones hold distinct values, even ones a count of what lies between; a rank in an even zone
    gives None. While the zones that wanted ranks lie in have more than ``_AT_HAND`` rows, sketched
    pivots cut them finer and everything else collapses to counts; the rest comes to the driver.
    ``counted`` is read a few times, so it should be stored or small.
    """
    while True:
        totals = counted.groupBy("variable", "zone").agg(
            F.sum("copies").alias("total"), F.count("*").alias("rows")).collect()
        wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}     # (rank, rank in the zone)
        for variable, asked in ranks.items():
            zones = sorted((r["zone"], r["total"]) for r in totals if r["variable"] == variable)
            for rank in asked:
                begin = 0
                for place, n in zones:
                    if rank < begin + n:
                        break
                    begin += n
                if place % 2 == 0:
                    return None
                wanted.setdefault((variable, place), []).append((rank, rank - begin))
        if not wanted:
            return {}
        here = F.struct("variable", F.col("zone").cast("long")).isin(
            [F.struct(F.lit(v), F.lit(z).cast("long")) for v, z in wanted])
        rows = sum(r["rows"] for r in totals if (r["variable"], r["zone"]) in wanted)
        if rows <= max(_AT_HAND, 16 * len(wanted)):
            break
        counted = _cut_finer(counted, list(wanted))
    kept = counted.filter(here).select("variable", "zone", "value", "copies").toArrow()
    variables, zones, values, copies = (kept.column(i).to_numpy() for i in range(4))
    found = {}
    for (variable, place), asked in wanted.items():
        mine = np.flatnonzero((variables == variable) & (zones == place))
        mine = mine[np.argsort(values[mine])]
        upto = np.cumsum(copies[mine])
        for rank, inner in asked:
            found[variable, rank] = float(values[mine[np.searchsorted(upto, inner, side="right")]])
    return found


def _cut_finer(counted: DataFrame, wanted: Sequence[tuple[int, int]]) -> DataFrame:
    """The rows with each wanted (variable, zone) cut by its own pivots, all else collapsed to counts."""
    at = {f"{v} {z}": (F.col("variable") == v) & (F.col("zone") == z) for v, z in wanted}
    pivots = {name: sorted(set(found.values())) for name, (_, found) in sketched(
        counted.select(*[F.when(here, F.col("value")).alias(name) for name, here in at.items()]),
        [k / _PIVOTS for k in range(1, _PIVOTS)]).items()}
    place = F.lit(None).cast("int")
    for name, edges in pivots.items():
        place = F.when(at[name], _passed([F.col("value") >= e for e in edges])).otherwise(place)
    step = F.lit(2 * (_PIVOTS + 1)).cast("long")
    placed = counted.withColumn("place", place)
    finer = F.col("zone") * step + F.when(F.col("place").isNotNull(), 2 * F.col("place") + 1).otherwise(0)
    return stored(placed.groupBy("variable", finer.alias("zone"),
                                 F.when(F.col("place").isNotNull(), F.col("value")).alias("value"))
                  .agg(F.sum("copies").alias("copies")))


def column_quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
                     probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of every column that has usable values."""
    return {name: values for name, (_, values) in moments_and_quantiles(df, columns, probs).items()}


def median_of(df: DataFrame, column: str) -> float | None:
    return column_quantiles(df, [column], [0.5]).get(column, [None])[0]


def ranked_with_count(df: DataFrame, order: Sequence[str],
                      name: str = "rank") -> tuple[DataFrame, int]:
    """1-based rank of every row, as an unpartitioned row_number gives it, and the row count.

    ``order`` should end in a unique column: it makes the rank definite and lets the range
    partitioning split a value that many rows share. The sorted rows are written once
    with their positions, since a second sort might choose other partition bounds.
    """
    position = "__position"
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn(position, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(position), 33)
    row = F.col(position).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = (placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
             .orderBy("part").collect())
    offsets, total = [], 0
    for size in sizes:
        offsets.append((size["part"], total))
        total += size["n"]
    lookup = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    ranked = (placed.withColumn("__part", part)
              .join(F.broadcast(lookup), "__part")
              .withColumn(name, F.col("__offset") + row + F.lit(1))
              .drop("__part", "__offset", position))
    return ranked, total


def keyed_hash(key: str | Column, seed: int) -> Column:
    """Hex digest that depends on the key and the seed only."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def _hash_cutoff(df: DataFrame, digest: Column, fraction: float) -> str | None:
    """Digest below or at which lie exactly ``floor(fraction * n)`` rows.

    Counts rows by leading digits, then looks into the one prefix the cut falls in.
    """
    digests = df.select(digest.alias("digest"))
    prefix, left = "", None
    while True:
        step = F.substring("digest", len(prefix) + 1, _HEX_STEP).alias("digits")
        counts = (digests.filter(F.col("digest").startswith(prefix)).groupBy(step).count()
                  .toArrow().sort_by("digits"))
        upto = np.cumsum(counts["count"].to_numpy())
        if left is None:
            left = math.floor(fraction * (upto[-1] if len(upto) else 0))
            if left == 0:
                return None
        cell = int(np.searchsorted(upto, left))
        prefix += counts["digits"][cell].as_py()
        if left == upto[cell]:
            return prefix.ljust(_HEX_DIGITS, "g")
        if len(prefix) >= _HEX_DIGITS:
            raise ValueError("the key repeats at the cut, so no split of that size exists")
        left -= int(upto[cell - 1]) if cell else 0


def sample_flag(df: DataFrame, key: str, fraction: float, seed: int) -> Column:
    """True for ``floor(fraction * n)`` rows, drawn by key without replacement.

    The key must be unique. The draw does not depend on partitioning or run, and the flag is
    a comparison with one constant: no rank, join or shuffle of the rows.
    """
    digest = keyed_hash(key, seed)
    cut = _hash_cutoff(df, digest, fraction)
    return F.lit(False) if cut is None else digest <= F.lit(cut)


def keyed_split(df: DataFrame, key: str, fraction: float = 0.2,
                seed: int = 37) -> tuple[DataFrame, DataFrame]:
    """(sampled rows, all other rows)."""
    flagged = sample_flag(df, key, fraction, seed)
    return df.filter(flagged), df.filter(~flagged)
