"""Variable selection: backward elimination and cross-validated best subsets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelwright.operators.leastsquares import (
    Factor, LinearModel, batch_matrix, fit, merged_in_levels,
)
from panelwright.operators.ordering import keyed_hash
from panelwright.operators.subsets import SubsetTree, coefficients
from panelwright.runtime import stored

# Fixed value: the Mersenne prime 2^31 - 1, modulus of the replicate draw.
DRAW_MODULUS = 2_147_483_647

# Replicate number under which the cross-product of all rows is searched.
_ALL_ROWS = -1


# ---------------------------------------------------------------- backward elimination

@dataclass(frozen=True)
class Step:
    """One accepted elimination; the first entry of a path has dropped nothing."""

    dropped: str | None
    aic: float
    predictors: tuple[str, ...]


def backward_by_aic(model: LinearModel) -> tuple[LinearModel, list[Step]]:
    """Drop predictors one by one while that lowers the AIC.

    Aliased predictors, which carry nothing, go first. Every candidate comes from the
    fitted triangle, so the data are not read again.
    """
    live = [p for p in model.predictors if model.coefficients[p] is not None]
    aliased = [p for p in model.predictors if model.coefficients[p] is None]
    path = [Step(None, model.aic, tuple(model.predictors))]
    current = model
    for name in reversed(aliased):
        current = model.subset([p for p in current.predictors if p != name])
        path.append(Step(name, current.aic, tuple(current.predictors)))
    while live:
        candidates = [model.subset([p for p in live if p != name]) for name in live]
        best = min(range(len(live)), key=lambda i: candidates[i].aic)
        if candidates[best].aic >= current.aic:
            break
        current = candidates[best]
        path.append(Step(live[best], current.aic, tuple(current.predictors)))
        live = list(current.predictors)
    return current, path


# ---------------------------------------------------------------- best subsets

class TooFewRows(ValueError):
    """Not enough rows to train on in the replicates."""


def training_share(n: int) -> float:
    """Share of rows a replicate trains on: ``1 - d/n`` of the delete-d rule, for 8 rows or more."""
    if n < 8:
        raise TooFewRows("delete-d cross-validation holds out no row of fewer than 8")
    held_out = math.ceil(n * (1 - 1 / (math.log(n) - 1)))
    return 1 - held_out / n


def draw_constants(replicates: int, seed: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each replicate's draw, from a digest of its number."""
    constants = []
    for r in range(replicates):
        digest = hashlib.md5(f"{seed}:{r}".encode()).hexdigest()
        constants.append((1 + int(digest[:7], 16), int(digest[7:14], 16)))
    return constants


def row_number_in_draw(key: str, seed: int):
    """A key's fixed integer below the draw modulus, as a column expression."""
    digits = F.conv(F.substring(keyed_hash(key, seed), 1, 8), 16, 10).cast("long")
    return F.pmod(digits, F.lit(DRAW_MODULUS))


def _centred(gram: np.ndarray) -> np.ndarray:
    """Centre a cross-product of (x, y, 1) about its own means and drop the ones."""
    n = gram[-1, -1]
    sums = gram[:-1, -1]
    return gram[:-1, :-1] - np.outer(sums, sums) / n if n > 0 else gram[:-1, :-1]


@dataclass
class _Scaling:
    """Means and scales of predictors and response, read off a fitted triangle."""

    centre: np.ndarray
    scale: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, factor: Factor) -> _Scaling:
        ones = factor.r[0, 0]
        both = np.column_stack([factor.r[:, 1:], factor.qty[:, 0]])
        centre = both[0] / ones
        inner = both[1:]
        gram = inner.T @ inner
        gram[-1, -1] += factor.rss[0]
        scale = np.sqrt(np.diag(gram) / factor.n)
        scale[scale == 0] = 1.0
        total = np.zeros((len(centre) + 1, len(centre) + 1))
        total[:-1, :-1] = gram / np.outer(scale, scale)
        total[-1, -1] = factor.n
        return cls(centre, scale, total)


@dataclass
class SubsetSearch:
    """Cross-validated error of the best subset of each size, and the chosen model."""

    errors: list[tuple[int, float, int]]
    size: int
    model: LinearModel
    subsets: dict[int, list[str]]

    def frame(self, spark) -> DataFrame:
        """Rows per size; ``predictors`` is the best subset of that size on all rows."""
        rows = [(size, error, n, size == self.size, self.subsets[size])
                for size, error, n in self.errors]
        return spark.createDataFrame(
            rows, "size int, cv_error double, replicates int, chosen boolean, predictors array<string>")


def training_grams(df: DataFrame, model: LinearModel, scaling: _Scaling, key: str, replicates: int,
                   seed: int) -> DataFrame:
    """Stored rows (replicate, gram): training cross-product of every replicate and that of all rows.

    One pass over standardised columns. Membership depends on key, seed and replicate only. Input
    splits are read by a number of tasks that follows the cluster, not the data, and each emits its
    matrices once; they are merged level by level.
    """
    predictors = model.predictors
    threshold = int(training_share(model.factor.n) * DRAW_MODULUS)
    draws = draw_constants(replicates, seed)
    width = len(predictors) + 2
    columns = [*predictors, model.response]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns],
                     row_number_in_draw(key, seed).cast("double").alias("__draw"))
    spark = df.sparkSession
    schema = "replicate int, slot int, gram array<double>"
    arrow = pa.schema([("replicate", pa.int32()), ("slot", pa.int32()), ("gram", pa.list_(pa.float64()))])

    def cross_products(batches: Iterable[pa.RecordBatch]):
        grams = np.zeros((replicates, width, width))
        for batch in batches:
            table = batch_matrix(batch)
            table = table[np.isfinite(table).all(axis=1)]
            if len(table) == 0:
                continue
            z = np.column_stack([(table[:, :-1] - scaling.centre) / scaling.scale,
                                 np.ones(len(table))])
            number = table[:, -1].astype(np.int64)
            for r, (a, b) in enumerate(draws):
                part = z[(a * number + b) % DRAW_MODULUS < threshold]
                grams[r] += part.T @ part
        slot = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"replicate": list(range(replicates)), "slot": [slot] * replicates,
             "gram": [g.ravel().tolist() for g in grams]}, schema=arrow)

    def add_up(table: pa.Table) -> pa.Table:
        flat = table.column("gram").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        total = flat.reshape(-1, width * width).sum(axis=0)
        return pa.Table.from_pydict(
            {"replicate": [table["replicate"][0].as_py()], "slot": [table["slot"][0].as_py()],
             "gram": [total.tolist()]}, schema=arrow)

    tasks = 4 * spark.sparkContext.defaultParallelism
    summed = merged_in_levels(
        rows.coalesce(tasks).mapInArrow(cross_products, schema), add_up, schema, "replicate", levels=1)
    summed = summed.groupBy("replicate").applyInArrow(add_up, schema)
    everything = spark.createDataFrame([(_ALL_ROWS, scaling.total.ravel().tolist())],
                                       "replicate int, gram array<double>")
    return stored(summed.select("replicate", "gram").unionByName(everything), "replicate-grams")


def _square(gram: Iterable[float]) -> np.ndarray:
    flat = np.array(gram, dtype=float)
    return flat.reshape(math.isqrt(len(flat)), -1)


def best_subsets(grams: DataFrame, predictors: int, parts: int) -> DataFrame:
    """Stored rows (replicate, size, subset): the least residual sum of each size.

    The branches below the root of a replicate's tree are dealt out into a few rows, more if the cluster
    has more tasks to run than there are replicates; the best of each size are then told by the least
    sum. Replicates with no more rows than terms are left out.
    """
    schema = "replicate int, size int, rss double, subset array<int>"
    arrow = pa.schema([("replicate", pa.int32()), ("size", pa.int32()), ("rss", pa.float64()),
                       ("subset", pa.list_(pa.int32()))])

    def search(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for replicate, flat, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gram = _square(flat)
                if gram[-1, -1] > predictors + 1:
                    tree = SubsetTree(_centred(gram))
                    tree.search(set(range(part, predictors, parts)))
                    rows += [{"replicate": replicate, "size": size, "rss": rss, "subset": list(subset)}
                             for size, rss, subset in tree.found()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    tasks = 4 * grams.sparkSession.sparkContext.defaultParallelism
    dealt = grams.select("replicate", "gram", F.explode(
        F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    found = dealt.repartition(tasks, "replicate", "part").mapInArrow(search, schema)
    return stored(found.groupBy("replicate", "size").agg(
        F.min(F.struct("rss", "subset"))["subset"].alias("subset")), "best-subsets")


def replicate_scores(grams: DataFrame, subsets: DataFrame, scaling: _Scaling) -> DataFrame:
    """(replicate, size, subset, held-out sum of squares, held-out rows).

    What is held out is the total minus the training cross-product.
    """
    schema = "replicate int, size int, subset array<int>, held_out_ss double, held_out_n double"
    arrow = pa.schema([
        ("replicate", pa.int32()), ("size", pa.int32()), ("subset", pa.list_(pa.int32())),
        ("held_out_ss", pa.float64()), ("held_out_n", pa.float64())])

    def score(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out = []
            for replicate, size, subset, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                training = _square(flat)
                held_out = scaling.total - training
                means = training[:-1, -1] / training[-1, -1]
                beta, _ = coefficients(_centred(training), tuple(subset))
                weights = np.zeros(len(training))
                weights[subset] = beta
                weights[-2] = -1.0
                weights[-1] = means[-1] - beta @ means[subset]
                out.append({"replicate": replicate, "size": size, "subset": subset,
                            "held_out_ss": float(weights @ held_out @ weights) * scaling.scale[-1] ** 2,
                            "held_out_n": float(held_out[-1, -1])})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    drawn = subsets.filter(F.col("replicate") != _ALL_ROWS).join(grams, "replicate")
    return drawn.select("replicate", "size", "subset", "gram").mapInArrow(score, schema)


def best_subset_cv(df: DataFrame, response: str, predictors: Sequence[str], key: str,
                   replicates: int = 100, seed: int = 37) -> SubsetSearch:
    """Best subset of the size whose delete-d cross-validation error is least.

    In every replicate the best subset of each size is found on the training rows and
    judged on the held-out ones. The winner of the chosen size is then fitted on all rows. The search
    is exact for any number of predictors; its time depends on how much they differ in weight.
    """
    predictors = list(predictors)
    model = fit(df, response, predictors)
    training_share(model.n)
    if None in model.coefficients.values():
        model = model.subset([p for p in predictors if model.coefficients[p] is not None])
        kept = [0, *[predictors.index(p) + 1 for p in model.predictors]]
        q, r = np.linalg.qr(model.factor.r[:, kept])
        qty = q.T @ model.factor.qty
        left = model.factor.qty - q @ qty
        reduced = Factor(r, qty, model.factor.rss + (left * left).sum(axis=0), model.n, model.dropped)
        model.factor = reduced
    scaling = _Scaling.of(model.factor)
    grams = training_grams(df, model, scaling, key, replicates, seed)
    width = len(model.predictors)
    parts = max(1, min(width, max(-(-width // 10), -(-4 * df.sparkSession.sparkContext.defaultParallelism
                                                     // replicates))))
    subsets = best_subsets(grams, width, parts)
    errors = [
        (r["size"], r["cv_error"], r["replicates"]) for r in
        replicate_scores(grams, subsets, scaling).groupBy("size").agg(
            F.avg(F.col("held_out_ss") / F.col("held_out_n")).alias("cv_error"),
            F.count("*").cast("int").alias("replicates")).orderBy("size").collect()]
    if not errors:
        raise TooFewRows("too few rows to train on in any replicate")
    size = min(errors, key=lambda e: (e[1], e[0]))[0]
    whole = {r["size"]: [model.predictors[i] for i in r["subset"]]
             for r in subsets.filter(F.col("replicate") == _ALL_ROWS).collect()}
    return SubsetSearch(errors, size, model.subset(whole[size]), whole)
