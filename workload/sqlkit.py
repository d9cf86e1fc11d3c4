"""Checking SQL for least squares: cross-products as lists, solved by the sweep operator."""

from __future__ import annotations

from collections.abc import Sequence


def gram(columns: Sequence[str]) -> str:
    """Centred cross-product matrix of the columns as one flat list."""
    cells = [f"covar_pop({a}, {b}) * count(*)" for a in columns for b in columns]
    return f"[{', '.join(cells)}]"


def swept(width: int, pivot: str, matrix: str = "a") -> str:
    """The matrix after sweeping one pivot (0-based, a number or a column)."""
    def at(i: str, j: str) -> str:
        return f"{matrix}[({i}) * {width} + ({j}) + 1]"

    i, j = f"(e // {width})", f"(e % {width})"
    d = at(pivot, pivot)
    return (
        f"list_transform(range(0, {width * width}), lambda e: CASE "
        f"WHEN {i} = {pivot} AND {j} = {pivot} THEN -1 / {d} "
        f"WHEN {i} = {pivot} THEN {at(pivot, j)} / {d} "
        f"WHEN {j} = {pivot} THEN {at(i, pivot)} / {d} "
        f"ELSE {at(i, j)} - {at(i, pivot)} * {at(pivot, j)} / {d} END)")


def ols_ctes(source: str, response: str, predictors: Sequence[str], name: str = "ols") -> str:
    """CTE ``name``: n, means, swept matrix, coefficients b0..bp, rss and tss in one row."""
    p, width = len(predictors), len(predictors) + 1
    columns = [*predictors, response]
    means = ", ".join(f"avg({c}) AS m_{c}" for c in columns)
    ctes = [f"{name}_0 AS (SELECT count(*) AS n, {means}, {gram(columns)} AS a FROM {source})"]
    for k in range(p):
        tss = f"a[{width * width}] AS tss" if k == 0 else "tss"
        kept = ", ".join(["n", *[f"m_{c}" for c in columns]])
        ctes.append(f"{name}_{k + 1} AS (SELECT {kept}, {tss}, {swept(width, str(k))} AS a "
                    f"FROM {name}_{k})")
    betas = [f"a[{i * width + p + 1}]" for i in range(p)]
    intercept = f"m_{response} - " + " - ".join(f"{b} * m_{c}" for b, c in zip(betas, predictors))
    named = ", ".join([f"{intercept} AS b0", *[f"{b} AS b{i + 1}" for i, b in enumerate(betas)]])
    ctes.append(f"{name} AS (SELECT *, {named}, a[{width * width}] AS rss FROM {name}_{p})")
    return ",\n".join(ctes)


def fitted(predictors: Sequence[str], name: str = "ols") -> str:
    return f"{name}.b0 + " + " + ".join(f"{name}.b{i + 1} * {c}" for i, c in enumerate(predictors))


def subset_ctes(source: str, response: str, predictors: Sequence[str]) -> str:
    """CTE ``subsets``: mask, rss and n of every subset (needs WITH RECURSIVE)."""
    p, width = len(predictors), len(predictors) + 1
    return f"""
whole AS (SELECT count(*) AS n, {gram([*predictors, response])} AS a FROM {source}),
sweeps(mask, k, n, a) AS (
  SELECT CAST(mask AS INTEGER), 0, n, a FROM whole, range(0, {1 << p}) t(mask)
  UNION ALL
  SELECT mask, k + 1, n, CASE WHEN (mask >> k) & 1 = 1 THEN {swept(width, 'k')} ELSE a END
  FROM sweeps WHERE k < {p}),
subsets AS (SELECT mask, bit_count(mask) AS size, n, a[{width * width}] AS rss
            FROM sweeps WHERE k = {p})"""
