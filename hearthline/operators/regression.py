"""Least squares with several regressors and fixed effects from one aggregate, with errors, intervals and p values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction from the inside out, on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    fraction = 1.0
    for k in range(400, 0, -1):
        m = k // 2
        step = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        fraction = 1 + step * x / fraction
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a / fraction


def student_p(t: float, freedom: float) -> float:
    """The chance of a Student's t at least as far from 0."""
    return _beta_share(freedom / 2, 0.5, freedom / (freedom + t * t))


def student_quantile(level: float, freedom: float) -> float:
    """How far from 0 a Student's t stays with probability ``level``."""
    low, high = 0.0, 1.0
    while student_p(high, freedom) > 1 - level:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if student_p(middle, freedom) > 1 - level else (low, middle)
    return (low + high) / 2


OUT = "name string, coefficient double, error double, t double, p double, low double, high double"


def least_squares(df: DataFrame, y: Column, xs: dict[str, Column], groups: list[str] | None = None, effects: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """groups, n, freedom and, per regressor (and 'intercept', without effects): name, coefficient, standard error, t, two-sided p, and the ends of the interval at ``level``.

    One aggregate takes numbers, means and covariances by group and effect; ``effects`` are columns whose every combination of values has an intercept of its own: the covariances inside them
    are added, and their means drop out. Rows that lack a value take no part; null keys are a key. A group without enough rows or with dependent regressors has nulls. A hot group is summed in every task first; a
    group's matrix is as small as the regressors are few.
    """
    groups, effects, names = groups or [], effects or [], list(xs)
    k, v = len(names), [f"_v{i}" for i in range(len(names) + 1)]
    rows = df.select(*groups, *(F.col(e).alias(f"_e{i}") for i, e in enumerate(effects)), *(c.cast("double").alias(n) for n, c in zip(v, [*xs.values(), y])))
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in v))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    inside = rows.groupBy(*groups, *(f"_e{i}" for i in range(len(effects)))).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(v)), *(F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i, j in pairs))
    sums = inside.groupBy(*groups).agg(
        F.sum("_n").alias("n"), F.count("*").alias("_cells"), F.array(*(F.sum(F.col("_n") * F.col(f"c{i}_{j}")) for i, j in pairs)).alias("_s"), F.array(*(F.first(f"m{i}") for i in range(k + 1))).alias("_m"))

    @F.pandas_udf(f"array<struct<{OUT.replace(' double', ':double').replace(' string', ':string')}>>")
    def solve(n: pd.Series, cells: pd.Series, s: pd.Series, m: pd.Series) -> pd.Series:
        def one(n: int, cells: int, s: np.ndarray, m: np.ndarray) -> list[tuple]:
            full, (upper, right) = np.zeros((k + 1, k + 1)), np.array(pairs).T
            full[upper, right] = full[right, upper] = s
            xx, xy, freedom = full[:k, :k], full[:k, k], n - k - cells
            scale = np.sqrt(np.diag(xx))
            if freedom <= 0 or not (scale > 0).all() or np.linalg.cond(xx / np.outer(scale, scale)) > 1e12:
                return [(name, *[None] * 6) for name in [*names, *([] if effects else ["intercept"])]]
            back = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
            b = back @ xy
            noise = max(full[k, k] - b @ xy, 0.0) / freedom
            found = [*zip(names, b, np.sqrt(noise * np.diag(back)))]
            if not effects:
                found.append(("intercept", m[k] - b @ m[:k], math.sqrt(noise * (1 / n + m[:k] @ back @ m[:k]))))
            wide, out = student_quantile(level, freedom), []
            for name, c, e in found:
                t = c / e if e else math.copysign(math.inf, c)
                out.append((name, float(c), float(e), float(t), student_p(t, freedom) if e else 0.0, float(c - wide * e), float(c + wide * e)))
            return out

        return pd.Series([one(*x) for x in zip(n, cells, s, m)])

    out = sums.withColumn("_x", F.explode(solve("n", "_cells", "_s", "_m")))
    return out.select(*groups, "n", (F.col("n") - k - F.col("_cells")).alias("freedom"), "_x.*")


def page_depth(df: DataFrame, page: Column, price_per_area: Column, area: Column, groups: list[str] | None = None, low: float = 8e6, high: float = 400e6) -> DataFrame:
    """groups, n, percent by which the price per area changes from one result page to the next at equal area, its 95 per cent interval (percent_low, percent_high) and p; prices per area outside [low, high] take no part."""
    rows = df.where(price_per_area.between(low, high) & (area > 0))
    out = least_squares(rows, F.log(price_per_area), {"page": page, "area": F.log(area)}, groups).where("name = 'page'")
    percent = lambda c: 100 * F.expm1(c)
    return out.select(*(groups or []), "n", percent("coefficient").alias("percent"), percent("low").alias("percent_low"), percent("high").alias("percent_high"), "p")
