"""Nearest variance grid free of static arbitrage, one snapshot per group.

The call price is not linear in total variance, so the constraints are linearised
at the current grid and the quadratic problem solved again, at most ten times. The
problem has one unknown per cell (some dozens); each is solved by operator
splitting in NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ivlattice.functions.black76 import SQRT_TWO_PI, np_price

FLOOR = 1e-10
NOISE = 1e-10
ROUNDS = 10


def call_and_slope(k: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calls on a forward of one, and their derivative by total variance."""
    s = np.sqrt(np.maximum(w, FLOOR))
    d1 = -k / s + s / 2
    return np_price(1.0, np.exp(k), 1.0, s, 1.0), np.exp(-d1 * d1 / 2) / SQRT_TWO_PI / (2 * s)


def breaches(k: np.ndarray, w: np.ndarray) -> float:
    """The largest violation over calendar, slope and convexity (0 if none); rows are maturities."""
    strike = np.exp(k)
    call, _ = call_and_slope(k, w)
    slope = np.diff(call, axis=1) / np.diff(strike)
    parts = [-np.diff(w, axis=0), slope, -1 - slope, -np.diff(slope, axis=1), -w]
    return float(max([0.0, *(p.max() for p in parts if p.size)]))


def _constraints(k: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """G x >= h for the flattened grid x."""
    m, n = w.shape
    at = lambda j, i: j * n + i
    call, slope = call_and_slope(k, w)
    strike = np.exp(k)
    base = call - slope * np.maximum(w, FLOOR)  # call = base + slope * x
    rows, h = [], []

    def add(terms: dict[int, float], at_least: float) -> None:
        row = np.zeros(m * n)
        for c, v in terms.items():
            row[c] += v
        size = np.linalg.norm(row)
        if size > 1e-12:
            rows.append(row / size)
            h.append(at_least / size)

    for j in range(m):
        for i in range(n):
            add({at(j, i): 1.0}, 0.0)
            if j + 1 < m:
                add({at(j + 1, i): 1.0, at(j, i): -1.0}, 0.0)
        d = np.diff(strike)
        for i in range(n - 1):
            step = {at(j, i + 1): slope[j, i + 1] / d[i], at(j, i): -slope[j, i] / d[i]}
            const = (base[j, i + 1] - base[j, i]) / d[i]
            add({c: -v for c, v in step.items()}, const)  # slope <= 0
            add(step, -1.0 - const)  # slope >= -1
            if i + 2 < n:
                up = {at(j, i + 2): slope[j, i + 2] / d[i + 1], at(j, i + 1): -slope[j, i + 1] / d[i + 1]}
                const_up = (base[j, i + 2] - base[j, i + 1]) / d[i + 1]
                both = dict(up)
                for c, v in step.items():
                    both[c] = both.get(c, 0.0) - v
                add(both, const - const_up)
    return np.array(rows), np.array(h)


def nearest_feasible(x0: np.ndarray, weight: np.ndarray, g: np.ndarray, h: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """min sum weight (x - x0)^2 subject to g x >= h, by splitting with an adapted penalty."""
    rho, x = 1.0, x0.copy()
    z, u = np.maximum(g @ x, h), np.zeros(len(h))
    gram = g.T @ g
    inverse = np.linalg.inv(2 * np.diag(weight) + rho * gram)
    for i in range(steps):
        x = inverse @ (2 * weight * x0 + rho * g.T @ (z - u))
        gx = g @ x
        z_new = np.maximum(gx + u, h)
        u += gx - z_new
        primal, dual = np.abs(gx - z_new).max(), rho * np.abs(g.T @ (z_new - z)).max()
        z = z_new
        if primal < 1e-12 and dual < 1e-12:
            break
        if i % 50 == 49 and (primal > 10 * dual or dual > 10 * primal):
            scale = 2.0 if primal > dual else 0.5
            rho, u = rho * scale, u / scale
            inverse = np.linalg.inv(2 * np.diag(weight) + rho * gram)
    return x


def repair_grid(k: np.ndarray, w: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The nearest grid without arbitrage (rows: maturities ascending, columns: log-moneyness ascending)."""
    goal = np.asarray(w, float)
    weight = np.ones(goal.size) if weight is None else np.maximum(np.asarray(weight, float).ravel(), 1e-8)
    x = np.maximum(goal, FLOOR)
    for _ in range(ROUNDS):
        if breaches(k, x) <= NOISE:
            break
        g, h = _constraints(k, x)
        new = nearest_feasible(goal.ravel(), weight, g, h + 1e-11).reshape(goal.shape)
        moved, x = np.abs(new - x).max(), np.maximum(new, FLOOR)
        if moved < NOISE:
            break
    return x


def repair_surfaces(grid: DataFrame, snap: list[str], row: str, column: str, k: str, w: str) -> DataFrame:
    """Adds repaired_w to complete grids: ``row`` orders maturities, ``column`` log-moneyness shared by all of them.

    A snapshot whose grid has holes, repeated cells or numbers that are not finite is
    returned with null.
    """
    schema = T.StructType([*grid.schema.fields, T.StructField("repaired_w", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([row, column]).reset_index(drop=True)
        m, n = pdf[row].nunique(), pdf[column].nunique()
        values = pdf[w].to_numpy(float)
        whole = m * n == len(pdf) and not pdf.duplicated([row, column]).any() and np.isfinite(values).all()
        if whole:
            axis = pdf[k].to_numpy(float)[:n]
            pdf["repaired_w"] = repair_grid(axis, values.reshape(m, n)).ravel()
        else:
            pdf["repaired_w"] = np.nan
        return pdf

    return grid.groupBy(*snap).applyInPandas(one, schema)
