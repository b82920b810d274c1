"""Fitting volatility surfaces, one snapshot per group, as small NumPy kernels.

Within a snapshot the slices are fitted in order of maturity, because each must not
fall below the one before it; snapshots are independent and Spark spreads them. All
numbers a kernel needs for one snapshot are a few hundred observations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The grid every surface is sampled on.
TENOR_DAYS = (7, 14, 30, 60, 90, 180)
MONEYNESS = (-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0)
CALENDAR_K = np.linspace(-2, 2, 9)


@dataclass(frozen=True)
class Settings:
    min_obs_svi: int = 5
    min_obs_slice: int = 3
    min_expiries: int = 2
    butterfly_penalty: float = 10.0
    escalation: float = 10.0
    attempts: int = 3
    calendar_penalty: float = 10.0


def variance(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    a, b, rho, m, s = p
    return a + b * (rho * (k - m) + np.sqrt((k - m) ** 2 + s * s))


def durrleman(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    _, b, rho, m, s = p
    r = np.sqrt((k - m) ** 2 + s * s)
    w = np.maximum(variance(p, k), 1e-12)
    d1, d2 = b * (rho + (k - m) / r), b * s * s / r**3
    return (1 - k * d1 / (2 * w)) ** 2 - d1 * d1 / 4 * (1 / w + 0.25) + d2 / 2


def _softplus(x: float) -> float:
    return float(np.logaddexp(0.0, x))


def unpack(x: np.ndarray) -> np.ndarray:
    """Five free numbers to parameters inside the domain."""
    b, s = _softplus(x[1]), _softplus(x[4]) + 1e-6
    rho = float(np.clip(np.tanh(x[2]), -1 + 1e-9, 1 - 1e-9))
    return np.array([_softplus(x[0]) - b * s * np.sqrt(1 - rho * rho), b, rho, x[3], s])


def least_squares(residuals: Callable[[np.ndarray], np.ndarray], x: np.ndarray, steps: int = 200) -> np.ndarray:
    """Levenberg-Marquardt with forward differences."""
    x = np.asarray(x, float)
    r = residuals(x)
    cost, damp = r @ r, 1e-3
    for _ in range(steps):
        h = 1.5e-8 * np.maximum(1, np.abs(x))
        jac = np.stack([(residuals(x + h[i] * np.eye(len(x))[i]) - r) / h[i] for i in range(len(x))], 1)
        grad, hess = jac.T @ r, jac.T @ jac
        if np.max(np.abs(grad)) < 1e-10:
            break
        better = False
        for _ in range(12):
            step = np.linalg.lstsq(hess + damp * np.diag(np.maximum(np.diag(hess), 1e-12)), -grad, rcond=None)[0]
            trial = residuals(x + step)
            if np.all(np.isfinite(trial)) and trial @ trial < cost:
                better, gain = True, cost - trial @ trial
                x, r, cost, damp = x + step, trial, trial @ trial, max(damp / 5, 1e-12)
                break
            damp *= 4
        if not better or gain < 1e-14 * (1e-14 + cost) or np.max(np.abs(step)) < 1e-10:
            break
    return x


def lowest_g(p: np.ndarray, lo: float, hi: float) -> float:
    """Minimum of g over [lo, hi] and +-200 sigma around m, by golden section in every interval at once."""
    a, b = min(lo, p[3] - 200 * p[4]), max(hi, p[3] + 200 * p[4])
    edges = np.unique(np.concatenate([np.linspace(lo, hi, 100), np.linspace(p[3] - 200 * p[4], p[3] + 200 * p[4], 100), [a, b]]))
    left, right, ratio = edges[:-1].copy(), edges[1:].copy(), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = right - ratio * (right - left), left + ratio * (right - left)
        down = durrleman(p, c) < durrleman(p, d)
        right, left = np.where(down, d, right), np.where(down, left, c)
    return float(min(durrleman(p, (left + right) / 2).min(), durrleman(p, edges).min()))


def _start(k: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([max(0.5 * w.min(), 1e-4), 0.1, -0.1, k[np.argmin(w)], 0.1])


def _rmse(p: np.ndarray, k: np.ndarray, iv: np.ndarray, tau: float) -> float:
    return float(np.sqrt(np.mean((np.sqrt(np.maximum(variance(p, k), 0) / tau) - iv) ** 2)))


def fit_slice(k: np.ndarray, iv: np.ndarray, tau: float, vega: np.ndarray, penalty: float, floor_w: np.ndarray | None = None, calendar: float = 10.0) -> np.ndarray:
    """SVI parameters of one slice: vega-weighted total variance, with penalties on g < 0 and on falling below ``floor_w``."""
    w = iv * iv * tau
    weight = np.sqrt(np.maximum(vega, 1e-8))
    wings = np.linspace(min(k.min(), -5), max(k.max(), 5), 100)

    def residuals(x: np.ndarray) -> np.ndarray:
        p = unpack(x)
        parts = [weight * (variance(p, k) - w)]
        if floor_w is None:
            parts += [penalty * np.minimum(durrleman(p, wings), 0), penalty * np.minimum(durrleman(p, p[3] + p[4] * np.linspace(-200, 200, 801)), 0)]
        else:
            parts += [calendar * np.maximum(floor_w - variance(p, CALENDAR_K), 0), penalty * np.minimum(durrleman(p, CALENDAR_K), 0)]
        return np.concatenate(parts)

    return unpack(least_squares(residuals, _start(k, w)))


def fit_ssvi(slices: list[dict]) -> tuple[float, float, float, dict[float, float]]:
    """(rho, eta, gamma) of all slices together, and each slice's at-the-money variance."""
    theta = {}
    for s in slices:
        k, w = _collapse(s["k"], s["iv"] ** 2 * s["tau"])
        theta[s["tau"]] = max(float(np.interp(0.0, k, w)), 1e-8)

    def of(x: np.ndarray) -> tuple[float, float, float]:
        return float(np.tanh(x[0])), _softplus(x[1]), 1e-3 + (1 - 2e-3) / (1 + np.exp(-x[2]))

    def residuals(x: np.ndarray) -> np.ndarray:
        rho, eta, gamma = of(x)
        out = []
        for s in slices:
            t = theta[s["tau"]]
            phi = eta * t**-gamma
            model = t / 2 * (1 + rho * phi * s["k"] + np.sqrt((phi * s["k"] + rho) ** 2 + 1 - rho * rho))
            out.append(model - s["iv"] ** 2 * s["tau"])
        return np.concatenate(out)

    rho, eta, gamma = of(least_squares(residuals, np.array([np.arctanh(-0.3), np.log(np.expm1(1.0)), 0.0])))
    return rho, eta, gamma, theta


def _collapse(k: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of w at equal k, ascending in k."""
    u, inverse = np.unique(k, return_inverse=True)
    return u, np.bincount(inverse, w) / np.bincount(inverse)


def fit_surface(slices: list[dict], c: Settings) -> list[dict]:
    """Slices in order of maturity, each with parameters, method and diagnostics."""
    fitted, shared, before = [], None, None
    for s in sorted(slices, key=lambda s: s["tau"]):
        k, iv, tau, vega = s["k"], s["iv"], s["tau"], s["vega"]
        if len(np.unique(k)) >= c.min_obs_svi:
            penalty, attempts, p = c.butterfly_penalty, 1, fit_slice(k, iv, tau, vega, c.butterfly_penalty)
            certified = lambda q: lowest_g(q, min(k.min(), -5), max(k.max(), 5)) >= 0  # noqa: E731, B023
            ok = certified(p)
            while not ok and attempts < c.attempts:
                penalty *= c.escalation
                q, attempts = fit_slice(k, iv, tau, vega, penalty), attempts + 1
                q_ok = certified(q)
                if q_ok or _rmse(q, k, iv, tau) < _rmse(p, k, iv, tau):
                    p, ok = q, q_ok
            method = "svi"
        else:
            shared = shared or fit_ssvi(slices)
            rho, eta, gamma, theta = shared
            t = theta[tau]
            phi = eta * t**-gamma
            p = np.array([t * (1 - rho * rho) / 2, t * phi / 2, rho, -rho / phi, np.sqrt(1 - rho * rho) / phi])
            ok, attempts, method = bool(durrleman(p, CALENDAR_K).min() >= 0), 0, "ssvi"
        # a slice of the shared surface that crosses is only marked, not fitted freely
        if before is not None and method == "svi" and np.any(before - variance(p, CALENDAR_K) > 1e-10):
            p = fit_slice(k, iv, tau, vega, c.butterfly_penalty, floor_w=before, calendar=c.calendar_penalty)
            ok, attempts = bool(durrleman(p, CALENDAR_K).min() >= 0), 1
        w_now = variance(p, CALENDAR_K)
        calendar_ok = before is None or bool(np.all(w_now - before >= -1e-10))
        before = w_now
        fitted.append(s | {"p": p, "method": method, "rmse": _rmse(p, k, iv, tau), "vega_sum": float(np.maximum(vega, 1e-8).sum()), "butterfly_ok": ok, "calendar_ok": calendar_ok, "attempts": attempts})
    return fitted


def sample_grid(fitted: list[dict]) -> list[dict]:
    """Total variance at every tenor and moneyness; exact tenors use their own slice, others the nearest one rescaled."""
    taus = np.array([s["tau"] for s in fitted])
    theta = np.array([float(variance(s["p"], np.zeros(1))[0]) for s in fitted])
    rows = []
    for days in TENOR_DAYS:
        tau = days / 365.0
        near = int(np.argmin(np.abs(taus - tau)))
        exact = bool(np.isclose(taus[near], tau, rtol=1e-9, atol=1e-12))
        at = theta[near] if exact else float(np.interp(tau, taus, theta))
        k = np.array(MONEYNESS) * np.sqrt(max(at, 0.0))
        w = np.maximum(variance(fitted[near]["p"], k) * (at / theta[near] if theta[near] > 0 else 1.0), 0.0)
        rows += [{"tau": tau, "moneyness": m, "grid_k": float(x), "grid_w": float(y), "cell_n_obs": len(fitted[near]["k"]), "interp_flag": not exact} for m, x, y in zip(MONEYNESS, k, w)]
    return rows


SURFACE_SCHEMA = (
    "snap_date date, currency string, record_kind string, tau double, expiry timestamp, svi_a double, svi_b double, svi_rho double, svi_m double, svi_sigma double, "
    "fit_method string, rmse double, n_obs long, vega_sum double, butterfly_ok boolean, calendar_ok boolean, refit_attempts long, "
    "moneyness double, grid_k double, grid_w double, cell_n_obs long, interp_flag boolean"
)
COLUMNS = [x.split()[0] for x in SURFACE_SCHEMA.split(", ")]


def build_surfaces(obs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Parameter and grid rows of each (snap_date, currency).

    ``obs``: snap_date, currency, expiry, tau, k, iv, vega. An expiry with fewer than
    ``min_obs_slice`` rows is left out; a snapshot with fewer than ``min_expiries``
    expiries gives no rows. Null or non-finite observations are left out.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf[["tau", "k", "iv", "vega"]].to_numpy(float)).all(1)]
        slices = []
        for expiry, g in pdf.groupby("expiry"):
            if len(g) >= settings.min_obs_slice:
                g = g.sort_values(["k", "iv"])
                slices.append({"expiry": expiry, "tau": float(g["tau"].iloc[0]), **{c: g[c].to_numpy(float) for c in ("k", "iv", "vega")}})
        if len(slices) < settings.min_expiries:
            return pd.DataFrame(columns=COLUMNS)
        with np.errstate(all="ignore"):
            fitted = fit_surface(slices, settings)
            grid = sample_grid(fitted)
        head = {"snap_date": key[0], "currency": key[1]}
        rows = [
            head
            | {"record_kind": "param", "tau": s["tau"], "expiry": s["expiry"], "fit_method": s["method"], "rmse": s["rmse"], "n_obs": len(s["k"]), "vega_sum": s["vega_sum"]}
            | {"butterfly_ok": s["butterfly_ok"], "calendar_ok": s["calendar_ok"], "refit_attempts": s["attempts"]}
            | dict(zip(("svi_a", "svi_b", "svi_rho", "svi_m", "svi_sigma"), map(float, s["p"])))
            for s in fitted
        ]
        out = pd.DataFrame(rows + [head | {"record_kind": "grid"} | r for r in grid]).reindex(columns=COLUMNS)
        for c in ("butterfly_ok", "calendar_ok", "interp_flag"):
            out[c] = out[c].astype("boolean")
        for c in ("n_obs", "refit_attempts", "cell_n_obs"):
            out[c] = out[c].astype("Int64")
        return out

    return obs.groupBy("snap_date", "currency").applyInPandas(one, SURFACE_SCHEMA)
