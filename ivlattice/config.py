"""Settings with their defaults and invariants; a YAML file may override them."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Curation:
    window_minutes: int = 60
    widen_step_minutes: int = 60
    max_window_minutes: int = 360
    min_trades_per_expiry: int = 4
    recency_half_life_s: float = 900.0
    pair_window_s: float = 60.0
    min_pairs: int = 1
    tau_min_days: float = 2.0
    delta_min: float = 0.02
    delta_max: float = 0.98
    iv_min: float = 0.01
    iv_max: float = 5.0
    mad_multiple: float = 5.0
    size_min: float = 0.1
    iv_divergence: float = 0.02

    def __post_init__(self) -> None:
        _need(0 < self.window_minutes <= self.max_window_minutes, "window_minutes must lie in (0, max_window_minutes]")
        _need(self.min_trades_per_expiry >= 1 and self.min_pairs >= 1, "minimum counts must be at least 1")
        _need(self.recency_half_life_s > 0, "recency_half_life_s must be positive")
        _need(0 <= self.delta_min < self.delta_max <= 1, "delta band")
        _need(0 < self.iv_min < self.iv_max, "iv band")


@dataclass(frozen=True)
class Features:
    horizons: tuple[int, ...] = (1, 5, 22)
    jump_days: int = 22
    jump_multiple: float = 3.0
    dvol_max_age_s: int = 7_200
    dvol_back_days: int = 5
    funding_max_age_s: int = 43_200
    basis_target_days: float = 30.0
    basis_min_days: float = 7.0
    basis_max_age_s: int = 86_400
    lookback: int = 20
    horizon: int = 1

    def __post_init__(self) -> None:
        _need(bool(self.horizons) and all(h >= 1 for h in self.horizons), "horizons must be positive")
        _need(self.lookback >= 1 and self.horizon >= 1, "lookback and horizon must be at least 1")


@dataclass(frozen=True)
class Evaluation:
    fit_months: int = 16
    validation_months: int = 2
    test_months: int = 2
    step_months: int = 2
    tune_folds: int = 2

    def __post_init__(self) -> None:
        _need(min(self.fit_months, self.validation_months, self.test_months, self.step_months) >= 1, "months must be at least 1")


# The bar lengths the data providers offer.
OHLC_MINUTES = (1, 3, 5, 10, 15, 30, 60, 120, 180, 360, 720, 1440)
DVOL_SECONDS = (60, 3600, 43200, 86400)


@dataclass(frozen=True)
class Collection:
    poll_s: float = 300.0
    max_instruments: int = 300
    ohlc_minutes: int = 60
    dvol_seconds: int = 3600

    def __post_init__(self) -> None:
        _need(self.poll_s > 0 and self.max_instruments >= 1, "poll_s and max_instruments must be positive")
        _need(self.ohlc_minutes in OHLC_MINUTES, f"ohlc_minutes must be one of {OHLC_MINUTES}")
        _need(self.dvol_seconds in DVOL_SECONDS, f"dvol_seconds must be one of {DVOL_SECONDS}")


def load(kind: type, path: str | Path | None) -> Any:
    """Settings of ``kind``; defaults where the file is missing or empty, unknown keys refused."""
    given: dict[str, Any] = {}
    if path is not None and Path(path).exists():
        import yaml

        given = yaml.safe_load(Path(path).read_text()) or {}
    names = {f.name for f in fields(kind)}
    _need(set(given) <= names, f"unknown settings {sorted(set(given) - names)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
