"""Forecasts of many series: one bounded group of periods each, candidates judged by rolling-origin backtests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_quantile

# Smoothing weights of the candidates, and periods of a season by grain.
LEVEL, SLOPE, DAMPING, DAMPED_SLOPE, MOVING = 0.4, 0.2, 0.9, 0.15, 3
SEASON = {"day": 7, "week": 52, "month": 12, "quarter": 4, "year": 1}
FOLDS = 8


def holt(y: np.ndarray, h: int, slope: float, damping: float) -> np.ndarray:
    """Level and trend by exponential smoothing, the trend damped by each step ahead."""
    level, trend = y[0], y[1] - y[0]
    for v in y[1:]:
        before = level
        level = LEVEL * v + (1 - LEVEL) * (level + damping * trend)
        trend = slope * (level - before) + (1 - slope) * damping * trend
    return level + trend * np.cumsum(damping ** np.arange(1, h + 1))


def candidates(season: int):
    yield "naive", lambda y, h: np.full(h, y[-1])
    yield "drift", lambda y, h: y[-1] + (y[-1] - y[0]) / (len(y) - 1) * np.arange(1, h + 1)
    yield "moving_average", lambda y, h: np.full(h, y[-MOVING:].mean())
    yield "holt", lambda y, h: holt(y, h, SLOPE, 1.0)
    yield "damped_holt", lambda y, h: holt(y, h, DAMPED_SLOPE, DAMPING)
    if season > 1:
        yield "seasonal_naive", lambda y, h: np.array([y[len(y) - season + i % season] if len(y) >= season else np.nan for i in range(h)])


def fit(y: np.ndarray, horizon: int, season: int, alpha: float) -> list[tuple]:
    """Rows (step, forecast, low, high, method, mae, rmse, mase) of the candidate with the least backtest error."""
    least = max(6, horizon + 2)
    if len(y) < least:
        return []
    origins = range(max(least - horizon, len(y) - horizon - FOLDS + 1), len(y) - horizon + 1)
    scale = np.abs(np.diff(y)).mean() or np.nan
    best = None
    for name, method in candidates(season):
        errors = np.concatenate([y[o : o + horizon] - method(y[:o], horizon) for o in origins if o >= 2] or [np.array([np.nan])])
        if np.isnan(errors).any():
            continue
        score = (np.abs(errors).mean(), np.sqrt((errors**2).mean()))
        if best is None or score < best[0]:
            best = (score, name, method, errors)
    if best is None:
        return []
    (mae, rmse), name, method, errors = best
    ahead = method(y, horizon)
    width = np.quantile(np.abs(errors), 1 - alpha) if len(errors) >= 3 else normal_quantile(alpha) * rmse
    reach = width * np.sqrt(np.arange(1, horizon + 1))
    return [(i + 1, float(v), float(v - r), float(v + r), name, float(mae), float(rmse), float(mae / scale) if np.isfinite(scale) else None) for i, (v, r) in enumerate(zip(ahead, reach))]


def forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = 3, grain: str = "month", alpha: float = 0.05) -> DataFrame:
    """keys, step, period, forecast, low, high, method and errors of every series with enough periods.

    series has a row for each period (a date) and value; series too short for a backtest have no forecast.
    """
    rows = series if keys else series.withColumn("series", F.lit("all"))
    names = list(keys) or ["series"]
    season = SEASON[grain]
    offset = {"day": pd.DateOffset(days=1), "week": pd.DateOffset(weeks=1), "month": pd.DateOffset(months=1), "quarter": pd.DateOffset(months=3), "year": pd.DateOffset(years=1)}[grain]
    columns = [*names, "step", "period", "forecast", "low", "high", "method", "mae", "rmse", "mase"]

    def ahead(group: pd.DataFrame) -> pd.DataFrame:
        group = group.dropna(subset=["value"]).sort_values("period")
        found = fit(group["value"].astype(float).to_numpy(), horizon, season, alpha)
        last = pd.Timestamp(group["period"].iloc[-1]) if len(group) else None
        return pd.DataFrame([(*(group[k].iloc[0] for k in names), f[0], (last + f[0] * offset).date(), *f[1:]) for f in found], columns=columns)

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)
    return rows.groupBy(*names).applyInPandas(ahead, f"{schema}, step int, period date, forecast double, low double, high double, method string, mae double, rmse double, mase double")
