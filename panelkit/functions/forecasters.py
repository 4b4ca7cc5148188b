"""Small context-to-horizon forecasters for ``backtest.plugin_forecast``.

Each takes the context values, oldest first, and returns ``horizon`` values.
Any library model can be wrapped the same way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def repeat_last(context: np.ndarray, horizon: int) -> np.ndarray:
    return np.full(horizon, context[-1])


def drift(context: np.ndarray, horizon: int) -> np.ndarray:
    """Last value plus the mean step of the context."""
    step = (context[-1] - context[0]) / (len(context) - 1)
    return context[-1] + step * np.arange(1, horizon + 1)


def seasonal(season: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """Repeat the last full season."""

    def forecast(context: np.ndarray, horizon: int) -> np.ndarray:
        return np.resize(context[-season:], horizon)

    return forecast


def seasonal_average(season: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """Mean of the context at each phase of the season."""

    def forecast(context: np.ndarray, horizon: int) -> np.ndarray:
        whole = context[len(context) % season :].reshape(-1, season)
        return np.resize(whole.mean(axis=0), horizon)

    return forecast


def recursive(step: Callable[[np.ndarray], float]) -> Callable[[np.ndarray, int], np.ndarray]:
    """One-step-ahead model applied to its own output."""

    def forecast(context: np.ndarray, horizon: int) -> np.ndarray:
        values = list(context)
        for _ in range(horizon):
            values.append(float(step(np.array(values))))
        return np.array(values[-horizon:])

    return forecast
