"""Detectable effects of the two-sided two-sample t-test.

Small numeric helper, called once per distinct test level inside Spark tasks.
Student's t with noncentrality is integrated over its scale variable.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import erf

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Test level, power, bounds on the size per group.
ALPHA = 0.05
POWER = 0.80
MIN_SIZE = 30
MAX_SIZE = 200

_GRID = 65
_STEPS = 60
_CLOSE = 1e-11


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    flat = [erf(v) for v in (z / np.sqrt(2.0)).ravel()]
    return 0.5 * (1 + np.array(flat).reshape(z.shape))


def _tail_above(limit: np.ndarray, shift: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > limit) for noncentrality ``shift``: a mean of normal tails over s = sqrt(chi2/df)."""
    reach = 8 / np.sqrt(2 * df)
    s = 1 + np.linspace(-1, 1, _GRID) * reach[:, None]
    s = np.maximum(s, 1e-6)
    log_density = (df[:, None] - 1) * np.log(s) - df[:, None] * s * s / 2
    weight = np.exp(log_density - log_density.max(axis=1, keepdims=True))
    return (weight * _normal_cdf(shift[:, None] - limit[:, None] * s)).sum(axis=1) / weight.sum(axis=1)


def _root(function, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Roots of rising functions, one per element: false position with the stale end halved."""
    at_low, at_high = function(low), function(high)
    side = np.zeros(low.size)
    x = low
    for _ in range(_STEPS):
        x = (low * at_high - high * at_low) / (at_high - at_low)
        value = function(x)
        if np.all(np.abs(value) < _CLOSE):
            break
        under = value < 0
        at_high = np.where(under & (side < 0), at_high / 2, np.where(under, at_high, value))
        at_low = np.where(~under & (side > 0), at_low / 2, np.where(under, value, at_low))
        low, high = np.where(under, x, low), np.where(under, high, x)
        side = np.where(under, -1, 1)
    return x


def detectable_effects(alpha: float, power: float = POWER) -> list[float]:
    """Smallest effect detected per group size, from MIN_SIZE up to one below MAX_SIZE; falling."""
    n = np.arange(MIN_SIZE, MAX_SIZE, dtype=float)
    df, root, none = 2 * n - 2, np.sqrt(n / 2), np.zeros(n.size)
    critical = _root(lambda t: alpha / 2 - _tail_above(t, none, df), none, none + 10.0)

    def gap(effect: np.ndarray) -> np.ndarray:
        shift = effect * root
        return _tail_above(critical, shift, df) + 1 - _tail_above(-critical, shift, df) - power

    return _root(gap, none, (critical + 4) / root).tolist()


def limits_per_alpha(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch = batch.dropna()
        yield pd.DataFrame({"limit_alpha": batch["limit_alpha"], "limits": [detectable_effects(a) for a in batch["limit_alpha"]]})


# executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
