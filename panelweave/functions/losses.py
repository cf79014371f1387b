"""Pinball loss as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default quantiles of the forecasts.
QUANTILES = (0.1, 0.5, 0.9)


def pinball(y: Column, yhat: Column, tau: Column | float) -> Column:
    """``tau * max(e, 0) + (1 - tau) * max(-e, 0)`` with ``e = y - yhat``."""
    t = F.lit(tau) if isinstance(tau, float) else tau
    error = y - yhat
    return t * F.greatest(error, F.lit(0.0)) + (1 - t) * F.greatest(-error, F.lit(0.0))


def pinball_arrays(y: Column, yhat: Column, tau: float) -> Column:
    """Mean over steps for a window row that holds its steps in two arrays; needs no shuffle."""
    parts = F.zip_with(y, yhat, lambda a, b: pinball(a, b, tau))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(y)
