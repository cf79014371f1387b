"""Arithmetic on array columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(columns: Sequence[Column]) -> list[Column]:
    """Softmax across columns of one row, shifted by the maximum for stability."""
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    weights = [F.exp(c - top) for c in columns]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return [w / total for w in weights]

