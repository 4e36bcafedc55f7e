"""Interval index and threshold flags as Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

# Inner interval borders; each list is open to both sides, so there
# are len + 1 intervals and only values >= 1.0 reach the last one.
QUARTER_BORDERS = (0.0, 0.25, 0.5, 0.75, 1.0)
TENTH_BORDERS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def interval_index(value: str, borders: Sequence[float]) -> str:
    """Index (as double) of the half-open interval [lo, hi) holding the value of a column.

    Missing and NaN give null.
    """
    cases = " ".join(f"WHEN {value} < {float(border)!r}D THEN {float(i)!r}D" for i, border in enumerate(borders))
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN NULL {cases} ELSE {float(len(borders))!r}D END"


def above(value: str, threshold: float) -> str:
    """1.0 if the value of an expression is > threshold, else 0.0, also for missing and NaN."""
    return f"CASE WHEN {value} > {float(threshold)!r}D AND NOT isnan({value}) THEN 1.0D ELSE 0.0D END"
