"""Approximate medians and quantiles from mergeable sketches.

A KLL sketch of some rows is a few kilobytes whatever their number, and sketches of parts
merge into the sketch of the whole.  So sketches of every snapshot can be stored once and merged by month, region or all;
the exact route (``operators.snapshot``) must count all distinct values again for each such group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.panel import Panel, quoted

K = 400


def rank_error(k: int = K) -> float:
    """How far the rank of a returned quantile may be from the asked one, as a share of the rows.

    This holds for a single quantile with 99 % confidence (the published fit for these sketches); groups
    of fewer than ``k`` rows are exact.
    """
    return 2.296 / k**0.9021


def sketched(df: DataFrame, panel: Panel, keys: Sequence[Column], columns: Sequence[str], k: int = K) -> DataFrame:
    """One row per group with ``n_{column}`` (rows with a value) and ``sketch_{column}``; missing values and NaN do not count.

    Sketches are built with map-side partials, so a group may hold any share of the rows.
    """
    parts = [
        item
        for c in columns
        for item in (F.count(panel.number(c)).alias(f"n_{c}"), F.kll_sketch_agg_double(panel.number(c), F.lit(k)).alias(f"sketch_{c}"))
    ]
    return df.groupBy(*keys).agg(*parts)


def merged(sketches: DataFrame, keys: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Sketches of larger groups out of those of smaller ones."""
    parts = [
        item
        for c in columns
        for item in (F.sum(f"n_{c}").alias(f"n_{c}"), F.kll_merge_agg_double(quoted(f"sketch_{c}")).alias(f"sketch_{c}"))
    ]
    return sketches.groupBy(*keys).agg(*parts)


def quantiles(sketches: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """A row per group and share with the approximate ``quantile`` of ``column`` (null for a group without values)."""
    others = [c for c in sketches.columns if not c.startswith("sketch_")]
    known = F.col(f"n_{column}") > 0
    each = [
        F.struct(F.lit(float(s)).alias("share"), F.when(known, F.kll_sketch_get_quantile_double(quoted(f"sketch_{column}"), F.lit(float(s)))).alias("quantile"))
        for s in shares
    ]
    return sketches.select(*[quoted(c) for c in others], F.inline(F.array(*each)))
