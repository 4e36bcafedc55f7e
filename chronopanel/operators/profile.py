"""Size, schema and value ranges of a table, and sorted previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.panel import Panel, quoted


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows, present, smallest, largest (as text).

    A single aggregation over the table, turned on its side afterwards.
    """
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        column = F.col(quoted(c))
        aggregates += [
            F.count(column).alias(f"present_{i}"),
            F.min(column).cast("string").alias(f"smallest_{i}"),
            F.max(column).cast("string").alias(f"largest_{i}"),
        ]
    one = df.agg(*aggregates)
    per_column = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("name"),
            F.lit(kind).alias("type"),
            F.col("rows").alias("rows"),
            F.col(f"present_{i}").alias("present"),
            F.col(f"smallest_{i}").alias("smallest"),
            F.col(f"largest_{i}").alias("largest"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return one.select(F.inline(F.array(*per_column)))


def latest_first(df: DataFrame, panel: Panel, rows: int | None = None) -> DataFrame:
    """Rows by entity, newest snapshot first; with ``rows`` only that many (a preview)."""
    ordered = df.orderBy(quoted(panel.entity), F.col(quoted(panel.snapshot)).desc())
    return ordered if rows is None else ordered.limit(rows)


def one_snapshot(df: DataFrame, panel: Panel, value) -> DataFrame:
    """Rows of one snapshot; on a table partitioned by snapshot only that folder is read."""
    return df.where(F.col(quoted(panel.snapshot)) == F.lit(value))
