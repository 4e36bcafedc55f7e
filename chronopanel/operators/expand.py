"""Making a large panel out of a small table: copies, column clones, snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.panel import named, quoted
from chronopanel.scale import global_position

# Fixed value: days between two generated snapshots.
SNAPSHOT_DAYS = 30


def stack_copies(df: DataFrame, copies: int, out: str = "copy") -> DataFrame:
    """Every row ``copies`` times, numbered from 0 in ``out``; no shuffle."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def clone_columns(df: DataFrame, keys: list[str], clones: int) -> DataFrame:
    """Add ``clones`` copies of all non-key columns with suffixes _1, _2, ..."""
    values = [c for c in df.columns if c not in keys]
    return df.selectExpr("*", *named({f"{c}_{i}": quoted(c) for i in range(1, clones + 1) for c in values}))


def renumber(df: DataFrame, entity: str, copy: str | None = None) -> DataFrame:
    """Replace unique entity ids by 1..n in their order.

    With ``copy`` (0-based number of the copy a row belongs to) ids continue from
    copy to copy.  Call it before ``stack_copies`` where possible: see
    ``expand_table``, which sorts one copy only.
    """
    order = [F.col(quoted(c)) for c in ([copy] if copy else []) + [entity]]
    placed = global_position(df, order, unique=True)
    return placed.withColumn(entity, F.col("__pos") + 1).drop("__pos")


def monthly_snapshots(df: DataFrame, snapshots: int, start: dt.date, out: str = "snapshotDate") -> DataFrame:
    """Every row once per snapshot: ``start`` and every 30 days after it."""
    number = F.explode(F.sequence(F.lit(0), F.lit(snapshots - 1)))
    return df.withColumn("__n", number).withColumn(out, F.date_add(F.lit(start), F.col("__n") * SNAPSHOT_DAYS)).drop("__n")


def expand_table(
    df: DataFrame, entity: str, copies: int, clones: int, snapshots: int, start: dt.date, out: str = "snapshotDate"
) -> DataFrame:
    """The whole load-test table: clones, copies with dense ids, snapshots."""
    numbered = global_position(df, [F.col(quoted(entity))], unique=True)
    rows = df.count()
    # Few input rows become many: spread them over all tasks before they multiply.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = clone_columns(numbered.repartition(tasks, "__pos"), [entity, "__pos"], clones)
    stacked = stack_copies(wide, copies, "__copy").withColumn(entity, F.col("__copy") * F.lit(rows) + F.col("__pos") + 1)
    return monthly_snapshots(stacked.drop("__copy", "__pos"), snapshots, start, out)
