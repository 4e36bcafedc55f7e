"""Features that compare a row with its entity's own earlier snapshots.

All of them derive from the values 1..k snapshots earlier, so one window
(partition by entity, order by snapshot) with k offsets serves every column;
moving means, minima and maxima are row-wise expressions over those offsets.
Frames count rows, not months: gaps in the calendar are not filled.

An entity normally has at most as many rows as there are snapshots.  Where that
is too many for one task, the entity's time line is divided into slices, and each
slice gets a copy of the few rows before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronopanel.panel import Panel, named, quoted
from chronopanel.scale import (
    DEFAULT_LIMITS,
    GroupSizes,
    Limits,
    cut_points,
    entity_column,
    group_sizes,
    pin,
    place_among,
    snapshot_column,
)

SLICE = "__slice"
COPY = "__copy"

# Frame lengths of the moving features (that many older rows plus the
# current one) and the distances of the lags.
MOVING_ROWS = (2, 3, 6)
LAG_ROWS = (1, 2, 3, 6)


def earlier(name: str, k: int) -> str:
    """Helper column: the value k snapshots earlier; k = 0 is the current one."""
    return f"__{k}_before_{name}"


def hot_entity_cuts(
    df: DataFrame, panel: Panel, snapshots: int | None = None, limits: Limits = DEFAULT_LIMITS
) -> tuple[DataFrame, int] | None:
    """(entity, ``__cuts`` of snapshot) for entities too long for one task, and the piece count.

    With unique keys no history is longer than the number of snapshots, so a
    panel with few snapshots needs no look at the entities at all.  Text has no
    cut points and is refused as snapshot whatever the size of the panel.
    """
    if isinstance(df.schema[panel.snapshot].dataType, StringType):
        raise ValueError(f"{panel.snapshot} is text; history features need dates, timestamps or numbers as snapshots")
    if snapshots is None:
        snapshots = df.select(snapshot_column(panel)).distinct().limit(limits.rows_per_group + 1).count()
    if snapshots <= limits.rows_per_group:
        return None
    sizes: GroupSizes = group_sizes(df, entity_column(panel))
    limit = limits.rows_per_group
    if sizes.largest <= limit:
        return None
    pieces = limits.pieces(sizes.largest)
    hot = pin(df.groupBy(panel.entity).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit))
    return cut_points(df.select(panel.entity, panel.snapshot), [panel.entity], panel.snapshot, hot, pieces), pieces


def add_slices(df: DataFrame, panel: Panel, cuts: tuple[DataFrame, int]) -> DataFrame:
    """Add ``__slice``: 0 for most entities, the time slice for hot ones."""
    table, pieces = cuts
    placed = df.join(F.broadcast(table), panel.entity, "left")
    return place_among(placed, snapshot_column(panel), "__cuts", pieces, SLICE).drop("__cuts")


def add_preceding_copies(df: DataFrame, panel: Panel, cuts: tuple[DataFrame, int], reach: int) -> DataFrame:
    """Add to each slice a copy of the ``reach`` rows before it, marked ``__copy``.

    ``df`` has ``__slice``.  Only the last ``reach`` rows of each slice of a hot
    entity are candidates, at most pieces x reach rows per hot entity.
    """
    table, _ = cuts
    of_hot = df.join(F.broadcast(table.select(panel.entity)), panel.entity, "left_semi")
    slice_end = Window.partitionBy(panel.entity, SLICE).orderBy(F.col(quoted(panel.snapshot)).desc())
    ends = of_hot.withColumn("__from_end", F.row_number().over(slice_end)).where(F.col("__from_end") <= reach)
    line = Window.partitionBy(panel.entity).orderBy(panel.snapshot)
    later = F.array_compact(F.array_distinct(F.array(*[F.lead(SLICE, k).over(line) for k in range(1, reach + 1)])))
    copies = (
        ends.withColumn("__later", later)
        .withColumn("__to", F.explode("__later"))
        .where(F.col("__to") != F.col(SLICE))
        .withColumn(SLICE, F.col("__to"))
        .select(*[quoted(c) for c in df.columns], F.lit(True).alias(COPY))
    )
    return df.withColumn(COPY, F.lit(False)).unionByName(copies)


def add_earlier(
    df: DataFrame,
    panel: Panel,
    offsets: dict[str, set[int]],
    limits: Limits = DEFAULT_LIMITS,
    sliced: tuple[DataFrame, int] | None | str = "look",
) -> DataFrame:
    """Add the values of ``{column: {k, ...}}`` k snapshots earlier as helper columns.

    By default hot entities are looked for.  A caller that did so already gives
    the finding as ``sliced``: None, or the cuts with ``__slice`` in ``df``.
    """
    wanted = {c: sorted(ks) for c, ks in offsets.items() if ks}
    if not wanted:
        return df
    cuts = sliced
    if sliced == "look":
        cuts = hot_entity_cuts(df, panel, limits=limits)
        if cuts is not None:
            df = add_slices(df, panel, cuts)
    group = [quoted(panel.entity)]
    if cuts is not None:
        df = add_preceding_copies(df, panel, cuts, max(max(ks) for ks in wanted.values()))
        group.append(SLICE)
    # The current values as clean doubles first, so that lags and frames only name them.
    now = df.selectExpr("*", *named({earlier(c, 0): panel.number_sql(c) for c in wanted}))
    line = f"(PARTITION BY {', '.join(group)} ORDER BY {quoted(panel.snapshot)})"
    lags = {
        earlier(c, k): f"lag({quoted(earlier(c, 0))}, {k}) OVER {line}" for c, ks in wanted.items() for k in ks if k > 0
    }
    out = now.selectExpr("*", *named(lags))
    if cuts is None:
        return out
    out = out.where(~F.col(COPY)).drop(COPY)
    return out.drop(SLICE) if sliced == "look" else out


def moving_sql(panel: Panel, name: str, statistic: str, rows: int) -> str:
    """Mean, min or max over the current value and those up to ``rows`` snapshots earlier."""
    values = [quoted(earlier(name, k)) for k in range(rows + 1)]
    if statistic == "min":
        return f"least({', '.join(values)})"
    if statistic == "max":
        return f"greatest({', '.join(values)})"
    if panel.exact_scale is None:
        summands = [f"coalesce({v}, 0D)" for v in values]
    else:
        # At most eight of up to 18 digits fit a long, which is added far faster than a decimal.
        summands = [f"coalesce({panel.unit_sql(v)}, 0L)" for v in values]
    total = "(" + " + ".join(summands) + ")"
    present = " + ".join(f"int({v} IS NOT NULL)" for v in values)
    return f"{panel.total_sql(total)} / nullif({present}, 0)"


def moving_distance_columns(panel: Panel, name: str, statistic: str, prefix: str) -> dict[str, str]:
    """``{prefix}_{n}``: value minus the statistic of the current and n older rows."""
    now = quoted(earlier(name, 0))
    return {f"{prefix}_{n}": f"{now} - {moving_sql(panel, name, statistic, n)}" for n in MOVING_ROWS}


def lag_columns(name: str) -> dict[str, str]:
    """``L{k}_{name}``: value k snapshots earlier, null where there is none."""
    return {f"L{k}_{name}": quoted(earlier(name, k)) for k in LAG_ROWS}
