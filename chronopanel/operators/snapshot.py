"""Cross-section statistics and the distances of rows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.pieces import CrossSection
from chronopanel.panel import Panel, named, quoted
from chronopanel.scale import lookup_join, small_enough

STATISTICS = ("mean", "min", "max", "median")
#: Statistics of one's own: (panel, SQL of the value) -> SQL aggregate.
OWN_STATISTICS: dict[str, Callable[[Panel, str], str]] = {}


def register_statistic(name: str, aggregate: Callable[[Panel, str], str]) -> None:
    """Make a cross-section statistic available to operators of kind ``distance`` under ``name``.

    ``aggregate`` gives an SQL expression over Spark's aggregates of the value, which is a double or null, as in
    ``lambda panel, v: f"sqrt(sum({v} * {v}) / nullif(count({v}), 0))"``.  It is computed with the other statistics in one
    aggregation with map-side partials, whatever the size of a snapshot.
    """
    if name in STATISTICS or not name.isidentifier():
        raise ValueError(f"{name} is no name for a statistic of one's own")
    OWN_STATISTICS[name] = aggregate


def known_statistics() -> tuple[str, ...]:
    return (*STATISTICS, *OWN_STATISTICS)


def statistic_name(column: str, statistic: str) -> str:
    return f"__{statistic}_{column}"


def statistic_sql(panel: Panel, column: str, statistic: str) -> str:
    value = panel.number_sql(column)
    if statistic in OWN_STATISTICS:
        return f"CAST({OWN_STATISTICS[statistic](panel, value)} AS DOUBLE)"
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic {statistic}; known: {', '.join(known_statistics())}")
    if statistic == "mean":
        total = panel.total_sql(f"sum({panel.summand_sql(value)})")
        return f"{total} / nullif(count({value}), 0)"
    return f"{statistic}({value})"


def snapshot_stats(cross: CrossSection, wanted: Iterable[tuple[str, str]]) -> DataFrame:
    """One row per snapshot with the wanted (column, statistic) pairs.

    Mean, minimum and maximum of all columns come from one aggregation with
    map-side partial results.  Exact medians need an order and take the route of
    ``snapshot_medians``.
    """
    wanted, panel = list(dict.fromkeys(wanted)), cross.panel
    given = cross.given_statistics(wanted)
    if given is not None:
        return given
    aggregates = [
        F.expr(statistic_sql(panel, column, statistic)).alias(statistic_name(column, statistic))
        for column, statistic in wanted
        if statistic != "median"
    ]
    medians = [column for column, statistic in wanted if statistic == "median"]
    stats = cross.df.groupBy(quoted(panel.snapshot)).agg(F.count(F.lit(1)).alias("__rows"), *aggregates)
    if medians:
        found = small_enough(snapshot_medians(cross, medians), cross.sizes.groups, cross.limits)
        stats = stats.join(found, [panel.snapshot], "left")
    return stats


def snapshot_medians(cross: CrossSection, columns: list[str]) -> DataFrame:
    """Exact medians, one row per snapshot, one column per input column.

    The ranks of the distinct values say which one or two are in the middle.
    """
    ranked = cross.ranks(columns).table.where(~F.isnan("__v"))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__c") < position) & (F.col("__upto") >= position), F.col("__v")))

    middle = (at(_lower(F.col("__m"))) + at(_upper(F.col("__m")))) / 2
    t = quoted(cross.panel.snapshot)
    medians = ranked.groupBy(t, "__f").agg(middle.alias("__median"))
    return medians.groupBy(t).agg(
        *[F.max(F.when(F.col("__f") == i, F.col("__median"))).alias(statistic_name(c, "median")) for i, c in enumerate(columns)]
    )


def _lower(count: Column) -> Column:
    """1-based position of the lower middle value among ``count`` values."""
    return F.call_function("div", count + 1, F.lit(2))


def _upper(count: Column) -> Column:
    return F.call_function("div", count + 2, F.lit(2))


def add_distances(df: DataFrame, cross: CrossSection, distances: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """Add ``{output: (column, statistic, unit)}``: value minus its own snapshot's statistic, in units of another one if given.

    A unit of 0 gives null.

    ``df`` has the rows of ``cross`` and may have more columns.
    """
    panel = cross.panel
    used = list(dict.fromkeys((column, s) for column, *found in distances.values() for s in found if s is not None))
    stats = snapshot_stats(cross, used)
    joined = lookup_join(df, stats, [panel.snapshot], cross.sizes, "__rows", [panel.entity], cross.limits)
    helpers = {statistic_name(column, statistic) for column, statistic in used}
    made = {}
    for out, (column, statistic, unit) in distances.items():
        made[out] = f"{panel.number_sql(column)} - {quoted(statistic_name(column, statistic))}"
        if unit is not None:
            made[out] = f"({made[out]}) / nullif({quoted(statistic_name(column, unit))}, 0.0D)"
    return joined.selectExpr("*", *named(made)).drop(*helpers)
