"""A panel seen by snapshot, and the rank of every distinct value in its snapshot.

Equal values are counted first, with map-side partials, so a value that fills a
third of the table is one row from then on and nothing ever sorts its copies.  The
distinct (snapshot, column, value) rows are dealt to equal ranges, each is summed
by itself, and what the ranges before it hold is added.  A range has about
``Limits.rows_per_group`` rows at every size of the table; there is no other route.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.panel import Panel, quoted
from chronopanel.scale import DEFAULT_LIMITS, GroupSizes, Limits, stored


@dataclass(frozen=True)
class ValueRanks:
    """Per distinct value: ``__c`` rows, ``__upto`` rows with no larger value.

    ``__m`` and ``__n`` are the snapshot's rows with a value and all its rows.
    ``sizes`` are those of the groups of equal values.  Missing values are one
    value, NaN, which sorts last.
    """

    table: DataFrame
    sizes: GroupSizes


class CrossSection:
    """A panel table seen by snapshot: what statistics and ranks are taken from.

    Sizes and ranks are found on first use and then shared by all operators.
    """

    def __init__(self, df: DataFrame, panel: Panel, limits: Limits = DEFAULT_LIMITS):
        self.df, self.panel, self.limits = df, panel, limits
        self._ranks: dict[tuple[str, ...], ValueRanks] = {}

    @cached_property
    def sizes(self) -> GroupSizes:
        """Sizes of the snapshots; raises if a key is null."""
        counts = self.df.groupBy(quoted(self.panel.snapshot)).agg(F.count(F.lit(1)).alias("__c"), self._nulls())
        return self._checked(counts)

    def ranks(self, columns: list[str]) -> ValueRanks:
        """Ranks of the distinct values of ``columns``; raises if a key is null."""
        if tuple(columns) not in self._ranks:
            self._ranks[tuple(columns)] = _value_ranks(self, columns)
        return self._ranks[tuple(columns)]

    def long(self, columns: list[str], keep: list[str]) -> DataFrame:
        """Thin rows (keep..., __f, __v): one per row and column, __f the column's index, NaN if missing."""
        values = F.array(*[F.coalesce(self.panel.number(c), F.lit(float("nan"))) for c in columns])
        return self.df.select(*[quoted(k) for k in keep], F.posexplode(values).alias("__f", "__v"))

    def given_statistics(self, wanted: list[tuple[str, str]]) -> DataFrame | None:
        """Statistics that are not to be taken from the rows; none here."""
        return None

    def _nulls(self) -> Column:
        return F.count_if(F.col(quoted(self.panel.entity)).isNull()).alias("__nulls")

    def _checked(self, counts: DataFrame) -> GroupSizes:
        """Sizes of the groups counted in ``__c``; a null entity or snapshot is an error."""
        t = F.col(quoted(self.panel.snapshot))
        found = counts.agg(
            F.sum("__c"), F.count(F.lit(1)), F.max("__c"), F.sum(F.when(t.isNull(), F.col("__c")).otherwise(F.col("__nulls")))
        ).first()
        if found[3]:
            raise ValueError(f"rows have a null {self.panel.entity} or {self.panel.snapshot}")
        return GroupSizes(found[0] or 0, found[1], found[2] or 0)


def _value_ranks(cross: CrossSection, columns: list[str]) -> ValueRanks:
    t, limits = cross.panel.snapshot, cross.limits
    group = [quoted(t), "__f"]
    values = cross.long(columns, [t, cross.panel.entity])
    counted = stored(values.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c"), cross._nulls()))
    sizes = cross._checked(counted)
    ranges = max(counted.sparkSession.sparkContext.defaultParallelism, ceil(sizes.groups / limits.rows_per_group))
    dealt = counted.drop("__nulls").repartitionByRange(ranges, *group, "__v").withColumn("__part", F.spark_partition_id())
    line = Window.partitionBy("__part", *group).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A table: two plans must see the same ranges.
    local = stored(dealt.withColumn("__local", F.sum("__c").over(line)))
    known = F.when(~F.isnan("__v"), F.col("__c")).otherwise(0)
    totals = local.groupBy("__part", *group).agg(F.sum("__c").alias("__size"), F.sum(known).alias("__known"))
    # A group has a row here for each range it reaches into.
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__part",
        *group,
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"),
        F.sum("__known").over(whole).alias("__m"),
        F.sum("__size").over(whole).alias("__n"),
    )
    upto = (F.col("__start") + F.col("__local")).alias("__upto")
    table = local.join(starts, ["__part", t, "__f"]).select(*group, "__v", "__c", upto, "__m", "__n")
    return ValueRanks(table, sizes)
