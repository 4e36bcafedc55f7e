"""A cross-section that is kept: ranks and distances of later rows against it.

``freeze`` takes one cross-section out of a panel: per column the distinct values with
the number of rows up to each, and the statistics.  Rows of any later snapshot then get the rank
their value would have had there, also values that never occurred in it: an unseen value
has the rows up to the nearest smaller one.  This is an as-of look-up of a large table in a large
table: the distinct values of both sides are dealt to ranges of about ``Limits.rows_per_group``,
each range is walked once in order, and a range begins with what the ranges before it hold.  Rows find their value's
rank as they do in their own snapshot, so frequent values are spread in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.operators.pieces import CrossSection, ValueRanks
from chronopanel.operators.snapshot import known_statistics, snapshot_stats, statistic_name
from chronopanel.panel import Panel, quoted
from chronopanel.scale import DEFAULT_LIMITS, Limits, stored

EVERYTHING = "__everything"


@dataclass(frozen=True)
class Reference:
    """A frozen cross-section.

    values      column, value, upto (rows with no larger value), one row per distinct value
    statistics  {column: {statistic: value}}; ``rows`` counts all rows, missing values included
    size        rows of ``values``
    """

    values: DataFrame
    statistics: dict[str, dict[str, float | None]]
    size: int

    def save(self, path: str) -> None:
        """Write to a folder, over what is there."""
        flat = [(c, s, None if v is None else float(v)) for c, found in self.statistics.items() for s, v in found.items()]
        self.values.write.mode("overwrite").parquet(f"{path}/values")
        table = self.values.sparkSession.createDataFrame(flat, "column string, statistic string, value double")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Reference:
        values = spark.read.parquet(f"{path}/values")
        statistics: dict[str, dict[str, float | None]] = {}
        for r in spark.read.parquet(f"{path}/statistics").collect():  # five numbers a column
            statistics.setdefault(r["column"], {})[r["statistic"]] = r["value"]
        return Reference(values, statistics, values.count())


def freeze(df: DataFrame, panel: Panel, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> Reference:
    """All rows of ``df`` as one cross-section, whatever their snapshots."""
    whole = Panel(panel.entity, EVERYTHING, panel.exact_scale)
    rows = df.select(quoted(panel.entity), F.lit(0).alias(EVERYTHING), *[quoted(c) for c in columns])
    cross = CrossSection(rows, whole, limits)
    known = known_statistics()
    found = snapshot_stats(cross, [(c, s) for c in columns for s in known]).first()
    if found is None:
        raise ValueError("there are no rows to freeze")
    statistics = {c: {s: found[statistic_name(c, s)] for s in known} | {"rows": float(found["__rows"])} for c in columns}
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__f") + 1)
    ranked = cross.ranks(list(columns)).table.where(~F.isnan("__v"))
    values = stored(ranked.select(name.alias("column"), F.col("__v").alias("value"), F.col("__upto").alias("upto")))
    return Reference(values, statistics, values.count())


class FrozenSection(CrossSection):
    """A panel whose ranks and distances are taken against a ``Reference``."""

    def __init__(self, df: DataFrame, panel: Panel, reference: Reference, limits: Limits = DEFAULT_LIMITS):
        super().__init__(df, panel, limits)
        self.reference = reference

    def _known(self, columns: Sequence[str]) -> None:
        unknown = [c for c in columns if c not in self.reference.statistics]
        if unknown:
            raise ValueError(f"the frozen cross-section has no column {', '.join(unknown)}")

    def given_statistics(self, wanted: list[tuple[str, str]]) -> DataFrame:
        self._known([c for c, _ in wanted])
        values = [F.lit(self.reference.statistics[c][s]).cast("double").alias(statistic_name(c, s)) for c, s in wanted]
        counts = self.df.groupBy(quoted(self.panel.snapshot)).agg(F.count(F.lit(1)).alias("__rows"))
        return counts.select("*", *values)

    def ranks(self, columns: list[str]) -> ValueRanks:
        if tuple(columns) not in self._ranks:
            self._known(columns)
            self._ranks[tuple(columns)] = self._as_of(columns)
        return self._ranks[tuple(columns)]

    def _as_of(self, columns: list[str]) -> ValueRanks:
        t, limits = self.panel.snapshot, self.limits
        values = self.long(columns, [t, self.panel.entity])
        counted = stored(values.groupBy(quoted(t), "__f", "__v").agg(F.count(F.lit(1)).alias("__c"), self._nulls()))
        sizes = self._checked(counted)
        number = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
        frozen = self.reference.values.where(F.col("column").isin(columns)).select(
            number[F.col("column")].alias("__f"), F.col("value").alias("__v"), F.col("upto").alias("__seen")
        )
        both = counted.drop("__nulls").unionByName(frozen, allowMissingColumns=True)
        ranges = max(counted.sparkSession.sparkContext.defaultParallelism, ceil((sizes.groups + self.reference.size) / limits.rows_per_group))
        dealt = both.repartitionByRange(ranges, "__f", "__v").withColumn("__part", F.spark_partition_id())
        # A frozen value comes before equal ones that look for it.
        line = Window.partitionBy("__part", "__f").orderBy("__v", F.col("__seen").isNull())
        upto_here = F.last("__seen", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # A table: two plans must see the same ranges.
        local = stored(dealt.withColumn("__local", upto_here))
        before = Window.partitionBy("__f").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = local.groupBy("__part", "__f").agg(F.max("__seen").alias("__most"))
        starts = starts.select("__part", "__f", F.max("__most").over(before).alias("__start"))
        rows = F.element_at(F.array(*[F.lit(int(self.reference.statistics[c]["rows"])) for c in columns]), F.col("__f") + 1)
        looked = local.where(F.col("__seen").isNull()).join(starts, ["__part", "__f"])
        upto = F.coalesce("__local", "__start", F.lit(0)).alias("__upto")
        return ValueRanks(looked.select(quoted(t), "__f", "__v", "__c", upto, rows.cast("long").alias("__n")), sizes)
