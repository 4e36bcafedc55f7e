"""As-of look-up: the latest mark at or before a row's time.

Neither side need fit anywhere.  The distinct times of the rows are counted with map-side partials and
dealt, with the marks, to ranges by (keys, time); each range is walked once in order, and a range begins with the last mark
of the ranges before it.  Rows then find their time's mark, and a time that very many rows share is spread.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.panel import quoted
from chronopanel.scale import DEFAULT_LIMITS, GroupSizes, Limits, lookup_join, stored

MARK, PART = "__mark", "__part"


def latest_mark(
    rows: DataFrame, marks: DataFrame, keys: list[str], time: str, values: list[str], limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """``rows`` with the ``values`` of the latest of ``marks`` that has their keys and is not later than their time.

    Of marks at one time the greatest by ``values`` counts.  Rows before the first mark, and rows with
    a null key or time, get nulls.  ``rows`` is read twice, so give a stored table.
    """
    on = [*keys, time]
    names, places = [quoted(c) for c in on], [f"__k{i}" for i in range(len(on))]
    *key_places, at = places

    def placed(df: DataFrame) -> DataFrame:
        kept = df.dropna(subset=[c for c in on])
        return kept.select(*[F.col(n).alias(p) for n, p in zip(names, places)], *[quoted(c) for c in df.columns if c not in on])

    times = placed(rows.select(*names)).groupBy(*places).agg(F.count(F.lit(1)).alias("__n"))
    times = stored(times)
    found = times.agg(F.sum("__n"), F.count(F.lit(1)), F.max("__n")).first()
    sizes = GroupSizes(found[0] or 0, found[1], found[2] or 0)
    best = F.max(F.struct(*[quoted(c) for c in values])).alias(MARK)
    marked = stored(placed(marks.select(*names, *[quoted(c) for c in values])).groupBy(*places).agg(best))
    both = times.unionByName(marked, allowMissingColumns=True)
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, ceil((sizes.groups + marked.count()) / limits.rows_per_group))
    dealt = both.repartitionByRange(ranges, *places).withColumn(PART, F.spark_partition_id())
    # A mark comes before rows of its own time.
    line = Window.partitionBy(PART, *key_places).orderBy(at, F.col(MARK).isNull())
    upto = F.last(MARK, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A table: two plans must see the same ranges.
    local = stored(dealt.withColumn("__local", upto))
    # Few rows a key: one for each range the key reaches into.
    before = Window.partitionBy(*key_places).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    last = local.groupBy(PART, *key_places).agg(F.max_by(MARK, F.when(F.col(MARK).isNotNull(), F.col(at))).alias("__last"))
    starts = last.select(PART, *key_places, F.last("__last", ignorenulls=True).over(before).alias("__start"))
    looked = local.where(F.col("__n").isNotNull()).join(starts, [PART, *key_places])
    mark = F.coalesce("__local", "__start")
    columns = [mark.getField(c).alias(c) for c in values]
    table = looked.select(*[F.col(p).alias(c) for p, c in zip(places, on)], "__n", *columns)
    return lookup_join(rows, table, on, sizes, "__n", rows.columns, limits).select(*[quoted(c) for c in [*rows.columns, *values]])
