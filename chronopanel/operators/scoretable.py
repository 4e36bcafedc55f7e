"""The score table: percentile and buckets of model outputs per snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.buckets import TENTH_BORDERS, interval_index
from chronopanel.operators.ecdf import ecdf_long
from chronopanel.operators.pieces import CrossSection
from chronopanel.panel import Panel, quoted
from chronopanel.scale import DEFAULT_LIMITS, Limits, group_sizes, lookup_join


def score_table(
    outputs: DataFrame,
    object_id: str,
    snapshot: str,
    models: Sequence[str],
    probability: str,
    borders: Sequence[float] = TENTH_BORDERS,
    limits: Limits = DEFAULT_LIMITS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Score 0-100 (percentile inside snapshot and model) and buckets per object.

    ``models`` are the columns that identify view and model; the keys, the
    probability and everything in ``models`` and ``carry`` come out, nothing else.
    """
    keep = [object_id, snapshot, *models, *carry]
    cross = "__cross"
    keyed = outputs.withColumn(cross, F.struct(*[quoted(c) for c in [snapshot, *models]])).withColumn(
        "__p", F.col(quoted(probability))
    )
    ranked = ecdf_long(CrossSection(keyed, Panel(object_id, cross), limits), [probability], [*keep, "__p"])
    return ranked.selectExpr(
        *[quoted(c) for c in keep],
        "__e * 100 AS score",
        f"{interval_index('__e', borders)} AS score_bucket",
        "__p AS probability",
        f"{interval_index('__p', borders)} AS probability_bucket",
    )


def scores_by_scheme(
    outputs: DataFrame,
    schemes: DataFrame,
    object_id: str,
    snapshot: str,
    models: Sequence[str],
    probability: str,
    score_scheme: str,
    probability_scheme: str,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The score table with bucketing schemes from a table instead of fixed borders.

    ``schemes`` has a row (scheme_id, border) per border; ``score_scheme`` and ``probability_scheme`` are the columns of
    ``outputs`` that say which scheme a row's score (0-100) and probability are bucketed by.  The bucket is the number of the
    half-open interval between borders, 0 below the first; it is null for a missing value and for a scheme that has no
    borders.  Scheme ids come out as ``score_bucketing_scheme_id`` and ``probability_bucketing_scheme_id``.
    """
    ids = ["score_bucketing_scheme_id", "probability_bucketing_scheme_id"]
    named = outputs.withColumns({ids[0]: F.col(quoted(score_scheme)), ids[1]: F.col(quoted(probability_scheme))})
    found = score_table(named, object_id, snapshot, models, probability, limits=limits, carry=ids)
    borders = schemes.where(F.col("border").isNotNull() & ~F.isnan("border")).groupBy("scheme_id")
    table = borders.agg(F.array_sort(F.collect_set(F.col("border").cast("double"))).alias("__borders"))
    for name, scheme in zip(("score", "probability"), ids):
        found = _bucketed(found.drop(f"{name}_bucket"), table, name, scheme, [object_id, snapshot], limits)
    return found


def _bucketed(rows: DataFrame, table: DataFrame, name: str, scheme: str, spread_by: list[str], limits: Limits) -> DataFrame:
    """Add ``{name}_bucket``: the interval of the row's scheme its value lies in; a scheme of very many rows is spread."""
    sizes = group_sizes(rows, F.col(scheme))
    weights = rows.groupBy(scheme).agg(F.count(F.lit(1)).alias("__weight"))
    known = weights.join(table.withColumnRenamed("scheme_id", scheme), scheme)
    joined = lookup_join(rows, known, [scheme], sizes, "__weight", spread_by, limits)
    return joined.withColumn(f"{name}_bucket", _interval("__borders", F.col(name))).drop("__borders")


def _interval(borders: str, value: Column) -> Column:
    below = F.size(F.filter(borders, lambda border: border <= value)).cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & F.col(borders).isNotNull(), below)
