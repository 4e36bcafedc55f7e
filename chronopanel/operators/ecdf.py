"""Empirical distribution rank of a value inside its snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.pieces import CrossSection
from chronopanel.panel import named, quoted
from chronopanel.scale import lookup_join


# Up to this many columns a generated conditional maximum per column is the faster
# pivot; beyond it Spark's own, whose work per row does not grow with the columns.
CONDITIONAL_PIVOT = 64


def ecdf_long(cross: CrossSection, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., __f, __e): share of the snapshot's rows whose value is <= the row's.

    Missing values get 0.0 and count in the denominator.  Only distinct values are
    ordered; thin rows look theirs up, and those of a frequent value are spread.
    """
    t, ranks = cross.panel.snapshot, cross.ranks(columns)
    values = cross.long(columns, list(dict.fromkeys([*keep, t])))
    share = F.when(F.isnan("__v"), F.lit(0.0)).otherwise(F.col("__upto") / F.col("__n"))
    table = ranks.table.select(quoted(t), "__f", "__v", share.alias("__e"), "__c")
    found = lookup_join(values, table, [t, "__f", "__v"], ranks.sizes, "__c", keep, cross.limits)
    return found.select(*[quoted(k) for k in keep], "__f", "__e")


def add_ecdf(
    df: DataFrame, cross: CrossSection, ranks: dict[str, str], slices: list[str] | None = None
) -> DataFrame:
    """Add ``{output: column}`` empirical distribution ranks; ``df`` has the rows of ``cross``.

    The ranks of all columns return to the rows in one join on the keys.  The
    thin rows are shuffled before they are pivoted to one row per key: the pivoted
    rows are mostly null until complete, so pivoting first would only widen them.
    ``slices`` names columns that divide a hot entity's rows, see
    ``operators.history``.  Raises while running if two rows share a key.
    """
    columns = list(dict.fromkeys(ranks.values()))
    index = {c: i for i, c in enumerate(columns)}
    place = [cross.panel.entity, *(slices or [])]
    keys = [*place, cross.panel.snapshot]
    thin = ecdf_long(cross, columns, keys)
    together = thin.repartition(*[quoted(c) for c in place]).groupBy(*[quoted(c) for c in keys])
    # Every row has each column once here, so more of them are rows that share a key.
    once = f"count(1) = {len(columns)}"
    repeated = "raise_error('an (entity, snapshot) pair occurs more than once')"
    if len(columns) <= CONDITIONAL_PIVOT:
        by_name = {out: f"CASE WHEN {once} THEN max(CASE WHEN __f = {index[c]} THEN __e END) ELSE {repeated} END" for out, c in ranks.items()}
        pivoted = together.agg(*[F.expr(e).alias(out) for out, e in by_name.items()])
    else:
        found = together.pivot("__f", list(index.values())).agg(F.max("__e").alias("e"), F.count(F.lit(1)).alias("n"))
        by_name = {out: f"CASE WHEN `{index[c]}_n` = 1 THEN `{index[c]}_e` ELSE {repeated} END" for out, c in ranks.items()}
        pivoted = found.selectExpr(*[quoted(k) for k in keys], *named(by_name))
    # A merge join: rows meet by entity, in place if ``df`` is bucketed by it, and the
    # sort is the one the history window needs.
    return df.join(pivoted.hint("merge"), keys, "left")
