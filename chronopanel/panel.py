"""What a panel is: one row per entity and snapshot, with numeric columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    """Key columns of a panel table.

    ``exact_scale`` is the number of decimal places the numeric columns hold, if
    that is known (money: 2).  Sums are then taken over whole smallest units, so a
    mean does not depend on the order in which Spark adds rows; sums have 28 digits, so
    10^12 rows of 10^16 units fit.  ``None`` means plain doubles.
    """

    entity: str = "ID"
    snapshot: str = "snapshotDate"
    exact_scale: int | None = None

    @property
    def keys(self) -> list[str]:
        return [self.snapshot, self.entity]

    def value_columns(self, df: DataFrame) -> list[str]:
        """All columns that are not keys, in table order."""
        return [c for c in df.columns if c not in (self.entity, self.snapshot)]

    def number_sql(self, name: str) -> str:
        """The column as double; NaN counts as missing and -0.0 becomes 0.0."""
        value = f"CAST({quoted(name)} AS DOUBLE)"
        return f"CASE WHEN NOT isnan({value}) THEN {value} + 0.0D END"

    def number(self, name: str) -> Column:
        return F.expr(self.number_sql(name))

    def summand_sql(self, value: str) -> str:
        """What sums add up for ``value``: the double itself, or whole smallest units."""
        if self.exact_scale is None:
            return value
        return f"CAST(rint({value} * {10.0**self.exact_scale!r}D) AS DECIMAL(18, 0))"

    def unit_sql(self, value: str) -> str:
        """``summand_sql`` with an exact scale as a long, for sums of a few values; out of range it does what that does."""
        units = f"rint({value} * {10.0**self.exact_scale!r}D)"
        wide = f"CAST({self.summand_sql(value)} AS BIGINT)"
        return f"CASE WHEN abs({units}) < 1E17D THEN CAST({units} AS BIGINT) ELSE {wide} END"

    def total_sql(self, total: str) -> str:
        """A sum of summands as double."""
        if self.exact_scale is None:
            return f"CAST({total} AS DOUBLE)"
        return f"CAST({total} AS DOUBLE) / {10.0**self.exact_scale!r}D"


def quoted(name: str) -> str:
    """Column reference that survives dots, leading digits and back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def named(expressions: dict[str, str]) -> list[str]:
    """SQL select items for ``{name: expression}``."""
    return [f"{expression} AS {quoted(name)}" for name, expression in expressions.items()]


def check_keys(df: DataFrame, panel: Panel) -> None:
    """Raise if a key is null or an (entity, snapshot) pair occurs twice.

    One distributed aggregation; only two numbers reach the driver.
    """
    entity, snapshot = F.col(quoted(panel.entity)), F.col(quoted(panel.snapshot))
    per_key = df.groupBy(entity.alias("e"), snapshot.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    found = per_key.agg(
        F.sum(F.when(F.col("e").isNull() | F.col("t").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"),
    ).first()
    if found["nulls"]:
        raise ValueError(f"{found['nulls']} rows have a null {panel.entity} or {panel.snapshot}")
    if found["repeated"]:
        raise ValueError(
            f"{found['repeated']} ({panel.entity}, {panel.snapshot}) pairs occur more than once"
        )
