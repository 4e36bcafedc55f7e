"""A stored feature table that grows by new snapshots without reading the old ones.

Ranks and distances of a row need only its own snapshot; histories reach back a fixed
number of rows.  So next to the features, one folder per snapshot, a tail is kept: of every entity the last
rows (six for the shipped recipes) with the inputs of its history features.  Appending reads the new
snapshots and the tail, writes the new snapshots' folders (dynamic partition overwrite) and the next tail.

Tails are folders named by the latest snapshot they cover, and an append starts from the latest
tail before its own rows.  So an append that failed, at whatever step, or that is done again with corrected rows,
gives the same table as one that ran through the first time.  Tails that are no longer needed may be deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.panel import Panel, quoted
from chronopanel.plans.generate import generate_features
from chronopanel.plans.spec import KEEP, Controller, Recipe, Step, steps_for
from chronopanel.scale import DEFAULT_LIMITS, Limits, stored

COVERED = "__covered"


@dataclass(frozen=True)
class FeatureStore:
    """Features of one panel under ``path``; the recipes stay the same from one append to the next."""

    spark: SparkSession
    path: str
    panel: Panel
    controller: Controller
    unlisted: Recipe | None = None
    limits: Limits = DEFAULT_LIMITS

    def features(self) -> DataFrame:
        """The whole feature table."""
        return self.spark.read.parquet(f"{self.path}/features")

    def append(self, df: DataFrame) -> None:
        """Add the snapshots of ``df``, all of them whole; the first append begins the store.

        They must be later than any snapshot before them that is to precede them in the histories.
        ``df`` is read several times, so give a stored table.  An empty ``df`` changes nothing.
        """
        t = F.col(quoted(self.panel.snapshot))
        first, last = df.agg(F.min(t), F.max(t)).first()
        if last is None:
            return
        tail = self._tail_before(first)
        wide = stored(self._generated(df, tail))
        columns = self.panel.value_columns(df)
        rows = wide.select(*self.panel.keys, *self._sources(columns))
        self._write(wide, "features", self.panel.snapshot)
        kept = rows if tail is None else rows.unionByName(tail)
        newest = Window.partitionBy(quoted(self.panel.entity)).orderBy(t.desc())
        kept = kept.withColumn("__place", F.row_number().over(newest)).where(F.col("__place") <= self._reach(columns)).drop("__place")
        self._write(kept.withColumn(COVERED, F.lit(last)), "tails", COVERED)

    def _generated(self, df: DataFrame, tail: DataFrame | None) -> DataFrame:
        return generate_features(df, self.panel, self.controller, self.unlisted, self.limits, earlier_rows=tail)

    def _write(self, df: DataFrame, folder: str, by: str) -> None:
        writer = df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(by).parquet(f"{self.path}/{folder}")

    def _tail_before(self, snapshot: object) -> DataFrame | None:
        """The latest tail that covers only earlier snapshots; reads the names of the folders, then that one."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tails")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return None
        tails = self.spark.read.parquet(f"{self.path}/tails")
        latest = tails.where(F.col(COVERED) < F.lit(snapshot)).agg(F.max(COVERED)).first()[0]
        if latest is None:
            return None
        return tails.where(F.col(COVERED) == F.lit(latest)).drop(COVERED)

    def _steps(self, columns: list[str]) -> list[Step]:
        steps = [s for c in columns for s in steps_for(c, self.controller.get(c, self.unlisted or KEEP))]
        return [s for s in steps if s.operator.kind == "history"]

    def _sources(self, columns: list[str]) -> list[str]:
        """Inputs of history features, plain or derived."""
        return list(dict.fromkeys(s.source for s in self._steps(columns)))

    def _reach(self, columns: list[str]) -> int:
        return max((k for s in self._steps(columns) for k in s.operator.offsets), default=1)
