"""What several operators of this subpackage share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.scale import new_path, stored

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Tasks import it, and only the driver need have it on its path.
    """
    context = spark.sparkContext
    if getattr(context, "_chronopanel_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="chronopanel-")  # the driver serves the file from here while it lives
    context.addPyFile(shutil.make_archive(f"{folder}/chronopanel-{context.applicationId}", "zip", package.parent, package.name))
    context._chronopanel_shipped = True


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions from an iterator of column dicts to an iterator of column dicts.

    Every input dict is one Arrow batch as Python lists, every output dict one batch
    of equally long lists, so a task holds one batch at a time.
    """
    kind = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)
        for out in rows(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the tasks; a worker gives back what its task's batches held."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    ship(df.sparkSession)
    return df.mapInArrow(released, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote under the shared folder, through Spark's file systems."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_new(df: DataFrame, kind: str, partition_by: str | None = None, **options: str) -> tuple[str, DataFrame]:
    """Write ``df`` as Parquet in the shared folder; its path and the table read back."""
    path = new_path(df.sparkSession, kind)
    df.write.options(**options).parquet(path, partitionBy=partition_by, compression="zstd")
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


class Remembered:
    """What was found for the latest strings: two generations, so that filling up forgets the older half only."""

    def __init__(self, size: int):
        self.half, self.young, self.old = size // 2, {}, {}

    def again(self, key: str):
        """What was found for a string that is not among the young; None if it is unknown."""
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key: str, found) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = found


class Scratch:
    """Tables between the steps of an operator, in the shared folder until ``close``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, kind: str, partition_by: str | None = None, **options: str) -> DataFrame:
        path, table = write_new(df, kind, partition_by, **options)
        self.paths.append(path)
        return table

    def close(self) -> None:
        """Delete the tables; call it once nothing that is still lazy reads them."""
        while self.paths:
            discard(self.spark, self.paths.pop())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long), component the smallest node reachable.

    Alternating large-star and small-star steps: each is a grouped minimum with
    map-side partials and an equi-join whose skewed keys Spark splits, so neither a
    node with millions of links nor a large component meets in one task.  Every round
    is a table in the shared folder; a lost executor costs a re-read.  Only a
    row count and a checksum reach the driver.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _state(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Tables of their own, so that Spark can split the rows of a hot node in both joins.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        root = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(root, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pairs = stored(small)
        now = _state(pairs)
        if now == seen:
            found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stored(found.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        seen = now


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
