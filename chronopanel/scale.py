"""Building blocks that keep every task's share of the data bounded.

Three situations recur in panel work and each has one answer here:

* a table is looked up by key: ``lookup_join`` broadcasts it only if its row count
  is known and small, and otherwise spreads the rows of hot keys;
* rows of one key must be ordered but one key may hold a third of the table:
  ``cut_points`` and ``place_among`` divide the key's value range into pieces of
  bounded size;
* rows need a dense position in a total order: ``global_position``.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from math import ceil
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.panel import Panel, quoted


@dataclass(frozen=True)
class Limits:
    """Size bounds; the defaults suit executors with a few GB per core.

    rows_per_group    rows one task should order or one key may hold before it is spread,
                      whatever the size of the table
    broadcast_cells   rows x columns up to which a table is broadcast
    """

    rows_per_group: int = 1_000_000
    broadcast_cells: int = 4_000_000

    def pieces(self, largest: int) -> int:
        """Pieces of a key of that many rows."""
        return max(2, ceil(largest / self.rows_per_group))


DEFAULT_LIMITS = Limits()


@dataclass(frozen=True)
class GroupSizes:
    """Row count, number of groups and size of the largest group."""

    rows: int
    groups: int
    largest: int


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the wide plans profit from; results do not depend on them.

    The first lets a join on (entity, snapshot) and the window by entity share one
    shuffle by entity.  It is safe against skew here because the shuffle key of a
    hot entity also holds its time slice (see ``operators.history``).  The second
    keeps the JVM compiling: it interprets methods above 8000 bytes of code, which
    a fused stage with dozens of feature expressions exceeds; Spark then generates
    the projections split into small methods instead.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors can reach."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="chronopanel-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a checkpoint; row order and partitions stay as they are.

    Lost executors then cost a re-read, and a table that later plans read twice
    (cut points, positions) is the same both times.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{kind}-{uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as Parquet in the shared folder.

    For tables that several plans read with different columns, such as a panel
    derived by an aggregation: each scan then reads just its columns.
    """
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_sizes(df: DataFrame, *keys: Column) -> GroupSizes:
    """Sizes of the groups of ``keys``; reads only the key columns."""
    counts = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest")).first()
    return GroupSizes(found["rows"] or 0, found["groups"], found["largest"] or 0)


def small_enough(table: DataFrame, rows: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """``table`` marked for broadcast if its known row count allows it, else as it is."""
    return F.broadcast(table) if rows * len(table.columns) <= limits.broadcast_cells else table


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    sizes: GroupSizes,
    weight: str,
    spread_by: list[str],
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one row per value of ``on``.

    ``sizes`` describes the groups of ``rows`` by ``on``; ``weight`` is the column of
    ``table`` with a group's row count and does not come out.  A small table is
    broadcast.  Otherwise both sides are shuffled by key, and a hot key is spread: its
    table row is repeated once per ``rows_per_group`` rows, and its rows choose among the
    repeats by a hash of ``spread_by``.  The list of hot keys is broadcast if its count allows.
    """
    limit = limits.rows_per_group
    if sizes.groups * len(table.columns) <= limits.broadcast_cells:
        return rows.join(F.broadcast(table.drop(weight)), on, "left")
    if sizes.largest <= limit:
        return rows.join(table.drop(weight), on, "left")
    parts = F.ceil(F.col(weight) / limit).cast("int")
    hot = pin(table.where(F.col(weight) > limit).select(*on, parts.alias("__parts")))
    part = F.pmod(F.xxhash64(*[quoted(c) for c in spread_by]), F.coalesce("__parts", F.lit(1))).cast("int")
    spread = rows.join(small_enough(hot, hot.count(), limits), on, "left").withColumn("__part", part).drop("__parts")
    repeats = table.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(weight)
    return spread.join(repeats, [*on, "__part"], "left").drop("__part")


def cut_points(df: DataFrame, keys: list[str], value: str, hot: DataFrame, pieces: int) -> DataFrame:
    """Cut points of ``value`` for every key in ``hot`` (columns: keys, ``__n``).

    One row per key with ``__cuts``, a sorted array of distinct values; a key with
    fewer rows keeps fewer cuts.  The cuts only steer how work is divided, results
    never depend on them.  Pinned, because two plans must see the same cuts.
    """
    largest = hot.agg(F.max("__n")).first()[0] or 1
    share = [i / pieces for i in range(1, pieces)]
    every = F.greatest(F.lit(1), F.floor(F.lit(largest) / F.col("__n")))
    return pin(
        df.join(F.broadcast(hot), keys)
        .groupBy(*keys, "__n")
        .agg(F.percentile_approx(value, share, F.lit(10 * pieces)).alias("__cuts"))
        .select(
            *keys,
            F.array_sort(F.array_distinct(F.filter("__cuts", lambda c, i: F.pmod(i + 1, every) == 0))).alias("__cuts"),
        )
    )


def place_among(df: DataFrame, value: Column, cuts: str, pieces: int, out: str) -> DataFrame:
    """Add ``out`` = number of array elements below ``value`` (binary search).

    A chain of generated projections: no Python, no higher-order function, about
    log2(pieces) comparisons per row.  A null array gives 0.
    """
    df = df.withColumn(out, F.lit(0))
    for bit in reversed(range(pieces.bit_length())):
        step = 1 << bit
        probe = F.get(F.col(cuts), F.col(out) + F.lit(step - 1))
        df = df.withColumn(out, F.col(out) + F.when(probe < value, F.lit(step)).otherwise(F.lit(0)))
    return df


def global_position(df: DataFrame, order: list[Column], unique: bool, out: str = "__pos") -> DataFrame:
    """Add ``out``, the 0-based dense position of every row in a total order.

    A range-partitioned sort, written to the checkpoint folder so that the layout
    is fixed; a row's position is the number of rows in earlier partitions plus
    its place in its own.  If rows can tie on ``order`` (``unique=False``), a
    random last key spreads them, so even a third of the table being one repeated
    row does not pile up.  The random key is pinned before the sort reads it: a
    shuffle on a value that a retried task would draw anew can lose rows.
    """
    if not unique:
        df = pin(df.withColumn("__tie", F.rand()))
        order = [*order, F.col("__tie")]
    ordered = pin(df.orderBy(*order))
    if not unique:
        ordered = ordered.drop("__tie")
    placed = ordered.withColumn("__mid", F.monotonically_increasing_id())
    part = F.shiftright("__mid", 33).alias("__part")
    sizes = placed.select(part).groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # One row per partition of the sort: a few thousand at most.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(out, F.col("__start") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__start", "__mid")
    )


def entity_column(panel: Panel) -> Column:
    return F.col(quoted(panel.entity))


def snapshot_column(panel: Panel) -> Column:
    return F.col(quoted(panel.snapshot))


def rank_in_key(
    df: DataFrame, keys: list[str], order: list[Column], out: str, unique: bool, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Add ``out``, the 0-based place of a row among the rows of its key.

    A window while every key is small enough for one task; otherwise, and without
    keys, positions in one distributed sort, minus the position at which the key starts.
    """
    if not keys:
        return global_position(df, order, unique, out)
    sizes = group_sizes(df, *[F.col(quoted(k)) for k in keys])
    if sizes.largest <= limits.rows_per_group:
        line = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(line) - 1).cast("long"))
    columns = df.columns
    placed = global_position(df, [*[F.col(quoted(k)) for k in keys], *order], unique)
    starts = placed.groupBy(*[quoted(k) for k in keys]).agg(
        F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__weight")
    )
    joined = lookup_join(placed, starts, keys, sizes, "__weight", ["__pos"], limits)
    return joined.select(*[quoted(c) for c in columns], (F.col("__pos") - F.col("__first")).alias(out))


def add_neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    values: dict[str, str],
    step: int,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add ``{output: column}`` taken from the next (step 1) or previous (step -1) row of the key.

    For a hot key, and always without keys, the rows get dense positions; blocks of equally many
    positions are windows of their own, and the row just across a border is copied over it.
    """
    if step not in (1, -1):
        raise ValueError("step is 1 or -1")
    key_columns = [F.col(quoted(k)) for k in keys]
    block = limits.rows_per_group
    columns = df.columns
    group, copied = list(key_columns), None
    if not keys or group_sizes(df, *key_columns).largest > block:
        placed = global_position(df, [*key_columns, *order], unique=False)
        home = F.floor(F.col("__pos") / block)
        at_border = F.col("__pos") % block == (0 if step == 1 else block - 1)
        both = F.when(at_border, F.array(home, home - step)).otherwise(F.array(home))
        df = placed.withColumn("__block", F.explode(both))
        copied = F.col("__block") != home
        group.append(F.col("__block"))
        order = [F.col("__pos")]
    line = Window.partitionBy(*group).orderBy(*order)
    near = F.lead if step == 1 else F.lag
    out = df.select("*", *[near(F.col(quoted(c))).over(line).alias(o) for o, c in values.items()])
    if copied is not None:
        out = out.where(~copied)
    return out.select(*[quoted(c) for c in columns], *[quoted(o) for o in values])
