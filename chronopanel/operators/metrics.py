"""Tables behind the profiler's charts: step curves, metric groups, aligned series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.asof import latest_mark
from chronopanel.scale import DEFAULT_LIMITS, Limits, add_neighbour, group_sizes, lookup_join

# Keys left out, and the group of keys with fewer than two name parts.
EXCLUDED_PREFIX = "cpu.trace"
OTHER_GROUP = "other.other"


def milliseconds(nanoseconds: Column) -> Column:
    """Whole milliseconds of a time in nanoseconds."""
    return F.call_function("div", nanoseconds, F.lit(1_000_000))


def step_curve(
    samples: DataFrame,
    keys: list[str] | None = None,
    time: str = "time",
    value: str = "heartbeat",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Points (x, part, y) of the step curve through samples at nanosecond times.

    Every sample gives part 0 (x, previous value) if there is one, part 1 (x, 0)
    and part 2 (x, value); x is in seconds since the first sample of the key.
    """
    keys = keys or []
    ms = samples.select(*keys, F.col(time).alias("ns"), milliseconds(F.col(time)).alias("ms"), F.col(value).alias("y"))
    curve = add_neighbour(ms, keys, [F.col("ns"), F.col("y")], {"before": "y"}, -1, limits)
    first = ms.groupBy(*keys).agg(F.min("ms").alias("origin"), F.count(F.lit(1)).alias("weight"))
    if keys:
        sizes = group_sizes(ms, *[F.col(k) for k in keys])
        curve = lookup_join(curve, first, keys, sizes, "weight", ["ns"], limits)
        origin = F.col("origin")
    else:
        origin = F.lit(first.first()["origin"])
    points = F.array(
        F.struct(F.lit(0).alias("part"), F.col("before").alias("y")),
        F.struct(F.lit(1).alias("part"), F.lit(0).cast(samples.schema[value].dataType).alias("y")),
        F.struct(F.lit(2).alias("part"), F.col("y")),
    )
    return (
        curve.select(*keys, "ns", ((F.col("ms") - origin) / 1000.0).alias("x"), F.explode(points).alias("p"))
        .select(*keys, "ns", "x", "p.part", "p.y")
        .where((F.col("part") > 0) | F.col("y").isNotNull())
    )


def metric_name(key: Column) -> Column:
    """Key without its tags: text before the first comma."""
    return F.substring_index(key, ",", 1)


def metric_pid(key: Column) -> Column:
    """Value of the key's pid tag, empty if it has none."""
    return F.regexp_extract(key, r"pid=([^,]*)", 1)


def metric_group(key: Column) -> Column:
    """First two dotted parts of the name, or the group of the others."""
    name = metric_name(key)
    return F.when(F.size(F.split(name, r"\.")) >= 2, F.substring_index(name, ".", 2)).otherwise(F.lit(OTHER_GROUP))


def metric_groups(metrics: DataFrame, key: str = "key") -> DataFrame:
    """group, key, name, pid: one row per distinct key, stack-trace keys left out."""
    kept = metrics.where(~F.col(key).startswith(EXCLUDED_PREFIX)).select(F.col(key).alias("key")).distinct()
    k = F.col("key")
    return kept.select(metric_group(k).alias("group"), "key", metric_name(k).alias("name"), metric_pid(k).alias("pid"))


def aligned_series(metrics: DataFrame, heartbeats: DataFrame, key: str = "key", heartbeat_time: str = "time") -> DataFrame:
    """group, series, x, value: metric values at seconds since the first heartbeat.

    ``metrics`` has the key, ``epoch_ms`` and ``value``.  The origin is one number.
    """
    origin = heartbeats.agg(F.min(milliseconds(F.col(heartbeat_time))).alias("o")).first()["o"]
    k = F.col(key)
    return metrics.where(~k.startswith(EXCLUDED_PREFIX)).select(
        metric_group(k).alias("group"),
        F.concat_ws(".", metric_name(k), metric_pid(k)).alias("series"),
        ((F.col("epoch_ms") - F.lit(origin)) / 1000.0).alias("x"),
        "value",
    )


def run_origins(heartbeats: DataFrame, run: str = "run", time: str = "time", keys: list[str] | None = None) -> DataFrame:
    """keys, run and origin (milliseconds): the first heartbeat of every run."""
    keys = keys or []
    return heartbeats.groupBy(*keys, run).agg(F.min(milliseconds(F.col(time))).alias("origin"))


def run_series(
    metrics: DataFrame, origins: DataFrame, keys: list[str] | None = None, key: str = "key", run: str = "run", limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """group, series, run, x, value: metric values at seconds since the start of the run they fall into.

    ``metrics`` has the key, ``epoch_ms`` and ``value`` and does not know the runs: a sample belongs to the latest run of
    ``origins`` (of the same ``keys``) that has begun.  Samples before any run have neither run nor x.
    """
    keys = keys or []
    k = F.col(key)
    kept = metrics.where(~k.startswith(EXCLUDED_PREFIX)).select(*keys, key, "epoch_ms", "value")
    starts = origins.select(*keys, F.col("origin").alias("epoch_ms"), "origin", run)
    found = latest_mark(kept, starts, keys, "epoch_ms", ["origin", run], limits)
    return found.select(
        *keys,
        metric_group(k).alias("group"),
        F.concat_ws(".", metric_name(k), metric_pid(k)).alias("series"),
        run,
        ((F.col("epoch_ms") - F.col("origin")) / 1000.0).alias("x"),
        "value",
    )
