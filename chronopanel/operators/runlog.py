"""Timings out of run logs.

Jobs write marker lines such as ``002__MEASURE__ START(reading csv): 2018-04-10
10:11:12 1523355072.123`` and, per column, ``2018-04-10 10:11:12| Generating
features for column: AGE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.text import epoch_seconds, last_token, trailing_count
from chronopanel.scale import DEFAULT_LIMITS, Limits, add_neighbour, group_sizes, lookup_join, pin, rank_in_key

# Texts that mark the lines of interest.
MEASURE_MARKER = "__MEASURE__"
FEATURE_MARKER = "| Generating features for column:"
FAILED = "FAILED"


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parse_measures(lines: DataFrame, text: str = "value") -> DataFrame:
    """tag, label, time, failed and the digest line of every marker line; other columns stay.

    tag     text before the first underscore
    time    last blank-separated token, seconds since 1970
    label   text inside the first parentheses
    failed  whether the message, up to its second colon, says so
    """
    others = [F.col(c) for c in lines.columns if c != text]
    line = _tidy(F.col(text))
    # Text after the first token, up to its second colon.
    message = F.substring_index(F.regexp_extract(line, r"^\S+ (.*)$", 1), ":", 2)
    return lines.where(F.col(text).contains(MEASURE_MARKER)).select(
        *others,
        F.substring_index(line, "_", 1).alias("tag"),
        F.regexp_extract(message, r"\(([^)]*)", 1).alias("label"),
        last_token(line).try_cast("decimal(20,9)").alias("time"),
        message.contains(FAILED).alias("failed"),
        message.alias("message"),
    )


def pair_measures(measures: DataFrame, run: list[str] | None = None, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """START and STOP of each tag: label, tag, n, started, stopped, seconds.

    The lines of a tag in time order form pairs.  A failed step has 0 seconds; a
    start without a stop has null.
    """
    key = [*(run or []), "tag"]
    order = [F.col("time"), F.col("message")]
    ranked = rank_in_key(measures, key, order, "rank", unique=False, limits=limits)
    opens = F.col("rank") % 2 == 0

    def first(column: str) -> Column:
        return F.max(F.when(opens, F.col(column)))

    def second(column: str) -> Column:
        return F.max(F.when(~opens, F.col(column)))

    pairs = ranked.groupBy(*key, F.floor(F.col("rank") / 2).alias("pair")).agg(
        first("label").alias("label"),
        first("time").alias("started"),
        second("time").alias("stopped"),
        second("failed").alias("failed"),
    )
    seconds = F.when(F.col("failed"), F.lit(0)).otherwise(F.col("stopped") - F.col("started"))
    return pairs.select(
        *(run or []), "label", "tag", trailing_count(F.col("label")).alias("n"), "started", "stopped", seconds.alias("seconds")
    )


def parse_feature_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """time and label of every line that reports the start of a column; other columns stay."""
    others = [F.col(c) for c in lines.columns if c != text]
    parts = F.split(F.col(text), r"\|")
    return lines.where(F.col(text).contains(FEATURE_MARKER)).select(
        *others,
        epoch_seconds(F.trim(F.get(parts, F.lit(0)))).alias("time"),
        _tidy(F.get(F.split(F.get(parts, F.lit(1)), ":"), F.lit(1))).alias("label"),
    )


def gaps_to_next(
    events: DataFrame,
    run: list[str],
    time: str = "time",
    label: str = "label",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Every event with the time until the next one of its run; the last has none and is dropped."""
    out = add_neighbour(events, run, [F.col(time), F.col(label)], {"next_time": time}, 1, limits)
    return out.where(F.col("next_time").isNotNull())


def label_index(events: DataFrame, time: str = "time", label: str = "label", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """label, first_time and idx: 1, 2, 3, ... in order of first appearance."""
    firsts = events.groupBy(label).agg(F.min(time).alias("first_time"))
    ranked = rank_in_key(firsts, [], [F.col("first_time"), F.col(label)], "rank", unique=True, limits=limits)
    return ranked.select(label, "first_time", (F.col("rank") + 1).alias("idx"))


def feature_timings(events: DataFrame, run: list[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """idx, seconds and label per generated column."""
    gaps = pin(gaps_to_next(events, run, limits=limits))
    sizes = group_sizes(gaps, F.col("label"))
    weights = gaps.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
    index = label_index(gaps, limits=limits).drop("first_time").join(weights, "label")
    return lookup_join(gaps, index, ["label"], sizes, "weight", [*run, "time"], limits).select(
        *run, "idx", (F.col("next_time") - F.col("time")).alias("seconds"), "label"
    )


def submit_options(scripts: DataFrame, text: str = "value") -> DataFrame:
    """key and value of the options in the active submit configuration of each script.

    ``scripts`` holds one whole script per row (``spark.read.text(..., wholetext=True)``);
    ``SUBMIT_CONFIG=$NAME`` says which ``NAME="--key value ..."`` block is active.
    """
    others = [F.col(c) for c in scripts.columns if c != text]
    name = F.regexp_extract(F.col(text), r"SUBMIT_CONFIG=\$(\w+)", 1)
    block = F.call_function("regexp_extract", F.col(text), F.concat(name, F.lit('="([^"]*)"')), F.lit(1))
    return options_of(scripts.select(*others, F.when(name != "", block).alias(text)), text)


def options_of(lines: DataFrame, text: str = "value") -> DataFrame:
    """key and value of every ``--key=value`` or ``--key value`` in each line."""
    others = [F.col(c) for c in lines.columns if c != text]
    pieces = F.slice(F.split(F.regexp_replace(F.col(text), r"\\", ""), "--"), 2, 2**31 - 1)
    option = _tidy(F.translate(F.col("option"), "=", " "))
    return lines.select(*others, F.explode(pieces).alias("option")).select(
        *[F.col(c) for c in lines.columns if c != text],
        F.substring_index(option, " ", 1).alias("key"),
        F.regexp_extract(option, r"^\S+ (.*)$", 1).alias("value"),
    )
