"""Row-wise operators: rank buckets, normal scores, tail flags."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chronopanel.functions.buckets import QUARTER_BORDERS, TENTH_BORDERS, above, interval_index
from chronopanel.functions.normal import normal_quantile, tail_distance
from chronopanel.panel import named, quoted

# Distance from the centre, in standard deviations, that counts as a tail.
TAIL_THRESHOLDS = (2, 3)


def bucket_columns(name: str) -> dict[str, str]:
    return {
        f"B4_{name}": interval_index(quoted(name), QUARTER_BORDERS),
        f"B10_{name}": interval_index(quoted(name), TENTH_BORDERS),
    }


def tail_flag_columns(name: str) -> dict[str, str]:
    up = {f"{k}SDU_{name}": above(quoted(name), k) for k in TAIL_THRESHOLDS}
    down = {f"{k}SDD_{name}": above(f"(-{quoted(name)})", k) for k in TAIL_THRESHOLDS}
    return {**up, **down}


def add_normal_scores(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Add ``{output: column}`` standard normal quantiles.

    Two projections: the first holds the logarithms, so that each is taken once.
    """
    tails = {c: f"__tail_{c}" for c in dict.fromkeys(scores.values())}
    inner = df.selectExpr("*", *named({t: tail_distance(quoted(c)) for c, t in tails.items()}))
    quantiles = {out: normal_quantile(quoted(c), quoted(tails[c])) for out, c in scores.items()}
    return inner.selectExpr("*", *named(quantiles)).drop(*tails.values())
