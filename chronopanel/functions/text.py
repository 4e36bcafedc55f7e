"""Text and time helpers for row keys and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(*columns: Column) -> Column:
    """SHA-1 hex digest of the column, or of several joined by a unit separator.

    A null among several columns is a zero character, so rows that differ in where
    their nulls are have different digests.
    """
    text = [c.cast("string") for c in columns]
    return F.sha1(text[0] if len(text) == 1 else F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in text]))


def last_token(text: Column) -> Column:
    """Text after the last blank, the whole text if there is none."""
    return F.substring_index(text, " ", -1)


def trailing_count(label: Column) -> Column:
    """The last blank-separated token if it is all digits, else 0."""
    token = last_token(label)
    return F.coalesce(F.when(token.rlike("^[0-9]+$"), token.try_cast("bigint")), F.lit(0).cast("bigint"))


def epoch_seconds(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1970 of a date text in the session time zone, null if unreadable."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(pattern))).cast("double")

