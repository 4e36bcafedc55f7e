"""Exact dedup: groups by a 128-bit content hash, the smallest id stays, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import SPACE, text_or_empty, write_new


def normalised(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__keep_id``, ``__group_size``, ``__kept`` and ``__sha256`` of the normalised text.

    Of the rows whose normalised texts are equal exactly one is kept: that of the
    smallest id, of several such the first stored.  A null text counts as empty; a
    null id comes after all others (``__keep_id`` is null if a group has no id).  An
    empty table gives an empty table; other columns pass through untouched.

    Counting per hash has map-side partials.  The bytes are compared by grouping the
    texts of repeated hashes themselves, again with partials, so a group of any size
    sends one text per task.  Different texts of one hash, should there ever be any,
    become groups of their own.
    """
    id_, text = F.col(id_col), text_or_empty(text_col)
    plain = normalised(text)
    path, rows = write_new(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
            F.struct(id_.isNull().alias("none"), id_.alias("id"), F.monotonically_increasing_id().alias("row")).alias("__order"),
            F.unhex(F.md5(plain.cast("binary"))).alias("__hash"),
            F.sha2(plain.cast("binary"), 256).alias("__sha256"),
        ),
        "exact",
    )
    text = normalised(text_or_empty(F.col(f"__doc.`{text_col}`"))).alias("__text")
    thin = rows.select("__hash", "__order")
    counts = thin.groupBy("__hash").agg(F.count(F.lit(1)).alias("n"))
    # Tables of their own: Spark splits the rows of a hot hash only where a join reads both sides as dealt.
    _, repeated = write_new(counts.where("n > 1").select("__hash"), "repeated")
    texts = rows.select("__hash", text).join(repeated, "__hash", "left_semi").groupBy("__hash", "__text").count()
    _, collided = write_new(texts.groupBy("__hash").count().where("count > 1").select("__hash"), "collided")
    if collided.isEmpty():
        keys = ["__hash"]
    else:  # a text hash beside the content hash would only repeat the doubt: group these by their texts
        rows = rows.join(collided.withColumn("__both", F.lit(True)), "__hash", "left").withColumn(
            "__text", F.when(F.col("__both"), normalised(text_or_empty(F.col(f"__doc.`{text_col}`")))).otherwise(F.lit(""))
        )
        keys = ["__hash", "__text"]
    _, groups = write_new(rows.groupBy(*keys).agg(F.min("__order").alias("__first"), F.count(F.lit(1)).alias("__group_size")), "groups")
    return rows.join(groups, keys).select(
        "__doc.*",
        F.col("__first.id").alias("__keep_id"),
        "__group_size",
        (F.col("__order.row") == F.col("__first.row")).alias("__kept"),
        "__sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    plain = docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])  # names that cannot clash with the marks
    place = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    found = marked(plain, place[id_col], place[text_col])
    return found.where("__kept").select(*plain.columns).toDF(*docs.columns)
