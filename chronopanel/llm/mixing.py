"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import WORD, text_or_empty, write_new

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Ranges a source's sampling keys are divided into, twice in a row.
SPLIT = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Sampling weight of a document: one whose mean word length is odd (markup, tables, junk) counts half."""
    return F.when(F.length(text).between(3 * size, 12 * size), F.lit(1.0)).otherwise(F.lit(0.5))


def sampling_key(id_: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential variate with rate ``weight``, a function of id and seed only; small keys are drawn first."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))
    return -F.log(uniform) / weight


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to (source, source_size): ``share`` x all words by weight, at most ``most`` x a source.

    What a full source leaves is shared by weight among the others until none is above.
    In the order of size over weight the full sources come first, so one running
    sum over the sources finds them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cap = most * F.col("source_size")
    budget = share * F.sum("source_size").over(everything)
    left = budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = cap * open_weight <= left * F.col("weight")
    found = sizes.withColumn("weight", weight).select("*", cap.alias("cap"), budget.alias("budget"), full.alias("full"))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    rest = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    even = F.col("weight") * (F.col("budget") - spent) / F.when(rest > 0, rest)
    return found.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(even)).drop("cap", "budget", "full")


def mixed(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__times``, how often the mix takes a row.

    A source with a target of at least its size is taken in complete epochs; the rest
    of its target is filled by its documents in the order of their sampling keys, up
    to the document whose end lies nearest to the target.  Rows that repeat an id have
    one key and are taken or left together.  Null texts and texts without words have
    size 0; null sources are one source; ids may be null.  No rows give no rows.

    No source is ever sorted: its keys fall into 4096 ranges whose sums say in which
    range the draw ends, that range is divided once more, and only the rows of
    the last range (a 16-millionth of the source) are put in order.
    """
    text = text_or_empty(text_col)
    size = word_count(text)
    source, id_ = F.col(source_col), F.col(id_col)
    s = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))  # never null
    key = sampling_key(id_, quality(text, size))
    place = F.floor((1 - F.exp(-F.col("key"))) * F.lit(float(SPLIT * SPLIT))).cast("long")
    _, thin = write_new(
        docs.select(s.alias("s"), source.alias("source"), id_.alias("id"), size.alias("size"), key.alias("key")).withColumn("place", place),
        "mix",
    )
    sizes = thin.groupBy("s").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    _, sources = write_new(
        source_targets(sizes, share, most)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "mix",
    )
    high, low = F.floor(F.col("place") / SPLIT), F.pmod("place", F.lit(SPLIT))
    first = _range_of_end(thin.withColumn("r", high), sources.select("s", "rest"))
    inside = thin.withColumn("r", high).join(first, ["s", "r"]).withColumn("r", low)
    second = _range_of_end(inside, first.select("s", "rest"))
    last = inside.drop("rest").join(second, ["s", "r"])
    # Equal (key, id) are summed first, so that they are taken or left together.
    units = last.groupBy("s", "place", "key", "id", "rest").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("s").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = units.withColumn("upto", F.sum("size").over(order))
    end = upto.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("s").agg(
        F.max(F.struct("place", "key", F.col("id").isNotNull().alias("has"), "id")).alias("end")
    )
    whole = second.join(first.select("s", F.col("r").alias("q")), "s").select("s", (F.col("q") * SPLIT + F.col("r")).alias("stop"))
    _, rule = write_new(sources.join(whole, "s", "left").join(end, "s", "left"), "mix")
    with_rule = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), s.alias("s"), size.alias("__size"), id_.alias("id"), key.alias("key")
    ).withColumn("place", place)
    here = F.struct("place", "key", F.col("id").isNotNull().alias("has"), "id")
    drawn = (F.col("place") < F.col("stop")) | F.coalesce(here <= F.col("end"), F.lit(False))
    times = F.col("epochs") + F.when((F.col("rest") > 0) & drawn, 1).otherwise(0)
    return with_rule.join(rule.drop("source"), "s").select(
        "__doc.*", "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), times.alias("__times")
    )


def _range_of_end(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(s, r, rest): per source the range in which its running size passes ``rest``, and what is left there."""
    sums = rows.groupBy("s", "r").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sums.withColumn("upto", F.sum("n").over(order)).join(rest, "s")
    inside = (F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("rest") < F.col("upto"))
    found = upto.where(inside).select("s", "r", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
    return write_new(found, "mix")[1]


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows the mix takes, as often as it takes them, with the columns of ``docs``."""
    plain = docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])  # names that cannot clash with the added ones
    place = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    columns = {name: place[options.pop(name, default)] for name, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    taken = mixed(plain, **columns, **options).where("__times > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*plain.columns).toDF(*docs.columns)
