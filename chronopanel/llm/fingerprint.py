"""Document fingerprints: homomorphic multiset hash over paragraphs.

A fingerprint is a vector of sums.  Every paragraph (cut at line breaks and sentence
ends) hashes to a wide vector, and the vectors of a text are added coordinate by
coordinate modulo a power of two, so the order of paragraphs does not matter and a
paragraph can be added or taken out without the text.  The coordinates are

* one count of paragraphs and four dense ones modulo 2^60, which decide equality;
* ``LEVELS`` x ``LANES`` sparse ones modulo 2^16.  A paragraph enters level l with
  probability 4^-l and touches one lane there.  Of two fingerprints the share of equal
  lanes gives the number of paragraphs in which they differ: level 0 serves
  short texts, the higher ones texts of up to some 100,000 paragraphs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import text_or_empty
from chronopanel.scale import global_position

DENSE, LEVELS, LANES = 5, 7, 32
WIDE, NARROW = (1 << 60) - 1, (1 << 16) - 1
PARAGRAPH_END = r"[\r\n]+|(?<=[.!?])[ \t]+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH_END), lambda p: p != "")


def vector(text: Column) -> Column:
    """The fingerprint of a text as array<bigint>; null counts as empty."""
    hashes = F.transform(paragraphs(text_or_empty(text)), lambda p: F.struct(F.xxhash64(p).alias("h"), F.xxhash64(F.lit(7), p).alias("g")))
    zero = F.array_repeat(F.lit(0).cast("bigint"), DENSE)
    masked = lambda *of: F.xxhash64(*of).bitwiseAND(F.lit(WIDE))
    dense = F.aggregate(
        hashes,
        zero,
        lambda sums, p: F.array(
            sums[0] + 1,
            *[(sums[i] + masked(p["h"] if i % 2 else p["g"], F.lit(i))).bitwiseAND(F.lit(WIDE)) for i in range(1, DENSE)],
        ),
    )
    entries = F.flatten(
        F.transform(
            hashes,
            lambda p: F.transform(
                # The level a paragraph reaches: one more for every further pair of zero bits.
                F.sequence(
                    F.lit(0),
                    reduce(
                        lambda rest, level: F.when(p["g"].bitwiseAND(F.lit(4**level - 1)) == 0, F.lit(level)).otherwise(rest),
                        range(1, LEVELS),
                        F.lit(0),
                    ),
                ),
                lambda level: F.struct(
                    (level * LANES + F.pmod(p["h"], F.lit(LANES)).cast("int")).alias("lane"),
                    (F.shiftrightunsigned(p["h"], 20).bitwiseAND(F.lit(NARROW - 1)) + 1).alias("add"),
                ),
            ),
        )
    )
    none = F.array_repeat(F.lit(0).cast("bigint"), LEVELS * LANES)
    sparse = F.aggregate(
        entries,
        none,
        lambda sums, e: F.concat(
            F.slice(sums, F.lit(1), e["lane"]),
            F.array((F.get(sums, e["lane"]) + e["add"]).bitwiseAND(F.lit(NARROW))),
            F.slice(sums, e["lane"] + 2, F.lit(LEVELS * LANES)),
        ),
    )
    return F.concat(dense, sparse)


def _moduli() -> Column:
    return F.concat(F.array_repeat(F.lit(WIDE), DENSE), F.array_repeat(F.lit(NARROW), LEVELS * LANES).cast("array<bigint>"))


def inserted(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both: insertion."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), _moduli(), lambda x, m: x.bitwiseAND(m))


def deleted(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``: deletion."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x - y), _moduli(), lambda x, m: x.bitwiseAND(m))


def written(v: Column) -> Column:
    """A fingerprint as text: 15 hexadecimal digits per dense and 4 per sparse coordinate."""
    digits = lambda part, n: F.array_join(F.transform(part, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(digits(F.slice(v, 1, DENSE), 15), digits(F.slice(v, DENSE + 1, LEVELS * LANES), 4)))


def likeness(a: Column, b: Column) -> Column:
    """Share of paragraphs two texts have in common, 0 to 1, from their fingerprints alone.

    Level l has about D / 4^l of the D paragraphs that differ, on 32 lanes; if a share e
    of its lanes is equal, D is about -32 x 4^l x ln(e).  The lowest level with enough
    equal lanes decides.  Equal fingerprints, those of two empty texts too, give 1.
    """
    total = F.get(a, F.lit(0)) + F.get(b, F.lit(0))
    same = F.zip_with(F.slice(a, DENSE + 1, LEVELS * LANES), F.slice(b, DENSE + 1, LEVELS * LANES), lambda x, y: F.when(x == y, 1).otherwise(0))
    estimates = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda level: F.aggregate(F.slice(same, level * LANES + 1, F.lit(LANES)), F.lit(0), lambda n, x: n + x),
    )
    usable = F.transform(
        estimates,
        lambda n, level: F.when(
            (n >= LANES // 3) | (level == LEVELS - 1), -LANES * F.pow(F.lit(4.0), level) * F.log(F.greatest(n, F.lit(0.5)) / LANES)
        ),
    )
    differing = F.get(F.filter(usable, lambda d: d.isNotNull()), F.lit(0))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - differing / total)))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last third (floor(n_chars / 3) code points) replaced by the
    first as many code points of the next document in descending id order; the last
    document's next is the first.  Null texts count as empty.  Rows that repeat an id
    are one place in that order, each row is edited on its own, and the smallest of
    their texts' beginnings serves their predecessor; a null id comes last.  An empty table
    gives an empty one.  Columns: id, n_chars, edited, vectors ``v``, ``ve``, ``vn``.

    Only ids and lengths are sorted.  The next texts' beginnings travel by an equi-join
    on the id; both joins read one shuffle of the texts.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sizes = texts.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    placed = global_position(sizes, [F.col("id").desc_nulls_last()], unique=True)
    count = placed.count()
    here = placed.select(F.col("id").alias("of"), F.floor(F.col("n") / 3).cast("int").alias("most"), F.pmod(F.col("__pos") + 1, F.lit(max(1, count))).alias("__pos"))
    asked = here.join(placed.select("id", "__pos"), "__pos").drop("__pos")
    given = (
        asked.join(texts, asked.id.eqNullSafe(texts.id))
        .select("of", F.struct(F.substring("text", F.lit(1), F.col("most")).alias("start"), vector(F.col("text")).alias("vn")).alias("next"))
        .groupBy("of")
        .agg(F.min("next").alias("next"))
    )
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    both = texts.join(given, texts.id.eqNullSafe(given.of))
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next.start", F.lit(1), third))
    return both.select("id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("next.vn").alias("vn")).select(
        "id", "n_chars", "edited", vector(F.col("text")).alias("v"), vector(F.col("edited")).alias("ve"), "vn"
    )
