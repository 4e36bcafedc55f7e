"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets form a class first (one 128-bit hash of the set), so
copies never multiply.  A class has one signature of ``BANDS`` x ``ROWS`` minima; bands
of whole minima find candidates, and of every minimum only the low ``BITS`` bits are
kept and packed.  Counting equal groups of bits gives a similarity that is corrected
for chance collisions and drops hopeless candidates; all others are confirmed on the full sets.

Candidates are not all pairs of a bucket.  First every document meets the smallest members (hubs) of its buckets
in six of the bands, which joins most of a group of copies into one component.  Of all 42
bands only the buckets that then hold several components are looked at, and in them only pairs of
different components: each member with the hub, and any others
by their packed signatures in blocks, inside tasks.  A pair that passes the estimate
counts only in the first bucket it shares, and leaves the task in a list with its streamed
row.  The pairs of a block are confirmed together, so a row's text goes there once, and no
link between two different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import Scratch, components, map_batches, map_rows, write_new
from chronopanel.llm.shingles import MinHash, band_keys, shingle_set

ROWS, BANDS, BITS, SEED = 6, 42, 4, 20240
#: Bands whose buckets form the first components.
FIRST = 6
#: Standard deviations of the estimate by which a candidate may miss the threshold.
SLACK = 4.5
#: Rows of a bucket that one block of comparisons holds.
BLOCK = 512
#: Shingles of a bucket that one block holds.
CELLS = 1 << 22
#: Pairs of one hub that are confirmed in one group.
HUB_PAIRS = 64


def pack(minima: np.ndarray) -> bytes:
    """Low 4 bits of every minimum, two to a byte."""
    low = (minima & np.uint64(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def matches(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Per row of ``many`` (packed) the number of 4-bit groups equal to those of ``one``, by bit counts."""
    differing = many ^ one
    differing |= differing >> 2
    differing |= differing >> 1
    return one.shape[-1] * 2 - np.bitwise_count(differing & np.uint8(0x11)).sum(axis=-1, dtype=np.int64)


def estimate(equal: np.ndarray | int, k: int, bits: int = BITS) -> np.ndarray | float:
    """Similarity from equal groups, corrected for those that are equal by chance."""
    chance = 0.5**bits
    return (equal / k - chance) / (1 - chance)


def least_matches(percent: int, k: int, bits: int = BITS, slack: float = SLACK) -> int:
    chance = 0.5**bits
    p = percent / 100 * (1 - chance) + chance
    return int(np.floor(k * p - slack * np.sqrt(k * p * (1 - p))))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n_shingles, digest, bands, packed, prints) per row; the last four are null for an empty set.

    ``prints`` has 32 bits of every band key.
    """
    minhash = MinHash(ROWS * BANDS, SEED)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {"id": b["id"], "n_shingles": [], "digest": [], "bands": [], "packed": [], "prints": []}
            for text in b["text"]:
                own = shingle_set(text, words)
                out["n_shingles"].append(len(own))
                if len(own) == 0:
                    found = (None, None, None, None)
                else:
                    minima = minhash.minima(own)
                    keys = band_keys(minima, ROWS)
                    prints = keys.astype(np.uint32).tobytes()
                    found = (xxhash.xxh3_128_digest(own.tobytes()), keys.view(np.int64).tolist(), pack(minima), prints)
                for name, value in zip(("digest", "bands", "packed", "prints"), found):
                    out[name].append(value)
            yield out

    return map_rows(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
        rows,
        "id long, n_shingles long, digest binary, bands array<long>, packed binary, prints binary",
    )


def confirmed(pairs: DataFrame, blocks: DataFrame | None, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) of the candidates whose full shingle sets are similar enough.

    Candidates are the (hub, id) of ``pairs`` and those of ``blocks`` (see ``block_pairs``).  Either way
    they are groups of held rows, which a task keeps as sets, and of rows that stream past them, each with
    the ids to compare with: a hub is held once for every group of about 64 of its pairs.  The texts are
    shuffled once.  An id with several rows is similar if one of its texts is.
    """
    counts = scratch.write(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("parts")), "pairs")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    spread = scratch.write(pairs.join(counts, "hub").select(F.col("hub").alias("key"), part.alias("block"), "id"), "pairs")
    hubs = spread.select("key", "block").distinct().select("key", "block", F.lit(0), F.col("key"), F.lit(None).cast("array<long>"))
    wanted = spread.select("key", "block", F.lit(1).alias("kind"), "id", F.array("key").alias("others")).union(hubs)
    wanted = wanted.withColumn("from", F.lit(0))
    if blocks is not None:
        wanted = wanted.union(blocks.select("key", "block", "kind", "id", "others", F.lit(1)))
    # A table and a merge join at every size: Spark splits the rows of a hot id.
    wanted = scratch.write(wanted, "pairs")
    group = ("from", "key", "block")
    together = wanted.join(texts.hint("merge"), "id").select(*group, "kind", "id", "others", "text")
    together = together.repartition(*group).sortWithinPartitions(*group, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, {}
        for b in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for *own_group, kind, i, others, text in zip(*(c.to_pylist() for c in b.columns)):
                if at != own_group:
                    at, sets = own_group, {}
                own = shingle_set(text, words)
                if kind == 0:
                    sets.setdefault(i, []).append(own)
                    continue
                for j in others:
                    if any(similar(held, own, percent) for held in sets.get(j, ())):
                        out["a"].append(j)
                        out["b"].append(i)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return map_batches(together, run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 x intersection >= percent x union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def passing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose packed signatures do not rule the similarity out."""
    least = least_matches(percent, ROWS * BANDS)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if b["hub"]:
                one, two = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b["hub"]), -1) for c in ("p", "q"))
                keep = matches(one, two) >= least
                yield {c: [x for x, k in zip(b[c], keep) if k] for c in ("hub", "id")}

    left = nodes.select(F.col("id").alias("hub"), F.col("packed").alias("p"))
    right = nodes.select("id", F.col("packed").alias("q"))
    return map_rows(pairs.join(left, "hub").join(right, "id").select("hub", "id", "p", "q"), rows, "hub long, id long")


def block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within a bucket whose packed signatures may be similar enough, by blocks.

    ``entries``: band, key, id, label, packed, prints, size and weight (rows and shingles of the bucket).  A bucket
    is dealt into blocks of about 512 rows or 4 million shingles.  A task holds one block and streams the rows
    of the blocks from it on past it.  A pair comes out of the first band it shares.

    Gives key, block, kind, id, others: held rows in some pair (kind 0), and streamed rows (kind 1) with the
    ids of their pairs, so a bucket has no more rows here than there, however many pairs it has.
    """
    least = least_matches(percent, ROWS * BANDS)
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / CELLS)).cast("int")
    home = entries.withColumn("home", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rest = ("band", "home", "id", "label", "packed", "prints")
    held = home.select("key", F.col("home").alias("block"), F.lit(0).alias("kind"), *rest)
    shown = home.select("key", F.explode(F.sequence(F.lit(0), "home")).alias("block"), F.lit(1).alias("kind"), *rest)
    dealt = held.union(shown).repartition("key", "block").sortWithinPartitions("key", "block", "kind")
    table = lambda parts, kind: np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)

    kinds = "key long, block int, kind int, id long, others array<long>"
    schema = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("others", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_, ready, used = None, [], None, None
        out: list[tuple] = []

        def close() -> None:
            if ready is not None:
                out.extend((*at, 0, i, None) for i in ready[0][used].tolist())

        def written() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in batches:
            for key, block, kind, band, own, i, label, packed, prints in zip(*(c.to_pylist() for c in b.columns)):
                if at != (key, block):
                    close()
                    at, held_, ready = (key, block), [], None
                if kind == 0:
                    held_.append((i, label, packed, prints))
                    continue
                if not held_:
                    continue
                if ready is None:
                    ids, labels, signs, marks = zip(*held_)
                    ready = np.array(ids), np.array(labels), table(signs, np.uint8), table(marks, np.uint32)
                    used = np.zeros(len(ids), bool)
                # Two rows of one block see each other twice.
                other = ((ready[1] != label) & ((ready[0] > i) | (own != block))).nonzero()[0]
                if len(other):
                    hit = other[matches(np.frombuffer(packed, np.uint8), ready[2][other]) >= least]
                    hit = hit[(ready[3][hit] == np.frombuffer(prints, np.uint32)).argmax(axis=1) == band]
                    if len(hit):
                        used[hit] = True
                        out.append((key, block, 1, i, ready[0][hit].tolist()))
            yield written()
        close()
        yield written()

    return map_batches(dealt, run, kinds)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) for every row: the smallest id reachable over similar documents.

    Two documents are linked if 100 x common shingles >= ``percent`` x all shingles.  A
    document with fewer than ``words`` words has them all as one shingle.  Null, empty
    and blank texts have no shingles and are linked with nothing.  Rows that share an
    id are one document, linked by any of its texts; a row without id is linked with nothing
    and has a null component.  No rows give no rows.

    Two documents at exactly 80 % miss all 42 bands of 6 with a chance of 3 in a million.
    """
    early, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    signed = early.write(signatures(docs, id_col, text_col, words), "signatures")
    _, rows = write_new(signed.select("id", "n_shingles", "digest"), "digests")
    with_id = rows.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = with_id.groupBy("digest").agg(F.min("id").alias("first"))
    _, classes = write_new(classes, "classes")
    # An id that is the first of several classes has a node for each; ``twin`` tells them apart and is 0 for all others.
    crowded = classes.groupBy(F.col("first").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = classes.withColumnRenamed("first", "id").join(crowded, "id", "left")
    own = own.select("digest", "id", F.when(F.col("n") > 1, F.xxhash64("digest")).otherwise(0).alias("twin"))
    heads = signed.join(own, ["digest", "id"]).select("id", "twin", "n_shingles", "bands", "packed", "prints")
    nodes = scratch.write(heads.dropDuplicates(["id", "twin"]), "nodes")
    early.close()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")

    # Rows of one id, and of one class, are one component whatever their texts are.
    same = with_id.select("id", "digest").join(classes, "digest").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    several = same.join(with_id.groupBy("id").agg(F.count_distinct("digest").alias("n")).where("n > 1"), F.col("a") == F.col("id"), "left_semi")
    several = scratch.write(several, "links")

    # Tables between the steps: Spark splits the rows of a hot key only where a join reads both sides as dealt.
    entries = nodes.select("id", F.explode(F.slice("bands", 1, FIRST)).alias("key"))
    hubs = scratch.write(entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last"), "hubs")
    stars = scratch.write(entries.join(hubs, "key").where("id <> hub").select("id", "hub").distinct(), "stars")
    links = _confirmed_links(stars, None, nodes, texts, words, percent, scratch).union(several)
    labels = components(links)

    # What is left are pairs of different components.
    own = labels.select(F.col("node").alias("id"), "component")
    labelled = scratch.write(nodes.join(own, "id", "left").select("id", F.coalesce("component", "id").alias("label"), "twin", "n_shingles", "bands"), "labels")
    entries = labelled.select("id", "twin", "label", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("key").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.min(F.struct("id", "label")).alias("hub"),
        F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight"),
    )
    buckets = scratch.write(buckets.where("x < y").select("key", F.col("hub.id").alias("hub"), F.col("hub.label").alias("hub_label"), "size", "weight"), "hubs")
    left = scratch.write(entries.join(buckets, "key").where("id <> hub"), "bands")
    late = left.where("label <> hub_label").select("id", "hub").distinct().join(stars, ["id", "hub"], "left_anti")
    late = scratch.write(late, "stars")
    inside = left.select("band", "key", "id", "twin", "label", "size", "weight").join(nodes.select("id", "twin", "packed", "prints"), ["id", "twin"])
    inside = block_pairs(inside, percent)
    labels = components(links.union(_confirmed_links(late, inside, nodes, texts, words, percent, scratch)))
    scratch.close()
    found = rows.join(classes, "digest", "left")
    return found.join(labels, F.col("first") == F.col("node"), "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "first", "id")).alias("component")
    )


def _confirmed_links(pairs: DataFrame, blocks: DataFrame | None, nodes: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) of the ``pairs`` that pass the estimate, and of those in ``blocks``, which are similar."""
    near = scratch.write(passing(pairs, nodes, percent), "pairs")
    return scratch.write(confirmed(near, blocks, texts, words, percent, scratch), "links")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of every group of near duplicates, with the columns of ``docs``; rows without id stay."""
    found = near_duplicates(docs, id_col, text_col, words, percent)
    dropped = found.where("id <> component").select(F.col("id").alias("__id")).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped["__id"], "left_anti")
