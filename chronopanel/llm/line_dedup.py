"""Line dedup by pairwise alignment.

A run is the least number of neighbouring lines, from or up to a line with words, that has
``BLOCK_WORDS`` words.  A run that several documents share sends each later one to the first
document that holds it.  Every line with words of a common block of ``BLOCK_WORDS`` words lies in
a run within the block, so no such block is missed, whichever documents share it.
The pairs are aligned by patience diff over line hashes: lines that are unique in both
anchor the alignment, which grows from the anchors and ends into common blocks.  What it leaves, being
repeated or in another order, is aligned again by its runs, ascending or descending, until
nothing in common is left.  A common
block of at least ``BLOCK_WORDS`` words is deleted from the later document, each time it is there; empty
lines at its ends go with it where the alignment has them.

Pairs are linear in the number of lines, however many documents share a
run: there are at most two runs a line, and one pair per later document and first document; a run that very many documents
share has one first document, whose pairs are spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import map_batches, map_rows, write_new

#: Words a common block needs to be deleted.
BLOCK_WORDS = 10
HUB_PAIRS = 256
LAST = (1 << 63) - 1


def matching(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: ascending places of equal lines."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, ie, j, je = work.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        na, nb = Counter(a[i:ie]), Counter(b[j:je])
        where = {x: k for k, x in enumerate(b[j:je], j) if nb[x] == 1}
        common = [(k, where[x]) for k, x in enumerate(a[i:ie], i) if na[x] == 1 and x in where]
        # Longest run of anchors that ascends in both.
        tails: list[int] = []
        at: list[int] = []
        before: list[int] = []
        for n, (_, y) in enumerate(common):
            k = bisect_left(tails, y)
            before.append(at[k - 1] if k else -1)
            tails[k : k + 1], at[k : k + 1] = [y], [n]
        chain, n = [], at[-1] if at else -1
        while n >= 0:
            chain.append(common[n])
            n = before[n]
        if not chain:
            continue
        for x, y in reversed(chain):
            work.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        work.append((i, ie, j, je))
    return sorted(out)


def runs(words: list[int] | np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) places of the shortest runs from, and up to, each line with words that have ``least`` words."""
    words = np.asarray(words, np.int64)
    upto = np.append(0, np.cumsum(words))
    full = words.nonzero()[0]
    end = np.searchsorted(upto, upto[full] + least)
    first = np.searchsorted(upto, upto[full + 1] - least, "right") - 1
    found = {(i, e) for i, e in zip(full.tolist(), end.tolist()) if e <= len(words)}
    return sorted(found | {(i, e + 1) for i, e in zip(first.tolist(), full.tolist()) if i >= 0})


def run_keys(lines: list, words: list[int], least: int) -> dict[tuple, None]:
    """The different runs, in their order."""
    return dict.fromkeys(tuple(lines[i:e]) for i, e in runs(words, least))


def aligned_runs(a: list[tuple], b: list[tuple]) -> set[tuple]:
    """The runs of ``b`` that alignments with the runs of ``a`` reach; both lists have no repeats.

    Each alignment takes one way through what the ones before it left, ascending in both or, if that is longer, descending
    in ``a``.  Of n common runs one of the two has at least the root of n, so there are at most about two roots of n alignments.
    """
    reached: set[tuple] = set()
    both = set(a) & set(b)
    while both:
        a, b = [x for x in a if x in both], [x for x in b if x in both]
        way = max(matching(a, b), matching(a[::-1], b), key=len)
        if not way:
            break
        found = {b[j] for _, j in way}
        reached |= found
        both -= found
    return reached


def common_blocks(a: list, b: list, words: list[int], least: int, known: dict[tuple, None] | None = None) -> list[int]:
    """Places in ``b`` of the common blocks that have at least ``least`` words, by alignment.

    The alignment of the lines is one ascending way through both and has no anchor in lines that either repeats.  What it
    leaves is aligned by runs (``known``: those of ``a``), each taken once; copies of an aligned run in ``b`` go with it.  So every
    line with words of a common block is found, repeated or in another order as well.
    """
    if known is None:
        # A line that b has not ends a run.
        size = dict(zip(b, words))
        known = run_keys(a, [size.get(x, least) for x in a], least)
    out: set[int] = set()
    block: list[int] = []
    last = (-2, -2)
    for pair in [*matching(a, b), (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            if sum(words[j] for j in block) >= least:
                out.update(block)
            block = []
        block.append(pair[1])
        last = pair
    left = [(i, e, tuple(b[i:e])) for i, e in runs(words, least) if not out.issuperset(range(i, e))]
    left = [run for run in left if run[2] in known]
    if left:
        reached = aligned_runs(list(known), list(dict.fromkeys(key for *_, key in left)))
        for i, e, key in left:
            if key in reached:
                out.update(range(i, e))
    return sorted(out)


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _listed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per distinct (id, text): ``hashes`` (16 bytes a line) and ``words`` (4 bytes a line)."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            hashes, words = [], []
            for text in b["text"]:
                lines = [line.strip().encode("utf-8", "surrogatepass") for line in lines_of(text)]
                hashes.append(b"".join(map(xxhash.xxh3_128_digest, lines)))
                words.append(np.array([len(line.split()) for line in lines], "<u4").tobytes())
            yield {"id": b["id"], "tid": b["tid"], "hashes": hashes, "words": words}

    given = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text")).where("text <> ''")
    return map_rows(given, rows, "id long, tid long, hashes binary, words binary")


def _key(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("tid")]


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, tid, places): the numbers of the lines to delete from each document that loses any.

    ``id`` is the largest long for a null id, ``tid`` the xxhash64 of the text.  Documents come in the order of (id, tid); rows
    equal in both are one document.
    """
    _, listed = write_new(_listed(docs, id_col, text_col).dropDuplicates(["id", "tid"]), "lines")

    def occurrences(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"h": [], "id": [], "tid": []}
            for i, tid, hashes, words in zip(b["id"], b["tid"], b["hashes"], b["words"]):
                own = {xxhash.xxh3_128_digest(hashes[16 * i : 16 * e]) for i, e in runs(np.frombuffer(words, "<u4"), block_words)}
                out["h"] += own
                out["id"] += [i] * len(own)
                out["tid"] += [tid] * len(own)
            yield out

    _, found = write_new(map_rows(listed, occurrences, "h binary, id long, tid long"), "lines")
    firsts = (
        found.groupBy("h")
        .agg(F.min(F.struct("id", "tid")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h", F.col("first.id").alias("a"), F.col("first.tid").alias("at"))
    )
    # Tables between the steps, and merge joins at every size: Spark splits the rows of a hot line only where a join reads both sides as dealt.
    _, firsts = write_new(firsts, "lines")
    pairs = found.join(firsts.hint("merge"), "h").where("id <> a OR tid <> at").select("a", "at", "id", "tid").distinct()
    _, pairs = write_new(pairs, "pairs")
    counts = pairs.groupBy("a", "at").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("parts"))
    _, counts = write_new(counts, "pairs")
    _, pairs = write_new(
        pairs.join(counts.hint("merge"), ["a", "at"]).select("a", "at", "id", "tid", F.pmod(F.xxhash64("id", "tid"), F.col("parts")).cast("int").alias("part")), "pairs"
    )
    later = pairs.join(listed.hint("merge"), ["id", "tid"]).select("a", "at", "part", F.lit(1).alias("kind"), "id", "tid", "hashes", "words")
    _, hubs = write_new(pairs.select("a", "at", "part").distinct(), "pairs")
    first = hubs.join(listed.hint("merge"), (hubs["a"] == listed["id"]) & (hubs["at"] == listed["tid"])).select(
        "a", "at", "part", F.lit(0).alias("kind"), "id", "tid", "hashes", "words"
    )
    together = later.union(first).repartition("a", "at", "part").sortWithinPartitions("a", "at", "part", "kind")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("tid", pa.int64()), ("places", pa.list_(pa.int32()))])
        split = lambda h: [h[k : k + 16] for k in range(0, len(h), 16)]
        hub: list[bytes] = []
        known: dict[tuple, None] = {}
        for b in batches:
            out: dict[str, list] = {"id": [], "tid": [], "places": []}
            kinds, ids, tids, hashes, words = (b.column(n).to_pylist() for n in ("kind", "id", "tid", "hashes", "words"))
            for kind, i, tid, h, w in zip(kinds, ids, tids, hashes, words):
                if kind == 0:
                    hub = split(h)
                    known = run_keys(hub, np.frombuffer(w, "<u4"), block_words)
                    continue
                places = common_blocks(hub, split(h), np.frombuffer(w, "<u4").tolist(), block_words, known)
                if places:
                    out["id"].append(i)
                    out["tid"].append(tid)
                    out["places"].append(places)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    aligned = map_batches(together, align, "id long, tid long, places array<int>")
    # A line number per row: at most the lines of the document come together.
    return aligned.select("id", "tid", F.explode("places").alias("place")).distinct().groupBy("id", "tid").agg(F.sort_array(F.collect_list("place")).alias("places"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_lines, n_deleted, deleted_words, text) for every row: its text without the aligned blocks of earlier documents.

    Lines are compared without the white space around them and kept as they are.  Null and
    empty texts have no lines and stay as they are (null stays null); a null id comes after all others; rows that
    repeat an id and a text get the same result, rows that repeat an id with other texts are
    documents of their own.  No rows give no rows.  A text of any length is one document, held by one task as 20 bytes a line.
    """
    _, lost = write_new(deletions(docs, id_col, text_col, block_words), "deleted")
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[c.alias(n) for c, n in zip(_key(id_col, text_col), ("k", "kt"))])
    lost = lost.select(F.col("id").alias("k"), F.col("tid").alias("kt"), "places")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"id": b["id"], "n_lines": [], "n_deleted": [], "deleted_words": [], "text": []}
            for text, places in zip(b["text"], b["places"]):
                lines, gone = lines_of(text), set(places or ())
                out["n_lines"].append(len(lines))
                out["n_deleted"].append(len(gone))
                out["deleted_words"].append(sum(len(lines[p].encode("utf-8", "surrogatepass").split()) for p in gone))
                out["text"].append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
            yield out

    return map_rows(given.join(lost.hint("merge"), ["k", "kt"], "left").select("id", "text", "places"), rows, "id long, n_lines long, n_deleted long, deleted_words long, text string")
