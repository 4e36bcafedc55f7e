"""Token ids as binary blocks under canonical length-limited Huffman codes.

The file format is a folder of two Parquet tables, so Spark writes and reads it on any
file system with its commit protocol:

* ``codes``: id, length.  Code lengths from the counts of all ids (package-merge, at
  most ``LONGEST`` bits); the codes follow from the lengths: ascending by (length, id).
* ``blocks``: start, doc_ids, lengths, n_ids, checkpoints, payload.  A block holds whole
  documents in ascending order of id and decodes on its own.  ``payload`` is the bit
  string, first bit highest; ``checkpoints`` has the bit offset of every
  ``STEP``-th id as little-endian 64-bit numbers, so the pieces between them
  decode side by side by table look-ups.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronopanel.llm.common import Remembered, discard, map_batches, map_rows, text_or_empty
from chronopanel.scale import new_path

LONGEST, STEP, BLOCK = 18, 256, 1 << 20


# -- codes ---------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = len(row) // 2
        packages = row[0 : 2 * pairs : 2] + row[1 : 2 * pairs : 2]
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        row = both[place]
        is_leaf.append(place < n)
    lengths, wanted = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:wanted].sum())
        lengths[order[:own]] += 1
        wanted = 2 * (wanted - own)
    return lengths


class Codes:
    """Canonical codes for (id, length) pairs, with the tables for both directions."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.width = int(lengths[-1]) if len(ids) else 1
        spans = np.int64(1) << (self.width - lengths)
        firsts = np.cumsum(spans) - spans
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids], self.length[ids] = (firsts >> (self.width - lengths)).astype(np.uint64), lengths
        self.symbol, self.taken = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.int64)
        self.symbol[: spans.sum()], self.taken[: spans.sum()] = np.repeat(ids, spans), np.repeat(lengths, spans)

    def encode(self, ids: np.ndarray, step: int = STEP, most: int = 1 << 15) -> tuple[bytes, bytes]:
        """(payload, checkpoints) of some ids; about ``most`` at a time, which a processor's cache holds."""
        words, checkpoints, end = np.zeros((len(ids) * self.width + 63) // 64 + 1, np.uint64), [], 0
        many = step * max(1, most // step)
        for i in range(0, len(ids), many):
            some = ids[i : i + many]
            lengths, code = self.length[some], self.code[some]
            ends = np.cumsum(lengths) + end
            starts, end = ends - lengths, int(ends[-1])
            word, room = starts >> 6, 64 - (starts & 63) - lengths
            over = (room < 0).nonzero()[0]
            high = code << np.maximum(room, 0).astype(np.uint64)
            high[over] = code[over] >> (-room[over]).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] |= np.bitwise_or.reduceat(high, first)
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
            checkpoints.append(starts[::step].astype("<i8").tobytes())
        return words[: (end + 63) // 64].astype(">u8").tobytes(), b"".join(checkpoints)

    def decode(self, payload: bytes, checkpoints: bytes, n: int, step: int = STEP) -> np.ndarray:
        """All ids of a block: one table look-up per id, the pieces between checkpoints side by side."""
        at = np.frombuffer(checkpoints, "<i8").astype(np.int64)
        if not n:
            return np.zeros(0, np.uint32)
        words = np.frombuffer(payload, ">u8").astype(np.uint64)
        words = np.append(words, np.zeros(2, np.uint64))
        out = np.zeros((min(step, n), len(at)), np.uint32)
        last, shift, one = len(words) - 2, np.uint64(64 - self.width), np.uint64(1)
        for i in range(len(out)):
            word = np.minimum(at >> 6, last)
            bit = (at & 63).astype(np.uint64)
            window = (words[word] << bit) | ((words[word + 1] >> one) >> (np.uint64(63) - bit))
            entry = window >> shift
            out[i] = self.symbol[entry]
            at = at + self.taken[entry]
        return out.T.reshape(-1)[:n]


# -- tokenizing ----------------------------------------------------------------------------


class WordTokenizer:
    """Ids as the tokenizers library gives them without special tokens, with a memory of pieces of texts.

    For a byte-level BPE without normaliser, whose words follow a fixed pattern, texts are
    cut where that pattern always ends a word: at white space, and in texts whose blanks are single also between a letter and
    an ASCII character that is none.  Of such texts the pieces are compared and their ids joined as Arrow
    columns, so only different pieces become Python objects; unknown ones that begin with a blank go through the library in one
    string, whose ids are dealt to them by the bytes they stand for.  Other unknown pieces go through the
    pattern and their words through the library's model.  A text with a special token, an odd
    control character, or any other kind of tokenizer goes through the library as a whole.
    """

    PARTS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    ODD = "[\x1c-\x1f]"
    #: White space but ODD, as Arrow's patterns write it. And: texts that are not cut at single blanks.
    SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    UNLIKE = f"^$|^{SPACE}|{SPACE}$|{SPACE}{SPACE}|{ODD}"
    #: Bytes that are an ASCII letter; that are printable and none; that follow byte C3 in a letter.
    LETTER, OTHER, ACCENT = np.zeros((3, 256), bool)
    LETTER[[*range(65, 91), *range(97, 123)]] = True
    OTHER[33:127] = ~LETTER[33:127]
    ACCENT[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
    #: Bytes of texts that are cut together.
    SLICE = 1 << 23

    def __init__(self, path: str, memory: int = 800_000, longest: int = 60):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.longest = longest
        state = self.library.pre_tokenizer.__getstate__() if self.library.pre_tokenizer else b""
        plain = type(self.model).__name__ == "BPE" and not self.library.normalizer and b'"type":"ByteLevel"' in state
        plain = plain and b'"add_prefix_space":false' in state and b'"use_regex":true' in state
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd, self.unlike, self.special = re.compile(self.ODD if plain else ""), self.UNLIKE if plain else "", special
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        # Bytes that an id stands for: its piece has one letter for each.
        pieces = self.library.get_vocab() if plain else {}
        self.bytes = np.zeros(max(pieces.values(), default=0) + 1, np.int64)
        self.bytes[list(pieces.values())] = [len(p) for p in pieces]
        self.known = Remembered(memory)

    def tokenized(self, word: str) -> bytes:
        letters = word.encode("utf-8").decode("latin-1").translate(self.letters)
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.model.tokenize(letters)]) else b""

    def part(self, part: str) -> bytes:
        """Ids of a piece of a text that the pattern does not cross."""
        found = self.known.young.get(part) or self.known.again(part)
        if found is None:
            words = self.WORDS.findall(part)
            found = self.tokenized(part) if len(words) == 1 else b"".join(map(self.part, words))
            if len(part) <= self.longest:
                self.known.put(part, found)
        return found

    def together(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a blank, from one call of the library; it is fastest on strings of a few hundred pieces."""
        strings = ["".join(keys[i : i + 300]) for i in range(0, len(keys), 300)]
        if any(s in text for s in self.special for text in strings):
            return list(map(self.part, keys))
        found = self.library.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
        reached = np.cumsum(self.bytes[ids])
        ends = np.cumsum(pc.binary_length(pa.array(keys, pa.string())).to_numpy(), dtype=np.int64)
        last = np.searchsorted(reached, ends)
        if last[-1] >= len(ids) or (reached[last] != ends).any():
            raise ValueError("a piece of the tokenizer goes across a blank")
        data, cuts = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a column without nulls; about ``SLICE`` bytes are cut at a time."""
        reached = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // self.SLICE
        cuts = [0, *(np.flatnonzero(np.diff(reached)) + 1).tolist(), len(texts)]
        return [ids for i, j in zip(cuts, cuts[1:]) for ids in self._encode_all(texts.slice(i, j - i).cast(pa.string()))]

    def _encode_all(self, texts: pa.StringArray) -> list[bytes]:
        unlike = pc.match_substring_regex(texts, self.unlike)
        for s in self.special:
            unlike = pc.or_(unlike, pc.match_substring(texts, s))
        others = map(self.uneven, texts.filter(unlike).to_pylist())
        own = iter(self.even(texts.filter(pc.invert(unlike))))
        return [next(others if u else own) for u in unlike.to_pylist()]

    def uneven(self, text: str) -> bytes:
        if self.odd.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.PARTS.findall(text)
        return b"".join([f or self.part(p) for f, p in zip(map(self.known.young.get, parts), parts)])

    def even(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of texts that are not empty and have no white space at their ends or beside other white space."""
        if not len(texts):
            return []
        _, bounds, buffer = texts.buffers()
        bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]]
        starts = bounds - bounds[0]
        letter, cut = self.LETTER[data], data == 32
        letter[1:] |= (data[:-1] == 0xC3) & self.ACCENT[data[1:]]
        cut[1:] |= letter[:-1] & self.OTHER[data[1:]]
        cut[starts[:-1]] = True
        at = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at + bounds[0]), buffer).dictionary_encode()
        ids = pa.array(self.found(pieces.dictionary.to_pylist()), pa.binary()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[np.searchsorted(at, starts)].tolist()
        return [ids.buffers()[2][i:j].to_pybytes() for i, j in zip(ends, ends[1:])]

    def found(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        found = list(map(self.known.young.get, pieces))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                piece = pieces[i]
                ids = found[i] = self.known.again(piece) if piece[0] == " " else self.part(piece)
                if ids is None:
                    missing.append(i)
        if missing:
            keys = [pieces[i] for i in missing]
            for i, key, ids in zip(missing, keys, self.together(keys)):
                found[i] = ids
                if len(key) <= self.longest:
                    self.known.put(key, ids)
        return found


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    return WordTokenizer(path)


# -- writing and reading -------------------------------------------------------------------


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two arrays of counts, the shorter one as if it went on with zeros."""
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def write_blocks(
    docs: DataFrame, path: str, model: str, end_id: int = 2, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Tokenize whole texts, end every document with ``end_id`` and write the ids in ascending order of id.

    Null texts count as empty and give the end id alone.  Null ids come last; rows of
    one id are ordered by their texts.  An empty table gives empty tables.  The texts are
    range-partitioned once; a task passes through its range and holds one block.
    """
    spark = docs.sparkSession
    place = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    ordered = texts.repartitionByRange(*place).sortWithinPartitions(*place)
    schema = pa.schema(
        [("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())]
    )

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, part = tokenizer(model), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        before, size, held, ids, lengths, counts = 0, 0, [], [], [], np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            nonlocal before, size, counts
            data = np.frombuffer(b"".join(held), "<u4")
            counts = added(counts, np.bincount(data))
            if data.max() < 1 << 16:  # the width of the ids follows from their number
                data = data.astype("<u2")
            row = {"part": [part], "before": [before], "n_ids": [size], "doc_ids": [list(ids)], "lengths": [list(lengths)], "ids": [data.tobytes()], "counts": [None]}
            before, size = before + size, 0
            for x in (held, ids, lengths):
                x.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for b in batches:
            for i, found in zip(b.column(0).to_pylist(), own.encode_all(b.column(1))):
                found += end
                held.append(found)
                ids.append(i)
                lengths.append(len(found) // 4)
                size += len(found) // 4
                if size >= block:
                    yield flush()
        if ids:
            yield flush()
        if len(counts):  # a last row has the counts of a task's ids and no documents
            yield pa.RecordBatch.from_pydict({f.name: [counts.tobytes() if f.name == "counts" else None] for f in schema}, schema=schema)

    kinds = "part int, before long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"
    staged = new_path(spark, "ids")
    map_batches(ordered, collect, kinds).write.option("compression", "zstd").parquet(staged)
    rows, counted = spark.read.parquet(staged).where("counts IS NULL").drop("counts"), spark.read.parquet(staged).select("counts")

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for data in b["counts"]:
                total = added(total, np.frombuffer(data, np.int64))
        ids = total.nonzero()[0]
        yield {"id": ids.tolist(), "n": total[ids].tolist()}

    # At most one row per id of the vocabulary reaches the driver.
    found = map_rows(counted.where("counts IS NOT NULL"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    ids, lengths = found["id"].to_numpy(np.int64), code_lengths(found["n"].to_numpy(np.int64))
    table = spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length long")
    table.coalesce(1).write.parquet(f"{path}/codes")
    codes = spark.sparkContext.broadcast(Codes(ids, lengths))

    # One row per partition of the sort.
    sums = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    def encode(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for i, data in enumerate(b["ids"]):
                payload, checkpoints = codes.value.encode(np.frombuffer(data, f"<u{len(data) // b['n_ids'][i]}"))
                yield {k: [b[k][i]] for k in ("start", "doc_ids", "lengths", "n_ids")} | {"checkpoints": [checkpoints], "payload": [payload]}

    placed = rows.join(F.broadcast(starts), "part").select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "lengths", "n_ids", "ids")
    kinds = "start long, doc_ids array<long>, lengths array<long>, n_ids long, checkpoints binary, payload binary"
    map_rows(placed, encode, kinds).write.parquet(f"{path}/blocks")
    discard(spark, staged)


def read_blocks(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the files at ``path``."""
    table = spark.read.parquet(f"{path}/codes").toPandas()  # bounded by the vocabulary
    codes = spark.sparkContext.broadcast(Codes(table["id"].to_numpy(np.int64), table["length"].to_numpy(np.int64)))

    def decode(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for start, doc_ids, lengths, n, checkpoints, payload in zip(*(b[k] for k in ("start", "doc_ids", "lengths", "n_ids", "checkpoints", "payload"))):
                data = codes.value.decode(payload, checkpoints, n).astype("<u4")
                ends = np.cumsum(lengths)
                parts = [data[e - k : e] for e, k in zip(ends.tolist(), lengths)]
                out = {"doc_id": doc_ids, "start": (start + ends - lengths).tolist(), "n_tokens": lengths, "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts]}
                yield out | ({"ids": [p.tolist() for p in parts]} if keep_ids else {})

    return map_rows(
        spark.read.parquet(f"{path}/blocks"), decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    )
