"""Language-model scores of texts by Katz backoff, with tables partitioned by n-gram.

Counts ``c`` are of words in the training rows, a start before every text and one end after it.  A counted
n-gram ``hw`` has probability ``d(c) * c(hw) / c(h)``, where ``d`` is the Good-Turing discount for counts up to
``DISCOUNTED`` and 1 above; any other word has ``alpha(h)`` times its probability after the shorter
history.  ``alpha(h)`` is what the discounts free, divided by what the shorter history gives to words not
counted after ``h``, so every distribution sums to 1.  The shortest one gives what it frees to one
class of unknown words.  A history all of whose counts are above ``DISCOUNTED`` frees nothing; its total is then
raised by 1 and that 1 is free.  If the counts of counts allow no Good-Turing discount at any limit
(small or odd tables), half an occurrence is taken from every count up to the limit.

How it runs.  Texts are cut into chunks of about ``CHUNK`` tokens, stored as numbers.  A chunk asks for each of
its distinct n-grams once, a sorted array of 64-bit hashes for every part of the hash range; the
part sums the training counts over all chunks and answers each array with an array of counts.  So an n-gram crosses the
network once per chunk, hot ones too, no part grows with a frequent word, and the number of parts grows with the
input.  Of the chunks that hold an n-gram one is told to speak for it, so that sums over distinct n-grams (what
a history frees) can be formed by the chunks and added by the same parts.  A chunk then scores its
texts from the answers, token by token, recursing from the longest history to the empty one in numpy.
Only counts of counts reach the driver.  Every exchange is a table in the shared folder or a shuffle, so
lost executors cost a recomputation.

Defined results: null, empty and blank texts are the end alone; without training rows every token has probability 1 in
both scores; every row counts by itself, also with null or repeated ids; a text longer than a chunk is a chunk.  Extra columns are
ignored, whatever their names.  Words are told apart by 64-bit hashes; two words or n-grams with one hash
(below 1e-5 in ten million) would share their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from chronopanel.llm.common import Scratch, map_batches, ship
from chronopanel.scale import stored

#: Tokens of a chunk, n-grams a part of the hash range should get, words whose hash a task remembers.
CHUNK, PART, REMEMBERED = 1 << 20, 1 << 21, 1 << 20
#: Counts up to this are discounted.
DISCOUNTED = 5
_U = np.uint64
#: No word holds a blank.
START, END = xxh3_64_intdigest(b" start"), xxh3_64_intdigest(b" end")


def longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their first n - 1 and last words."""
    x = history * _U(0x9E3779B97F4A7C15) + _U(1)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93) + word
    x = (x ^ (x >> _U(32))) * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(29))


def starts(size: int) -> int:
    """Hash of ``size`` starts."""
    code = one = np.array([START], _U)
    for _ in range(size - 1):
        code = longer(code, one)
    return int(code[0])


def pack(values: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    plain = np.frombuffer(pa.decompress(data, width * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(plain.reshape(width, size).T).view(kind).ravel()


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxh3_64_intdigest(word)
        return code


def chunked(docs: DataFrame, id: str, text: str, train: Column, order: int, size: int) -> DataFrame:
    """One row per chunk: ids, whether the texts train, their numbers of tokens, distinct words, and all tokens as places among those."""
    taken = docs.select(F.col(f"`{id}`").alias("id"), train.alias("train"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    schema = f"chunk long, ids array<{kind}>, train array<boolean>, sizes array<int>, words long, tokens long, vocabulary binary, line binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        memory = Words()
        ids, trains, sizes, codes, held = [], [], [], [], 0
        pad = [START] * (order - 1)

        def chunk() -> pa.RecordBatch:
            vocabulary, line = np.unique(np.concatenate(codes), return_inverse=True)
            arrays = [
                pa.array([number]),
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids)),
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(trains, pa.bool_())),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([len(vocabulary)]),
                pa.array([held]),
                pa.array([packed_codes(vocabulary)], pa.binary()),
                pa.array([pack(line.astype(np.int32))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "train", "sizes", "words", "tokens", "vocabulary", "line"])

        for batch in batches:
            texts, flags = batch.column("text"), batch.column("train").to_pylist()
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").lower().split()
                codes.append(np.array([*pad, *map(memory.__getitem__, words), END], _U))
                ids.append(batch.column("id").slice(i, 1))
                trains.append(bool(flags[i]))
                sizes.append(len(words) + 1)
                held += len(words) + 1
                if held >= size:
                    yield chunk()
                    number += 1
                    ids, trains, sizes, codes, held = [], [], [], [], 0
                if len(memory) > REMEMBERED:
                    memory.clear()
        if held:
            yield chunk()

    return map_batches(taken, run, schema)


class Chunk:
    """The texts of a chunk and their n-grams."""

    def __init__(self, row: dict, order: int):
        self.number, self.ids, self.order = row["chunk"], row["ids"], order
        vocabulary = unpacked_codes(row["vocabulary"], row["words"])
        self.sizes = np.array(row["sizes"], np.int64)
        line = unpack(row["line"], row["tokens"] + (order - 1) * len(self.sizes), np.int32)
        ends = np.cumsum(self.sizes + order - 1)
        self.first = ends - self.sizes  # of every text, after its starts
        self.token = np.ones(len(line), bool)
        for back in range(1, order):
            self.token[self.first - back] = False
        self.train = np.repeat(np.array(row["train"], bool), self.sizes + order - 1)
        self.codes = {1: vocabulary[line]}
        for size in range(2, order + 1):
            code = self.codes[size] = np.zeros(len(line), _U)
            code[1:] = longer(self.codes[size - 1][:-1], self.codes[1][1:])
        self._distinct: dict[int, tuple] = {}

    def distinct(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams; a place where each ends; and for every place the index of the one that ends there.

        Those that end in a word, and for histories the starts before the first word.
        """
        if size not in self._distinct:
            used = self.token.copy()
            if size < self.order:
                used[self.first - 1] = True
            places = np.flatnonzero(used)
            codes, first, inverse = np.unique(self.codes[size][places], return_index=True, return_inverse=True)
            index = np.zeros(len(used), np.int64)
            index[places] = inverse
            self._distinct[size] = codes, places[first], index
        return self._distinct[size]

    def training_counts(self, size: int) -> np.ndarray:
        codes, _, index = self.distinct(size)
        used = self.token & self.train
        if size < self.order:
            before = self.first - 1
            used[before] = self.train[before]
        return np.bincount(index[used], minlength=len(codes))


def parted(codes: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Part numbers and slices of sorted hashes."""
    part = ((codes >> _U(32)) * _U(parts)) >> _U(32)
    number, at = np.unique(part, return_index=True)
    for p, low, high in zip(number.tolist(), at, [*at[1:], len(codes)]):
        yield p, slice(low, high)


def packed_codes(codes: np.ndarray) -> bytes:
    return pack(np.diff(codes, prepend=_U(0)))


def unpacked_codes(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpack(data, size, _U), dtype=_U)


ASKED = "chunk long, part long, size long, codes binary, n binary"


def asked(chunks: DataFrame, size: int, order: int, parts: int) -> DataFrame:
    """Every chunk's distinct n-grams of ``size`` words and their training counts in the chunk, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.slice(i, 1).to_pylist()[0], order)
                codes, counts = chunk.distinct(size)[0], chunk.training_counts(size)
                rows = [(chunk.number, p, s.stop - s.start, packed_codes(codes[s]), pack(counts[s])) for p, s in parted(codes, parts)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), ["chunk", "part", "size", "codes", "n"])

    return map_batches(chunks, run, ASKED)


def _summed(asks: pa.Table) -> tuple[list[dict], list[slice], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by chunk; the slices of their n-grams; distinct n-grams, which one each is, own and total counts."""
    rows = sorted(asks.to_pylist(), key=lambda r: r["chunk"])
    ends = np.cumsum([r["size"] for r in rows])
    slices = [slice(e - r["size"], e) for e, r in zip(ends.tolist(), rows)]
    codes, index = np.unique(np.concatenate([unpacked_codes(r["codes"], r["size"]) for r in rows]), return_inverse=True)
    own = np.concatenate([unpack(r["n"], r["size"], np.int64) for r in rows])
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, index, own)
    return rows, slices, codes, index, own, total


def counted(asks: DataFrame, size: int) -> DataFrame:
    """The answers: counts over all chunks, twice, plus 1 for the chunk that speaks for the n-gram.

    One row of a part also has its number of counted n-grams, their sum, and how many were counted 1, 2, ... times.
    """
    all_starts = starts(size)

    def part(table: pa.Table) -> pa.Table:
        rows, slices, codes, index, own, total = _summed(table)
        trained = np.flatnonzero(own)
        speaks = np.zeros(len(own), np.int64)
        speaks[trained[np.unique(index[trained], return_index=True)[1]]] = 1
        answer = 2 * total[index] + speaks
        real = total[(codes != _U(all_starts)) & (total > 0)]
        statistics = [len(real), int(real.sum()), *np.bincount(np.minimum(real, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()]
        return pa.table(
            {
                "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                "part": pa.array([r["part"] for r in rows], pa.int64()),
                "size": pa.array([r["size"] for r in rows], pa.int64()),
                "counts": pa.array([pack(answer[s]) for s in slices], pa.binary()),
                "statistics": pa.array([statistics] + [None] * (len(rows) - 1), pa.list_(pa.int64())),
            }
        )

    ship(asks.sparkSession)
    return asks.groupBy("part").applyInArrow(part, "chunk long, part long, size long, counts binary, statistics array<long>")


def discounts(n: list[int]) -> np.ndarray:
    """Factor by count (0 unused, the last for all higher ones) from the numbers of n-grams counted 1, 2, ... times."""
    factors = np.ones(DISCOUNTED + 2)
    for top in range(DISCOUNTED, 0, -1):
        if min(n[: top + 1]) > 0:
            share = (top + 1) * n[top] / n[0]
            found = [((r + 1) * n[r] / (r * n[r - 1]) - share) / (1 - share) if share != 1 else 0 for r in range(1, top + 1)]
            if all(0 < d < 1 for d in found):
                factors[1 : top + 1] = found
                return factors
    factors[1:-1] = 1 - 0.5 / np.arange(1, DISCOUNTED + 1)
    return factors


class Model:
    """What all tasks know: counts of counts, as discounts, and the number of tokens and words in training."""

    def __init__(self, statistics: dict[int, list[int]]):
        self.words, self.tokens = statistics[1][:2]
        self.factors = {size: discounts(s[2:]) for size, s in statistics.items()}
        freed = sum((1 - self.factors[1][r]) * r * statistics[1][1 + r] for r in range(1, DISCOUNTED + 1))
        self.total = self.tokens + (freed == 0)
        self.unknown = (freed or 1.0) / self.total

    def discounted(self, size: int, counts: np.ndarray) -> np.ndarray:
        return self.factors[size][np.minimum(counts, DISCOUNTED + 1)] * counts


class Answered(Chunk):
    """A chunk with the answers it got so far."""

    def __init__(self, row: dict, answers: list[dict], model: Model, order: int):
        super().__init__(row, order)
        self.model, self.counts, self.speaks, self.alpha = model, {}, {}, {}
        answers = sorted(answers, key=lambda a: (a["length"], a["part"]))
        for size in range(1, order + 1):
            mine = [a for a in answers if a["length"] == size]
            found = [unpack(a["counts"], a["size"], np.int64) for a in mine if a["counts"] is not None]
            if found:
                found = np.concatenate(found)
                self.counts[size], self.speaks[size] = found >> 1, (found & 1).astype(bool)
            found = [unpack(a["alpha"], a["size"], np.float64) for a in mine if a["alpha"] is not None]
            if found:
                self.alpha[size] = np.concatenate(found)

    def probability(self, size: int, places: np.ndarray) -> np.ndarray:
        """Probability of the words at ``places`` after the ``size - 1`` words before them."""
        count = self.counts[size][self.distinct(size)[2][places]]
        if size == 1:
            return np.where(count > 0, self.model.discounted(1, count) / self.model.total, self.model.unknown)
        history = self.distinct(size - 1)[2][places - 1]
        alpha = self.alpha[size - 1][history]
        total = self.counts[size - 1][history] + (alpha < 0)
        shorter = np.abs(alpha) * self.probability(size - 1, places)
        return np.where(count > 0, self.model.discounted(size, count) / np.maximum(total, 1), shorter)

    def histories(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams with ``size`` words of history this chunk speaks for: (history, what it frees, what the shorter history gives to their words)."""
        places = self.distinct(size + 1)[1]
        told = self.speaks[size + 1] & self.token[places]
        places, counts = places[told], self.counts[size + 1][told]
        codes, _, index = self.distinct(size)
        history = index[places - 1]
        freed = np.bincount(history, (1 - self.model.factors[size + 1][np.minimum(counts, DISCOUNTED + 1)]) * counts, len(codes))
        given = np.bincount(history, self.probability(size, places), len(codes))
        held = np.flatnonzero(given)
        return codes[held], freed[held], given[held]


def _with_answers(chunks: DataFrame, answers: DataFrame, model: Model, order: int, result, schema: str) -> DataFrame:
    """``result`` (a table of an ``Answered``) for every chunk."""
    answers = answers.select("chunk", "part", "size", "length", "counts", "alpha")

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        return result(Answered(chunk.to_pylist()[0], answers.to_pylist(), model, order))

    ship(chunks.sparkSession)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def backed_off(asks: DataFrame, sums: DataFrame) -> DataFrame:
    """The answers for histories: their backoff weight, negative if the history's total is raised by 1."""

    def part(asks: pa.Table, sums: pa.Table) -> pa.Table:
        rows, slices, codes, index, _, total = _summed(asks)
        freed, given = np.zeros(len(codes)), np.zeros(len(codes))
        for r in sorted(sums.to_pylist(), key=lambda r: r["chunk"]):
            at = np.searchsorted(codes, unpacked_codes(r["codes"], r["size"]))
            freed[at] += unpack(r["freed"], r["size"], np.float64)
            given[at] += unpack(r["given"], r["size"], np.float64)
        full = (freed == 0) & (total > 0)
        alpha = np.where(full, -1.0, freed) / np.maximum(total + full, 1) / (1 - given)
        alpha[total == 0] = 1.0
        return pa.table(
            {
                "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                "part": pa.array([r["part"] for r in rows], pa.int64()),
                "size": pa.array([r["size"] for r in rows], pa.int64()),
                "alpha": pa.array([pack(alpha[index[s]]) for s in slices], pa.binary()),
            }
        )

    return asks.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(part, "chunk long, part long, size long, alpha binary")


def _history_rows(chunk: Answered, size: int, parts: int) -> pa.Table:
    codes, freed, given = chunk.histories(size)
    rows = [(chunk.number, p, s.stop - s.start, packed_codes(codes[s]), pack(freed[s]), pack(given[s])) for p, s in parted(codes, parts)]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    columns = list(zip(*rows)) or [[]] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "part", "size", "codes", "freed", "given"])


def _score_rows(chunk: Answered, kind: pa.DataType) -> pa.Table:
    places = np.flatnonzero(chunk.token)
    model = chunk.model
    count = chunk.counts[1][chunk.distinct(1)[2][places]]
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    score = np.log10(chunk.probability(chunk.order, places))
    at = np.concatenate([[0], np.cumsum(chunk.sizes)[:-1]])
    return pa.table(
        {
            "id": pa.array(chunk.ids, kind),
            "held_out": pa.array(~chunk.train[chunk.first]),
            "n_tokens": pa.array(chunk.sizes),
            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
            "train_tokens": pa.array(np.full(len(at), model.tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, at)),
            "score": pa.array(np.add.reduceat(score, at)),
        }
    )


def scored(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", order: int = 2, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``train`` says which rows the model learns from; ``order`` is the length of the longest n-grams, ``chunk`` the tokens of a
    chunk and ``part`` the n-grams of a part of the hash range.  ``base_score`` is that of single words with half an occurrence added to each and to the unknown.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    try:
        chunks = scratch.write(chunked(docs, id, text, F.coalesce(train, F.lit(False)), order, chunk), "chunks")
        words, tokens = (n or 0 for n in chunks.agg(F.sum("words"), F.sum("tokens")).first())
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = {size: max(least, -(-(words if size == 1 else tokens) // part)) for size in range(1, order + 1)}
        asks, answers, statistics = {}, None, {}
        for size in range(1, order + 1):
            asks[size] = asked(chunks, size, order, parts[size])
            if size < order:  # histories are asked for again
                asks[size] = scratch.write(asks[size], "asked")
            found = scratch.write(counted(asks[size], size), "counted")
            sums = found.select(F.posexplode("statistics")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
            statistics[size] = [0] * (DISCOUNTED + 3)
            for r in sums:
                statistics[size][r["pos"]] = r["n"]
            found = found.withColumn("length", F.lit(size)).withColumn("alpha", F.lit(None).cast("binary"))
            answers = found if answers is None else answers.unionByName(found)
        model = Model(statistics)
        for size in range(1, order):
            sums = _with_answers(
                chunks,
                answers.where(F.col("length") <= size + 1),
                model,
                order,
                lambda chunk, size=size: _history_rows(chunk, size, parts[size]),
                "chunk long, part long, size long, codes binary, freed binary, given binary",
            )
            found = scratch.write(backed_off(asks[size], sums), "backoff")
            found = found.withColumn("length", F.lit(size)).withColumn("counts", F.lit(None).cast("binary"))
            answers = answers.unionByName(found, allowMissingColumns=True)
        kind = docs.schema[id].dataType
        schema = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        arrow = to_arrow_type(kind)
        return stored(_with_answers(chunks, answers, model, order, lambda chunk: _score_rows(chunk, arrow), schema))
    finally:
        scratch.close()
