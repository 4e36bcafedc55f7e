"""Language identification by prediction by partial matching (PPM, escape method C) over bytes.

Every language has a tree of byte contexts of length 0 to 3 with frozen counts.  The code
length of a byte is -log2 of its share in the longest context that the language has
seen; a byte that never followed there costs the context's escape probability and is
coded by the next shorter context, at last as one of 256.  The language with the
shortest code for a whole text is the prediction.

The trees are learned from a bounded sample of the labelled rows: at most ``SAMPLE`` different texts a
language, those whose hashes are smallest, so copies of a text count once.  Each language keeps its own ``CONTEXTS`` most
frequent byte strings; with many languages fewer, so that strings times languages stay near ``CELLS`` (the
model has a number for each), but never under ``LEAST_CONTEXTS``.  All are parameters.  There is no limit of languages.
Everything else covers all rows: every byte of every text is coded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import map_batches, map_rows

ORDER = 3
SAMPLE = 2_000
CONTEXTS, LEAST_CONTEXTS, CELLS = 75_000, 1_000, 40_000_000
LETTER = regex.compile(r"\p{L}")
#: Bytes of texts that are scored at a time.
SLICE = 2_000_000
#: What stands before a text.
START = b"\n" * ORDER
UNKNOWN = "und"


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """Codes of the byte strings of ``length`` that end at the places from ORDER on."""
    n = len(data) - ORDER
    code = np.zeros(n, np.uint32)
    for i in range(ORDER + 1 - length, ORDER + 1):
        code = (code << np.uint32(8)) | data[i : i + n]
    return code


class Index:
    """Places of 32-bit codes in a sorted array; a table of slots, eight a key, answers nearly all at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = min(24, max(4, (8 * len(keys)).bit_length()))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(32 - self.bits)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of every code, -1 if absent."""
        at = self.slots[self._slot(codes)]
        if len(self.keys) == 0:
            return at
        wrong = ((at >= 0) & (self.keys[at] != codes)).nonzero()[0]
        if len(wrong):
            place = np.minimum(np.searchsorted(self.keys, codes[wrong]), len(self.keys) - 1)
            at[wrong] = np.where(self.keys[place] == codes[wrong], place, -1)
        return at


@dataclass
class Model:
    """Code lengths in bits: ``cost[n]`` for byte strings of length n, ``escape[n]`` for their contexts; a column per language."""

    languages: list[str]
    strings: list[Index]
    cost: list[np.ndarray]
    contexts: list[Index]
    escape: list[np.ndarray]

    def bits(self, codes: np.ndarray, length: int = ORDER + 1) -> np.ndarray:
        """Code lengths (n, languages) of the last byte of each string, given the bytes before it."""
        if length == 0:
            return np.full((len(codes), len(self.languages)), 8.0, np.float32)
        at = self.strings[length].find(codes)
        out = self.cost[length][at]
        unseen = (at < 0).nonzero()[0]
        if len(unseen):
            out[unseen] = self.fallback(codes[unseen], length)
        return out

    def fallback(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Escape from the longest context plus the code in the next shorter one."""
        context = self.contexts[length].find(codes >> np.uint32(8))
        escape = np.where((context >= 0)[:, None], self.escape[length][context], np.float32(0))
        shorter = codes & np.uint32((1 << (8 * (length - 1))) - 1)
        return escape + self.bits(shorter, length - 1)

    def totals(self, texts: list[bytes], cells: int = 4_000_000) -> np.ndarray:
        """Code lengths (texts, languages) of whole texts, a bounded number of bytes at a time."""
        out = np.zeros((len(texts), len(self.languages)))
        step = max(4096, cells // max(1, len(self.languages)))
        block: list[bytes] = []
        rows: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not block:
                return
            data = np.frombuffer(b"".join(block), np.uint8)
            lengths = np.array([len(b) for b in block])
            starts = np.cumsum(lengths) - lengths
            costs = self.bits(grams(data, ORDER + 1))
            # The last bytes of one piece and the first of the next make no string of a text.
            own = np.ones(len(data) - ORDER, bool)
            for i in range(ORDER):
                inside = starts[1:] - ORDER + i
                own[inside] = False
            costs[~own] = 0
            np.add.at(out, rows, np.add.reduceat(costs, starts, axis=0, dtype=np.float64))
            block.clear()
            rows.clear()
            size = 0

        for row, text in enumerate(texts):
            if not text:
                continue
            whole = START + text
            for at in range(0, len(text), step):
                piece = whole[at : at + step + ORDER]
                block.append(piece)
                rows.append(row)
                size += len(piece)
                if size >= step:
                    flush()
        flush()
        return out


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, contexts: int = CONTEXTS
) -> Model | None:
    """Frozen model of the rows with text and language; None if there are none.

    Byte strings are counted on the executors, summed by Spark, and only the most
    frequent ``contexts`` of each language reach the driver.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text <> '' AND lang IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # Hashes are even, so the smallest of n different ones lie below about 1 in n of their range; half more than asked
    # for passes here, for which partial counts are enough, and the windows order that little exactly.
    different = rows.select("lang", "hash").distinct()
    sizes = different.groupBy("lang").count().collect()
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    share = [(r["lang"], min(1.0, (1.5 * sample + 100) / r["count"])) for r in sizes]
    shares = F.broadcast(labelled.sparkSession.createDataFrame(share, "lang string, share double"))  # a row a language
    few = different.join(shares, "lang").where(F.col("hash") / 2.0**64 + 0.5 <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = few.withColumn("place", place).where(F.col("place") <= sample).select("lang", "hash")
    # At most ``sample`` rows a language.
    drawn = rows.join(F.broadcast(chosen), ["lang", "hash"]).dropDuplicates(["lang", "hash"]).select("text", "lang")

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"lang": [], "length": [], "code": [], "n": []}
            for lang in sorted(set(b["lang"])):
                parts = [START + t.encode("utf-8", "surrogatepass") for t, own in zip(b["text"], b["lang"]) if own == lang]
                for length in range(1, ORDER + 2):
                    codes = np.concatenate([grams(np.frombuffer(p, np.uint8), length) for p in parts])
                    keys, n = np.unique(codes, return_counts=True)
                    out["lang"] += [lang] * len(keys)
                    out["length"] += [length] * len(keys)
                    out["code"] += keys.tolist()
                    out["n"] += n.tolist()
            yield out

    counted = map_rows(drawn, count, "lang string, length int, code long, n long")
    summed = counted.groupBy("lang", "length", "code").agg(F.sum("n").alias("n"))
    own = min(contexts, max(LEAST_CONTEXTS, CELLS // len(languages) ** 2))
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "length", "code")
    found = summed.withColumn("place", F.row_number().over(frequent)).where(F.col("place") <= own).drop("place").toPandas()
    return build(languages, found)


def build(languages: list[str], found) -> Model:
    """Code lengths for every kept byte string, those a language lacks by their escapes."""
    none = Index(np.zeros(0, np.uint32))
    model = Model(languages, [none], [np.zeros((0, len(languages)), np.float32)], [none], [np.zeros((0, len(languages)), np.float32)])
    column = {lang: i for i, lang in enumerate(languages)}
    for length in range(1, ORDER + 2):
        own = found[found["length"] == length]
        codes, n = own["code"].to_numpy(np.uint32), own["n"].to_numpy(np.float64)
        lang = own["lang"].map(column).to_numpy(np.int64)
        keys, row = np.unique(codes, return_inverse=True)
        parents, parent = np.unique(codes >> np.uint32(8), return_inverse=True)
        total, distinct = np.zeros((len(parents), len(languages))), np.zeros((len(parents), len(languages)))
        np.add.at(total, (parent, lang), n)
        np.add.at(distinct, (parent, lang), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
        model.strings.append(Index(keys))
        model.contexts.append(Index(parents))
        model.escape.append(np.append(escape, np.zeros((1, len(languages))), axis=0).astype(np.float32))
        cost = model.fallback(keys, length) if len(keys) else np.zeros((0, len(languages)), np.float32)
        cost[row, lang] = -np.log2(n / (total[parent, lang] + distinct[parent, lang]))
        model.cost.append(np.append(cost, np.zeros((1, len(languages)), np.float32), axis=0))  # the row that place -1 reads
    return model


def predicted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] = (), keep_text: bool = False) -> DataFrame:
    """(id, lang_pred, score, bits) and the columns of ``carry`` for every row, in place; with ``keep_text`` also ``text``.

    ``und`` with score 0 if the text is null, empty or has no letter, or if nothing was learned.
    ``score`` is the best language's share of the per-byte likelihoods, ``bits`` its
    code length per byte.  Of equal code lengths the first language in code point order wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[bytes | None]) -> list[pa.Array]:
        own, n = shared.value, len(texts)
        known = [own is not None and t is not None and LETTER.search(t.decode("utf-8", "surrogatepass")) is not None for t in texts]
        lang, score, bits = [UNKNOWN] * n, [0.0] * n, [None] * n
        if any(known):
            texts = [t if k else b"" for t, k in zip(texts, known)]
            mean = own.totals(texts) / np.maximum(1, [len(t) for t in texts])[:, None]
            best = mean.argmin(axis=1)
            least = mean.min(axis=1)
            likely = 1 / np.exp2(least[:, None] - mean).sum(axis=1)
            for i in range(n):
                if known[i]:
                    lang[i], score[i], bits[i] = own.languages[best[i]], float(likely[i]), float(least[i])
        return [pa.array(lang), pa.array(score), pa.array(bits, pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, others = batch.column(1), [0, *range(1 if keep_text else 2, batch.num_columns)]
            low = 0
            while low < batch.num_rows:  # carried columns go through as they are, texts a slice at a time
                size, high = 0, low
                while high < batch.num_rows and (high == low or size < SLICE):
                    size += len(text[high].as_buffer() or b"")
                    high += 1
                found = score(text.slice(low, high - low).to_pylist())
                kept = [batch.column(i).slice(low, high - low) for i in others]
                yield pa.RecordBatch.from_arrays([*kept, *found], [*(batch.schema.names[i] for i in others), "lang_pred", "score", "bits"])
                low = high

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *carry)
    kinds = ", ".join(f"`{n}` {t}" for n, t in given.dtypes[:1] + given.dtypes[1 if keep_text else 2 :])
    found = map_batches(given, run, f"{kinds}, lang_pred string, score double, bits double")
    return found.withColumn("text", F.col("text").cast("string")) if keep_text else found
