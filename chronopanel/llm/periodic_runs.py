"""Runs of repeated phrases, found online by catchers over completed power-of-two blocks of words.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(6, 4 * q)``
words that no neighbouring word extends.  Words are appended a piece at a time.  Whenever a block
of ``2**k`` words is complete, a catcher watches the following words for the block's return at
every distance from ``2 * 2**k`` to below ``4 * 2**k``; a return means that the suffix just
appended agrees with the text that far back.  A square of half length ``p`` has a block of at least
``p / 4`` words in its first half, so its catcher meets it; four periods hold five such
blocks in a row, so a distance at which five catchers in a row report is a chain of squares.  Chains
are followed until they break, widened by single words, confirmed on the words themselves and
merged into runs: chains over the same stretch at multiples of a period are one run.

Catchers of one level advance together over a piece of appended words (numpy comparisons of
the blocks' hashes), so a word costs some ten nanoseconds per level and there are as many levels as
the logarithm of the longest text has bits.  Each level keeps the last ``5 * 2**k`` hashes.

Texts are independent, so the work is a map over rows.  Null, empty and blank texts have no words and no run.
Every row counts by itself, also if ids are null or repeated.  Texts of any length are taken whole; what
a task holds is one Arrow batch plus ``GROUP_WORDS`` words, or one text if that is longer.  Equal extent
and period mean one run; runs of different periods may overlap and are all reported, in order of start
and period.  Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import map_batches

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Catchers in a row that four periods are sure to meet.
CHAIN = 5
#: Words appended at a time, and words of short texts that are searched together.
PIECE, GROUP_WORDS = 1 << 16, 1 << 18

_U = np.uint64
_A, _M = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)

RUNS = "array<struct<start:long,length:long,period:long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _M
    x ^= x >> _U(29)
    return x


class Level:
    """The catchers of all blocks of one size; they report distances from ``low`` to below ``high``."""

    def __init__(self, block: int, low: int, high: int):
        self.block, self.low, self.high = block, low, high
        self.base = 0  # the next block to decide starts at this word; hashes before it are forgotten
        self.hashes = np.empty(0, _U)
        self.last = np.zeros((0, high - low), bool)  # reports of the latest blocks
        self.open = np.full(high - low, -1)  # first block of a chain that has not broken yet, by distance

    def hashed(self) -> int:
        """Words up to which every window of ``block`` words has its hash."""
        return self.base + len(self.hashes)

    def advance(self, closing: bool) -> list[tuple[int, int, int]]:
        """Decide all blocks whose distances are known; the chains that broke as (start, end, distance)."""
        size, low, high = self.block, self.low, self.high
        if closing:  # what follows the last word is unlike anything
            self.hashes = np.append(self.hashes, np.arange(1, high + 1, dtype=_U) * _A)
        count = (len(self.hashes) - high) // size + 1 if len(self.hashes) >= high else 0
        if count <= 0:
            return []
        ahead = sliding_window_view(self.hashes[low:], high - low)[: (count - 1) * size + 1 : size]
        found = ahead == self.hashes[: (count - 1) * size + 1 : size, None]
        first = self.base // size - len(self.last)
        rows = np.vstack([self.last, found]) if len(self.last) else found
        self.base += count * size
        self.hashes = self.hashes[count * size :].copy()
        self.last = rows[max(0, len(rows) - CHAIN + 1) :].copy()
        if len(rows) < CHAIN:
            return []
        chain = rows[: len(rows) - CHAIN + 1]
        for i in range(1, CHAIN):
            chain = chain & rows[i : len(rows) - CHAIN + 1 + i]
        return self._broken(chain, first, closing)

    def _broken(self, chain: np.ndarray, first: int, closing: bool) -> list[tuple[int, int, int]]:
        """Pairs of first and last block of every chain; those that go on stay open."""
        if not chain.any() and (self.open < 0).all():
            return []
        edge = np.zeros((1, chain.shape[1]), bool)
        before = np.vstack([(self.open >= 0)[None], chain])
        after = np.vstack([chain, edge])
        # Column by column, so that the i-th start belongs to the i-th end.
        column, start = np.nonzero((before & ~np.vstack([edge, before[:-1]])).T)
        _, end = np.nonzero((before & ~after).T)
        starts = np.where(start > 0, first + start - 1, self.open[column])
        goes_on = (end == len(chain)) & (not closing)
        self.open = np.full(chain.shape[1], -1)
        self.open[column[goes_on]] = starts[goes_on]
        done = ~goes_on
        distance = column[done] + self.low
        ends = (first + end[done] - 1 + CHAIN) * self.block + distance
        return list(zip((starts[done] * self.block).tolist(), ends.tolist(), distance.tolist()))


class SquareCatcher:
    """Runs of a growing sequence of numbered words; ``longest`` bounds the length of a run."""

    def __init__(self, longest: int):
        self.words = np.empty(PIECE, np.int64)
        self.size = 0
        self.levels = [Level(1, 1, 2)]
        while 2 * self.levels[-1].high <= 2 * max(longest // LEAST_PERIODS, 1):
            block = 1 if len(self.levels) == 1 else 2 * self.levels[-1].block
            self.levels.append(Level(block, 2 * block, 4 * block))
        self.found: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        """Append words and let every catcher compare them."""
        size = self.size + len(words)
        if size > len(self.words):
            self.words = np.resize(self.words, max(size, 2 * len(self.words)))
        self.words[self.size : size] = words
        self.size = size
        self._advance(False)

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period), by start, then period."""
        self._advance(True)
        return sorted((s, e - s, p) for (s, e), p in self.found.items())

    def _advance(self, closing: bool) -> None:
        lower = None
        for level in self.levels:
            if lower is None or level.block == 1:
                new = _mixed(self.words[level.hashed() : self.size].astype(_U) * _A + _U(1))
            else:
                half, at = level.block // 2, level.hashed()
                left = lower[1][at - lower[0] :]
                new = _mixed(left[: max(0, len(left) - half)] * _A + left[half:]) if len(left) > half else left[:0].copy()
            level.hashes = np.append(level.hashes, new)
            lower = (level.base, level.hashes)
        for level in self.levels:  # after all levels have their hashes: deciding forgets them
            chains = level.advance(closing)
            if chains:
                self._merge(chains, level.block)

    def _merge(self, chains: list[tuple[int, int, int]], block: int) -> None:
        """Widen chains to whole stretches and keep them as runs, unless they lie in a run of a smaller period."""
        known = np.array(sorted(self.found), np.int64).reshape(-1, 2)
        starts, reach = known[:, 0], np.maximum.accumulate(known[:, 1]) if len(known) else known[:, 1]
        spans = np.array(chains, np.int64)
        before = np.searchsorted(starts, spans[:, 0], "right") - 1
        inside = (before >= 0) & (reach[before] >= spans[:, 1]) if len(known) else np.zeros(len(spans), bool)
        w = self.words
        for start, end, period in spans[~inside].tolist():
            low = max(0, start - block)
            differ = np.flatnonzero(w[low:start] != w[low + period : start + period])
            start = low + int(differ[-1]) + 1 if len(differ) else low
            high = min(self.size, end + block)
            differ = np.flatnonzero(w[end:high] != w[end - period : high - period])
            end = end + int(differ[0]) if len(differ) else high
            for s, e in _agreeing(w[start : end - period] == w[start + period : end]):
                s, e = start + s, start + e + period
                if e - s >= max(LEAST_WORDS, LEAST_PERIODS * period):
                    self.found[s, e] = min(period, self.found.get((s, e), period))


def _agreeing(equal: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of true values; one, unless hashes of different words were equal."""
    if equal.all():
        return [(0, len(equal))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


class Numbers(dict):
    """A number for every distinct word."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of every text as (start, length, period); the texts are one sequence, parted by words of their own."""
    numbers = Numbers()
    catcher = SquareCatcher(max(map(len, texts), default=0))
    borders = np.cumsum([0] + [len(words) + 1 for words in texts])
    line = np.empty(borders[-1], np.int64)
    for i, words in enumerate(texts):
        line[borders[i] : borders[i + 1] - 1] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        line[borders[i + 1] - 1] = -1 - i
    for at in range(0, len(line), PIECE):
        catcher.append(line[at : at + PIECE])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catcher.finish():
        i = int(np.searchsorted(borders, start, "right")) - 1
        found[i].append((start - int(borders[i]), length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def groups(sizes: list[int]) -> Iterator[list[int]]:
    """Rows in groups of similar sizes (so that short texts need no catchers for long periods), up to GROUP_WORDS words each."""
    group, words = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and (words + sizes[i] > GROUP_WORDS or sizes[i].bit_length() > sizes[group[0]].bit_length() + 1):
            yield group
            group, words = [], 0
        group.append(i)
        words += sizes[i]
    if group:
        yield group


def periodic_runs(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
    edit_by: Column | None = None,
) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row: its runs by start and period, and the text with every run cut to one period.

    ``edit`` may change the words of a row before the search; it gets the row's ``edit_by`` and the words.
    """
    key = F.col(f"`{id}`")
    taken = docs.select(key.alias("id"), (F.lit(None).cast("long") if edit_by is None else edit_by).alias("by"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = f"id {taken.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Lengths in bytes stand for lengths in words here, so that only one group's words exist at a time.
            for group in groups([(n or 0) // 6 for n in pc.binary_length(batch.column("text")).to_pylist()]):
                part = batch.take(pa.array(group))
                words = [(t or b"").split() for t in part.column("text").to_pylist()]
                if edit is not None:
                    words = [edit(by, w) for by, w in zip(part.column("by").to_pylist(), words)]
                runs = runs_of(words)
                flat = [r for row in runs for r in row]
                offsets = pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32())
                fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                        pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return map_batches(taken, run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(crc: int | None, words: list[bytes]) -> list[bytes]:
    """Make the last part of every tenth text periodic: texts whose number ends in 0 repeat some words to their end."""
    n = len(words)
    if crc is None or crc % 10 or not n:
        return words
    g = crc // 10
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]
