"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template of t distinct shingles (five words, letters and digits only, lower case) is looked for in
windows of whole blocks of s shingles, s a power of two and about t / 4, long enough
that any t neighbouring shingles lie in one window.  A window then holds fewer than
t + 2s shingles, so one with 80 % of a template has a Jaccard similarity of at least
0.8 t / (t + 2s + 0.2 t) > 0.47.  With ``BANDS`` = 32 bands of ``ROWS`` = 2 minima the
window and the template share a band with probability 1 - (1 - 0.47^2)^32 > 0.9995; a
verbatim template (0.66) is missed with a chance below 10^-7.

Templates of fewer than ``SHORT`` shingles have windows of t shingles that begin at every shingle, and
``SHORT_BANDS`` = 12 bands of one minimum.  Up to four shingles 80 % of a template is all of it, so the sets
are equal and every band matches; with five to seven the similarity of such a window is at least 4 / 6 and the
chance to share no band at most (1 / 3)^12 < 2 * 10^-6.  A window shares a band if one of its shingles has
the template's minimum and no other of its shingles less, so only windows around such shingles are compared.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import map_rows
from chronopanel.llm.license_templates import TEMPLATES
from chronopanel.llm.shingles import MinHash, shingle_hashes, word_hashes

WORDS, PERCENT, ROWS, BANDS, SEED, SHORT, SHORT_BANDS = 5, 80, 2, 32, 77, 8, 12
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return TOKEN.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def shingles_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[i:] for i in range(WORDS))))


class Scanner:
    """Finds templates in texts; holds a few numbers per template."""

    def __init__(self, templates: dict[str, str], percent: int = PERCENT):
        self.percent = percent
        self.minhash = MinHash(ROWS * BANDS, SEED)
        self.sets = {name: frozenset(shingles_of(words_of(text))) for name, text in templates.items()}
        if not all(self.sets.values()):
            raise ValueError(f"a template needs {WORDS} words")
        #: Places in the template of the shingles that it has once.
        self.orders = {}
        for name, text in templates.items():
            run = shingles_of(words_of(text))
            counts = Counter(run)
            self.orders[name] = {x: i for i, x in enumerate(run) if counts[x] == 1}
        self.variants = {a: {b for b, x in self.sets.items() if a != b and 100 * len(own & x) >= percent * len(own)} for a, own in self.sets.items()}
        #: (block size, blocks of a window) -> band keys -> templates
        self.shapes: dict[tuple[int, int], dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
        #: minimum -> short templates with it, for every band
        self.short_minhash = MinHash(SHORT_BANDS, SEED + 1)
        self.short: list[dict[int, list[str]]] = [defaultdict(list) for _ in range(SHORT_BANDS)]
        for name, text in templates.items():
            t = len(self.sets[name])
            hashes = np.unique(shingle_hashes(word_hashes(words_of(text)), WORDS))
            if t < SHORT:
                for least, band in zip(self.short_minhash.values(hashes).min(axis=1).tolist(), self.short):
                    band[least].append(name)
                continue
            s = 1 << max(0, (t // 4).bit_length() - 1)
            # Any t shingles in a row start in some block and lie in t + s - 1 from its start.
            shape = (s, -(-(len(shingles_of(words_of(text))) + s - 1) // s))
            minima = self.minhash.values(hashes).min(axis=1)
            for key in self.keys(minima[:, None])[:, 0].tolist():
                self.shapes[shape][key].append(name)
        self.probes = {shape: self.probe(keys) for shape, keys in self.shapes.items()}
        self.short_probes = [self.probe(band) for band in self.short]

    @staticmethod
    def probe(keys: dict[int, list[str]]) -> np.ndarray:
        table = np.zeros(1 << 16, bool)
        table[np.array(list(keys), np.uint64) >> np.uint64(48)] = True
        return table

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """(bands, windows) band keys of (minima, windows)."""
        band = np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
        key = (minima[0::ROWS] * np.uint64(0x9E3779B97F4A7C15)) ^ (minima[1::ROWS] * np.uint64(0xC2B2AE3D27D4EB4F) + band)
        key ^= key >> np.uint64(29)
        return key * np.uint64(0xBF58476D1CE4E5B9)

    def candidates(self, words: list[bytes], part: int = 1 << 14) -> set[tuple[str, int, int]]:
        """(template, first shingle, end) of the windows that share a band with a template.

        A long text goes through in overlapping parts of bounded size.
        """
        hashes = shingle_hashes(word_hashes(words), WORDS) if len(words) >= WORDS else np.zeros(0, np.uint64)
        found: set[tuple[str, int, int]] = set()
        longest = max((s * q for s, q in self.shapes), default=0)
        for at in range(0, len(hashes), part):
            self._short_candidates(hashes[at : at + part + SHORT], at, found)
            if self.shapes:
                self._candidates(hashes[at : at + part + longest], at, found)
        return found

    def _short_candidates(self, hashes: np.ndarray, at: int, found: set[tuple[str, int, int]]) -> None:
        for values, names, probe in zip(self.short_minhash.values(hashes), self.short, self.short_probes):
            for p in probe[values >> np.uint64(48)].nonzero()[0].tolist():
                for name in names.get(int(values[p]), ()):
                    t = len(self.sets[name])
                    for w in range(max(0, p - t + 1), min(p, max(0, len(hashes) - t)) + 1):
                        if values[w : w + t].min() == values[p]:
                            found.add((name, at + w, at + min(len(hashes), w + t)))

    def _candidates(self, hashes: np.ndarray, at: int, found: set[tuple[str, int, int]]) -> None:
        values = self.minhash.values(hashes)
        blocks = {}
        for (s, q), names in self.shapes.items():
            if s not in blocks:
                blocks[s] = np.minimum.reduceat(values, np.arange(0, len(hashes), s), axis=1) if s > 1 else values
            least, own = blocks[s], blocks[s]
            count = max(1, own.shape[1] - q + 1)
            least = own[:, :count].copy() if own.shape[1] >= q else own.min(axis=1)[:, None]
            for i in range(1, q if own.shape[1] >= q else 1):
                np.minimum(least, own[:, i : i + count], out=least)
            keys = self.keys(least)
            band, window = self.probes[s, q][keys >> np.uint64(48)].nonzero()
            for b, w in zip(band.tolist(), window.tolist()):
                for name in names.get(int(keys[b, w]), ()):
                    found.add((name, at + w * s, at + min(len(hashes), (w + q) * s)))

    def occurrences(self, name: str, windows: list[tuple[int, int]], words: list[bytes]) -> list[tuple[int, int, float]]:
        """(first word, end, containment) of the occurrences of a template in its windows, best first; none overlap."""
        regions: list[list[tuple[int, int]]] = []
        upto = -1
        for window in windows:
            if window[0] > upto:
                regions.append([])
            regions[-1].append(window)
            upto = max(upto, window[1])
        found = [hit for region in regions for hit in self._occurrences(name, region, words)]
        return sorted(found, key=lambda h: (-h[2], h[0]))

    def _occurrences(self, name: str, windows: list[tuple[int, int]], words: list[bytes]) -> list[tuple[int, int, float]]:
        template, order = self.sets[name], self.orders[name]
        begin, longest = windows[0][0], max(end - first for first, end in windows)
        run = shingles_of(words[begin : max(end for _, end in windows) + WORDS - 1])
        inside = [i for i, x in enumerate(run) if x in template]
        gone = bytearray(len(run) + WORDS)
        found = []

        def shortest(places: list[int]) -> tuple[float, int, int] | None:
            """(containment, first, last) of the shortest stretch with all the shingles, if they are enough."""
            n = len({run[i] for i in places})
            if 100 * n < self.percent * len(template):
                return None
            counts: Counter = Counter()
            best, left = (places[0], places[-1]), 0
            for i in places:
                counts[run[i]] += 1
                while counts[run[places[left]]] > 1:
                    counts[run[places[left]]] -= 1
                    left += 1
                if len(counts) == n and i - places[left] < best[1] - best[0]:
                    best = (places[left], i)
            return n / len(template), *best

        def take(hit: tuple[float, int, int]) -> None:
            share, first, last = hit
            if not any(gone[first : last + WORDS]):
                gone[first : last + WORDS] = b"\1" * (last + WORDS - first)
                found.append((begin + first, begin + last + WORDS, share))

        # Copies in the order of the template: a new one starts where the order restarts.
        copies: list[list[int]] = [[]]
        seen: set[int] = set()
        before = 0
        for i in inside:
            at = order.get(run[i])
            if at is not None:
                if at in seen or before - at >= len(template) / 2:
                    copies.append([])
                    seen.clear()
                seen.add(at)
                before = at
            copies[-1].append(i)
        for hit in filter(None, map(shortest, filter(None, copies))):
            if hit[2] - hit[1] < longest:
                take(hit)
        # What is left, in any order, window by window and best first.
        while True:
            hits = set()
            for first, end in windows:
                pieces: list[list[int]] = [[]]
                for i in inside[bisect_left(inside, first - begin) : bisect_left(inside, end - begin)]:
                    if not gone[i]:
                        pieces[-1].append(i)
                    elif pieces[-1]:
                        pieces.append([])
                hits.update(filter(None, map(shortest, filter(None, pieces))))
            taken = len(found)
            for hit in sorted(hits, key=lambda h: (-h[0], h[2] - h[1], h[1])):
                take(hit)
            if len(found) == taken:
                return found

    def own(self, hit: tuple[str, int, int, float], hits: list[tuple[str, int, int, float]], words: list[bytes]) -> bool:
        """Whether a hit stands beside the larger ones of its variants, templates that hold its shingles as well.

        Where a variant matches more shingles, the words it has more are no insertions: t shingles in a row must hold enough.
        """
        name, first, end, share = hit
        template = self.sets[name]
        least = self.percent * len(template)
        if not self.variants[name]:
            return True
        held = share * len(template) + 0.5
        if not any(h[1] < end and first < h[2] and h[3] * len(self.sets[h[0]]) > held for h in hits if h[0] in self.variants[name]):
            return True
        run = shingles_of(words[first:end])
        return any(100 * len(template.intersection(run[i : i + len(template)])) >= least for i in range(max(1, len(run) - len(template) + 1)))

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first character, end character, containment) of every verified occurrence, best first within a template."""
        words = words_of(text)
        windows: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for name, first, end in self.candidates(words):
            windows[name].append((first, end))
        kept = [(name, *hit) for name in sorted(windows) for hit in self.occurrences(name, sorted(windows[name]), words)]
        kept = [hit for hit in kept if self.own(hit, kept, words)]
        if not kept:
            return []
        data = text.encode("utf-8", "surrogatepass")
        spans = [m.span() for m in TOKEN.finditer(data.lower())]
        chars = lambda n: len(data[:n].decode("utf-8", "replace"))
        return [(name, chars(spans[first][0]), chars(spans[end - 1][1]), share) for name, first, end, share in kept]


def license_matches(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, template, first_char, end_char, containment) of every occurrence of a template in whole texts.

    Rows are scanned where they lie, without a shuffle; the templates travel with the
    tasks, a few numbers for each.  Null and empty texts, texts under five words and an empty table
    have no occurrences; equal rows report each for itself; ids may be null.  Occurrences of one
    template do not overlap: copies one after the other are told apart by the template's order, others by containment.  A notice that holds
    80 % of another version's, as those of GNU licences do, is reported for both; the containment tells them apart.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        scanner = Scanner(templates, percent)
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("id", "template", "first_char", "end_char", "containment")}
            for i, text in zip(b["id"], b["text"]):
                for hit in scanner.scan(text):
                    for name, value in zip(out, (i, *hit)):
                        out[name].append(value)
            yield out

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(given, rows, "id long, template string, first_char long, end_char long, containment double")
