"""SentencePiece encoding and decoding with a merge-type prefix table.

For every prefix of a normalised text exactly one piece can be the last of the prefix's
encoding.  An automaton over the vocabulary reports the pieces that end at a place;
the one that is the prefix's last is compatible with the last piece of the prefix
before it, which means that merging the two together leaves just these two.  With
the table filled, the ids are read backwards from the end.

No piece has a space mark after another character, so no merge crosses into a space
mark.  Nor does one go from a letter to a sign that follows no letter in any piece.  So a text is encoded
run by run: runs end before space marks, and between a letter and such a sign.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import Remembered, map_rows

MARK = "▁"
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and (c.isascii() or c >= "À"))


def runs_of(pieces: Iterable[str]) -> re.Pattern:
    """Cuts a text before space marks, and after a letter of ``LETTERS`` before a sign that follows none in any piece."""
    pairs = {pair for piece in pieces for pair in zip(piece, piece[1:])}
    signs = {c for c in map(chr, range(33, 127)) if not c.isalnum()} - {b for a, b in pairs if a in LETTERS}
    if not signs:
        return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
    sign = "".join(map(re.escape, sorted(signs)))
    return re.compile(rf"{MARK}*+[{sign}]*+[{LETTERS}]++(?={MARK}|[{sign}]|\Z)|{MARK}*+[^{MARK}]+|{MARK}+")


def _steps(edge: list[tuple[float | None, str | None]]) -> list[tuple[float, str]]:
    """(time, piece) of the merges at an edge; a merge waits for all that came before it in its piece."""
    out, time = [], float("inf")
    for score, piece in edge:
        if score is not None:
            time = min(time, score)
            if piece is not None:
                out.append((time, piece))
    return out


class PieceEncoder:
    """Encodes as the library does with the merge-type (BPE) model at ``path``."""

    def __init__(self, path: str, runs: int = 400_000, pairs: int = 2_000_000, longest: int = 40):
        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pairs, self.longest = pairs, longest
        plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(model.is_unused(i) for i in plain) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has unused pieces or pieces that cross a space")
        self.runs = runs_of(self.ids)
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.falls_back = model.is_byte(self.bytes[0])
        # Only a piece that its own encoding reproduces can be the last of a prefix.
        # Pieces have numbers here, so that a pair of neighbours is one number; characters that are no piece follow.
        self.automaton = ahocorasick.Automaton()
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.rights: dict[str, list[tuple[float, str]]] = {}
        self.lefts: dict[str, list[tuple[float, str]]] = {}
        for piece in self.ids:
            if self.merged(piece, (lefts := []), (rights := [])) == [piece]:
                self.automaton.add_word(piece, len(self.names))
                self.names.append(piece)
                self.sizes.append(len(piece))
                self.lefts[piece], self.rights[piece] = _steps(lefts), _steps(rights)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.own = [(self.ids[piece],) for piece in self.names]
        self.decimal = [str(i) for i in range(model.get_piece_size())]
        self.known = Remembered(runs)

    def merged(self, text: str, lefts: list | None = None, rights: list | None = None) -> list[str]:
        """Merging by definition: the neighbours of the best score, the leftmost of several, until none is a piece.

        ``lefts`` and ``rights`` get the (score, piece) of the merges at either edge.
        """
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            for edge, i in ((lefts, 0), (rights, len(parts) - 2)):
                if edge is not None:  # every merge counts as time passing, only those at the edge change it
                    edge.append((best, parts[i] + parts[i + 1] if at == i and best is not None else None))
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging ``left`` and ``right`` together leaves these two.

        The merges at the right edge of one and at the left edge of the other are replayed
        in the order of their scores; the two do not fit if the pieces that face each
        other become the best merge at any time.
        """
        a, b, scores = left[-1], right[0], self.scores
        ones, twos = self.rights.get(left, ()), self.lefts.get(right, ())
        i = j = 0
        never = float("-inf")
        while True:
            across = scores.get(a + b, never)
            one = ones[i][0] if i < len(ones) else never
            two = twos[j][0] if j < len(twos) else never
            if one >= across and one >= two and one != never:
                a = ones[i][1]
                i += 1
            elif across >= two and across != never:
                return False
            elif two != never:
                b = twos[j][1]
                j += 1
            else:
                return True

    def last_pieces(self, run: str) -> list[int]:
        """For every prefix of a run the number of its last piece, -1 if that is a character without a piece."""
        last = [-1] * (len(run) + 1)
        compatible, sizes, many = self.compatible, self.sizes, len(self.names)
        for end, piece in self.automaton.iter(run):
            end += 1
            if last[end] >= 0:
                continue
            start = end - sizes[piece]
            if start:
                before = last[start]
                if before < 0:  # a character that is no piece stands for itself
                    before = many + ord(run[start - 1])
                pair = before * many + piece
                fit = compatible.get(pair)
                if fit is None:
                    if len(compatible) >= self.pairs:
                        compatible.clear()
                    left = self.names[before] if before < many else chr(before - many)
                    fit = compatible[pair] = self.fits(left, self.names[piece])
                if not fit:
                    continue
            last[end] = piece
        return last

    def encoded(self, run: str) -> tuple[int, ...]:
        """Encoding of a run: the table of last pieces, then backwards from the end."""
        last, end, out = self.last_pieces(run), len(run), []
        while end:
            piece = last[end]
            if piece >= 0:
                out.append(self.own[piece])
                end -= self.sizes[piece]
            else:
                end -= 1
                out.append(self.alone(run[end]))
        return tuple(chain.from_iterable(out[::-1]))

    def alone(self, character: str) -> tuple[int, ...]:
        """Ids of a character that no usable piece spells."""
        if character in self.ids:
            return (self.ids[character],)
        if self.falls_back:
            return tuple(self.bytes[b] for b in character.encode("utf-8"))
        return (self.library.unk_id(),)

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """Ids of a whole text, and the same as decimal numbers joined by commas."""
        if not text:
            return [], ""
        runs = self.runs.findall(self.library.normalize(text))
        known = self.known
        found = list(map(known.young.get, runs))
        if None in found:
            for i, run in enumerate(runs):
                if found[i] is None:
                    found[i] = known.young.get(run) or known.again(run)
                    if found[i] is None:
                        found[i] = self.encoded(run)
                        if len(run) <= self.longest:
                            known.put(run, found[i])
        ids = list(chain.from_iterable(found))
        return ids, ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One per Python worker: its tables serve all its tasks."""
    return PieceEncoder(path)


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded, decoded_sha256) per row, in place, without a shuffle.

    Null and empty texts have no ids and decode to the empty text.  Texts of any length
    are encoded whole.  ``path`` names the model on every executor.  Without ``keep_ids``
    the ids and the decoded text are left out.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        own = encoder(path)
        for b in batches:
            out: dict[str, list] = {"id": b["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            if keep_ids:
                out |= {"ids": [], "decoded": []}
            for text in b["text"]:
                ids, written = own.encode(text)
                decoded = own.decode(ids) if ids else ""
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(written.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(decoded)
            yield out

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, schema)
