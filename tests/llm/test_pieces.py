"""SentencePiece runs: cut between a letter and a sign where no piece goes across, with the library's ids."""

import numpy as np
import pytest

from chronopanel.llm import sentencepieces

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def own():
    return sentencepieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))


def test_words_are_known_without_signs_after_them(own):
    own.encode("un mot, deux mots. Mot!! éé, x")
    known = own.known.young
    assert "▁mot" in known and "▁éé" in known and "," in known
    assert "▁mot," not in known and "▁éé," not in known


def test_every_text_has_the_ids_of_the_library(own):
    draw, letters = np.random.default_rng(6), list("ab'stre Éß÷×é,.;!1²…»́▁  \n\t_😀中(\")")
    texts = ["".join(draw.choice(letters, n)) for n in draw.integers(0, 30, 4000)]
    texts += [f"{a}{b}{c} {b}{a}" for a in "eZé1²…»中" for b in map(chr, range(33, 127)) for c in ("", "a", ".")]
    for text in texts:
        ids = own.library.encode(text)
        assert own.encode(text) == (ids, ",".join(map(str, ids))), text


def test_no_cut_where_a_piece_goes_across():
    cut = sentencepieces.runs_of(["a", ".", "a.", "▁b", "b,c"]).findall
    assert cut("▁ab!c▁a.b!c▁▁b,c") == ["▁ab", "!c", "▁a.b!c", "▁▁b,c"] and cut("▁▁") == ["▁▁"] and cut("") == []
    assert cut("x…!y!") == ["x…!y!"] and "".join(cut("é!…,b;")) == "é!…,b;"
