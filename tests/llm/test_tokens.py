"""Tokens: pieces of texts are cut where the pattern ends a word, and every text has the library's ids."""

import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from chronopanel.llm import token_blocks

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def own():
    return token_blocks.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def check(own, texts):
    found = own.encode_all(pa.array(texts, pa.string()))
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids, text


def test_words_are_known_without_what_follows_them(own):
    text = "un mot, deux mots. Mot!! it's éé, x"
    check(own, [text])
    known = own.known.young
    assert " mot" in known and " éé" in known and "'s" in known
    assert " mot," not in known and " éé," not in known and " it's" not in known


def test_every_text_has_the_ids_of_the_library(own):
    draw, letters = np.random.default_rng(5), list("ab'stre Éß÷×é,.;!1²…́  \n\t_😀中")
    texts = ["".join(draw.choice(letters, n)) for n in draw.integers(0, 30, 4000)]
    texts += ["", " ", "a", " a", "a ", "a\x1cb", "a<|endoftext|>b", "<| endoftext|>", "we'll, I'd", "x'", "''s", "é,×,÷,", "word " * 300 + "z"]
    check(own, texts)
    check(own, [])
    sliced = pa.array(["first", *texts], pa.string())[1:]
    assert own.encode_all(sliced) == own.encode_all(sliced.cast(pa.large_string())) == [own.encode(t) for t in texts]


def test_white_space_is_that_of_the_pattern(own):
    space = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
    check(own, [t for c in space for t in (f"a{c}b", f"a{c}{c}b", f"{c}b, c", f"a, b{c}", f"a {c}b", f"a{c} b")])
    latin = [chr(i) for i in range(0x21, 0x250) if unicodedata.category(chr(i)) != "Cc"]
    check(own, [f"b {c}, x{c}1{c}!{c}'s {c}{c}. " + "z" for c in latin])


def test_blocks_have_wide_ids_too(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab, cd " * (i % 5) + "e") for i in range(60)], "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for end in (2, 70_000):
        token_blocks.write_blocks(docs, str(tmp_path / str(end)), path, end_id=end, block=40)
        found = token_blocks.read_blocks(spark, str(tmp_path / str(end))).orderBy("doc_id").collect()
        library, at = token_blocks.tokenizer(path).library, 0
        for r, d in zip(found, docs.orderBy("doc_id").collect(), strict=True):
            assert (r["ids"], r["start"]) == (library.encode(d["text"], add_special_tokens=False).ids + [end], at)
            at += r["n_tokens"]
