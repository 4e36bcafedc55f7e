"""Language identification against a plain context model; many and rare languages; the pipeline run as a whole."""

import random
from collections import Counter, defaultdict
from math import log2

import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, awkward_rows, prose

import corpus_pipeline
from chronopanel.llm import language_id


class Plain:
    """Escape method C over bytes, contexts of 0 to 3 bytes, with dictionaries."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for text in texts:
            data = language_id.START + text.encode()
            for i in range(3, len(data)):
                for n in range(4):
                    self.after[data[i - n : i]][data[i]] += 1

    def bits(self, text):
        data = language_id.START + text.encode()
        return sum(self.byte(data[i - 3 : i], data[i]) for i in range(3, len(data)))

    def byte(self, context, byte):
        found = self.after.get(context, Counter())
        total, distinct = sum(found.values()), len(found)
        if byte in found:
            return -log2(found[byte] / (total + distinct))
        escape = -log2(distinct / (total + distinct)) if total else 0
        return escape + (self.byte(context[1:], byte) if context else 8.0)


def test_code_lengths_against_plain_model(spark):
    rows = [(prose(i, 40), "a") for i in range(6)] + [(f"ön ça {prose(i, 15).upper()}", "b") for i in range(5)] + [(None, "a"), ("", "b"), ("no label", None)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    plain = {lang: Plain([t for t, own in rows if t and own == lang]) for lang in "ab"}
    texts = ["bada ki", "ÇA ön", "zzz 中 x", rows[0][0], rows[7][0], "q"]
    for text, bits in zip(texts, model.totals([t.encode() for t in texts])):
        assert list(bits) == [pytest.approx(plain[lang].bits(text), rel=1e-5) for lang in "ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in language_id.predicted(df, model).collect():
        own = {lang: plain[lang].bits(texts[r["id"]]) / len(texts[r["id"]].encode()) for lang in "ab"}
        best = min(own, key=own.get)
        assert r["lang_pred"] == best and r["bits"] == pytest.approx(own[best], rel=1e-5)
        assert r["score"] == pytest.approx(1 / sum(2 ** (own[best] - v) for v in own.values()), rel=1e-4)


def test_many_languages_and_a_rare_one(spark):
    """Every language is learned and keeps strings of its own, however many rows the others have."""
    letters = [chr(0x400 + i) for i in range(250)]
    draw = random.Random(1)
    rows = [("".join(draw.choices(letters[i % 250 :][:4] + [chr(0x4E00 + i)], k=30)), f"l{i:03}") for i in range(300)]
    rows += [(prose(i, 60), "frequent") for i in range(200)] * 2
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), contexts=400)
    assert len(model.languages) == 301
    rare = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[:300])], "doc_id long, text string")
    found = {r["id"]: r["lang_pred"] for r in language_id.predicted(rare, model).collect()}
    assert sum(found[i] == rows[i][1] for i in range(300)) >= 295


def test_copies_do_not_pass_the_bound_of_the_sample(spark):
    rows = [("the same text", "a")] * 500 + [(f"text {i}", "a") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    few = language_id.train(df, sample=20)
    # Twenty different texts at most: their first byte after the start is counted once each.
    assert few.languages == ["a"] and len(few.strings[1].keys) <= len(set("the same text0123456789"))
    one = language_id.train(df.where("text = 'the same text'"), sample=20)
    assert list(one.totals([b"the same text"])[0]) == [pytest.approx(Plain(["the same text"]).bits("the same text"), rel=1e-5)]


@pytest.mark.parametrize("text,known", [("½ ² Ⅷ ①", False), ("12_34", False), ("é", True), ("中", True)])
def test_only_letters_have_a_language(spark, text, known):
    model = language_id.train(spark.createDataFrame([("some text", "en")], "text string, lang string"))
    row = language_id.predicted(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert (row["lang_pred"] != "und") == known


def test_pipeline_as_a_whole(spark, tmp_path):
    """``run`` gives what its stages give one after the other, with names that clash and without rows."""
    docs = spark.createDataFrame(awkward_rows(), SCHEMA).where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256").collect())
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        assert name == "sentencepiece" or step.columns == docs.columns
    assert found == sorted(tuple(r) for r in step.select("doc_id", "n_tokens", "ids_sha256").collect()) and found
