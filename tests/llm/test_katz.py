"""Katz scores against a plain model with exact counts, its normalisation, and the registered query on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, SF, awkward_rows

from chronopanel.llm import katz, queries

LIMIT = katz.DISCOUNTED


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [" end"]


class Plain:
    """The model as the module's text defines it, with dictionaries."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        self.history = [Counter() for _ in range(order + 1)]
        self.order = order
        for text in texts:
            line = [" start"] * (order - 1) + tokens(text)
            for i in range(order - 1, len(line)):
                for n in range(1, order + 1):
                    gram = tuple(line[i - n + 1 : i + 1])
                    self.counts[n][gram] += 1
                    self.history[n][gram[:-1]] += 1
        self.factor = [None] + [katz.discounts([sum(c == r for c in self.counts[n].values()) for r in range(1, LIMIT + 2)]) for n in range(1, order + 1)]
        self.after = [defaultdict(list) for _ in range(order + 1)]
        for n in range(1, order + 1):
            for gram in self.counts[n]:
                self.after[n][gram[:-1]].append(gram)

    @cache
    def parts(self, history):
        n = len(history) + 1
        grams = self.after[n][history]
        freed = sum((1 - self.factor[n][min(self.counts[n][g], LIMIT + 1)]) * self.counts[n][g] for g in grams)
        total = self.history[n][history]
        return (freed, total) if freed else (1.0, total + 1)

    def p(self, history, word):
        n = len(history) + 1
        c = self.counts[n][(*history, word)]
        freed, total = self.parts(history)
        if c:
            return self.factor[n][min(c, LIMIT + 1)] * c / total
        if n == 1:
            return freed / total
        if not self.history[n][history]:
            return self.p(history[1:], word)
        return freed / total / (1 - self.given(history)) * self.p(history[1:], word)

    @cache
    def given(self, history):
        return sum(self.p(history[1:], g[-1]) for g in self.after[len(history) + 1][history])

    def score(self, text):
        line = [" start"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(line[i - self.order + 1 : i]), line[i])) for i in range(self.order - 1, len(line)))

    def base(self, text):
        n, v = sum(self.counts[1].values()), len(self.counts[1])
        return sum(math.log10((self.counts[1][(t,)] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text))


def random_texts(seed, n=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weight = [1 / (1 + i) ** 1.2 for i in range(40)]
    return ["" if i % 19 == 7 else " ".join(draw.choices(words, weight, k=draw.randrange(1, 30))) for i in range(n)]


@pytest.mark.parametrize("order,chunk,part", [(1, 50, 10), (2, 100, 30), (3, 64, 20), (3, 1 << 20, 1 << 21)])
def test_against_plain_model(spark, order, chunk, part):
    texts = random_texts(order)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = F.col("doc_id") % 3 != 1
    plain = Plain([t for i, t in enumerate(texts) if i % 3 != 1], order)
    found = {r["id"]: r for r in katz.scored(df, train, order=order, chunk=chunk, part=part).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        r, line = found[i], tokens(text)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (i % 3 == 1, len(line), sum(plain.counts[1].values()))
        assert r["n_known"] == sum(plain.counts[1][(t,)] > 0 for t in line)
        assert r["score"] == pytest.approx(plain.score(text), rel=1e-9) and r["base_score"] == pytest.approx(plain.base(text), rel=1e-12)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_distributions_sum_to_one(order):
    """Of the plain model, which the operator's scores equal."""
    plain = Plain(random_texts(9), order)
    words = [g[0] for g in plain.counts[1]] + ["never seen"]
    histories = list(plain.after[order])[:40] + [("w1", "never")[-(order - 1) :] if order > 1 else ()]
    for h in histories:
        assert sum(plain.p(h, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_discounts():
    d = katz.discounts([1000, 400, 200, 120, 80, 55])
    share = 6 * 55 / 1000
    assert d[1] == pytest.approx((2 * 400 / 1000 - share) / (1 - share)) and d[6] == 1 and (d[1:6] < 1).all()
    # Freed at each count as Good-Turing frees it: together the share of the n-grams seen once.
    n = [1000, 400, 200, 120, 80]
    assert sum((1 - d[r]) * r * n[r - 1] for r in range(1, 6)) == pytest.approx(1000)
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 900, 1, 1, 1, 1]):
        assert list(katz.discounts(odd)) == [1, 0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9, 1]


def test_words_only_seen_often_leave_something_for_others(spark):
    rows = [(i, "a b a b a b a b") for i in range(9)] + [(100, "a c"), (101, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") < 100
    plain = Plain([t for i, t in rows if i < 100], 2)
    found = {r["id"]: r["score"] for r in katz.scored(df, train).collect()}
    assert found[100] == pytest.approx(plain.score("a c")) and found[101] == pytest.approx(plain.score("zz"))


def test_awkward_rows(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    train = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    plain = Plain([r[1] for r in rows if r[0] is None or r[0] % 5 != 1], 2)
    found = katz.scored(docs, train, chunk=500, part=100).collect()
    assert sorted(r["id"] for r in found if r["id"] is not None) == sorted(r[0] for r in rows if r[0] is not None)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        if r["id"] is not None and len(tokens(text[r["id"]])) < 1000:
            assert r["score"] == pytest.approx(plain.score(text[r["id"]])) and r["base_score"] == pytest.approx(plain.base(text[r["id"]]))
    assert sorted(r["n_tokens"] for r in found if r["id"] is None) == [1, len(tokens(rows[0][1]))]
    assert katz.scored(spark.createDataFrame([], SCHEMA), train).count() == 0
    untrained = katz.scored(docs, F.lit(False)).agg(F.min("score"), F.max("base_score"), F.max("train_tokens"), F.max("n_known")).first()
    assert tuple(untrained) == (0.0, 0.0, 0, 0)


def test_hashes_travel_whole():
    codes = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (katz.unpacked_codes(katz.packed_codes(codes), 1000) == codes).all()
    assert sum(s.stop - s.start for _, s in katz.parted(codes, 7)) == 1000


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 5 == 1 for d in docs}
    plain = Plain([d["text"] for d in docs if not held[d["doc_id"]]], 2)
    found = {r["doc_id"]: r for r in queries.op13_katz_scores(spark, SF).collect()}
    assert len(found) == len(docs)
    for d in docs:
        r = found[d["doc_id"]]
        assert r["held_out"] == held[d["doc_id"]] and r["n_known"] == sum(plain.counts[1][(t,)] > 0 for t in tokens(d["text"]))
        assert r["base_score"] == pytest.approx(plain.base(d["text"]), rel=1e-9)
        if len(tokens(d["text"])) < 300:
            assert r["score"] == pytest.approx(plain.score(d["text"]), rel=1e-9)
    assert sum(r["score"] for r in found.values() if r["held_out"]) > sum(r["base_score"] for r in found.values() if r["held_out"])
