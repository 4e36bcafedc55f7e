"""Periodic runs against a search over all periods, and the registered query against the same."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from test_llm import SCHEMA, SF, awkward_rows

from chronopanel.llm import periodic_runs, queries


def plain_runs(words):
    """Every stretch that agrees with itself ``period`` words on, smallest period first."""
    found = {}
    for period in range(1, len(words) // 4 + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i + period - start >= max(6, 4 * period) and i > start:
                found.setdefault((start, i + period), period)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapsed(words, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def random_text(draw):
    words = [b"%d" % draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.choice([0, 1, 5, 6, 7, 20, 60, 200]))]
    n = len(words)
    if n and draw.random() < 0.6:
        a = draw.randrange(n)
        for i in range(a + 1 + (n - a) // draw.randint(3, 10), n):
            words[i] = words[i - 1 - (n - a) // 5]
        if draw.random() < 0.3:
            words[draw.randrange(n)] = b"x"
    return words


@pytest.mark.parametrize("piece", [1, 3, 64, 1 << 16])
def test_every_run_is_caught_however_words_are_appended(monkeypatch, piece):
    monkeypatch.setattr(periodic_runs, "PIECE", piece)
    draw = random.Random(piece)
    for _ in range(120):
        texts = [random_text(draw) for _ in range(draw.randint(1, 6))]
        assert periodic_runs.runs_of(texts) == [plain_runs(w) for w in texts]


def test_equal_hashes_of_different_words_make_no_run(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_mixed", lambda x: x * 0)
    draw = random.Random(4)
    for _ in range(40):
        words = [b"%d" % draw.randrange(2) for _ in range(30)]
        for start, length, period in periodic_runs.runs_of([words])[0]:
            assert all(words[i] == words[i + period] for i in range(start, start + length - period))


def test_long_texts():
    one, alternating = [b"a"] * 60_000, ([b"a"] * 6 + [b"b"]) * 9_000
    assert periodic_runs.runs_of([one, alternating, []])[0] == [(0, 60_000, 1)]
    found = periodic_runs.runs_of([alternating])[0]
    assert (0, 63_000, 7) in found and len(found) == 9_001


def test_rows(spark):
    rows = awkward_rows() + [(900, "la " * 9 + "di da " * 5, "en", None, 0, "o", "x", 1.0, "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted(((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()), key=repr)
    want = []
    for r in rows:
        words = words_of(r[1])
        runs = plain_runs(words) if len(words) < 10_000 else []
        want.append((r[0], len(words), runs, plain_collapsed(words, runs)))
    assert found == sorted(want, key=repr) and any(r[2] for r in found)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark):
    found = {r["doc_id"]: r.asDict() for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(found) == len(docs)
    with_runs = 0
    for doc in docs:
        words = planted(doc["doc_id"], words_of(doc["text"]))
        if len(words) > 3_000:
            continue
        runs = plain_runs(words)
        with_runs += bool(runs)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert found[doc["doc_id"]] == {
            "doc_id": doc["doc_id"],
            "n_runs": len(runs),
            "start": best and best[0],
            "length": best and best[1],
            "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest(),
        }
    assert with_runs > 5
