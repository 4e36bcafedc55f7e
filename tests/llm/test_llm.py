"""Operators for training data against brute force, on a fixture of awkward rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronopanel.llm import exact_dedup, fingerprint, language_id, license_scan, line_dedup, minhash_dedup, mixing, queries, sentencepieces, token_blocks, warc
from chronopanel.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __order string, id string, key double, size string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n):
    draw = random.Random(seed)
    words = [a + b for a in "ba ki lo mun ter".split() for b in "da fe sil tor un wa".split()]
    return " ".join(draw.choice(words) + ("." if i % 9 == 8 else "") for i in range(n))


def awkward_rows():
    base = prose(1, 120)
    near = base.replace(base.split()[60], "other", 1)
    texts = [base, near, base.replace(" ", "  ", 3), base.upper(), None, "", "  \n\t ", "one", "one two", "One  two", "é", "12 34 !!"]
    texts += [prose(2, 80) + "\n" + prose(3, 60), prose(4, 30) + "\n" + prose(3, 60) + "\n" + prose(5, 20), prose(6, 30_000), "x" * 50_000, "a▁b <s> \x1d \U0001f642 <|endoftext|>"]
    texts += [prose(7, 40) + " Released under the MIT License. " + prose(8, 40)] * 3
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3"][i % 4], 0, "o", "x", 1.0, "s") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components_of(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    want = components_of(links, linked)
    assert found == want


def shingles(text, n=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def test_near_duplicates(docs, none, rows):
    found = [(r["id"], r["n_shingles"], r["component"]) for r in minhash_dedup.near_duplicates(docs, words=2).collect()]
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(links, ids)
    assert links and sorted(x for x in found if x[0] is not None) == sorted((r[0], len(sets[r[0]]), want[r[0]]) for r in rows if r[0] is not None)
    assert [x[2] for x in found if x[0] is None] == [None, None]
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Chains of near copies, several of which share their buckets, in many small blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    base = prose(11, 90).split()
    texts = []
    for i in range(60):
        own = list(base)
        for k in range(3 + i % 7):
            own[(7 * i + 11 * k) % 90] = f"new{i}x{k}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(links, range(60))
    assert len(set(want.values())) > 3 and links
    assert {r["id"]: r["component"] for r in minhash_dedup.near_duplicates(df, words=2).collect()} == want


def test_b_bit_estimate():
    draw = np.random.default_rng(5)
    a = draw.integers(0, 1 << 63, 252, dtype=np.uint64)
    b = np.where(draw.random(252) < 0.7, a, draw.integers(0, 1 << 63, 252, dtype=np.uint64))
    one, two = (np.frombuffer(minhash_dedup.pack(x), np.uint8) for x in (a, b))
    assert minhash_dedup.matches(one, two[None])[0] == ((a & np.uint64(15)) == (b & np.uint64(15))).sum()
    assert abs(minhash_dedup.estimate(minhash_dedup.matches(one, two[None])[0], 252) - 0.7) < 0.12


def test_exact_dedup(docs, none, rows):
    found = exact_dedup.marked(docs).collect()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(plain(r[1]), []).append(r[0])
    for r in found:
        ids = groups[plain(r["text"])]
        known = [i for i in ids if i is not None]
        assert (r["__keep_id"], r["__group_size"], r["__sha256"]) == (min(known, default=None), len(ids), sha(plain(r["text"])))
    assert len(found) == len(rows) and sum(r["__kept"] for r in found) == len(groups)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.marked(none).count() == 0


def test_exact_dedup_tells_collisions_apart(docs, rows, monkeypatch):
    md5 = F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: md5(F.substring(c, 1, 2)))
    found = exact_dedup.marked(docs).collect()
    assert sum(r["__kept"] for r in found) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})


def test_mixing(docs, none, rows):
    found = mixing.mixed(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = {}
    for r in rows:
        by_source[r[3]] = by_source.get(r[3], 0) + size(r[1])
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(by_source.values()) - sum(target.values())
        full = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) >= 2 * by_source[s]}
        if not full:
            break
        target |= {s: 2 * by_source[s] for s in full}
        open_ -= full
    target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
    taken = {}
    for r in found:
        assert r["__size"] == size(r["text"]) and r["__source_size"] == by_source[r["source"]] and 0 <= r["__times"] <= 2
        assert r["__target"] == pytest.approx(target[r["source"]])
        taken.setdefault(r["source"], []).append(r["__size"] * r["__times"])
    assert len(found) == len(rows)
    for s, sizes in taken.items():
        assert abs(sum(sizes) - target[s]) <= max(size(r[1]) for r in rows if r[3] == s)
    again = mixing.mixture(docs)
    assert again.columns == docs.columns and again.count() == sum(r["__times"] for r in found)
    assert mixing.mixed(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_queries_with_sql(spark):
    from oracle import database, difference

    con = database(SF)
    for name, sql in queries.ORACLES.items():
        assert difference(queries.QUERIES[name](spark, SF), con, sql) is None


def test_fingerprints(spark, docs, none, rows):
    found = fingerprint.with_edits(docs).select("id", "n_chars", "edited", fingerprint.written(F.col("v")).alias("f"), fingerprint.likeness(F.col("v"), F.col("ve")).alias("l")).collect()
    first = {}
    for r in rows:
        first.setdefault(r[0], r[1] or "")
    order = sorted([i for i in first if i is not None], reverse=True) + [None]
    after = dict(zip(order, order[1:] + order[:1]))
    assert len(found) == len(rows)
    for r in found:
        if r["id"] is not None:
            text, follow = first[r["id"]], first[after[r["id"]]]
            third = len(text) // 3
            if after[r["id"]] is not None:
                assert r["edited"] == text[: len(text) - third] + follow[:third]
            assert r["n_chars"] == len(text) and 0 <= r["l"] <= 1
    by_text = {}
    for r in found:
        if r["id"] is not None:
            by_text.setdefault(first[r["id"]], set()).add(r["f"])
    assert all(len(x) == 1 for x in by_text.values()) and len({f for x in by_text.values() for f in x}) >= len(by_text) - 2
    assert fingerprint.with_edits(none).count() == 0


def test_fingerprint_algebra(spark):
    df = spark.createDataFrame([("a b.\nc d.", "e f.", "c d.\ne f.\na b.")], "x string, y string, z string")
    v = {c: fingerprint.vector(F.col(c)) for c in "xyz"}
    both = fingerprint.inserted(v["x"], v["y"])
    r = df.select((both == v["z"]).alias("sum"), (fingerprint.deleted(both, v["y"]) == v["x"]).alias("difference"), fingerprint.likeness(v["x"], v["y"]).alias("low"), fingerprint.likeness(both, v["x"]).alias("high")).first()
    assert r["sum"] and r["difference"] and r["low"] < 0.3 < 0.6 < r["high"] < 1


def test_sentencepieces(docs, none, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = sentencepieces.round_trips(docs, path).collect()
    library = sentencepieces.encoder(path).library
    want = {}
    for t in {r[1] for r in rows}:
        ids = library.encode(t or "")
        want[t] = (ids, library.decode(ids) if ids else "")
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in found:
        if r["id"] is not None:
            ids, back = want[texts[r["id"]]]
            assert (r["ids"], r["n_tokens"], r["decoded"], r["ids_sha256"], r["decoded_sha256"]) == (ids, len(ids), back, sha(",".join(map(str, ids))), sha(back))
    assert len(found) == len(rows) and sentencepieces.round_trips(none, path).count() == 0


def test_pieces_fit_as_merging_says():
    own = sentencepieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    draw, pieces = random.Random(2), sorted(own.rights)
    for _ in range(3000):
        a, b = draw.choice(pieces), draw.choice(pieces)
        assert own.fits(a, b) == (own.merged(a + b) == [a, b])
    for _ in range(2000):
        text = "".join(draw.choice("abceinrst  -=\n1é▁ß") for _ in range(draw.randint(1, 25)))
        assert own.encode(text)[0] == own.library.encode(text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_language_held_out(spark):
    found = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_language(docs, none):
    model = language_id.train(docs)
    assert model.languages == ["en", "fr"]
    found = {r["text"]: r for r in language_id.predicted(docs, model, carry=[F.col("text").alias("t")]).withColumnRenamed("t", "text").collect()}
    assert {found[t]["lang_pred"] for t in (None, "", "  \n\t ", "12 34 !!")} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found["one"]["lang_pred"] in ("en", "fr")
    # Code lengths of whole texts do not depend on how they are cut.
    long = [t.encode() for t in found if t and len(t) > 1000]
    assert np.allclose(model.totals(long), model.totals(long, cells=8192 * 2), rtol=1e-5)
    assert language_id.train(none) is None and language_id.predicted(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predicted(docs, None).collect()} == {"und"}


def test_ppm_by_hand(spark):
    model = language_id.train(spark.createDataFrame([("abab", "x")], "text string, lang string"))
    # After "b" came "a" once: 1 of (1 + 1); "b" never came after "b": escape 1/2, then order 0 with 2 of (4 + 2).
    code = lambda s: np.array([int.from_bytes(s, "big")], np.uint32)
    assert model.bits(code(b"ba"), 2)[0, 0] == pytest.approx(1)
    assert model.bits(code(b"bb"), 2)[0, 0] == pytest.approx(1 + np.log2(3), rel=1e-5)


def test_license_scan(docs, none):
    found = [tuple(r) for r in license_scan.license_matches(docs).collect()]
    assert sorted((i, t) for i, t, *_ in found) == [(i, "MIT (line)") for i in (17, 18, 19)] and all(x[4] == 1 for x in found)
    assert license_scan.license_matches(none).count() == 0
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    draw = random.Random(9)
    for name, template in license_scan.TEMPLATES.items():
        for _ in range(12):
            words = template.split()
            if len(words) > 60:
                words[draw.randrange(1, len(words))] = "altered"
            before = prose(draw.random(), draw.randrange(300)) + "\n"
            text = before + " ".join(words) + " " + prose(draw.random(), draw.randrange(300))
            hits = {h[0]: h for h in scanner.scan(text)}
            brute = set()
            for other, own in scanner.sets.items():
                run = license_scan.shingles_of(license_scan.words_of(text))
                if any(len(own & set(run[i : i + len(own)])) >= 0.8 * len(own) for i in range(len(run))):
                    brute.add(other)
            assert name in hits and set(hits) == brute
            assert len(before) <= hits[name][1] < hits[name][2] <= len(before) + len(" ".join(words))


def test_license_wordings():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    names = lambda text: {h[0] for h in scanner.scan(f"{prose(1, 50)} {text} {prose(2, 50)}") if h[3] == 1}
    for text, name in {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 (short)",
        "This work is licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0 (short)",
        "See https://creativecommons.org/licenses/by-nd/4.0/ for it.": "CC-BY-ND-4.0 (link)",
        "It is under the GNU Affero General Public License, version 3.": "AGPL-3.0 (line)",
        "It is under the GNU General Public License, version 2.": "GPL-2.0 (line)",
        "Released under the BSD 3-Clause License.": "BSD-3-Clause (line)",
    }.items():
        assert names(text) == {name}, text
    assert names("This work is licensed under the GNU General Public License, version 3.") == {"GPL-3.0 (line)"}
    for name in ("ISC", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "MIT (with warranty)"):
        assert name in names(license_scan.TEMPLATES[name])
    assert "BSD-2-Clause" not in {h[0] for h in scanner.scan(license_scan.TEMPLATES["BSD-3-Clause"])}


def test_short_licenses_come_through_bands():
    """Whole wordings, and those that lack a word or have one altered, against a look at every window."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    short = {n: s for n, s in scanner.sets.items() if len(s) < license_scan.SHORT}
    draw, altered = random.Random(4), 0
    for name in sorted(short):
        words = license_scan.TEMPLATES[name].split()
        place = draw.randrange(len(words))
        for own in (words, words[1:], words[:-1], words[:place] + ["altered"] + words[place + 1 :]):
            far = [((1 << 14) - draw.randrange(12), 60)] if draw.random() < 0.05 else []
            for before, after in [(0, 0), (3, 0), (40, 25), *far]:
                text = f"{prose(5, before)} {' '.join(own)} {prose(6, after)}"
                given = license_scan.words_of(text)
                run = license_scan.shingles_of(given[max(0, before - 40) :])
                brute = {n for n, s in short.items() if any(10 * len(s.intersection(run[i : i + len(s)])) >= 8 * len(s) for i in range(len(run)))}
                windows = scanner.candidates(given)
                found = {n for n in {w[0] for w in windows} & short.keys() if scanner.occurrences(n, sorted(w[1:] for w in windows if w[0] == n), given)}
                assert found == brute, text[-300:]
                altered += own is not words and name in brute
    assert len(short) > 40 and altered > 40
    # Nothing but the bands brings them.
    scanner.short = [{} for _ in scanner.short]
    assert not any(w[0] in short for n in short for w in scanner.candidates(license_scan.words_of(license_scan.TEMPLATES[n])))


def test_license_notices_one_after_the_other():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name in ("MIT", "MPL-2.0", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MIT (line)"):
        text = " ".join(license_scan.TEMPLATES[name].split())
        for offset in range(0, 32, 5):
            for copies, gap in ((2, 0), (2, 10), (5, 0), (40, 3)):
                between = " " + prose(7, gap) + " " if gap else " "
                before = prose(3, offset) + " " if offset else ""
                hits = sorted(h[1:] for h in scanner.scan(before + between.join([text] * copies)) if h[0] == name)
                starts = [len(before) + k * len(text + between) for k in range(copies)]
                assert [h[0] for h in hits] == starts and all(h[2] == 1 for h in hits), (name, offset, copies, gap)
    # Altered at different places, and in another order.
    words = license_scan.TEMPLATES["MIT"].split()
    early, late, swapped = words[:10] + ["new"] + words[11:], words[:70] + ["new"] + words[71:], words[40:] + words[:40]
    scan = lambda *parts: sum(h[0] == "MIT" for h in scanner.scan(" ".join(w for p in parts for w in p)))
    assert scan(early, late) == scan(late, early) == scan(words[12:], words[:-12]) == 2
    assert scan(swapped) == 1 and scan(words, swapped, words) == 3


def test_warc_round_trip(spark, none, tmp_path):
    page = '<html><head><title>T &amp; t</title><script>x="<p>"</script></head><body><p>One&nbsp;two<br>three <a href="/a?b=1&amp;c">go</a><!-- no --></body>'
    pages = [(1, "http://a.example/", page), (2, None, None), (3, "http://b.example/", ""), (4, "http://c.example/", "<p>a\r\n\r\nWARC/1.0\r\nb</p>" + "y" * 100_000), (1, "http://a.example/", page), (None, "u", "☃ < 3")]
    responses = warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"), "2024-01-01T00:00:00Z")
    made = responses.union(warc.derivatives(responses)).orderBy("record_id")
    warc.write_warc(made, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert order(back) == order(made) and made.count() == 3 * len(pages)
    got = {(r["record_type"], r["target_uri"]): r for r in back.collect()}
    text, meta = got["conversion", "http://a.example/"], got["metadata", "http://a.example/"]
    source = got["response", "http://a.example/"]
    assert text["block"] == "T & t\nOne two\nthree go" and text["refers_to"] == meta["refers_to"] == source["record_id"]
    assert text["payload_digest"] == source["payload_digest"] == warc.sha1(page.encode()) and text["block_digest"] == warc.sha1(text["block"].encode())
    assert '"/a?b=1&c"' in meta["block"] and '"title": "T & t"' in meta["block"] and meta["concurrent_to"] == text["record_id"]
    assert warc.derivatives(warc.responses(none.withColumnRenamed("source", "url").withColumnRenamed("lang", "html").withColumnRenamed("doc_id", "page_id"), "d")).count() == 0


def test_token_blocks(spark, docs, none, rows, tmp_path):
    path, library = public_tokenizers.path("byte_bpe_50k.json"), None
    token_blocks.write_blocks(docs, str(tmp_path / "t"), path, block=5000)
    found = token_blocks.read_blocks(spark, str(tmp_path / "t")).collect()
    library = token_blocks.tokenizer(path).library
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows if r[0] is not None}
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            assert r["ids"] == ids[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    known = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert known == sorted(known, key=lambda i: (i is None, i or 0)) and len(found) == len(rows)
    token_blocks.write_blocks(none, str(tmp_path / "n"), path)
    assert token_blocks.read_blocks(spark, str(tmp_path / "n")).count() == 0


def test_length_limited_codes():
    draw = np.random.default_rng(4)
    for n, longest in ((1, 4), (2, 4), (16, 4), (50, 8), (3000, 12), (3000, 18)):
        counts = (draw.pareto(0.5, n) * 10 + 1).astype(np.int64)
        lengths = token_blocks.code_lengths(counts, longest)
        assert lengths.max() <= longest and (n == 1 or sum(2.0**-lengths) == 1)
        codes = token_blocks.Codes(np.arange(n) * 3, lengths)
        ids = draw.choice(n, 2000, p=counts / counts.sum()) * 3
        payload, checkpoints = codes.encode(ids, step=64)
        assert (codes.decode(payload, checkpoints, len(ids), step=64) == ids).all()


def test_line_dedup(docs, none, rows):
    found = line_dedup.without_repeats(docs).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    repeat = prose(3, 60)
    for r in found:
        if r["id"] is not None:
            want = texts[r["id"]]
            if r["id"] == 13:  # shares its second line with document 12
                want = want.replace(repeat + "\n", "")
            elif r["id"] in (18, 19):  # equal to document 17
                want = ""
            assert r["text"] == want, r["id"]
    assert len(found) == len(rows) and line_dedup.without_repeats(none).count() == 0


def test_line_dedup_with_many_first_holders(spark):
    """A passage whose lines have other first holders, each alone under ten words."""
    lines = [prose(50 + i, 9) for i in range(8)]
    p, q, both = prose(40, 6), prose(41, 6), prose(40, 6) + "\n" + prose(41, 6)
    texts = [p, q, "x\n" + both, "y\n" + both + "\nz", *lines, "u\n" + "\n".join(lines), "v\n" + "\n".join(lines) + "\nw"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: r["text"] for r in line_dedup.without_repeats(df).collect()}
    assert found == dict(enumerate(texts)) | {3: "y\nz", 13: "v\nw"}


def test_patience():
    a, b = list("xaybzcq"), list("axbyzcw")
    pairs = line_dedup.matching(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and [j for _, j in pairs] == sorted(j for _, j in pairs)
    assert (4, 4) in pairs and (5, 5) in pairs
    assert line_dedup.common_blocks(list("pabq"), list("rabs"), [3, 6, 6, 3], 10) == [1, 2]
    assert line_dedup.common_blocks(list("pabq"), list("rabs"), [3, 4, 4, 3], 10) == []


def test_blocks_without_anchor():
    """Blocks that a document repeats, or has in another order, and short lines beside them."""
    blocks = lambda a, b, n: line_dedup.common_blocks(list(a), list(b), [n] * len(b), 10)
    assert blocks("xpqypqz", "upqvpqw", 5) == [1, 2, 4, 5]
    assert blocks("xpqy", "upqvpqw", 5) == [1, 2, 4, 5] and blocks("xpqypqz", "upqv", 5) == [1, 2]
    assert blocks("abcd", "cdab", 5) == [0, 1, 2, 3] and blocks("abxcd", "cdyab", 4) == []
    draw = random.Random(6)
    for _ in range(300):
        a, b = ("".join(draw.choices("pqrst", k=12)) for _ in range(2))
        words = dict(zip("pqrst", draw.choices(range(1, 7), k=5)))
        n = [words[x] for x in b]
        want = {j for i in range(12) for e in range(i, 13) if sum(n[i:e]) >= 10 and b[i:e] in a for j in range(i, e)}
        assert line_dedup.common_blocks(list(a), list(b), n, 10) == sorted(want)


def test_language_stage_without_labels(spark, docs, rows):
    found = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF)
    assert found.columns == docs.columns
    assert sorted(str(r["text"]) for r in found.collect()) == sorted(r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1]))


def test_pipeline(spark, docs, none):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
