"""Awkward input of single operators: bad pages and files, ids with several texts, clashing names, alignment alone."""

import gzip
import html
import json
import random
import re
import time

import pytest

from chronopanel.llm import exact_dedup, line_dedup, minhash_dedup, mixing, warc
from tests.llm.test_llm import prose

# The same rules as patterns over the whole page: short, but quadratic in unclosed tags.
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAGS = re.compile(r"<[a-zA-Z/!?][^>]*>")
LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
PARTS = ["<p>", "</p>", "<a ", "<A\nhref = ", 'href="x>y"', "href='q'", " href=z", 'href="', ">", "<", "<title>", "</title>", "<title ", "<script>", "<script ", "</script >",
         "<!--", "-->", "word", " ", "\n", "&amp;", "&lt;b>", "<style a>", "</style>", "<br/>", "<aside>", "'", "</", "é"]


def test_pages_against_patterns():
    draw = random.Random(4)
    for _ in range(6000):
        page = "".join(draw.choices(PARTS, k=draw.randrange(0, 16)))
        seen = HIDDEN.sub("", page)
        assert warc.shown(page) == seen
        text = html.unescape(TAGS.sub("", warc.BREAKS.sub("\n", seen)))
        assert warc.plain_text(page) == re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[^\S\n]+", " ", text)).strip()
        found = TITLE.search(page)
        assert warc.title_of(page) == (found[1] if found else None)
        assert warc.links_of(seen) == [html.unescape(next((x for x in m if x), "")) for m in LINK.findall(seen)], page


@pytest.mark.parametrize("part", ["<title>", "<a ", "<a href", '<a href="', "<script ", "<!--", "<p", "<a <p x", "</script", "<script>", "<title", "&", " \n"])
def test_long_malformed_pages(part):
    page = part * (1_000_000 // len(part))
    start = time.process_time()
    for end in ("", ">"):
        warc.plain_text(page + end), warc.title_of(page + end), warc.links_of(warc.shown(page + end))
    assert time.process_time() - start < 4


def test_bad_warc_files(spark, tmp_path):
    def file(name, *records):
        with gzip.open(tmp_path / name, "wt", newline="") as out:
            out.write("".join(records))

    def record(i, block, size):
        return f"WARC/1.0\r\nWARC-Record-ID: <{i}>\r\nno colon\r\n" + ("" if size is None else f"Content-Length: {size}\r\n") + f"\r\n{block}\r\n\r\n"

    file("1.txt.gz", record("a", "one", 3), record("b", "cut", 1000))
    file("2.txt.gz", record("c", "first of the next file", 22), record("d", "no length", None), record("e", "x\r\n\r\nWARC/1.0\r\ny", 16))
    file("3.txt.gz", "no record at all\r\n\r\n", record("f", "after it", 8))
    file("4.txt.gz")
    file("5.txt.gz", record("g", "é", 1), record("h", "", 0), record("i", "word", "four"))
    found = {r["record_id"]: (r["block"].rstrip(), r["content_length"]) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert found == {
        "<a>": ("one", 3), "<b>": ("cut", 1000), "<c>": ("first of the next file", 22), "<d>": ("no length", None),
        "<e>": ("x\r\n\r\nWARC/1.0\r\ny", 16), "<f>": ("after it", 8), "<g>": ("�", 1), "<h>": ("", 0), "<i>": ("word", None),
    }


def test_derivatives_of_an_awkward_page(spark):
    page = "<title>T &amp; U</title><!-- no <a href=hidden> --><script>x</script><a href='/l?a=1&amp;b'>go</a> <p>one<p>two <unclosed"
    made = warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), "d")).collect()
    block = {r["record_type"]: r["block"] for r in made}
    described = json.loads(block["metadata"])
    assert (described["title"], described["links"]) == ("T & U", ["/l?a=1&b"])
    assert block["conversion"] == "T & U\ngo\none\ntwo <unclosed"


def test_id_with_several_texts(spark):
    """Each text of an id links it, also where the id is the smallest of the classes of both."""
    a, b = prose(91, 120), prose(92, 120)
    near = lambda t: t.replace(t.split()[60], "other", 1)
    rows = [(5, a), (5, b), (9, near(a)), (12, near(b)), (13, prose(93, 120)), (5, a)]
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r["id"], r["component"]) for r in found.collect()) == [(5, 5)] * 3 + [(9, 5), (12, 5), (13, 13)]


def test_clashing_names(spark):
    names = ["__kept", "__times", "__size", "__doc", "__copy", "__hash", "s", "key", "place", "c0"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, f"text {i % 3}", "s", *names) for i in range(6)], schema)
    once = exact_dedup.deduplicated(docs)
    assert once.columns == docs.columns and sorted(r[0] for r in once.collect()) == [0, 1, 2]
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns and all(list(r)[3:] == names for r in mix.collect()) and mix.count() == 9


def test_alignment_decides(monkeypatch):
    a, b, words = list("xpqypqzcd"), list("cdupqvpq"), [5] * 8
    assert line_dedup.common_blocks(a, b, words, 10) == [0, 1, 3, 4, 6, 7]
    monkeypatch.setattr(line_dedup, "matching", lambda *_: [])
    assert line_dedup.common_blocks(a, b, words, 10) == []


def test_many_moved_and_repeated_blocks():
    """Lines in reverse and shuffled order, and one line very often."""
    draw = random.Random(3)
    lines = [str(n) for n in range(5000)]
    mixed = draw.sample(lines, len(lines))
    for b in (lines[::-1], mixed, ["1"] * 20_000, mixed + ["7", "none"] * 5000):
        start = time.process_time()
        found = line_dedup.common_blocks(lines, b, [10] * len(b), 10)
        assert found == [j for j, x in enumerate(b) if x != "none"]
        assert time.process_time() - start < 20
