"""Text of pages: its definition by patterns, and how its time grows with words."""

import base64
import hashlib
import html
import json
import random
import re
import time
import uuid

from chronopanel.llm import warc


def test_lines_are_those_of_the_patterns():
    draw = random.Random(7)
    pieces = [*"ab \t\n\r\x0b\x1c\x1f\x85\xa0  ;", "<p>", "<b>", "&nbsp;", "&#32;", "&#10;", "  ", " \n "]
    for _ in range(5000):
        page = "".join(draw.choices(pieces, k=draw.randint(0, 14)))
        text = html.unescape(warc.TAGS.sub("", warc.BREAKS.sub("\n", page)))
        assert warc.plain_text(page) == re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[^\S\n]+", " ", text)).strip(), page


def test_ids_and_digests_are_the_standard_ones():
    for i in range(300):
        parts = ("metadata", str(i), None, "é ")
        assert warc.record_id(*parts) == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"
        assert warc.sha1(b"%d" % i) == "sha1:" + base64.b32encode(hashlib.sha1(b"%d" % i).digest()).decode()


def test_single_blanks_cost_little():
    """The text of a page of plain words takes at most three times as long as cutting it into words and joining them."""

    def least(f):
        took = []
        for _ in range(5):
            start = time.process_time()
            f(page)
            took.append(time.process_time() - start)
        return min(took)

    page = "<p>" + "some words and more " * 100_000 + "</p>"
    assert least(warc.plain_text) < 3 * least(lambda p: " ".join(p.split()))
