"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

Records are rows (``RECORD``).  Files are written and read by Spark's text source: a record is
one value whose "line" ends with the two empty lines that WARC puts after a record, so
files appear under Spark's commit protocol on any file system, compressed as ``.gz``.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm.common import map_rows

RECORD = (
    "record_id string, record_type string, refers_to string, concurrent_to string, target_uri string, date string, "
    "content_type string, payload_digest string, block_digest string, source_headers string, content_length long, block string"
)
FIELDS = [part.split()[0] for part in RECORD.split(", ")]
#: WARC header line of each column, in file order.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "concurrent_to": "WARC-Concurrent-To",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "block_digest": "WARC-Block-Digest",
    "source_headers": "WARC-Source-Headers",
    "content_length": "Content-Length",
}
VERSION, EMPTY = "WARC/1.0", "\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs

HIDDEN = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|pre|blockquote|title|body)\b[^>]*>", re.I)
TAGS = re.compile(r"<[a-zA-Z/!?][^>]*>")
ANCHOR, HREF = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"""\"([^"]*)"|'([^']*)'|([^\s>]+)""")
TITLE, TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title", re.I)


#: Two letters of base 32 for every ten bits, and where those of 160 bits are.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAIRS, _SHIFTS = [a + b for a in _LETTERS for b in _LETTERS], range(150, -1, -10)
_DESCRIBED = json.JSONEncoder(ensure_ascii=False)


def sha1(data: bytes) -> str:
    """Digest in base 32, as WARC writes it."""
    bits = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([_PAIRS[bits >> s & 1023] for s in _SHIFTS])


def record_id(*parts: object) -> str:
    """The same id for the same parts, so a repeated task writes the same records: a UUID of version 5."""
    x = hashlib.sha1(NAMESPACE.bytes + json.dumps(parts).encode()).hexdigest()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-5{x[13:16]}-{'89ab'[int(x[16], 16) & 3]}{x[17:20]}-{x[20:32]}>"


def shown(page: str) -> str:
    """The page without comments, scripts, styles and templates; what is not closed reaches to the end.

    One way through the page: every search goes on where the last one ended.
    """
    out, at, done, last = [], 0, 0, page.rfind(">")
    while found := HIDDEN.search(page, at):
        at = found.end()
        if found[1] is None:
            end = page.find("-->", at)
            end = end + 3 if end >= 0 else len(page)
        elif at > last:
            continue  # a tag without its end
        else:
            closing = CLOSING[found[1].lower()].search(page, page.find(">", at) + 1)
            end = closing.end() if closing else len(page)
        out.append(page[done : found.start()])
        at = done = end
    return "".join([*out, page[done:]])


def visible(page: str) -> str:
    """Text of a ``shown`` page: block elements as line breaks, other tags out, entities resolved."""
    # Every tag that begins before the last ">" ends there at the latest, so no search fails on its way to the end.
    cut = page.rfind(">") + 1
    page = BREAKS.sub("\n", page[:cut]) + page[cut:]
    cut = page.rfind(">") + 1
    page = TAGS.sub("", page[:cut]) + page[cut:]
    lines = [" ".join(line.split()) for line in html.unescape(page).split("\n")]
    return "\n".join(filter(None, lines))


def plain_text(page: str) -> str:
    """Visible text: scripts, styles and comments out, block elements as line breaks, entities resolved."""
    return visible(shown(page))


def title_of(page: str) -> str | None:
    """What stands between the first title tag and the next end of one."""
    start = TITLE.search(page, 0, page.rfind(">") + 1)
    end = TITLE_END.search(page, start.end()) if start else None
    return page[start.end() : end.start()] if end else None


def links_of(page: str) -> list[str]:
    """The address of every anchor that has one: the first readable one of its tag."""
    out, at = [], 0
    while anchor := ANCHOR.search(page, at):
        at = page.find(">", anchor.end())
        if at < 0:
            at = len(page)
        for name in HREF.finditer(page, anchor.end(), at):
            if value := VALUE.match(page, name.end()):
                out.append(html.unescape(value[value.lastindex]))
                at = value.end()
                break
    return out


def http_block(headers: str | None, body: str | None) -> tuple[str, str]:
    """(header lines, payload) of an HTTP response block; a block without an empty line is all payload."""
    head, mark, body = (body or "").partition(EMPTY) if headers is None else (headers, EMPTY, body or "")
    return (head, body) if mark else ("", head)


def responses(pages: DataFrame, date: str, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Response records of fetched pages; a null page is an empty payload, a null url leaves the target out.

    Record ids follow from id, url and payload; equal rows give equal records.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {f: [] for f in FIELDS}
            for i, url, page in zip(b["id"], b["url"], b["html"]):
                payload = (page or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
                digest = sha1(payload)
                append(
                    out, record_type="response", record_id=record_id("response", i, url, digest), target_uri=url, date=date,
                    content_type="application/http; msgtype=response", payload_digest=digest, block=head + EMPTY + (page or ""),
                )
            yield out

    return map_rows(pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rows, RECORD)


def append(out: dict[str, list], **values) -> None:
    """Add a record; the length and digest of its block are taken unless they are given."""
    if "block_digest" not in values:
        data = values["block"].encode("utf-8", "surrogatepass")
        values |= {"content_length": len(data), "block_digest": sha1(data)}
    for f in FIELDS:
        out[f].append(values.get(f))


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response among ``records``, in place, without a shuffle.

    Both refer to the response, carry its target, date and payload digest, and name
    each other.  The metadata block is JSON: the source's WARC and HTTP headers, title, links
    and the length and digest of the text.  Other record types give nothing; a null block counts
    as empty; a response without id gives records that refer to nothing.  Equal responses give
    equal records.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {f: [] for f in FIELDS}
            for r in ({f: b[f][i] for f in FIELDS} for i in range(len(b["block"]))):
                head, page = http_block(None, r["block"])
                seen = shown(page)
                text = visible(seen)
                data = text.encode("utf-8", "surrogatepass")
                digest, title = sha1(data), title_of(page)
                http = dict(line.split(":", 1) for line in head.split("\r\n")[1:] if ":" in line)
                described = {
                    "warc": {HEADERS[f]: r[f] for f in HEADERS if r[f] is not None},
                    "http": {k.strip(): v.strip() for k, v in http.items()},
                    "title": None if title is None else plain_text(title),
                    "links": links_of(seen),
                    "text_length": len(text),
                    "text_digest": digest,
                }
                seed = (r["record_id"], r["payload_digest"], r["target_uri"])
                ids = record_id("metadata", *seed), record_id("conversion", *seed)
                shared = {f: r[f] for f in ("target_uri", "date", "payload_digest")} | {"refers_to": r["record_id"], "source_headers": json.dumps(head)}
                append(out, **shared, record_type="metadata", record_id=ids[0], concurrent_to=ids[1], content_type="application/json", block=_DESCRIBED.encode(described))
                append(out, **shared, record_type="conversion", record_id=ids[1], concurrent_to=ids[0], content_type="text/plain; charset=utf-8", block=text, content_length=len(data), block_digest=digest)
            yield out

    return map_rows(records.where("record_type = 'response'").select(*FIELDS), rows, RECORD)


def as_text(record: str = "") -> Column:
    """A record as it stands in a file, without the empty lines after it."""
    lines = [F.concat(F.lit(f"\r\n{header}: "), F.col(field).cast("string")) for field, header in HEADERS.items()]
    return F.concat(F.lit(VERSION), F.concat_ws("", *lines), F.lit(EMPTY), F.col("block"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files ``part-*.txt.gz`` in the folder ``path``."""
    records.select(as_text().alias("value")).write.option("lineSep", EMPTY).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path`` (``RECORD``).

    Files are cut before every version line.  Where a block itself holds such a line, it
    is shorter than its Content-Length says and takes the next piece in; a compressed
    file is read by one task, in order.

    A record that its file ends too early has the block that is there, and the length its header
    says.  Without a readable Content-Length the block reaches to the next version line, and
    the length is null.  Header lines without a colon are passed over; what stands in a file
    before its first version line is no record.  Bytes that a wrong length cuts out of a character become
    replacement characters.  Empty files have no records.
    """
    mark = f"{EMPTY}{VERSION}\r\n"
    names = {header.lower(): field for field, header in HEADERS.items()}

    def record(found: dict, parts: list[bytes]) -> dict:
        data, size = b"".join(parts), found["content_length"]
        data = data.removesuffix(EMPTY.encode()) if size is None else data[:size]
        try:
            return found | {"block": data.decode("utf-8", "surrogatepass")}
        except UnicodeDecodeError:
            return found | {"block": data.decode("utf-8", "replace")}

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        at, found, parts, held = None, None, [], 0
        for b in batches:
            done: list[dict] = []
            for file, piece in zip(b["file"], b["value"]):
                if file != at:
                    if found is not None:
                        done.append(record(found, parts))
                    at, found = file, None
                    if not piece.startswith(f"{VERSION}\r\n"):
                        continue
                if found is None:
                    head, _, body = piece.removeprefix(f"{VERSION}\r\n").partition(EMPTY)
                    lines = [(k.strip().lower(), v.strip()) for k, mid, v in (line.partition(":") for line in head.split("\r\n")) if mid]
                    found = {names[k]: v for k, v in lines if k in names}
                    size = found.get("content_length", "")
                    found["content_length"] = int(size) if size.isascii() and size.isdigit() else None
                    parts, held = [], 0
                else:
                    body = mark + piece
                parts.append(body.encode("utf-8", "surrogatepass"))
                held += len(parts[-1])
                if held >= (found["content_length"] or 0):
                    done.append(record(found, parts))
                    found = None
            yield {f: [r.get(f) for r in done] for f in FIELDS}
        if found is not None:
            done = [record(found, parts)]
            yield {f: [r.get(f) for r in done] for f in FIELDS}

    pieces = spark.read.option("lineSep", mark).text(path)
    return map_rows(pieces.select("value", F.col("_metadata.file_path").alias("file")), rows, RECORD)
