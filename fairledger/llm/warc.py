"""Derived WARC records: metadata and plain-text conversions linked to the responses they come from.

A response has record_id, target_uri, warc_date, http_headers, payload_digest and payload. Each
gives a metadata record, and a conversion record if its payload is HTML or plain text. Both refer to
the response by its id and keep its URI, date, HTTP headers and payload digest. Ids are derived from
the response's id, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairledger.llm.common import in_arrow

VERSION = "WARC/1.1"
END = "\r\n\r\n"
RESPONSE = (
    "record_id string, target_uri string, warc_date string, http_headers string, "
    "payload_digest string, payload string"
)
RECORD = (
    "type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, source_headers string, source_payload_digest string, "
    "digest_matches boolean, block_digest string, content_length long, block string"
)

# Elements that end a line, that are cells, and whose content is no text.
LINES = (
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol optgroup option p pre "
    "section summary table tbody tfoot thead title tr ul"
).split()
CELLS = ["td", "th"]
RAW = ["script", "style", "noscript", "template", "svg", "iframe", "textarea"]

# A quoted value may hold > but not <, so that a missing quote ends at the next tag.
_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)
      | <(?:{'|'.join(RAW)})\b[^<>]*>.*?(?:</(?:{'|'.join(RAW)})\s*>|\Z)
      | <(?P<close>/?)(?P<name>[a-z][a-z0-9]*)(?P<more>(?:"[^"<]*"|'[^'<]*'|[^"'<>])*+)>
      | </?(?P<loose>[a-z][a-z0-9]*)[^<>]*> | <[/!?][^<>]*>""",
    re.S | re.I | re.X)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_BREAKS = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    """The labelled SHA-1 digest that WARC headers carry."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: object) -> str:
    """An id derived from what it names."""
    name = "\x1f".join("" if p is None else str(p) for p in parts)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def plain(markup: str, base: str) -> tuple[str, str, list[str]]:
    """Text, title and outgoing links of HTML."""
    links = {}

    def replaced(m):
        name = (m["name"] or m["loose"] or "").lower()
        if m["name"] and name == "a" and not m["close"] and (href := _HREF.search(m["more"])):
            to = html.unescape(next(g for g in href.groups() if g is not None)).strip()
            try:
                to = urljoin(base, to)
            except ValueError:  # an address that is none is kept as it is written
                pass
            links[re.sub(r"\s+", " ", to)] = None
        return "\n" if name in LINES else "\t" if name in CELLS else ""

    def tidy(text):
        return _BREAKS.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()

    title = _TITLE.search(markup)
    return (
        tidy(_MARKUP.sub(replaced, markup)),
        tidy(title[1]).replace("\n", " ") if title else "", list(links),
    )


def _media(headers: str) -> tuple[str, str]:
    """Media type and status of an HTTP header block; HTML where it names none."""
    status = re.match(r"HTTP/\S+ +(\d{3})", headers)
    kind = re.search(r"(?im)^content-type:[ \t]*([^;\s]+)", headers)
    return (kind[1].lower() if kind else "text/html"), (status[1] if status else "")


def _derived(r: dict) -> list[tuple]:
    payload, headers = r["payload"] or "", r["http_headers"] or ""
    kind, status = _media(headers)
    own = digest(payload.encode("utf-8", "replace"))
    source = r["payload_digest"] or own
    text, title, links = payload.strip(), "", []
    if kind in ("text/html", "application/xhtml+xml"):
        text, title, links = plain(payload, r["target_uri"] or "")
    converted = kind in ("text/html", "application/xhtml+xml", "text/plain")
    conversion = record_id(r["record_id"], "conversion")
    fields = [("source-content-type", kind), ("http-status", status),
              ("source-payload-digest", source)]
    if converted:
        fields += [("conversion-record-id", conversion),
                   ("conversion-block-digest", digest(text.encode("utf-8", "replace")))]
    fields += [("title", title)] * bool(title) + [("outlink", x) for x in links]
    block = "".join(f"{k}: {v}\r\n" for k, v in fields)
    made = [("metadata", record_id(r["record_id"], "metadata"), "application/warc-fields", block)]
    if converted:
        made.append(("conversion", conversion, "text/plain; charset=utf-8", text))
    return [(
        type_, id, r["record_id"], r["target_uri"], r["warc_date"], content, r["http_headers"],
        source, source == own, digest(data := body.encode("utf-8", "replace")), len(data), body,
    ) for type_, id, content, body in made]


def derive(responses: DataFrame) -> DataFrame:
    """The derived records of responses: see `RECORD`; one or two for each row.

    A null payload is empty, and its conversion too; null headers count as HTML; a null payload
    digest is computed, a given one is kept and compared. Null ids, URIs and dates stay null,
    repeated rows give repeated records with the same ids, an empty table gives none; columns
    other than those of `RESPONSE` are not read.
    """
    names = [c.split()[0] for c in RESPONSE.split(", ")]
    outs = [c.split()[0] for c in RECORD.split(", ")]
    kinds = {"digest_matches": pa.bool_(), "content_length": pa.int64()}

    def make(batch):
        rows = [x for r in batch.to_pylist() for x in _derived(r)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kinds.get(n, pa.string()))
             for n, c in zip(outs, zip(*rows) if rows else [[]] * len(outs))], names=outs)

    return in_arrow(responses.select(*names), RECORD, make)


def responses(
    pages: DataFrame, date: str, id: str = "page_id", url: str = "url", body: str = "html",
) -> DataFrame:
    """Pages as the responses that delivered them."""
    def make(batch):
        rows = []
        for page, uri, text in zip(*(batch[c].to_pylist() for c in ("id", "url", "body"))):
            data = (text or "").encode("utf-8", "replace")
            headers = (
                "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                f"Content-Length: {len(data)}")
            rows.append((page, record_id(uri, page), uri, date, headers, digest(data), text))
        columns = zip(*rows) if rows else [[]] * 7
        kinds = [pa.int64(), *[pa.string()] * 6]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["page_id", *(c.split()[0] for c in RESPONSE.split(", "))])

    rows = pages.select(
        F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.col(body).alias("body"))
    return in_arrow(rows, "page_id long, " + RESPONSE, make)


_HEADERS = [
    ("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
    ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("Content-Type", "content_type"),
    ("WARC-Block-Digest", "block_digest"), ("X-Source-Payload-Digest", "source_payload_digest"),
    ("X-Source-Headers", "source_headers"), ("Content-Length", "content_length"),
]


def write(records: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Records as WARC files under `path`, up to `per_file` in each; null fields are left out.

    Line ends within the source's headers are written as \\r and \\n, a backslash as two. The two
    line ends that close a record are what separates rows of the text writer.
    """
    def escaped(c):
        out = F.col(c).cast("string")
        for plain_, written in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n")):
            out = F.replace(out, F.lit(plain_), F.lit(written))
        return out

    lines = [F.concat(F.lit(f"{name}: "), escaped(c)) for name, c in _HEADERS]
    records.select(F.concat(
        F.concat_ws("\r\n", F.lit(VERSION), *lines), F.lit(END), F.coalesce("block", F.lit(""))
    ).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


_ESCAPE = re.compile(r"\\(.)")


def parse(data: bytes):
    """Header fields and block of each record of a file, by the lengths that the headers give."""
    at = 0
    while at < len(data):
        end = data.index(END.encode(), at)
        fields = dict(
            x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        start = end + len(END)
        at = start + int(fields["Content-Length"])
        yield fields, data[start:at].decode("utf-8", "replace")
        at += len(END)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files that `write` made: the columns of `_HEADERS`, and block."""
    names = [c for _, c in _HEADERS] + ["block"]
    unescaped = {"r": "\r", "n": "\n"}

    def make(batch):
        for data in batch["content"].to_pylist():
            rows = [
                [_ESCAPE.sub(lambda m: unescaped.get(m[1], m[1]), fields[n]) if n in fields else None
                 for n, _ in _HEADERS] + [block]
                for fields, block in parse(data)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * len(names))],
                names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    found = in_arrow(files.select("content"), ", ".join(f"{n} string" for n in names), make)
    return found.withColumn("content_length", F.col("content_length").cast("long"))
