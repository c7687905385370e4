"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records that point back to it by WARC-Refers-To: a
`metadata` record (title, language, charset, outlinks, as warc-fields) and a
`conversion` record (the page as plain text).  Both keep the source's target
URI and date, carry the source's payload digest, and have a block digest of their
own.  Record ids are UUIDs of name kind, so a repeated run gives equal records.

Records can be written as gzip members (concatenated members are a .warc.gz) and
read back, also from files that Spark reads as binary; what is read can be
derived from directly.  A derived record in a file names the source's HTTP headers
in WARC-Source-Headers (percent-encoded, as they are several lines).  The payload
digest and length are those of the source's bytes, whatever their charset.

Defined results: a null body is empty and gives an empty conversion and its
metadata; a null URI is the empty URI; pages are told apart by id and URI, so
repeated rows give repeated records of equal ids; an empty table gives none;
other columns are ignored.  A broken record or gzip member ends the reading of its
file there: what was read before stays.  Files are read member by member, pages in
time linear in their length, whatever they hold.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, tune

#: Names and media types of the WARC 1.1 format.
VERSION = "WARC/1.1"
RESPONSE_TYPE, FIELDS_TYPE, TEXT_TYPE = "application/http;msgtype=response", "application/warc-fields", "text/plain; charset=utf-8"
#: The date of response records made from tables that have none.
DATE = "2024-01-01T00:00:00Z"

OPENING = re.compile(r"<!--|<(script|style|noscript|template|svg)\b[^>]*>", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "title")}
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|body|head|blockquote|pre|hr|dd|dt)\b[^>]*>", re.I)
TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
TITLE = re.compile(r"<title\b[^>]*>", re.I)
LINK, META, ROOT = (re.compile(rf"<{name}\b[^>]*>", re.I) for name in ("a", "meta", "html"))
HREF = re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""", re.I)
CHARSET = re.compile(r"""\bcharset\s*=\s*["']?([\w-]+)""", re.I)
HTTP_CHARSET = re.compile(r"""^content-type:[^\r\n]*\bcharset\s*=\s*["']?([\w-]+)""", re.I | re.M)
SPACES = re.compile(r"[ \t\r\f\v\xa0]+")


def visible(page: str) -> str:
    """The page without comments, scripts and the like, each replaced by a space; what is never closed stays.

    One pass: a closing mark that was once looked for in vain is not looked for again."""
    end = page.rfind(">") + 1
    out, at, missing = [], 0, set()
    for m in OPENING.finditer(page, 0, end):
        name = (m[1] or "").lower()
        if m.start() < at or name in missing:
            continue
        if name:
            close = CLOSING[name].search(page, m.end())
            stop = close.end() if close else -1
        else:
            stop = page.find("-->", m.end())
            stop = stop + 3 if stop >= 0 else -1
        if stop < 0:
            missing.add(name)
            continue
        out += [page[at : m.start()], " "]
        at = stop
    out.append(page[at:])
    return "".join(out)


def without(mark: re.Pattern, page: str, by: str) -> str:
    """mark replaced; marks end with '>', so nothing is tried beyond the last one."""
    end = page.rfind(">") + 1
    return mark.sub(by, page[:end]) + page[end:]


def plain_text(page: str) -> str:
    """Visible text: one line per block, runs of space joined, empty lines dropped."""
    page = without(TAG, without(BREAK, visible(page.replace("\n", " ")), "\n"), "")
    lines = (SPACES.sub(" ", line).strip() for line in html.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def tags(mark: re.Pattern, page: str) -> Iterator[re.Match]:
    return mark.finditer(page, 0, page.rfind(">") + 1)


def attribute(mark: re.Pattern, value: re.Pattern, page: str) -> str:
    """The value in the first tag of a kind that has it."""
    return next((m[1] for m in (value.search(page, t.start(), t.end()) for t in tags(mark, page)) if m), "")


def title_of(page: str) -> str:
    start = next(tags(TITLE, page), None)
    close = CLOSING["title"].search(page, start.end()) if start else None
    return one_line(html.unescape(page[start.end() : close.start()])) if close else ""


def links_of(page: str) -> Iterator[str]:
    """The first href of every link; a quoted value may hold any sign."""
    for t in tags(LINK, page):
        m = HREF.search(page, t.start(), t.end())
        v = VALUE.match(page, m.end()) if m else None
        if v:
            yield one_line(html.unescape(v[1] or v[2] or v[3] or ""))


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(names))}>"


def one_line(x: str) -> str:
    return SPACES.sub(" ", x.replace("\n", " ")).strip()


def decode(payload: bytes, headers: str) -> str:
    """A payload as text by the charset that its headers or its beginning name, else as UTF-8."""
    named = HTTP_CHARSET.search(headers)
    name = named[1] if named else attribute(META, CHARSET, payload[:1024].decode("latin-1"))
    try:
        return payload.decode(name or "utf-8", "replace").encode("utf-8", "replace").decode()
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def metadata_fields(page: str, payload_digest: str, length: int) -> str:
    fields = [("title", title_of(page)), ("language", attribute(ROOT, LANG, page)), ("charset", attribute(META, CHARSET, page).lower())]
    fields += [("source-payload-digest", payload_digest), ("source-length", str(length))]
    fields += [("outlink", x) for x in dict.fromkeys(links_of(visible(page)))]
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v)


RECORD = (
    "source_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, source_headers string, block string"
)
NAMES = [part.split()[0] for part in RECORD.split(", ")]


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages: source_id, record_id, target_uri, warc_date, http_headers, body."""
    return pages.select(
        F.col("page_id").cast("long").alias("source_id"),
        F.lit(None).cast("string").alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_headers"),
        F.coalesce("html", F.lit("")).alias("body"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two linked records for every response record; of a table with record types, others are left out.

    payload_digest and payload_length are the source's where records have them, else those of the body as UTF-8."""

    def rows(source, rid, uri, date, headers, body, paid, length):
        body = body or ""
        if paid is None or length is None:
            payload = body.encode()
            paid, length = paid or digest(payload), len(payload) if length is None else length
        uri = uri or ""
        rid = rid or record_id("response", uri, str(source))
        for kind, media, block in (("metadata", FIELDS_TYPE, metadata_fields(body, paid, length)), ("conversion", TEXT_TYPE, plain_text(body))):
            raw = block.encode()
            yield (source, kind, record_id(kind, rid), rid, uri, date, media, len(raw), digest(raw), paid, headers, block)

    def run(batches):
        for batch in batches:
            step = 64
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                found = [r for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in rows(*x)]
                kinds = [pa.int64() if n in ("source_id", "content_length") else pa.string() for n in NAMES]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=NAMES)

    tune(records.sparkSession)
    if "record_type" in records.columns:
        records = records.filter("record_type = 'response'")
    source = [F.col(c) if c in records.columns else F.lit(None).cast(k).alias(c) for c, k in (("payload_digest", "string"), ("payload_length", "long"))]
    return records.select("source_id", "record_id", "target_uri", "warc_date", "http_headers", "body", *source).mapInArrow(run, RECORD)


def serialise(row) -> bytes:
    """One derived record in WARC form."""
    block = (row["block"] or "").encode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"])]
    head += [("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Payload-Digest", row["source_payload_digest"])]
    head += [("WARC-Source-Headers", quote(row["source_headers"] or "", safe="/:;,=()\"'+*?&"))]
    head += [("Content-Type", row["content_type"]), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def members(records: DataFrame) -> DataFrame:
    """record_id and the record as one gzip member (no time stamp, so equal records are equal bytes)."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [gzip.compress(serialise(r), 6, mtime=0) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array(out, pa.binary())], names=["record_id", "member"])

    tune(records.sparkSession)
    return records.select(*NAMES).mapInArrow(run, "record_id string, member binary")


#: Bytes inflated at a time.
STEP = 1 << 20


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a file in pieces, gzipped or not; a broken member ends them."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while view[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            yield z.decompress(view, STEP)
            while not z.eof:
                left = z.unconsumed_tail
                piece = z.decompress(left, STEP)
                if not piece and not left:
                    return
                yield piece
        except zlib.error:
            return
        view = view[len(view) - len(z.unused_data) :]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of a file, gzipped or not; one record is held at a time."""
    pieces, held = inflated(data), b""

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        held += piece or b""
        return piece is not None

    while True:
        while len(held) < 5 and more():
            pass
        if not held.startswith(b"WARC/"):
            return
        at = 0
        while (end := held.find(b"\r\n\r\n", max(at - 3, 0))) < 0:
            at = len(held)
            if not more():
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = head.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            return
        stop = end + 4 + int(size)
        if len(held) < stop:
            parts, have = [held], len(held)
            while have < stop and (piece := next(pieces, None)) is not None:
                parts.append(piece)
                have += len(piece)
            held = b"".join(parts)
            if have < stop:
                return
        yield head, held[end + 4 : stop]
        held = held[stop:]
        while True:
            while len(held) < 2 and more():
                pass
            if held[:2] != b"\r\n":
                break
            held = held[2:]


def _header_text(front: bytes) -> str:
    try:
        return front.decode()
    except UnicodeDecodeError:
        return front.decode("latin-1")


def read_records(files: DataFrame) -> DataFrame:
    """Records of binary files (a table with a column `content`): type, ids, URI, date, payload digest, HTTP headers and body; of derived ones, the source's digest and headers.

    Where a record of HTTP names no payload digest, it is computed of the payload's bytes.  source_id is a hash of the record id."""
    schema = (
        "record_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, http_headers string, body string, "
        "source_id long, payload_length long, source_payload_digest string, source_headers string"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if n in ("source_id", "payload_length") else pa.string() for n in names]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for place in range(len(batch)):
                for head, block in parse(batch.column(0)[place].as_py() or b""):
                    http, body, paid = "", block, head.get("warc-payload-digest")
                    if head.get("content-type", "").startswith("application/http"):
                        front, _, body = block.partition(b"\r\n\r\n")
                        http, paid = _header_text(front), paid or digest(body)
                    own = [head.get(k) for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date")]
                    name = own[1] or "\0".join(["", own[3] or "", own[4] or "", digest(block)])
                    source = int.from_bytes(hashlib.sha1(name.encode()).digest()[:8], "big", signed=True)
                    theirs = head.get("warc-source-headers")
                    rows.append((*own, paid, http, decode(body, http) if http else body.decode("utf-8", "replace"), source, len(body), head.get("warc-source-payload-digest"), theirs and unquote(theirs)))
                    size += len(block) + 1000
                    if size > 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
            yield batch_of(rows)

    tune(files.sparkSession)
    return files.select("content").mapInArrow(run, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(read(spark, sf_dir, "pages")))
