"""WARC derivatives: metadata and plain-text conversion records for response records.

A response record becomes linked records: a `metadata` record that keeps the source's header fields (all of
them, in order), its HTTP status and fields, and both digests; and, if the payload is text, a `conversion`
record with the page's text. Both carry WARC-Refers-To (the response's id), the target URI and, if the source
has one, its date; ids are derived from the response's id, so a rebuilt file has the same ids. Digests are
SHA-1 in base 32, as is usual in WARC. Transfer and content encodings (chunked, gzip, deflate) are undone.

read_archives() reads .warc and .warc.gz files of any store that Spark reads, a row a record; write_archives()
writes the derivatives as such files by Spark's own writer. Each record is built from its own row (no
shuffle), so a lost task is rebuilt alone.

Defined results: null html is an empty payload; null URLs give an empty WARC-Target-URI; malformed records
and encodings that cannot be undone give a row with `error` set and no derivatives; a payload that is no text
has metadata only; repeated rows repeat; extra columns are ignored.
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

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import table

VERSION = "WARC/1.1"
#: A payload that decodes to more bytes is an error.
MOST_PAYLOAD = 256 << 20
#: A header that is longer is malformed.
MOST_HEADER = 1 << 20
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:ridgeline:warc")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


def build(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; Content-Length and the block digest are added."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    text = VERSION + "\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


Fields = list[tuple[str, str]]


def value(fields: Fields, name: str) -> str | None:
    """The first value of a field, whatever the case of its name."""
    return next((v for k, v in fields if k.lower() == name), None)


def _fields(lines: list[str], strict: bool) -> Fields:
    out: Fields = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:  # a folded line goes on
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
            continue
        k, colon, v = line.partition(":")
        if not colon and strict:
            raise ValueError(f"malformed header line: {line[:40]}")
        if colon:
            out.append((k.strip(), v.strip()))
    return out


def parse(record: bytes) -> tuple[Fields, bytes]:
    """(header fields in order, block) of one record; ValueError if it is malformed."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = _fields(lines[1:], strict=True)
    n = value(fields, "content-length") or ""
    if not n.isdigit() or len(rest) < int(n):
        raise ValueError("truncated block")
    return fields, rest[: int(n)]


def parse_http(block: bytes) -> tuple[str, Fields, bytes]:
    """(status line, fields in order, payload) of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of HTTP header")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], _fields(lines[1:], strict=False), payload


def unchunked(data: bytes) -> bytes:
    """A chunked body without its frames."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise ValueError("malformed chunk")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if at + n > len(data):
            raise ValueError("truncated chunk")
        out.append(data[at : at + n])
        at += n + 2


def _inflated(data: bytes, kind: str) -> bytes:
    out, left = [], data
    try:
        while left:
            raw = kind == "deflate" and left[0] & 15 != 8
            step = zlib.decompressobj(31 if kind == "gzip" else -15 if raw else 15)
            out.append(step.decompress(left, MOST_PAYLOAD + 1 - sum(map(len, out))))
            if step.unconsumed_tail or sum(map(len, out)) > MOST_PAYLOAD:
                raise ValueError("payload too large")
            if not step.eof:
                raise ValueError(f"truncated {kind} payload")
            left = step.unused_data if kind == "gzip" and step.unused_data[:2] == b"\x1f\x8b" else b""
    except zlib.error as e:
        raise ValueError(f"malformed {kind} payload") from e
    return b"".join(out)


def body(http: Fields, payload: bytes) -> bytes:
    """A payload without its encodings. Archives often hold it decoded under the header it came with: then nothing is undone."""
    codings = lambda name: [c.strip().lower() for k, v in http if k.lower() == name for c in v.split(",") if c.strip()]
    if "chunked" in codings("transfer-encoding") and re.match(rb"[0-9a-fA-F]+[ \t]*(;[^\r\n]*)?\r\n", payload):
        payload = unchunked(payload)
    for coding in reversed([c for c in codings("transfer-encoding") if c != "chunked"] + codings("content-encoding")):
        if coding in ("gzip", "x-gzip"):
            payload = _inflated(payload, "gzip") if payload[:2] == b"\x1f\x8b" else payload
        elif coding == "deflate":
            payload = _inflated(payload, "deflate") if payload else payload
        elif coding != "identity":
            raise ValueError(f"unknown encoding {coding[:40]}")
    return payload


def response_record(key: str, url: str, page: str, date: str | None = None) -> bytes:
    """A response record around a page. Without a date the record has none."""
    payload = page.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id("response", key, url))] + ([("WARC-Date", date)] if date else [])
    fields += [("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload))]
    return build("response", fields, http + payload)


_HIDDEN = re.compile(r"(script|style|noscript|template)\b", re.I)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
_BREAK = re.compile(r"/?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|blockquote|pre|title|head|body|html|main|aside|form|hr|dd|dt)\b", re.I)


def plain_text(page: str) -> str:
    """The text of a page: scripts, styles, comments and tags go, block tags end lines, entities are resolved, blanks are folded.

    One scan forward: what was looked for once and does not follow is not looked for again, so the time grows
    with the length of the page, whatever is left open in it.
    """
    out, at, absent = [], 0, set()

    def find(what: str, start: int) -> int:
        if what in absent:
            return -1
        if what in _CLOSED:
            m = _CLOSED[what].search(page, start)
            end = m.end() if m else -1
        else:
            end = page.find(what, start)
            end = end + len(what) if end >= 0 else -1
        if end < 0:
            absent.add(what)
        return end

    while True:
        start = page.find("<", at)
        if start < 0:
            out.append(page[at:])
            break
        out.append(page[at:start])
        if page.startswith("<!--", start) and (end := find("-->", start + 4)) >= 0:
            out.append(" ")
        elif (m := _HIDDEN.match(page, start + 1)) and (end := find(m[1].lower(), m.end())) >= 0:
            out.append(" ")
        elif (page[start + 1 : start + 2] in ("/", "!", "?") or "a" <= page[start + 1 : start + 2].lower() <= "z") and page[start + 1 : start + 2] and (end := find(">", start + 2)) >= 0:
            out.append("\n" if _BREAK.match(page, start + 1) else "")
        else:
            out.append("<")
            end = start + 1
        at = end
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def text_of_payload(kind: str | None, payload: bytes) -> str | None:
    """The text of a payload by its content type; null for one that is no text."""
    name = (kind or "text/html").split(";")[0].strip().lower()
    if not (name.startswith("text/") or name.endswith(("html", "xml", "+xml", "json")) or not name):
        return None
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind or "", re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    if name.endswith(("html", "xml")) or not name:
        return plain_text(page)
    return "\n".join(line for line in (" ".join(x.split()) for x in page.split("\n")) if line)


def derive(record: bytes) -> dict[str, str | bytes | None]:
    """The metadata and conversion records of one response record."""
    fields, block = parse(record)
    if value(fields, "warc-type") != "response":
        raise ValueError("not a response record")
    source = value(fields, "warc-record-id")
    if not source:
        raise ValueError("no record id")
    status, http, payload = parse_http(block)
    found = text_of_payload(value(http, "content-type"), body(http, payload))
    uri, date = value(fields, "warc-target-uri") or "", value(fields, "warc-date")
    payload_digest = value(fields, "warc-payload-digest") or digest(payload)
    conversion_id, metadata_id = record_id("conversion", source), record_id("metadata", source)
    shared = [("WARC-Date", date)] if date else []
    shared += [("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri)] + ([("WARC-Refers-To-Date", date)] if date else [])
    conversion = None
    if found is not None:
        text = found.encode("utf-8", "replace")
        conversion = build("conversion", [("WARC-Record-ID", conversion_id), *shared, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Payload-Digest", digest(text))], text)
    kept = [("source-" + k.lower(), v) for k, v in fields] + [("http-status", status)] + [("http-" + k.lower(), v) for k, v in http]
    kept += [("payload-digest", payload_digest), ("payload-digest-holds", str(payload_digest == digest(payload)).lower())]
    kept += [("conversion", conversion_id)] if conversion else []
    lines = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in kept).encode()
    linked = [("WARC-Concurrent-To", conversion_id)] if conversion else []
    metadata = build("metadata", [("WARC-Record-ID", metadata_id), *shared, *linked, ("Content-Type", "application/warc-fields")], lines)
    return {
        "response_id": source, "metadata_id": metadata_id, "conversion_id": conversion_id if conversion else None, "target_uri": uri, "payload_digest": payload_digest,
        "text": None if found is None else text.decode(), "metadata": metadata, "conversion": conversion, "error": None,
    }


_SCHEMA = pa.schema(
    [("response_id", pa.string()), ("metadata_id", pa.string()), ("conversion_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string())]
    + [("text", pa.string()), ("metadata", pa.binary()), ("conversion", pa.binary()), ("error", pa.string())]
)
_SPARK = "response_id string, metadata_id string, conversion_id string, target_uri string, payload_digest string, text string, metadata binary, conversion binary, error string"


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.column(1):
            try:
                rows.append(derive(r.as_py() or b""))
            except ValueError as e:
                rows.append({"error": str(e)})
        made = pa.RecordBatch.from_pylist(rows, _SCHEMA)
        yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], ["key", *_SCHEMA.names])


def derivatives(responses: DataFrame, key_col: str = "key", record_col: str = "record") -> DataFrame:
    """key, response_id, metadata_id, conversion_id, target_uri, payload_digest, text, metadata, conversion, error of each response record."""
    kind = responses.schema[key_col].dataType.simpleString()
    rows = responses.select(F.col(key_col).alias("key"), F.col(record_col).alias("record"))
    return rows.mapInArrow(_derived, f"key {kind}, {_SPARK}")


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [response_record(str(k), u or "", p or "") for k, u, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["key", "record"])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """key, record: pages as WARC response records."""
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_responses, f"key {kind}, record binary")


def archive(records: list[bytes]) -> bytes:
    """Records as the content of a .warc.gz file, one gzip member each."""
    return b"".join(gzip.compress(r, 6, mtime=0) for r in records)


def _unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a .warc or .warc.gz file, in parts."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield data[at : at + step]
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member, done = zlib.decompressobj(31), False
        while not done:
            if at >= len(data):
                raise ValueError("truncated archive")
            piece = view[at : at + step]
            at += len(piece)
            try:
                out = member.decompress(piece, step)
                while True:
                    if out:
                        yield out
                    if member.eof or not member.unconsumed_tail:
                        break
                    out = member.decompress(member.unconsumed_tail, step)
            except zlib.error as e:
                raise ValueError("malformed archive") from e
            done = member.eof
        at -= len(member.unused_data)
        while at < len(data) and data[at] == 0:  # padding
            at += 1


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of a .warc or .warc.gz file, one by one. ValueError where the file cannot be read on."""
    held, parts, more = bytearray(), _unpacked(data), True
    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            length = re.search(rb"\r\ncontent-length:[ \t]*([0-9]{1,15})[ \t]*(?=\r\n)", bytes(held[: end + 2]), re.I)
            if not held.startswith(b"WARC/") or not length:
                raise ValueError("malformed record")
            size = end + 4 + int(length[1])
            if len(held) >= size:
                yield bytes(held[:size])
                del held[:size]
                continue
        elif len(held) > MOST_HEADER:
            raise ValueError("malformed record")
        part = next(parts, None)
        if part is None:
            if held:
                raise ValueError("truncated record")
            return
        held += part


def read_archive(data: bytes) -> list[tuple[Fields, bytes]]:
    """Header fields and blocks of the records of a .warc or .warc.gz file."""
    return [parse(r) for r in records_of(data)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["path", "position", "record", "error"], [pa.string(), pa.int64(), pa.binary(), pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            rows, size, n = [], 0, 0
            try:
                for record in records_of(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    rows.append((path.as_py(), n, record, None))
                    n, size = n + 1, size + len(record)
                    if size > 16 << 20:
                        yield made(rows)
                        rows, size = [], 0
            except ValueError as e:
                rows.append((path.as_py(), n, None, str(e)))
            if rows:
                yield made(rows)


def read_archives(spark, path: str, glob: str = "*") -> DataFrame:
    """path, position, record, error of the .warc and .warc.gz files under a path, a row a record.

    A file is one task's work (its members cannot be found without reading those before); Spark reads files of up
    to 2 GB so. A file that cannot be read on keeps the records before that place and gets a row with `error`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read, "path string, position long, record binary, error string")


#: A gzip member without content: what Spark's writer puts after each row of a .warc.gz file.
_EMPTY = gzip.compress(b"", 6, mtime=0)


def write_archives(derived: DataFrame, path: str, compressed: bool = True) -> None:
    """Writes the derivatives as WARC files, one a partition, through Spark's own writer: into any store, whole or not at all.

    compressed: each record is a gzip member. The files have the names that Spark gives to text files.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            rows = [[r for r in pair if r is not None] for pair in pairs]
            rows = [archive(r) if compressed else b"".join(r).removesuffix(b"\r\n\r\n") for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["warc"])

    rows = derived.where("error is null").select("metadata", "conversion").mapInArrow(pack, "warc binary")
    ending = _EMPTY.decode("latin-1") if compressed else "\r\n\r\n"
    rows.select(F.col("warc").cast("string")).write.option("lineSep", ending).option("encoding", "ISO-8859-1").text(path)


def op6_warc(spark, sf_dir) -> DataFrame:
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.select(
        F.col("key").alias("page_id"), "response_id", "metadata_id", "conversion_id", "target_uri", "payload_digest", "text",
        F.octet_length("metadata").alias("metadata_bytes"), F.octet_length("conversion").alias("conversion_bytes"),
        F.sha2("metadata", 256).alias("metadata_sha256"), F.sha2("conversion", 256).alias("conversion_sha256"), "error",
    )
