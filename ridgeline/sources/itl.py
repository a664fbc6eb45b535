"""Transaction files as DataFrames: whole files in, one nested row a transaction out, and back to bytes.

A file cannot be split (each record's start depends on the lengths before it), so a file is a row and the
parallelism is over files. decode() maps rows of (path, content) without a shuffle; encode() maps nested rows
back. Errors are columns; a damaged file never fails a job, and what was read before the damage stays.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.codes import EXTENSIONS, FS, GCA, GS, MAGIC, RS, field_code
from ridgeline.functions.text import decode_bytes

FIELDS = "array<struct<field:int,code:string,value:string,raw:binary>>"
RECORD = f"struct<record_index:int,record_type:int,idc:int,byte_offset:long,byte_length:long,binary_header:binary,image_data:binary,fields:{FIELDS}>"
TRANSACTION = f"path string, file_size long, bytes_read long, charset string, warnings array<string>, parse_error string, records array<{RECORD}>"

_FIELD_TYPE = pa.struct([("field", pa.int32()), ("code", pa.string()), ("value", pa.string()), ("raw", pa.binary())])
_RECORD_TYPE = pa.struct(
    [("record_index", pa.int32()), ("record_type", pa.int32()), ("idc", pa.int32()), ("byte_offset", pa.int64()), ("byte_length", pa.int64())]
    + [("binary_header", pa.binary()), ("image_data", pa.binary()), ("fields", pa.list_(_FIELD_TYPE))]
)
_TRANSACTION_TYPE = pa.schema(
    [("path", pa.string()), ("file_size", pa.int64()), ("bytes_read", pa.int64()), ("charset", pa.string()), ("warnings", pa.list_(pa.string()))]
    + [("parse_error", pa.string()), ("records", pa.list_(_RECORD_TYPE))]
)


class Malformed(ValueError):
    """What is wrong with a file, a record or an edit."""


# ---- reading --------------------------------------------------------------------------------------------

#: Binary records: header layout (big endian) and the fields it holds, in order. 6s is the finger positions.
LAYOUTS = {
    7: (struct.Struct(">IB"), ("LEN", "IDC")),
    8: (struct.Struct(">IBBBBHH"), ("LEN", "IDC", "SIG", "SRT", "ISR", "HLL", "VLL")),
    **{t: (struct.Struct(">IBB6sBHHB"), ("LEN", "IDC", "IMP", "FGP", "ISR", "HLL", "VLL", "GCA")) for t in (3, 4, 5, 6)},
}

_TAG = re.compile(rb"([^.]*)\.([^:.]*):")
_BLANK = b" \t\n\r\x0b\x0c"


def sniff(data: bytes) -> str | None:
    return next((name for magic, name in MAGIC.items() if data.startswith(bytes.fromhex(magic))), None)


def _number(raw: bytes, most: int, what: str) -> int:
    if not re.fullmatch(rb"\+?[0-9]+", raw) or int(raw) > most:
        raise Malformed(what)
    return int(raw)


def read_tag(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(record type, field, start of the value) of the tag T.NNN: at a position."""
    m = _TAG.match(data, at, end)
    if not m:
        dot = data.find(b".", at, end)
        if dot < 0:
            raise Malformed(f"expected '.' in tag at position {end}, found None")
        stop = min((p for p in (data.find(b":", dot + 1, end), data.find(b".", dot + 1, end)) if p >= 0), default=end)
        _number(data[at:dot].strip(_BLANK), 255, "record type tag is not a number")
        _number(data[dot + 1 : stop].strip(_BLANK), 65535, "field tag is not a number")
        raise Malformed(f"expected ':' in field tag at byte {stop}")
    kind = _number(m[1].strip(_BLANK), 255, "record type tag is not a number")
    return kind, _number(m[2].strip(_BLANK), 65535, "field tag is not a number"), m.end()


def _value_end(data: bytes, at: int, end: int, wide: bytes | None) -> int:
    """Where a value ends: at GS or FS, or for UTF-16 (wide: the next tag's start) in steps of a code unit."""
    if wide is None:
        stops = [p for p in (data.find(bytes([GS]), at, end), data.find(bytes([FS]), at, end)) if p >= 0]
        return min(stops, default=end)
    while at < end:
        if (at == end - 1 and data[at] == FS) or (data[at] == GS and data.startswith(wide, at + 1)):
            return at
        if end - at < 2:
            raise Malformed(f"unexpected end of file at position {at}: needed 2 bytes, only {end - at} left")
        at += 2
    return at


def _field(kind: int, number: int, value: str, raw: bytes | None = None) -> dict:
    return {"field": number, "code": field_code(kind, number), "value": value, "raw": raw}


def _first_record(data: bytes) -> tuple[dict, int, str]:
    """The Type-1 record by its separators, where it ends, and the character set it selects."""
    at, fields, charset = 0, [], "DEFAULT"
    while True:
        try:
            kind, number, start = read_tag(data, at, len(data))
        except Malformed as e:
            raise Malformed(f"Type-1 parsing at position {at}: {e}") from e
        if kind != 1:
            raise Malformed(f"expected Type-1 tag, got Type-{kind}")
        stop = start if number == 999 else _value_end(data, start, len(data), None)
        raw = data[start:stop]
        if number == 15:
            charset = {b"002": "UTF16", b"003": "UTF8"}.get(raw[:3], charset)
        fields.append(_field(1, number, decode_bytes(raw, "DEFAULT"), raw))
        if stop >= len(data):
            raise Malformed("Type-1: unexpected EOF")
        at = stop + 1
        if data[stop] == FS:
            return _record(1, 0, fields, None, None), at, charset
        if data[stop] not in (GS, RS):
            raise Malformed(f"Type-1: expected separator, found 0x{data[stop]:02X}")


def _record(kind, idc, fields, header, image) -> dict:
    return {"record_type": kind, "idc": idc, "fields": fields, "binary_header": header, "image_data": image}


def _tagged(data: bytes, start: int, kind: int, charset: str, images: bool) -> tuple[dict, int]:
    """A tagged record, framed by its LEN."""
    found, number, at = read_tag(data, start, len(data))
    at_end = _value_end(data, at, len(data), None)
    if found != kind or number != 1:
        raise Malformed(f"expected Type-{kind} LEN as the first field")
    length = _number(data[at:at_end], 1 << 62, "LEN field is not an integer")
    end = start + length
    if end > len(data) or end <= at_end:
        raise Malformed(f"Type-{kind}: invalid or truncated record length {length}")
    if data[end - 1] != FS:
        raise Malformed(f"Type-{kind}: record does not end with FS at its declared length")
    fields, idc, image, at = [_field(kind, 1, str(length))], 0, None, at_end
    while not (at == end - 1 and data[at] == FS):
        if at >= end or data[at] != GS:
            raise Malformed(f"Type-{kind}: expected field separator at byte {at - start}")
        found, number, value = read_tag(data, at + 1, end)
        if found != kind:
            raise Malformed(f"record type changed mid-record: expected {kind}, got {found}")
        if number == 999:  # all up to the last FS, whatever bytes it has
            image = data[value : end - 1] if images else b""
            fields.append(_field(kind, 999, ""))
            break
        at = _value_end(data, value, end, f"{kind}.".encode() if charset == "UTF16" and number > 2 else None)
        raw = data[value:at]
        text = raw.decode("utf-8", "replace") if number == 2 else decode_bytes(raw, charset)
        if number == 2:
            idc = _number(text.strip().encode(), 255, "IDC is not an unsigned byte")
        fields.append(_field(kind, number, text, raw))
    return _record(kind, idc, fields, None, image), end


def _need(data: bytes, at: int, n: int) -> None:
    if len(data) - at < n:
        raise Malformed(f"unexpected end of file at position {at}: needed {n} bytes, only {len(data) - at} left")


def _binary(data: bytes, start: int, kind: int, images: bool) -> tuple[dict, int]:
    """A record with a binary header."""
    layout, names = LAYOUTS[kind]
    _need(data, start, 4)
    length = int.from_bytes(data[start : start + 4], "big")
    if length < layout.size:
        raise Malformed({7: "Type-7: record length must be at least 5 bytes", 8: f"Type-8: invalid record length {length}"}.get(kind, f"Type-{kind}: invalid record length {length} (must be >= 18)"))
    _need(data, start, layout.size)
    _need(data, start + layout.size, length - layout.size)
    end = start + length
    values = dict(zip(names, layout.unpack_from(data, start)))
    payload = data[start + layout.size : end]
    if kind == 8:
        raw = (values["HLL"] + 7) // 8 * values["VLL"]
        values["GCA"] = "NONE" if values["SRT"] == 0 and len(payload) == raw else sniff(payload) or "NONE"
    elif kind != 7:
        width, height = values["HLL"], values["VLL"]
        raw = ((width + 7) // 8 if kind in (5, 6) else width) * height
        values["GCA"] = "NONE" if len(payload) == raw else sniff(payload) or GCA.get(values["GCA"], f"UNKNOWN({values['GCA']})")
        values["FGP"] = chr(RS).join(map(str, values["FGP"]))
    fields = [_field(kind, n, str(v)) for n, v in enumerate(values.values(), 1)]
    return _record(kind, values["IDC"], fields, data[start : start + layout.size], payload if images else b""), end


def declared_types(cnt: str) -> list[int]:
    entries = (e.split("\x1f")[0].strip() for e in cnt.split("\x1e")[1:])
    return [int(e) for e in entries if re.fullmatch(r"\+?[0-9]{1,9}", e) and int(e) <= 255]


def value_of(record: dict, code: str) -> str | None:
    return next((f["value"] for f in record["fields"] if f["code"] == code), None)


def parse(data: bytes, images: bool = True) -> dict:
    """A file as a row without its path. images=False leaves payloads empty (records with one keep a value)."""
    row = {"file_size": len(data), "bytes_read": 0, "charset": None, "warnings": [], "parse_error": None, "records": []}
    try:
        first, at, charset = _first_record(data)
    except Malformed as e:
        return row | {"parse_error": f"failed to parse Type-1 transaction information record: {e}"}
    warnings, records = [], []
    if value_of(first, "LEN") != str(at):
        declared = value_of(first, "LEN") or ""
        if not re.fullmatch(r"\+?0*" + str(at), declared):
            warnings.append("Type-1 length does not match the record bytes")
    cnt = value_of(first, "CNT")
    types = declared_types(cnt or "")
    first |= {"byte_offset": 0, "byte_length": at}
    while at < len(data):
        start, kind = at, types[len(records)] if len(records) < len(types) else None
        try:
            if kind not in LAYOUTS:
                while at < len(data) and data[at] in (RS, FS):
                    at += 1
                digits = re.compile(rb"[0-9]*").match(data, at)[0]
                if at == len(data):
                    start = at
                    break
                if not digits:
                    break
                seen = int(digits) if len(digits) < 9 and int(digits) <= 255 else 0
                kind = seen if kind is None else kind
            record, end = _binary(data, at, kind, images) if kind in LAYOUTS else _tagged(data, at, kind, charset, images)
        except Malformed as e:
            warnings.append(f"Stopped at byte {start}: {e}")
            break
        records.append(record | {"byte_offset": at, "byte_length": end - at})
        at = start = end
    else:
        start = at
    # Separators after the last record count as unread, as nothing follows them.
    start = records[-1]["byte_offset"] + records[-1]["byte_length"] if records else first["byte_length"]
    if start != len(data):
        warnings.append(f"{len(data) - start} input bytes could not be parsed")
    declared = re.fullmatch(r"\+?([0-9]+)", ((cnt or "").split("\x1e")[0].split("\x1f") + [""])[1])
    if not declared or int(declared[1]) != len(records) or len(types) != len(records):
        warnings.append("CNT does not match the number of parsed records")
    every = [{"record_index": i, **r} for i, r in enumerate([first, *records])]
    return row | {"bytes_read": start, "charset": charset, "warnings": warnings, "records": every}


def read_files(spark: SparkSession, path: str, glob: str = EXTENSIONS) -> DataFrame:
    """path, content of the transaction files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


#: Files are parsed in slices of about so many bytes.
SLICE_BYTES = 32 << 20


def _column(rows: list[dict], name: str, kind: pa.DataType) -> pa.Array:
    return pa.array([r.get(name) for r in rows], kind)


def _listed(counts: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _structs(rows: list[dict], kind: pa.StructType, nested: dict[str, pa.Array]) -> pa.Array:
    columns = [nested[f.name] if f.name in nested else _column(rows, f.name, f.type) for f in kind]
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Transactions as an Arrow batch, built column by column."""
    owned = [row["records"] or [] for row in rows]
    every = [r for records in owned for r in records]
    fields = [f for r in every for f in r["fields"]]
    fields = _listed([len(r["fields"]) for r in every], _structs(fields, _FIELD_TYPE, {}))
    records_ = _listed([len(records) for records in owned], _structs(every, _RECORD_TYPE, {"fields": fields}))
    return pa.RecordBatch.from_arrays([records_ if f.name == "records" else _column(rows, f.name, f.type) for f in schema], schema=schema)


def _split(values: list, counts: list[int]) -> list[list]:
    out, at = [], 0
    for n in counts:
        out.append(values[at : at + n])
        at += n
    return out


def records_in(column: pa.ListArray) -> list[list[dict]]:
    """A column of records as dictionaries, read column by column."""

    def rows(values: pa.StructArray, lists: dict[str, list]) -> list[dict]:
        names = [f.name for f in values.type]
        columns = [lists[n] if n in lists else c.to_pylist() for n, c in zip(names, values.flatten())]
        return [dict(zip(names, row)) for row in zip(*columns)]

    counts = [n or 0 for n in column.value_lengths().to_pylist()]
    every = column.flatten()
    own = every.field("fields") if every.offset == 0 else every.flatten()[every.type.get_field_index("fields")]
    fields = _split(rows(own.flatten(), {}), [n or 0 for n in own.value_lengths().to_pylist()])
    return _split(rows(every, {"fields": fields}), counts)


def sliced(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose values in a binary column have about so many bytes."""
    sizes = np.cumsum([n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()])
    at = 0
    while at < len(batch):
        before = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def decode(files: DataFrame, images: bool = True, raw: bool = True) -> DataFrame:
    """Nested transactions of (path, content). With images=False payload bytes, with raw=False the bytes of fields are not copied out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, 1):
                rows = [{"path": p, **parse(c or b"", images)} for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                if not raw:
                    for f in (f for row in rows for r in row["records"] for f in r["fields"]):
                        f["raw"] = None
                yield batch_of(rows, _TRANSACTION_TYPE)

    return files.select("path", "content").mapInArrow(run, TRANSACTION)


# ---- writing --------------------------------------------------------------------------------------------


def set_field(record: dict, number: int, code: str, value: str) -> None:
    """Sets a field, or inserts it before the first field with a larger number."""
    fields = record["fields"]
    for f in fields:
        if f["field"] == number:
            f["value"] = value
            return
    at = next((i for i, f in enumerate(fields) if f["field"] > number), len(fields))
    fields.insert(at, {"field": number, "code": code, "value": value, "raw": None})


def _encode_value(f: dict, charset: str) -> bytes:
    value = f["value"] or ""
    if "\x1c" in value or "\x1d" in value:
        raise Malformed(f"Field {f['field']} contains a reserved FS or GS separator")
    if f.get("raw") is not None and decode_bytes(f["raw"], charset) == value:
        return f["raw"]
    if charset == "DEFAULT":
        try:
            return value.encode("latin-1")
        except UnicodeEncodeError as e:
            raise Malformed(f"Field {f['field']} contains characters outside Latin-1; use a UTF-8 file") from e
    return value.encode("utf-8" if charset == "UTF8" else "utf-16-le", "surrogatepass")


def length_of(rest: int) -> int:
    """The least n with n = rest + the number of its digits."""
    return next(rest + d for d in range(1, 21) if len(str(rest + d)) <= d)


def _encode_tagged(record: dict, charset: str) -> bytes:
    kind = record["record_type"]
    set_field(record, 1, "LEN", "0")
    if record["fields"][0]["field"] != 1:
        raise Malformed("LEN must be the first field")
    seen, body = set(), []
    for f in record["fields"][1:]:
        n = f["field"]
        if not 2 <= n <= 999 or n in seen:
            raise Malformed(f"Invalid or duplicate field {n}")
        seen.add(n)
        if n == 999:
            if record["image_data"] is None:
                raise Malformed("DATA field has no binary payload")
            continue
        if kind == 1 and not (f["value"] or "").isascii():
            raise Malformed(f"Type-1 field {n} must contain ASCII characters")
        body.append(b"\x1d%d.%03d:" % (kind, n) + _encode_value(f, "DEFAULT" if n == 2 else charset))
    if record["image_data"] is not None:
        body.append(b"\x1d%d.999:" % kind + record["image_data"])
    tail, prefix = b"".join(body) + bytes([FS]), b"%d.001:" % kind
    length = length_of(len(prefix) + len(tail))
    set_field(record, 1, "LEN", str(length))
    return prefix + str(length).encode() + tail


def numeric_field(record: dict, number: int, most: int) -> int:
    f = next((f for f in record["fields"] if f["field"] == number), None)
    if f is None:
        raise Malformed(f"Missing field {number}")
    text = (f["value"] or "").strip()
    if not re.fullmatch(r"\+?[0-9]{1,18}", text) or int(text) > most:
        raise Malformed(f"Field {number} must be a valid unsigned integer within the header's range")
    return int(text)


def _encode_binary(record: dict) -> bytes:
    kind, header, payload = record["record_type"], record["binary_header"], record["image_data"]
    layout, names = LAYOUTS[kind]
    if header is None:
        raise Malformed("Missing original binary header")
    if len(header) != layout.size:
        raise Malformed("Invalid binary header size")
    if payload is None:
        raise Malformed("Missing binary payload")
    length = layout.size + len(payload)
    if length >> 32:
        raise Malformed("Binary record is too large")
    values = dict(zip(names, layout.unpack(header))) | {"LEN": length, "IDC": record["idc"]}
    for n, name in enumerate(names, 1):
        if name == "FGP":
            field = next((f for f in record["fields"] if f["field"] == n), None)
            if field is None:
                raise Malformed("Missing FGP field")
            parts = [p.strip() for p in (field["value"] or "").split("\x1e")]
            if not all(re.fullmatch(r"\+?[0-9]{1,9}", p) and int(p) <= 255 for p in parts):
                raise Malformed("FGP must contain six unsigned bytes separated by RS")
            if len(parts) != 6:
                raise Malformed("FGP must contain exactly six positions")
            values[name] = bytes(map(int, parts))
        elif name not in ("LEN", "IDC", "GCA"):  # the GCA byte stays as it was read
            values[name] = numeric_field(record, n, 65535 if name in ("HLL", "VLL") else 255)
    record["binary_header"] = layout.pack(*values.values())
    set_field(record, 1, "LEN", str(length))
    return record["binary_header"] + payload


def serialise(records: list[dict], warnings: list[str] | None = None) -> bytes:
    """Bytes of a transaction; LEN, CNT and idc of the given records are brought up to date. Malformed if it cannot be saved."""
    if warnings:
        raise Malformed("Cannot save an incompletely parsed file: " + "; ".join(warnings))
    if not records or records[0]["record_type"] != 1:
        raise Malformed("The first record must be Type-1")
    first, rest = records[0], records[1:]
    if any(r["record_type"] == 1 for r in rest):
        raise Malformed("Only one Type-1 record is allowed")
    for r in rest:
        r["idc"] = numeric_field(r, 2, 255)
    set_field(first, 3, "CNT", "\x1e".join([f"1\x1f{len(rest)}", *(f"{r['record_type']}\x1f{r['idc']:02}" for r in rest)]))
    dcs = value_of(first, "DCS")
    charset = {"003": "UTF8", "002": "UTF16", "000": "DEFAULT"}.get((dcs or "000")[:3])
    if charset is None or dcs is not None and not dcs.startswith(("000", "002", "003")):
        raise Malformed(f"Unsupported character set: {dcs}")
    out, at = [], 0
    for i, r in enumerate(records):
        try:
            out.append(_encode_binary(r) if r["record_type"] in LAYOUTS else _encode_tagged(r, charset if i else "DEFAULT"))
        except Malformed as e:
            raise Malformed(f"Type-{r['record_type']} IDC {r['idc']}: {e}" if i else str(e)) from e
        r |= {"byte_offset": at, "byte_length": len(out[-1]), "record_index": i}
        at += len(out[-1])
    return b"".join(out)


def encode(transactions: DataFrame) -> DataFrame:
    """path, content, error: nested transactions as bytes. On an error content is null and the input stays what it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, records, warnings in zip(b.column(0).to_pylist(), records_in(b.column(1)), b.column(2).to_pylist()):
                try:
                    rows.append({"path": path, "content": serialise(records, warnings)})
                except Malformed as e:
                    rows.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())]))

    return transactions.select("path", "records", "warnings").mapInArrow(run, "path string, content binary, error string")


#: Edits of at most so many files and bytes are broadcast; more of them meet their transactions by shuffle.
BROADCAST_EDITS, BROADCAST_BYTES = 100_000, 64 << 20


def with_edits(transactions: DataFrame, by_path: DataFrame, size) -> DataFrame:
    """transactions with the column todo of by_path (path, todo), or null. size: a column with the bytes of a row's edits."""
    n, total = by_path.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    small = n <= BROADCAST_EDITS and total <= BROADCAST_BYTES
    return transactions.join(F.broadcast(by_path) if small else by_path, "path", "left")


def recalculate(transactions: DataFrame) -> DataFrame:
    """Transactions with LEN, CNT and idc brought up to date; those that cannot be saved stay as they are, with `edit_error`."""
    return map_records(transactions, lambda records, warnings, _: serialise(records, warnings))


def map_records(transactions: DataFrame, edit, extra: str | None = None) -> DataFrame:
    """Runs edit(records, warnings, value of the extra column) on each transaction's own copy of its records.

    With an extra column, transactions that have no value there pass through untouched. An edit that raises Malformed leaves the transaction as it was and sets edit_error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _TRANSACTION_TYPE.append(pa.field("edit_error", pa.string()))
        plain = [n for n in _TRANSACTION_TYPE.names if n != "records"]
        for b in batches:
            rows = [dict(zip(plain, row)) for row in zip(*(b.column(n).to_pylist() for n in plain))]
            values = b.column(extra).to_pylist() if extra else [None] * len(b)
            for row, before, value in zip(rows, records_in(b.column("records")), values):
                row |= {"records": before, "edit_error": None}
                if extra and value is None:  # nothing to do
                    continue
                copy = [{**r, "fields": [dict(f) for f in r["fields"]]} for r in before]
                try:
                    edit(copy, row["warnings"], value)
                    row["records"] = copy
                except Malformed as e:
                    row["edit_error"] = str(e)
            yield batch_of(rows, schema)

    columns = [f.name for f in _TRANSACTION_TYPE] + ([extra] if extra else [])
    return transactions.select(*columns).mapInArrow(run, TRANSACTION + ", edit_error string")


# ---- views ----------------------------------------------------------------------------------------------


def files(transactions: DataFrame) -> DataFrame:
    return transactions.select("path", "file_size", "bytes_read", "charset", "warnings", (F.size("warnings") > 0).alias("read_only"), "parse_error")


def records(transactions: DataFrame) -> DataFrame:
    """One row a record, Type-1 first (record_index 0)."""
    return transactions.select("path", "warnings", F.explode("records").alias("r")).select("path", "warnings", "r.*")


def fields(transactions: DataFrame) -> DataFrame:
    own = records(transactions).select("path", "warnings", "record_index", "record_type", F.octet_length("image_data").alias("image_bytes"), F.posexplode("fields").alias("field_pos", "f"))
    return own.select("path", "warnings", "record_index", "record_type", "image_bytes", "field_pos", "f.field", "f.code", "f.value", "f.raw")


def items(transactions: DataFrame) -> DataFrame:
    """One row an item: subfields are parted by RS, items by US."""
    subfields = fields(transactions).select("path", "record_index", "field", F.posexplode(F.split("value", chr(RS), -1)).alias("subfield_pos", "s"))
    return subfields.select("path", "record_index", "field", "subfield_pos", F.posexplode(F.split("s", "\x1f", -1)).alias("item_pos", "item"))


def cnt(transactions: DataFrame) -> DataFrame:
    """The directory in Type-1: one row an entry after the first."""
    own = items(transactions).where((F.col("record_index") == 0) & (F.col("field") == 3) & (F.col("subfield_pos") > 0))
    pick = lambda n: F.max(F.when(F.col("item_pos") == n, F.col("item")))
    return own.groupBy("path", F.col("subfield_pos").alias("entry_pos")).agg(F.trim(pick(0)).try_cast("int").alias("declared_type"), pick(1).alias("declared_idc"))


def register_views(transactions: DataFrame) -> None:
    """files, records, fields, items and cnt as temporary views for SQL."""
    for name, make in (("files", files), ("records", records), ("fields", fields), ("items", items), ("cnt", cnt)):
        make(transactions).createOrReplaceTempView(name)
