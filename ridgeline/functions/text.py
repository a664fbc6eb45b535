"""Character sets, escapes and separator lists, as columns; kernels for what columns cannot say."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RS, US = "\x1e", "\x1f"
#: Valid escaped drafts.
DRAFT = r"^([^\\]|\\\\|\\x1[eEfF])*$"


def latin1(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def utf8_lossy(raw: Column) -> Column:
    return F.call_function("make_valid_utf8", raw.cast("string"))


def decode_bytes(raw: bytes, charset: str) -> str:
    """Text of a field value; invalid input becomes U+FFFD."""
    if charset == "UTF8":
        return raw.decode("utf-8", "replace")
    if charset == "UTF16":
        raw = raw[2:] if raw[:2] == b"\xff\xfe" else raw
        return raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace")
    return raw.decode("latin-1")


def charset_of(dcs: Column) -> Column:
    """Character set that a DCS value selects for reading."""
    return F.when(dcs.startswith("002"), "UTF16").when(dcs.startswith("003"), "UTF8").otherwise("DEFAULT")


def escape_value(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit(RS), F.lit("\\x1e")), F.lit(US), F.lit("\\x1f"))


def unescape_value(draft: Column) -> Column:
    """The value of an escaped draft, null if it is not valid.

    Escaped backslashes are set aside by splitting at them, so each piece has separator escapes only.
    """
    plain = lambda p: F.regexp_replace(F.regexp_replace(p, r"\\x1[eE]", RS), r"\\x1[fF]", US)
    pieces = F.transform(F.split(draft, r"\\\\", -1), plain)
    return F.when(draft.rlike("(?s)" + DRAFT), F.array_join(pieces, "\\"))


def unescape(draft: str) -> str:
    if not re.fullmatch(DRAFT, draft, re.S):
        raise ValueError("Invalid escape in field value; use \\\\, \\x1e or \\x1f")
    return re.sub(r"\\(\\|x1[eEfF])", lambda m: "\\" if m[1] == "\\" else chr(int(m[1][1:], 16)), draft)


def items(value: Column) -> Column:
    """Subfields (RS) of items (US) of a value."""
    return F.transform(F.split(value, RS, -1), lambda s: F.split(s, US, -1))


def cnt_types(cnt: Column) -> Column:
    """Record types that a CNT value declares; entries that are no unsigned byte are left out."""
    entries = F.slice(F.split(cnt, RS, -1), 2, 1_000_000)
    numbers = F.transform(entries, lambda e: F.regexp_extract(F.trim(F.split(e, US, -1)[0]), r"^\+?([0-9]{1,9})$", 1))
    return F.filter(F.transform(numbers, lambda n: n.try_cast("int")), lambda n: n.between(0, 255))


def declared_records(cnt: Column) -> Column:
    first = F.get(F.split(cnt, RS, -1), F.lit(0))
    return F.regexp_extract(F.coalesce(F.get(F.split(first, US, -1), F.lit(1)), F.lit("")), r"^\+?([0-9]{1,18})$", 1).try_cast("long")


def unsigned(value: Column) -> Column:
    """A value as an unsigned number, null if it is anything but digits."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"^\+?([0-9]{1,18})$", 1).try_cast("long")


def tag(record_type: Column, field: Column) -> Column:
    return F.concat(record_type.cast("string"), F.lit("."), F.lpad(field.cast("string"), 3, "0"), F.lit(":"))


def idc_text(idc: Column) -> Column:
    return F.format_string("%02d", idc)


def is_ascii(value: Column) -> Column:
    return value.rlike(r"(?s)^[\x00-\x7F]*$")


def finger_positions(raw: Column) -> Column:
    """Six header bytes as RS-joined decimals."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10)), RS)
