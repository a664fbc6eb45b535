"""Transactions built from table rows, as expressions over binary columns.

This is an encoder of its own, beside itl.serialise(): queries that write here and read with itl.decode()
check one against the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geometry import record_length

_GS, _FS = "\x1d", "\x1c"


def _bytes(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("binary")


def tagged(kind: int, fields: list[tuple[int, Column | str]], image: Column | None = None) -> Column:
    """A tagged record: LEN first, then the fields, then the payload."""
    parts = [p for n, v in fields for p in (_bytes(f"{_GS}{kind}.{n:03d}:"), _bytes(v))]
    if image is not None:
        parts += [_bytes(f"{_GS}{kind}.999:"), image]
    body, prefix = F.concat(*parts, _bytes(_FS)), f"{kind}.001:"
    length = record_length(F.octet_length(body) + len(prefix))
    return F.concat(_bytes(prefix), _bytes(length.cast("string")), body)


def number(value: Column, size: int) -> Column:
    """A big-endian unsigned number."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def binary_image(idc: Column, width: Column, height: Column, gca: Column, payload: Column) -> Column:
    """A Type-3 to 6 record."""
    head = [number(F.octet_length(payload) + 18, 4), number(idc, 1), F.unhex(F.lit("0001FFFFFFFFFF00")), number(width, 2), number(height, 2), number(gca, 1)]
    return F.concat(*head, payload)


def transaction(control: Column | str, records: list[tuple[int, int, Column]], dcs: str | None = "003\x1fUTF-8", declared: Column | None = None) -> Column:
    """A file: Type-1 with its directory, then the records (type, idc, bytes). declared: another count for the directory."""
    count = F.lit(str(len(records))) if declared is None else declared.cast("string")
    entries = "".join(f"\x1e{t}\x1f{i:02d}" for t, i, _ in records)
    cnt = F.concat(F.lit("1\x1f"), count, F.lit(entries))
    fields: list = [(2, "0400"), (3, cnt), (9, control)] + ([(15, dcs)] if dcs else [])
    return F.concat(tagged(1, fields), *[r for _, _, r in records])


def pixels(embedding: Column) -> Column:
    """An embedding as gray samples: floor((x + 1) * 127.5), one byte each."""
    return F.unhex(F.array_join(F.transform(embedding, lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("long")), 2, "0")), ""))


def documents(docs: DataFrame) -> DataFrame:
    """path, content: one transaction a document, with language, source and text in a Type-2 record."""
    record = tagged(2, [(2, "00"), (3, F.col("lang")), (4, F.col("source")), (5, F.col("text"))])
    return docs.select(F.col("doc_id").cast("string").alias("path"), transaction(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), [(2, 0, record)]).alias("content"))


def images(embeddings: DataFrame, kind: int = 4) -> DataFrame:
    """path, content: one transaction a vector, with an 8 by 8 image in a record of a type."""
    data = pixels(F.col("embedding"))
    if kind in (3, 4):
        record = binary_image(F.lit(1), F.lit(8), F.lit(8), F.lit(0), data)
    else:
        extra = [(11, "NONE"), (12, "GRAY" if kind == 10 else "8")]
        record = tagged(kind, [(2, "01"), (6, "8"), (7, "8"), *extra], data)
    return embeddings.select(F.col("vec_id").cast("string").alias("path"), transaction(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")), [(kind, 1, record)]).alias("content"))
