"""Images of records: decode, replace, resize, export."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import raster, wsq
from ridgeline.functions.codes import REPLACEABLE
from ridgeline.functions.raster import Raster, RasterError
from ridgeline.operators.records import apply_todo
from ridgeline.sources import itl
from ridgeline.sources.itl import Malformed

BITONAL = (5, 6, 8)
IMAGES = "path string, record_index int, width int, height int, channels int, pixels binary, source string, ppi int, decode_error string"
_IMAGES = pa.schema(
    [("path", pa.string()), ("record_index", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary())]
    + [("source", pa.string()), ("ppi", pa.int32()), ("decode_error", pa.string())]
)


def _side(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("+").isdecimal() and text.isascii() and int(text) < 1 << 32 else None


def _shape(record: dict) -> tuple[int | None, int | None, int | None]:
    """(width, height, raw size) that the record's fields declare."""
    width, height = _side(itl.value_of(record, "HLL")), _side(itl.value_of(record, "VLL"))
    if width is None or height is None:
        return width, height, None
    colour = record["record_type"] in (10, 16, 17) and itl.value_of(record, "CSP") in ("RGB", "SRGB")
    row = (width + 7) // 8 if record["record_type"] in BITONAL else width * (3 if colour else 1)
    return width, height, row * height


def compression(record: dict) -> str | None:
    return itl.value_of(record, "CGA") if itl.value_of(record, "CGA") is not None else itl.value_of(record, "GCA")


def _plain(record: dict) -> bool:
    return (compression(record) or "NONE").upper() == "NONE"


def is_wsq(record: dict) -> bool:
    """By leading bytes, unless the payload has the exact size of raw pixels that the record declares."""
    data = record["image_data"] or b""
    return data[:2] == b"\xff\xa0" and not (_plain(record) and _shape(record)[2] == len(data))


def decode_record(record: dict, preview: bool = False) -> Raster:
    """The image of a record. preview: also takes raw payloads that are longer than declared, as gray."""
    data, kind = record["image_data"], record["record_type"]
    if not data:
        raise RasterError("Record has no image")
    if not preview and kind == 8 and itl.value_of(record, "SRT") == "2":
        raise RasterError("Vector signature data cannot be resized as a raster image")
    width, height, size = _shape(record)
    if preview and (width == 0 or height == 0):
        raise RasterError("Image dimensions must be positive")
    if _plain(record) and size is not None and (len(data) == size or preview and len(data) >= size):
        raster._checked(width, height)
        data = data[:size]
        if kind in BITONAL:
            return Raster(raster.unpack_bitonal(data, width, height)[..., None], "raw 1-bit")
        channels = size // (width * height)
        pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        return Raster(pixels, "raw")
    return raster.read_image(data)


def images(records: DataFrame, preview: bool = False, spread: bool = False) -> DataFrame:
    """Decoded images of records (path, record_index, record_type, image_data, fields), one row an image.

    spread: rows are dealt by record first, for few files with very many images each, which else keep one task
    a file busy; that moves every payload once.
    """
    own = records.where(F.col("image_data").isNotNull()).select("path", "record_index", "record_type", "image_data", "fields")
    own = own.repartition(F.col("path"), F.col("record_index")) if spread else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                rows = []
                for r in b.slice(at, 64).to_pylist():
                    row = {"path": r["path"], "record_index": r["record_index"]}
                    try:
                        made = decode_record(r, preview)
                        row |= {"width": made.size[0], "height": made.size[1], "channels": made.pixels.shape[2], "pixels": made.pixels.tobytes(), "source": made.source, "ppi": made.ppi}
                    except RasterError as e:
                        row["decode_error"] = str(e)
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, _IMAGES)

    return own.mapInArrow(run, IMAGES)


def can_replace(record: dict) -> bool:
    return record["image_data"] is not None and record["record_type"] in REPLACEABLE


#: Types whose images are gray, whatever was given; and types that may hold a WSQ stream.
_GRAY_ONLY, _HOLDS_WSQ = (3, 4, 5, 6, 8, 13, 14, 15), (3, 4, 13, 14, 15, 16)


def store(record: dict, image: Raster, original: bytes | None) -> None:
    """Puts an image into a record and sets what describes it. original: the file it came from, kept if the record may hold it."""
    kind, (width, height) = record["record_type"], image.size
    binary = kind in itl.LAYOUTS
    if binary and max(width, height) > 65535:
        raise Malformed("Legacy binary records support dimensions of at most 65535 pixels")
    gray_only = kind in _GRAY_ONLY or kind == 17 and any(f["field"] == 25 and f["value"] == "NIR" for f in record["fields"])
    gray = gray_only or image.gray
    flat = raster.luma(image.pixels)[..., None] if gray else raster.on_white(image.pixels)
    as_is = original is not None and not image.alpha and (not gray_only or image.gray)
    if original is not None and original[:2] == b"\xff\xa0" and kind in _HOLDS_WSQ:
        payload, name = original, "WSQ20"
    elif binary:
        payload, name = raster.pack_bitonal(flat[..., 0]) if kind in BITONAL else flat.tobytes(), "NONE"
    elif as_is and image.source == "PNG" and original[24] == 8 and original[25] in (0, 2):
        payload, name = original, "PNG"
    elif as_is and image.source == "JPEG" and raster.baseline_jpeg(original):
        payload, name = original, "JPEGB"
    else:
        payload, name = raster.write_png(flat), "PNG"
    described = [(6, "HLL", str(width)), (7, "VLL", str(height))]
    space = "GRAY" if gray else "RGB"
    if binary:
        described.append((8, "GCA", name))
        if kind == 8:
            described.append((4, "SRT", "0"))
        elif record["binary_header"] is None or len(record["binary_header"]) != 18:
            raise Malformed("Invalid binary image header" if record["binary_header"] else "Missing binary image header")
        else:
            record["binary_header"] = record["binary_header"][:17] + bytes([name == "WSQ20"])
    else:
        described += [(11, "CGA", name), (12, "CSP", space) if kind == 10 else (12, "BPX", "8")]
        described += [(13, "CSP", space)] if kind in (16, 17) else []
        described.append((999, "DATA", ""))
    for number, code, value in described:
        itl.set_field(record, number, code, value)
    record["image_data"] = payload


def _own(records: list[dict], warnings: list[str], index: int) -> dict:
    if warnings:
        raise Malformed("Cannot edit an incompletely parsed file")
    if not 0 <= index < len(records):
        raise Malformed("No record selected")
    return records[index]


def replace_in(records: list[dict], warnings: list[str], index: int, data: bytes) -> None:
    record = _own(records, warnings, index)
    if not can_replace(record):
        raise Malformed(f"Image replacement is not supported for Type-{record['record_type']}")
    try:
        image = raster.read_image(data)
    except RasterError as e:
        raise Malformed(str(e)) from e
    store(record, image, data)
    itl.serialise(records, warnings)


def resize_in(records: list[dict], warnings: list[str], index: int, width: int, height: int) -> None:
    record = _own(records, warnings, index)
    kind, data = record["record_type"], record["image_data"]
    if not can_replace(record):
        raise Malformed(f"Resizing is not supported for Type-{kind}")
    if width <= 0 or height <= 0:
        raise Malformed("Width and height must be greater than zero")
    coded = is_wsq(record)
    if coded and kind not in _HOLDS_WSQ:
        raise Malformed("This record type cannot store a resized WSQ image")
    if coded and not all(wsq.LEAST_SIDE <= n <= wsq.MOST_SIDE for n in (width, height)):
        raise Malformed(f"WSQ resizing supports dimensions from {wsq.LEAST_SIDE} to 65535 pixels; the original image is kept for unsupported sizes")
    if kind in itl.LAYOUTS and max(width, height) > 65535:
        raise Malformed("Legacy binary records support dimensions of at most 65535 pixels")
    if width * height * 4 > raster.MOST_BYTES:
        raise Malformed("Requested image exceeds the image processing memory limit; choose smaller dimensions")
    try:
        image = raster.read_image(data) if coded else decode_record(record)
        if image.size == (width, height):
            return
        flat = raster.luma(image.pixels)[..., None] if image.gray else raster.on_white(image.pixels)
        made = raster.resize(flat, width, height, "nearest" if kind in BITONAL else "lanczos3")
        stream = wsq.encode(made.tobytes(), width, height, image.ppi, wsq.source_bitrate(data)) if coded else None
    except (RasterError, wsq.WsqError) as e:
        raise Malformed(str(e)) from e
    store(record, Raster(made, "WSQ" if coded else "resized"), stream)
    itl.serialise(records, warnings)


def replace_images(transactions: DataFrame, replacements: DataFrame) -> DataFrame:
    """Transactions with images replaced by image files: replacements(path, record_index, data). See itl.map_records for failures."""
    by_path = replacements.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("record_index", "data"))).alias("todo"))

    def edit(records, warnings, todo):
        for t in todo or []:
            replace_in(records, warnings, t["record_index"], t["data"])

    size = F.aggregate("todo", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["data"]) + 8)
    return itl.map_records(itl.with_edits(transactions, by_path, size), edit, "todo")


def resize_images(transactions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Transactions with images resized: sizes(path, record_index, width, height)."""
    by_path = sizes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("record_index", "width", "height"))).alias("todo"))

    def edit(records, warnings, todo):
        for t in todo or []:
            resize_in(records, warnings, t["record_index"], t["width"], t["height"])

    return itl.map_records(itl.with_edits(transactions, by_path, F.size("todo") * 12), edit, "todo")


def edit_files(transactions: DataFrame, drafts: DataFrame | None = None, replacements: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Field drafts (path, record_index, field, draft_value), image files (path, record_index, data) and new sizes
    (path, record_index, width, height) as one edit a file, in that order: all of a file's edits hold, or none (edit_error)."""
    kinds = {"record_index": "int", "field": "int", "draft_value": "string", "data": "binary", "width": "int", "height": "int"}
    todo = None
    for step, given in enumerate((drafts, replacements, sizes)):
        if given is None:
            continue
        columns = [(F.col(c) if c in given.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        rows = given.select("path", F.struct(F.lit(step).alias("step"), *columns).alias("t"))
        todo = rows if todo is None else todo.unionByName(rows)
    if todo is None:
        return transactions.withColumn("edit_error", F.lit(None).cast("string"))
    by_path = todo.groupBy("path").agg(F.sort_array(F.collect_list("t")).alias("todo"))

    def edit(records, warnings, todo):
        drafted = [t for t in todo if t["step"] == 0]
        if drafted:
            apply_todo(records, drafted)
            itl.serialise(records, warnings)
        for t in todo:
            if t["step"] == 1:
                replace_in(records, warnings, t["record_index"], t["data"])
            elif t["step"] == 2:
                resize_in(records, warnings, t["record_index"], t["width"], t["height"])

    size = F.aggregate("todo", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.octet_length(t["data"]), F.octet_length(t["draft_value"]), F.lit(0)) + 32)
    return itl.map_records(itl.with_edits(transactions, by_path, size), edit, "todo")


def read_images(files: DataFrame, preview: bool = True) -> DataFrame:
    """Image files (path, content), such as bare WSQ streams, as images() gives those of records."""
    empty = F.array().cast("array<struct<field:int,code:string,value:string,raw:binary>>")
    return images(files.select("path", F.lit(0).alias("record_index"), F.lit(0).alias("record_type"), F.col("content").alias("image_data"), empty.alias("fields")), preview)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for data in b.column(5):
            p = np.frombuffer(data.as_buffer(), np.uint8) if data.is_valid else np.empty(0, np.uint8)
            rows.append((int(p.min()), int(p.max()), int(p.sum(dtype=np.int64)) // len(p)) if len(p) else (None, None, None))
        columns = [b.column(k) for k in (0, 1, 2, 3, 4, 6)] + [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["path", "record_index", "width", "height", "source", "decode_error", "low", "high", "mean"])


def image_stats(images_df: DataFrame) -> DataFrame:
    """path, record_index, width, height, source, decode_error, and the least, largest and (whole) mean sample of decoded images."""
    rows = images_df.select("path", "record_index", "width", "height", "source", "pixels", "decode_error")
    return rows.mapInArrow(_measure, "path string, record_index int, width int, height int, source string, decode_error string, low int, high int, mean int")


def dump(transactions: DataFrame) -> DataFrame:
    """A row a record, for looking at files: type, idc, bytes, number of fields, what the image is and its samples' least, largest and mean."""
    records = itl.records(transactions)
    listed = records.select("path", "record_index", "record_type", "idc", "byte_length", F.size("fields").alias("n_fields"), F.octet_length("image_data").alias("image_bytes"))
    return listed.join(image_stats(images(records, preview=True)), ["path", "record_index"], "left")


def export_png(images_df: DataFrame) -> DataFrame:
    """path, record_index, png of decoded images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [raster.write_png(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], r["channels"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["path", "record_index", "png"])

    rows = images_df.where("decode_error is null").select("path", "record_index", "width", "height", "channels", "pixels")
    return rows.mapInArrow(run, "path string, record_index int, png binary")
