"""Lengths, sizes and indices as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_length(rest: Column) -> Column:
    """LEN of a tagged record that has `rest` bytes besides LEN's own digits: the least n with n = rest + digits(n)."""
    out = None
    for d in range(1, 11):
        n = rest + F.lit(d)
        fits = n < F.lit(10**d)
        out = F.when(fits, n) if out is None else out.when(fits, n)
    return out


def row_bytes(width: Column, bits: Column) -> Column:
    """Bytes of a row of pixels: packed for 1 bit, else whole bytes a sample (8 gray, 24 colour)."""
    return F.when(bits == 1, F.floor((width + 7) / 8)).otherwise(width * F.floor(bits / 8)).cast("long")


def raw_size(width: Column, height: Column, bits: Column) -> Column:
    return row_bytes(width.cast("long"), bits) * height.cast("long")


def proportional(value: Column, numerator: Column, denominator: Column) -> Column:
    """value * numerator / denominator, rounded, at least 1."""
    by = F.greatest(denominator.cast("long"), F.lit(1).cast("long"))
    return F.greatest(F.floor((value.cast("long") * numerator.cast("long") + F.floor(by / 2)) / by), F.lit(1)).cast("long")


def scaled_size(width: Column, height: Column, most: Column) -> Column:
    """(width, height) shrunk so that the longer side is at most `most`; (0, 0) for an empty image."""
    scale = F.least(F.lit(1.0).cast("float"), (most.cast("float") / F.greatest(width, height).cast("float")).cast("float"))
    side = lambda v: F.greatest(F.lit(1), F.floor((v.cast("float") * scale).cast("float") + F.lit(0.5))).cast("int")
    empty = (width == 0) | (height == 0)
    return F.struct(F.when(empty, 0).otherwise(side(width)).alias("width"), F.when(empty, 0).otherwise(side(height)).alias("height"))


def reflect(index: Column, length: Column) -> Column:
    """Index under whole-sample symmetric extension of a line of `length` samples."""
    period = F.greatest(2 * (length - 1), F.lit(1))
    at = F.pmod(index, period)
    return F.when(length <= 1, 0).otherwise(F.least(at, period - at)).cast("long")


def sign_of_power(n: Column) -> Column:
    return F.when(F.pmod(n, F.lit(2)) == 0, 1).otherwise(-1)


def low_bits(n: Column) -> Column:
    return (F.call_function("shiftleft", F.lit(1), n.cast("int")) - 1).cast("int")


def resize_error(record_type: Column, width: Column, height: Column, wsq: Column, most_bytes: int = 512 << 20) -> Column:
    """Why an image may not be resized to a size; null if it may."""
    ok_type = record_type.isin(3, 4, 5, 6, 8, 10, 13, 14, 15, 16, 17)
    return (
        F.when(~ok_type, F.concat(F.lit("Resizing is not supported for Type-"), record_type.cast("string")))
        .when((width <= 0) | (height <= 0), "Width and height must be greater than zero")
        .when(wsq & ~record_type.isin(3, 4, 13, 14, 15, 16), "This record type cannot store a resized WSQ image")
        .when(wsq & ~(width.between(128, 65535) & height.between(128, 65535)), "WSQ resizing supports dimensions from 128 to 65535 pixels; the original image is kept for unsupported sizes")
        .when(record_type.between(3, 8) & ((width > 65535) | (height > 65535)), "Legacy binary records support dimensions of at most 65535 pixels")
        .when(width.cast("long") * height.cast("long") * 4 > most_bytes, "Requested image exceeds the image processing memory limit; choose smaller dimensions")
    )
