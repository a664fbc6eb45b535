"""Code tables of the transaction format and the column functions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format: separators, record type names, field codes, image codes, WSQ markers.
US, RS, GS, FS = 0x1F, 0x1E, 0x1D, 0x1C

RECORD_TYPES = {
    1: "Type-1: Transaction Information",
    2: "Type-2: User-defined Descriptive Text",
    3: "Type-3: Low-resolution Grayscale Fingerprint",
    4: "Type-4: High-resolution Grayscale Fingerprint",
    5: "Type-5: Low-resolution Binary Fingerprint",
    6: "Type-6: High-resolution Binary Fingerprint",
    7: "Type-7: User-defined Image",
    8: "Type-8: Signature Image",
    9: "Type-9: Minutiae Data",
    10: "Type-10: Facial & SMT Image",
    11: "Type-11: Forensic & Investigatory Voice",
    12: "Type-12: Forensic Dental & Oral Care Data",
    13: "Type-13: Variable-resolution Latent Image",
    14: "Type-14: Variable-resolution Fingerprint",
    15: "Type-15: Palm Print Image",
    16: "Type-16: User-defined Test Image",
    17: "Type-17: Iris Image",
    99: "Type-99: CBEFF (Biometric Data Block)",
}

_VARIABLE = "1 LEN, 2 IDC, 3 IMP, 4 SRC, 5 FCD, 6 HLL, 7 VLL, 8 SLC, 9 HPS, 10 VPS, 11 CGA, 12 BPX, 13 FGP, 999 DATA"
_TESTING = "1 LEN, 2 IDC, 6 HLL, 7 VLL, 8 SLC, 9 HPS, 10 VPS, 11 CGA, 12 BPX, 13 CSP, 999 DATA"
_HEADER = "1 LEN, 2 IDC, 3 IMP, 4 FGP, 5 ISR, 6 HLL, 7 VLL, 8 GCA"
FIELD_CODES_TEXT = {
    1: "1 LEN, 2 VER, 3 CNT, 4 TOT, 5 DAT, 6 PRY, 7 DAI, 8 ORI, 9 TCN, 10 TCR, 11 NSR, 12 NTR, 13 DOM, 14 GMT, 15 DCS, 16 APS, 17 ANM, 18 GNS",
    2: "1 LEN, 2 IDC",
    3: _HEADER, 4: _HEADER, 5: _HEADER, 6: _HEADER,
    7: "1 LEN, 2 IDC",
    8: "1 LEN, 2 IDC, 3 SIG, 4 SRT, 5 ISR, 6 HLL, 7 VLL, 8 GCA",
    9: "1 LEN, 2 IDC, 3 IMP, 4 FGP, 12 ISR, 13 HLL, 14 VLL, 20 COM, 999 DATA",
    10: "1 LEN, 2 IDC, 3 IMT, 4 SRC, 5 PHD, 6 HLL, 7 VLL, 8 SLC, 9 HPS, 10 VPS, 11 CGA, 12 CSP, 13 SAP, 14 FIP, 20 POS, 21 POA, 38 COM, 39 T10, 40 SMT, 999 DATA",
    13: _VARIABLE + ", 22 NQM", 14: _VARIABLE + ", 22 NQM", 15: _VARIABLE,
    16: _TESTING, 17: _TESTING,
}
#: GCA byte of binary image records.
GCA = {0: "NONE", 1: "WSQ20", 2: "JPEGB", 3: "JPEGL"}
#: Leading bytes of payloads, in hex.
MAGIC = {"FFA0": "WSQ20", "FFD8": "JPEG", "89504E47": "PNG"}
WSQ_MARKERS = {0xFFA0: "SOI", 0xFFA1: "EOI", 0xFFA2: "SOF", 0xFFA3: "SOB", 0xFFA4: "DTT", 0xFFA5: "DQT", 0xFFA6: "DHT", 0xFFA7: "DRT", 0xFFA8: "COM"}
REPLACEABLE = (3, 4, 5, 6, 8, 10, 13, 14, 15, 16, 17)
EXTENSIONS = "*.{an2,nst,eft,nist}"

FIELD_CODES = {(t, int(n)): code for t, text in FIELD_CODES_TEXT.items() for n, code in (x.split() for x in text.split(", "))}


def field_code(record_type: int, field: int) -> str:
    return FIELD_CODES.get((record_type, field)) or ("UTF" if record_type == 2 else {1: "LEN", 999: "DATA"}.get(field, ""))


def record_types(spark: SparkSession) -> DataFrame:
    """The record type dimension, 18 rows."""
    return spark.createDataFrame(sorted(RECORD_TYPES.items()), "record_type int, type_name string")


def field_codes(spark: SparkSession) -> DataFrame:
    """The field dictionary, one row a known (type, field)."""
    return spark.createDataFrame([(t, f, c) for (t, f), c in sorted(FIELD_CODES.items())], "record_type int, field int, code string")


def _lookup(values: dict[int, str], key: Column, default: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def type_name(record_type: Column) -> Column:
    return _lookup(RECORD_TYPES, record_type, F.lit("Unknown"))


def type_label(record_type: Column) -> Column:
    return F.concat(F.lit("Type-"), record_type.cast("string"))


def with_codes(fields: DataFrame) -> DataFrame:
    """fields (record_type, field, ...) with their code: a join with the dictionary, whose size is fixed."""
    out = fields.join(F.broadcast(field_codes(fields.sparkSession)), ["record_type", "field"], "left")
    return out.withColumn("code", F.coalesce("code", F.when(F.col("record_type") == 2, "UTF").when(F.col("field") == 1, "LEN").when(F.col("field") == 999, "DATA").otherwise("")))


def sniff_compression(data: Column) -> Column:
    """Compression by leading bytes; null if unknown."""
    out = None
    for magic, name in MAGIC.items():
        hit = F.substring(data, 1, len(magic) // 2) == F.unhex(F.lit(magic))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def gca_name(byte: Column, data: Column, raw_size: Column) -> Column:
    """Compression of a Type-3 to 6 payload: exact raw size, then leading bytes, then the GCA byte."""
    by_byte = _lookup(GCA, byte, F.concat(F.lit("UNKNOWN("), byte.cast("string"), F.lit(")")))
    return F.when(F.octet_length(data) == raw_size, "NONE").otherwise(F.coalesce(sniff_compression(data), by_byte))


def signature_compression(srt: Column, data: Column, width: Column, height: Column) -> Column:
    """Compression of a Type-8 payload."""
    exact = (srt == 0) & (F.octet_length(data) == F.floor((width + 7) / 8) * height)
    return F.when(exact, "NONE").otherwise(F.coalesce(sniff_compression(data), F.lit("NONE")))


def wsq_marker(code: Column) -> Column:
    return _lookup(WSQ_MARKERS, code, F.lit(None).cast("string"))


def is_separator(byte: Column) -> Column:
    return byte.between(FS, US)


def can_replace_image(record_type: Column, image: Column) -> Column:
    return image.isNotNull() & record_type.isin(*REPLACEABLE)


def png_is_plain(data: Column) -> Column:
    """Whether a PNG has 8-bit samples and colour type 0 or 2 (bytes 24 and 25 of the file)."""
    at = lambda n: F.conv(F.hex(F.substring(data, n + 1, 1)), 16, 10).cast("int")
    return (F.substring(data, 1, 4) == F.unhex(F.lit("89504E47"))) & (at(24) == 8) & at(25).isin(0, 2)


def editable(record_type: Column, field: Column, warnings: Column) -> Column:
    """Whether a field may be edited: derived ones may not, nor any of a file with warnings."""
    derived = (field == 1) | ((record_type == 1) & field.isin(3, 15)) | (record_type.between(3, 8) & (field == 8))
    return ~derived & (F.size(warnings) == 0)
