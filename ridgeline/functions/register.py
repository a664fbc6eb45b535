"""SQL names: plain SQL functions where an expression does, vectorised Python where a codec is needed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import raster, wsq
from ridgeline.sources import itl

_SQL = {
    "is_separator(b INT) RETURNS BOOLEAN": "b BETWEEN 28 AND 31",
    "type_label(t INT) RETURNS STRING": "concat('Type-', t)",
    "field_tag(t INT, f INT) RETURNS STRING": "concat(t, '.', lpad(f, 3, '0'), ':')",
    "sniff_compression(data BINARY) RETURNS STRING": "CASE WHEN startswith(data, X'FFA0') THEN 'WSQ20' WHEN startswith(data, X'FFD8') THEN 'JPEG' WHEN startswith(data, X'89504E47') THEN 'PNG' END",
    "escape_value(v STRING) RETURNS STRING": r"replace(replace(replace(v, chr(92), chr(92) || chr(92)), chr(30), chr(92) || 'x1e'), chr(31), chr(92) || 'x1f')",
    "items_of(v STRING) RETURNS ARRAY<ARRAY<STRING>>": "transform(split(v, chr(30)), s -> split(s, chr(31)))",
    "proportional_dimension(v BIGINT, n BIGINT, d BIGINT) RETURNS BIGINT": "greatest((v * n + greatest(d, 1) div 2) div greatest(d, 1), 1)",
}


def register(spark: SparkSession) -> None:
    """Registers the functions for this session."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("width int, height int, ppi int, pixels binary, error string")
    def wsq_decode(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            try:
                x = wsq.decode(d or b"")
                rows.append((x.width, x.height, x.ppi, x.pixels, None))
            except wsq.WsqError as e:
                rows.append((None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "ppi", "pixels", "error"], dtype=object)

    @F.pandas_udf("binary")
    def wsq_encode(pixels: pd.Series, width: pd.Series, height: pd.Series, bitrate: pd.Series) -> pd.Series:
        return pd.Series([wsq.encode(p, int(w), int(h), None, float(b)) for p, w, h, b in zip(pixels, width, height, bitrate)])

    @F.pandas_udf(itl.TRANSACTION.removeprefix("path string, "))
    def itl_decode(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([itl.parse(d or b"") for d in data])

    @F.pandas_udf("double")
    def wsq_source_bitrate(data: pd.Series) -> pd.Series:
        return pd.Series([wsq.source_bitrate(d or b"") for d in data])

    @F.pandas_udf("boolean")
    def is_baseline_jpeg(data: pd.Series) -> pd.Series:
        return pd.Series([raster.baseline_jpeg(d or b"") for d in data])

    for f in (wsq_decode, wsq_encode, itl_decode, wsq_source_bitrate, is_baseline_jpeg):
        spark.udf.register(f.__name__, f)
