"""Relational operators over the views of transactions: lookups, checks, summaries, edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions import codes, text
from ridgeline.sources import itl


def all_records(transactions: DataFrame) -> DataFrame:
    """Records in file order, Type-1 first."""
    return itl.records(transactions).orderBy("path", "record_index")


def records_of_type(records: DataFrame, record_type: int) -> DataFrame:
    return records.where(F.col("record_type") == record_type)


def record_at(records: DataFrame, index: int) -> DataFrame:
    return records.where(F.col("record_index") == index)


def first_index(records: DataFrame, condition: Column) -> DataFrame:
    """path, record_index of the first record that satisfies a condition."""
    return records.where(condition).groupBy("path").agg(F.min("record_index").alias("record_index"))


def field_value(code: str, fields: str = "fields") -> Column:
    """Value of the first field with a code, of a record row."""
    return F.get(F.filter(F.col(fields), lambda f: f["code"] == F.lit(code)), F.lit(0))["value"]


def compression_algorithm() -> Column:
    return F.coalesce(field_value("CGA"), field_value("GCA"))


def dimensions(records: DataFrame) -> DataFrame:
    return records.withColumn("width", text.unsigned(field_value("HLL"))).withColumn("height", text.unsigned(field_value("VLL")))


def record_list(records: DataFrame) -> DataFrame:
    """A title and a detail line for each record."""
    shown = lambda code: F.coalesce(text.unsigned(field_value(code)).cast("string"), F.lit("?"))
    detail = F.concat(shown("HLL"), F.lit("×"), shown("VLL"), F.lit(", "), F.coalesce(compression_algorithm(), F.lit("binary")))
    title = F.concat(codes.type_name(F.col("record_type")), F.lit(" #"), F.col("idc").cast("string"))
    return records.select("path", "record_index", title.alias("title"), F.when(F.col("image_data").isNotNull(), detail).alias("detail"))


def file_list(transactions: DataFrame) -> DataFrame:
    """A summary line's parts for each file."""
    return transactions.select("path", F.format_number(F.col("file_size") / 1024, 1).alias("kb"), F.size("records").alias("n_records"), (F.size("warnings") > 0).alias("read_only"))


def field_table(transactions: DataFrame) -> DataFrame:
    """Fields as a table for editing: escaped values, whether they may be edited, and a placeholder for payloads."""
    f = itl.fields(transactions)
    is_data = F.col("field") == 999
    shown = F.when(is_data, F.concat(F.lit("<"), F.col("image_bytes").cast("string"), F.lit(" bytes of binary>"))).otherwise(text.escape_value(F.col("value")))
    may = ~is_data & codes.editable(F.col("record_type"), F.col("field"), F.col("warnings"))
    return f.select("path", "record_index", "record_type", "field_pos", "field", "code", shown.alias("shown"), may.alias("editable"))


def raw_size(records: DataFrame) -> DataFrame:
    """Adds raw_bytes: the size that uncompressed pixels of the declared dimensions have."""
    colour = F.col("record_type").isin(10, 16, 17) & F.coalesce(field_value("CSP"), F.lit("")).isin("RGB", "SRGB")
    width, height = text.unsigned(field_value("HLL")), text.unsigned(field_value("VLL"))
    row = F.when(F.col("record_type").isin(5, 6, 8), F.floor((width + 7) / 8)).otherwise(width * F.when(colour, 3).otherwise(1))
    return records.withColumn("raw_bytes", (row * height).cast("long"))


def is_wsq_image(records: DataFrame) -> DataFrame:
    """Adds is_wsq: the payload starts like a WSQ stream and is not raw pixels of just that size."""
    sized = raw_size(records)
    plain = F.upper(F.coalesce(compression_algorithm(), F.lit("NONE"))) == "NONE"
    raw = plain & F.coalesce(F.octet_length("image_data") == F.col("raw_bytes"), F.lit(False))
    magic = F.substring("image_data", 1, 2) == F.unhex(F.lit("FFA0"))
    return sized.withColumn("is_wsq", F.coalesce(magic & ~raw, F.lit(False)))


# ---- checks ---------------------------------------------------------------------------------------------


def record_offsets(records: DataFrame) -> DataFrame:
    """Where each record starts, as the running sum of the lengths before it."""
    before = Window.partitionBy("path").orderBy("record_index").rowsBetween(Window.unboundedPreceding, -1)
    return records.select("path", "record_index", "byte_length", F.coalesce(F.sum("byte_length").over(before), F.lit(0)).alias("offset"))


def directory(records: DataFrame) -> DataFrame:
    """The CNT value that fits the records: path, cnt."""
    rest = records.where("record_index > 0")
    entry = F.concat(F.col("record_type").cast("string"), F.lit("\x1f"), text.idc_text(F.col("idc")))
    listed = rest.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("record_index", entry.alias("e")))).alias("l"))
    heads = records.where("record_index = 0").select("path").join(listed, "path", "left")
    entries = F.transform(F.coalesce("l", F.array().cast("array<struct<record_index:int,e:string>>")), lambda x: x["e"])
    return heads.select("path", F.array_join(F.concat(F.array(F.concat(F.lit("1\x1f"), F.size(entries).cast("string"))), entries), "\x1e").alias("cnt"))


def directory_mismatch(transactions: DataFrame) -> DataFrame:
    """Positions at which the directory and the records differ: a full join of both."""
    declared = itl.cnt(transactions).select("path", F.col("entry_pos").alias("record_index"), "declared_type", "declared_idc")
    found = itl.records(transactions).where("record_index > 0").select("path", "record_index", "record_type", "idc")
    both = declared.join(found, ["path", "record_index"], "full")
    return both.where(~F.col("declared_type").eqNullSafe(F.col("record_type")))


def duplicate_fields(fields: DataFrame) -> DataFrame:
    return fields.groupBy("path", "record_index", "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---- edits ----------------------------------------------------------------------------------------------


def orphan_drafts(drafts: DataFrame, fields: DataFrame) -> DataFrame:
    """Drafts that belong to no field."""
    return drafts.join(fields.select("path", "record_index", "field"), ["path", "record_index", "field"], "left_anti")


def drafted_fields(fields: DataFrame, drafts: DataFrame) -> DataFrame:
    """Fields with their drafts laid over them."""
    over = drafts.select("path", "record_index", "field", text.unescape_value(F.col("draft_value")).alias("draft"))
    return fields.join(over, ["path", "record_index", "field"], "left").withColumn("value", F.coalesce("draft", "value")).drop("draft")


def apply_todo(records: list[dict], todo: list[dict]) -> None:
    """Sets the values of drafted fields; Malformed if one is not there."""
    for t in todo:
        own = next((f for r in records if r["record_index"] == t["record_index"] for f in r["fields"] if f["field"] == t["field"]), None)
        if own is None:
            raise itl.Malformed(f"Field {t['field']} no longer exists")
        try:
            own["value"] = text.unescape(t["draft_value"])
        except ValueError as e:
            raise itl.Malformed(str(e)) from e


def apply_drafts(transactions: DataFrame, drafts: DataFrame) -> DataFrame:
    """Transactions with drafts applied and lengths brought up to date; all of a file's drafts hold, or none (edit_error)."""
    by_path = drafts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("record_index", "field", "draft_value"))).alias("todo"))

    def edit(records, warnings, todo):
        apply_todo(records, todo)
        itl.serialise(records, warnings)

    size = F.aggregate("todo", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["draft_value"]) + 16)
    return itl.map_records(itl.with_edits(transactions, by_path, size), edit, "todo")


def image_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, record_index, image_changed: whether what an image shows may differ between two versions of the records."""

    def seen(records: DataFrame, suffix: str) -> DataFrame:
        bitonal = F.col("record_type").isin(5, 6, 8)
        look = F.struct(F.sha2("image_data", 256).alias("i"), text.unsigned(field_value("HLL")).alias("w"), text.unsigned(field_value("VLL")).alias("h"), compression_algorithm().alias("c"), bitonal.alias("b"))
        return records.select("path", "record_index", look.alias(suffix))

    both = seen(before, "x").join(seen(after, "y"), ["path", "record_index"])
    same = F.lit(True)
    for k in "iwhcb":
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return both.select("path", "record_index", (~same).alias("image_changed"))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for k, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            d = np.abs(np.frombuffer(x, np.uint8).astype(np.int64) - np.frombuffer(y, np.uint8))
            rows.append((k, int((d > 0).sum()), int(d.max()), float((d * d).mean())))
        columns = [b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.float64()))]]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n_different", "largest", "mean_square"])


def pixel_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of rasters of equal size (key, pixels): differing samples, the largest difference, the mean square."""
    kind = a.schema["key"].dataType.simpleString()
    both = a.select("key", F.col("pixels").alias("x")).join(b.select("key", F.col("pixels").alias("y")), "key")
    both = both.where((F.octet_length("x") == F.octet_length("y")) & (F.octet_length("x") > 0)).select("key", "x", "y")
    return both.mapInArrow(_differences, f"key {kind}, n_different int, largest int, mean_square double")
