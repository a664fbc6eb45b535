"""Named queries over the driver's tables and the SQL they must agree with.

Table rows become transaction files (sources/synth.py or itl.encode), an operator reads them back, and SQL
computes the answer from the rows themselves, so neither side sees the other's bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import codes, geometry, raster, text, wsq
from ridgeline.operators import images as image_ops
from ridgeline.operators import records as ops
from ridgeline.sources import itl, synth

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _documents(spark, sf, raw: bool = False) -> DataFrame:
    """Documents as transactions; raw: with the bytes of fields, which only edits need."""
    return itl.decode(synth.documents(_t(spark, sf, "documents")), images=raw, raw=raw)


def _vectors(spark, sf, kind=4) -> DataFrame:
    return itl.decode(synth.images(_t(spark, sf, "embeddings"), kind))


def _id(name: str = "doc_id"):
    return F.col("path").cast("long").alias(name)


def flagship(spark, sf_dir) -> DataFrame:
    """Records of every transaction: title, size, image dimensions, compression, warnings."""
    files = synth.documents(_t(spark, sf_dir, "documents")).unionByName(synth.images(_t(spark, sf_dir, "embeddings")).withColumn("path", F.concat(F.lit("v"), "path")))
    found = itl.decode(files)
    listed = ops.record_list(itl.records(found))
    own = itl.records(found).select("path", "record_index", "record_type", "idc", "byte_length", F.array_join("warnings", "; ").alias("warnings"))
    return own.join(listed, ["path", "record_index"])


# ---- round trips ----------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, text FROM documents")
def rt_document_fields(spark, sf):
    f = itl.fields(_documents(spark, sf)).where("record_type = 2")
    pick = lambda n: F.max(F.when(F.col("field") == n, F.col("value")))
    return f.groupBy(_id()).agg(pick(3).alias("lang"), pick(4).alias("source"), pick(5).alias("text"))


def _nested(rows: DataFrame, path, fields: list, dcs: str | None, warnings=None) -> DataFrame:
    """Nested transactions with one Type-2 record made of (field, column)."""
    field = lambda n, code, v: F.struct(F.lit(n).alias("field"), F.lit(code).alias("code"), v.cast("string").alias("value"), F.lit(None).cast("binary").alias("raw"))
    head = [field(2, "VER", F.lit("0400")), field(9, "TCN", path)] + ([field(15, "DCS", F.lit(dcs))] if dcs else [])
    body = [field(2, "IDC", F.lit("00"))] + [field(n, "UTF", v) for n, v in fields]

    def record(n, kind, own):
        return F.struct(
            F.lit(n).alias("record_index"), F.lit(kind).alias("record_type"), F.lit(0).alias("idc"), F.lit(0).cast("long").alias("byte_offset"), F.lit(0).cast("long").alias("byte_length"),
            F.lit(None).cast("binary").alias("binary_header"), F.lit(None).cast("binary").alias("image_data"), F.array(*own).alias("fields"),
        )

    return rows.select(path.cast("string").alias("path"), F.array().cast("array<string>").alias("warnings"), F.array(record(0, 1, head), record(1, 2, body)).alias("records"))


@query("SELECT c_custkey, c_name || ' é' AS name, c_mktsegment AS segment FROM customer")
def rt_latin1_customer(spark, sf):
    nested = _nested(_t(spark, sf, "customer"), F.col("c_custkey"), [(3, F.concat("c_name", F.lit(" é"))), (4, F.col("c_mktsegment"))], None)
    f = itl.fields(itl.decode(itl.encode(nested), images=False, raw=False)).where("record_type = 2")
    pick = lambda n: F.max(F.when(F.col("field") == n, F.col("value")))
    return f.groupBy(_id("c_custkey")).agg(pick(3).alias("name"), pick(4).alias("segment"))


@query("SELECT c_custkey, c_name || ' ĝĜ😀' AS name, 'UTF16' AS charset FROM customer")
def rt_utf16_customer(spark, sf):
    nested = _nested(_t(spark, sf, "customer"), F.col("c_custkey"), [(3, F.concat("c_name", F.lit(" ĝĜ😀")))], "002\x1fUTF-16")
    found = itl.decode(itl.encode(nested))
    f = itl.fields(found).where("record_type = 2 AND field = 3").select("path", F.col("value").alias("name"))
    return f.join(found.select("path", "charset"), "path").select(_id("c_custkey"), "name", "charset")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Type-2 IDC 0: Field 3 contains characters outside Latin-1; use a UTF-8 file' END AS error,
          c_custkey % 9 <> 0 AS written FROM customer""")
def encode_error(spark, sf):
    name = F.concat("c_name", F.when(F.col("c_custkey") % 9 == 0, "ĝ").otherwise(""))
    out = itl.encode(_nested(_t(spark, sf, "customer"), F.col("c_custkey"), [(3, name)], None))
    return out.select(_id("c_custkey"), "error", F.col("content").isNotNull().alias("written"))


@query("SELECT doc_id, true AS same FROM documents")
def rt_bytes(spark, sf):
    files = synth.documents(_t(spark, sf, "documents"))
    again = itl.encode(itl.decode(files))
    return files.select("path", F.sha2("content", 256).alias("a")).join(again.select("path", F.sha2("content", 256).alias("b")), "path").select(_id(), (F.col("a") == F.col("b")).alias("same"))


# ---- lengths, directories, lists ------------------------------------------------------------------------

_REST = "(6 + 9 + 7 + strlen(lang) + 7 + strlen(source) + 7 + strlen(text) + 1)"


@query(f"""SELECT doc_id, CASE {' '.join(f'WHEN {_REST} + {d} < {10**d} THEN {_REST} + {d}' for d in range(1, 10))} END AS len,
           CASE {' '.join(f'WHEN {_REST} + {d} < {10**d} THEN {_REST} + {d}' for d in range(1, 10))} END AS byte_length FROM documents""")
def record_len(spark, sf):
    r = itl.records(_documents(spark, sf)).where("record_type = 2")
    return r.select(_id(), text.unsigned(ops.field_value("LEN")).alias("len"), "byte_length")


@query("SELECT doc_id, 62 + strlen(doc_id::VARCHAR) AS second_starts FROM documents")
def record_offsets(spark, sf):
    r = itl.records(_documents(spark, sf))
    return ops.record_offsets(r).where("record_index = 1").select(_id(), F.col("offset").alias("second_starts"))


@query("SELECT doc_id, true AS fits FROM documents")
def length_sum(spark, sf):
    found = _documents(spark, sf)
    total = itl.records(found).groupBy("path").agg(F.sum("byte_length").alias("n"))
    return total.join(found.select("path", "file_size"), "path").select(_id(), (F.col("n") == F.col("file_size")).alias("fits"))


def _orders(spark, sf) -> DataFrame:
    """One transaction an order: Type-1, and a Type-2 with lines as subfields of part and supplier."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("l"))
    value = F.array_join(F.transform("l", lambda x: F.concat(x["l_partkey"].cast("string"), F.lit("\x1f"), x["l_suppkey"].cast("string"))), "\x1e")
    record = synth.tagged(2, [(2, "00"), (3, value)])
    return lines.select(F.col("l_orderkey").cast("string").alias("path"), synth.transaction("order", [(2, 0, record)]).alias("content"))


@query("""SELECT l_orderkey AS order_key, count(*) AS n_lines, sum(l_partkey)::BIGINT AS parts, sum(l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY l_orderkey""")
def subfield_items(spark, sf):
    own = itl.items(itl.decode(_orders(spark, sf), images=False, raw=False)).where("record_index = 1 AND field = 3").withColumn("v", F.col("item").cast("long"))
    pick = lambda n: F.sum(F.when(F.col("item_pos") == n, F.col("v")))
    return own.groupBy(_id("order_key")).agg(F.countDistinct("subfield_pos").alias("n_lines"), pick(0).alias("parts"), pick(1).alias("suppliers"))


@query("""SELECT l_orderkey AS order_key, '1' || chr(31) || count(*) || chr(30) || string_agg('2' || chr(31) || lpad(l_linenumber::VARCHAR, 2, '0'), chr(30) ORDER BY l_linenumber) AS cnt
          FROM lineitem GROUP BY l_orderkey""")
def cnt_directory(spark, sf):
    """Orders as transactions with a record a line; the directory is written by itl.encode and read back."""
    null = lambda kind: F.lit(None).cast(kind)
    field = lambda n, code, v: F.struct(F.lit(n).alias("field"), F.lit(code).alias("code"), v.alias("value"), null("binary").alias("raw"))

    def record(kind, own):
        zero = F.lit(0)
        return F.struct(
            zero.alias("record_index"), F.lit(kind).alias("record_type"), zero.alias("idc"), zero.cast("long").alias("byte_offset"), zero.cast("long").alias("byte_length"),
            null("binary").alias("binary_header"), null("binary").alias("image_data"), F.array(*own).alias("fields"),
        )

    numbers = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("l"))
    head = record(1, [field(2, "VER", F.lit("0400"))])
    rows = F.transform("l", lambda x: record(2, [field(2, "IDC", F.lpad(x.cast("string"), 2, "0"))]))
    nested = numbers.select(F.col("l_orderkey").cast("string").alias("path"), F.array().cast("array<string>").alias("warnings"), F.concat(F.array(head), rows).alias("records"))
    r = itl.records(itl.decode(itl.encode(nested), images=False, raw=False)).where("record_index = 0")
    return r.select(_id("order_key"), ops.field_value("CNT").alias("cnt"))


@query("""SELECT l_orderkey AS order_key, '1' || chr(31) || '1' || chr(30) || '2' || chr(31) || '00' AS cnt FROM lineitem GROUP BY l_orderkey""")
def directory_rebuilt(spark, sf):
    return ops.directory(itl.records(itl.decode(_orders(spark, sf), images=False, raw=False))).select(_id("order_key"), "cnt")


# ---- lookups --------------------------------------------------------------------------------------------


@query("SELECT 1 AS record_type, count(*) AS n FROM embeddings UNION ALL SELECT 4, count(*) FROM embeddings")
def record_type_counts(spark, sf):
    return itl.records(_vectors(spark, sf)).groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, 1 AS record_index, 82::BIGINT AS byte_length FROM embeddings")
def records_of_type(spark, sf):
    return ops.records_of_type(itl.records(_vectors(spark, sf)), 4).select(_id("vec_id"), "record_index", "byte_length")


@query("SELECT doc_id, 0 AS record_index, 'doc-' || doc_id AS tcn FROM documents")
def record_by_index(spark, sf):
    r = ops.record_at(itl.records(_documents(spark, sf)), 0)
    return r.select(_id(), "record_index", ops.field_value("TCN").alias("tcn"))


@query("SELECT vec_id, 1 AS record_index FROM embeddings")
def first_record_index(spark, sf):
    return ops.first_index(itl.records(_vectors(spark, sf)), F.col("image_data").isNotNull()).select(_id("vec_id"), "record_index")


@query("SELECT doc_id, lang AS first_utf, '0400' AS ver, NULL::VARCHAR AS missing FROM documents")
def field_first_by_code(spark, sf):
    r = itl.records(_documents(spark, sf))
    utf = r.where("record_index = 1").select("path", ops.field_value("UTF").alias("first_utf"))
    return r.where("record_index = 0").select("path", ops.field_value("VER").alias("ver"), ops.field_value("NOPE").alias("missing")).join(utf, "path").select(_id(), "first_utf", "ver", "missing")


@query("SELECT vec_id, 'NONE' AS compression FROM embeddings")
def compression_lookup(spark, sf):
    r = itl.records(_vectors(spark, sf, 14)).where("record_index = 1")
    return r.select(_id("vec_id"), ops.compression_algorithm().alias("compression"))


# Fixed values of the format once more, for the SQL side only: the names and codes that a reader of files must show.
_NAMES_SQL = """(VALUES (1, 'Transaction Information'), (2, 'User-defined Descriptive Text'), (3, 'Low-resolution Grayscale Fingerprint'), (4, 'High-resolution Grayscale Fingerprint'),
 (5, 'Low-resolution Binary Fingerprint'), (6, 'High-resolution Binary Fingerprint'), (7, 'User-defined Image'), (8, 'Signature Image'), (9, 'Minutiae Data'), (10, 'Facial & SMT Image'),
 (11, 'Forensic & Investigatory Voice'), (12, 'Forensic Dental & Oral Care Data'), (13, 'Variable-resolution Latent Image'), (14, 'Variable-resolution Fingerprint'), (15, 'Palm Print Image'),
 (16, 'User-defined Test Image'), (17, 'Iris Image'), (99, 'CBEFF (Biometric Data Block)')) AS names(t, n)"""
_CODES_SQL = """(VALUES ([1], 'LEN VER CNT TOT DAT PRY DAI ORI TCN TCR NSR NTR DOM GMT DCS APS ANM GNS'), ([2], 'LEN IDC'), ([3, 4, 5, 6], 'LEN IDC IMP FGP ISR HLL VLL GCA'), ([7], 'LEN IDC'),
 ([8], 'LEN IDC SIG SRT ISR HLL VLL GCA'), ([9], 'LEN IDC IMP FGP - - - - - - - ISR HLL VLL - - - - - COM'),
 ([10], 'LEN IDC IMT SRC PHD HLL VLL SLC HPS VPS CGA CSP SAP FIP - - - - - POS POA - - - - - - - - - - - - - - - - COM T10 SMT'),
 ([13, 14], 'LEN IDC IMP SRC FCD HLL VLL SLC HPS VPS CGA BPX FGP - - - - - - - - NQM'), ([15], 'LEN IDC IMP SRC FCD HLL VLL SLC HPS VPS CGA BPX FGP'),
 ([16, 17], 'LEN IDC - - - HLL VLL SLC HPS VPS CGA BPX CSP')) AS known(types, listed)"""


@query(f"""SELECT p_partkey, p_size AS record_type, 'Type-' || p_size AS label, CASE WHEN n IS NULL THEN 'Unknown' ELSE 'Type-' || t || ': ' || n END AS type_name
           FROM part LEFT JOIN {_NAMES_SQL} ON t = p_size""")
def type_name_join(spark, sf):
    parts = _t(spark, sf, "part").select("p_partkey", F.col("p_size").alias("record_type"))
    joined = parts.join(F.broadcast(codes.record_types(spark)), "record_type", "left")  # 18 rows
    return joined.select("p_partkey", "record_type", codes.type_label(F.col("record_type")).alias("label"), F.coalesce("type_name", F.lit("Unknown")).alias("type_name"))


@query(f"""WITH d AS (SELECT unnest(types) AS t, string_split(listed, ' ') AS l FROM {_CODES_SQL}),
           p AS (SELECT p_partkey, p_size % 19 AS record_type, (p_partkey % 41)::INTEGER AS field FROM part)
           SELECT p_partkey, record_type, field, coalesce(nullif(l[CASE WHEN field > 0 THEN field END], '-'), CASE WHEN record_type = 2 THEN 'UTF' WHEN field = 1 THEN 'LEN' ELSE '' END) AS code
           FROM p LEFT JOIN d ON t = record_type""")
def code_join(spark, sf):
    parts = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") % 19).alias("record_type"), (F.col("p_partkey") % 41).cast("int").alias("field"))
    return codes.with_codes(parts).select("p_partkey", "record_type", "field", "code")


@query("SELECT vec_id, 'Type-4: High-resolution Grayscale Fingerprint #1' AS title, '8×8, NONE' AS detail FROM embeddings")
def record_list(spark, sf):
    return ops.record_list(itl.records(_vectors(spark, sf))).where("record_index = 1").select(_id("vec_id"), "title", "detail")


@query("SELECT vec_id, 2 AS n_records, false AS read_only, '0.1' AS kb FROM embeddings")
def file_list(spark, sf):
    return ops.file_list(_vectors(spark, sf)).select(_id("vec_id"), "n_records", "read_only", "kb")


@query(r"""SELECT vec_id, 1 AS record_index, unnest([1, 2, 6, 7, 11, 12, 999]) AS field, unnest(['LEN', 'IDC', 'HLL', 'VLL', 'CGA', 'BPX', 'DATA']) AS code,
           unnest([false, true, true, true, true, true, false]) AS editable, unnest(['132', '01', '8', '8', 'NONE', '8', '<64 bytes of binary>']) AS shown FROM embeddings
           UNION ALL SELECT vec_id, 0, unnest([1, 2, 3, 9, 15]), unnest(['LEN', 'VER', 'CNT', 'TCN', 'DCS']), unnest([false, true, false, true, false]),
           unnest([(63 + strlen(vec_id::VARCHAR))::VARCHAR, '0400', '1\x1f1\x1e14\x1f01', 'vec-' || vec_id, '003\x1fUTF-8']) FROM embeddings""")
def field_table(spark, sf):
    return ops.field_table(_vectors(spark, sf, 14)).select(_id("vec_id"), "record_index", "field", "code", "editable", "shown")


@query("""SELECT vec_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS field, unnest(['LEN', 'IDC', 'IMP', 'FGP', 'ISR', 'HLL', 'VLL', 'GCA']) AS code,
          unnest([false, true, true, true, true, true, true, false]) AND vec_id % 2 = 0 AS editable FROM embeddings""")
def field_table_binary(spark, sf):
    """Binary headers: the coded algorithm may not be edited, and nothing may in a file with warnings (odd ids have a byte too many)."""
    files = synth.images(_t(spark, sf, "embeddings"), 4)
    odd = F.when(F.col("path").cast("long") % 2 == 1, F.concat("content", F.unhex(F.lit("41")))).otherwise(F.col("content"))
    return ops.field_table(itl.decode(files.withColumn("content", odd))).where("record_index = 1").select(_id("vec_id"), "field", "code", "editable")


@query("""SELECT vec_id, unnest([1, 2, 3, 4]) AS record_index, unnest([3, 5, 7, 8]) AS record_type, unnest([1, 2, 3, 4]) AS idc, unnest([82, 82, 69, 20])::BIGINT AS byte_length,
          unnest(['82|1|0|1 255 255 255 255 255|0|8|8|NONE', '82|2|0|1 255 255 255 255 255|0|8|8|WSQ20', '69|3', '20|4|0|0|1|8|8|NONE']) AS shown FROM embeddings""")
def legacy_records(spark, sf):
    """Binary records of Types 3, 5, 7 and 8 in one file."""
    data = synth.pixels(F.col("embedding"))
    short = F.substring(data, 1, 8)
    seven = F.concat(synth.number(F.lit(69), 4), synth.number(F.lit(3), 1), data)
    eight = F.concat(synth.number(F.lit(20), 4), synth.number(F.lit(4), 1), F.unhex(F.lit("000001")), synth.number(F.lit(8), 2), synth.number(F.lit(8), 2), short)
    # The payload's leading byte keeps the magic numbers out, so the algorithm comes from the header.
    plain = F.concat(F.unhex(F.lit("00")), F.substring(data, 2, 63))
    listed = [(3, 1, synth.binary_image(F.lit(1), F.lit(8), F.lit(8), F.lit(0), plain)), (5, 2, synth.binary_image(F.lit(2), F.lit(8), F.lit(8), F.lit(1), plain)), (7, 3, seven), (8, 4, eight)]
    files = _t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), synth.transaction("c", listed).alias("content"))
    r = itl.records(itl.decode(files)).where("record_index > 0")
    shown = F.array_join(F.transform("fields", lambda f: F.translate(f["value"], "\x1e", " ")), "|")
    return r.select(_id("vec_id"), "record_index", "record_type", "idc", "byte_length", shown.alias("shown"))


@query("SELECT vec_id, true AS replaceable, false AS is_wsq, 64::BIGINT AS raw_bytes FROM embeddings")
def image_predicates(spark, sf):
    r = ops.is_wsq_image(itl.records(_vectors(spark, sf)).where("record_index = 1"))
    return r.select(_id("vec_id"), codes.can_replace_image(F.col("record_type"), F.col("image_data")).alias("replaceable"), "is_wsq", "raw_bytes")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR END AS width FROM part""")
def guarded_number(spark, sf):
    shown = F.element_at(F.array(F.col("p_size").cast("string"), F.concat(F.lit("+"), "p_size"), F.concat(F.lit(" "), "p_size"), F.concat("p_size", F.lit("x"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", text.unsigned(shown).cast("string").alias("width"))


# ---- checks ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, doc_id % 7 = 0 AS mismatch FROM documents")
def cnt_mismatch(spark, sf):
    record = synth.tagged(2, [(2, "00"), (3, F.col("lang"))])
    declared = F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1)
    files = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), synth.transaction("c", [(2, 0, record)], declared=declared).alias("content"))
    return itl.files(itl.decode(files)).select(_id(), F.array_contains("warnings", "CNT does not match the number of parsed records").alias("mismatch"))


@query("""SELECT doc_id, doc_id % 11 = 0 AS read_only, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 2 END AS n_records FROM documents""")
def truncated_warnings(spark, sf):
    files = synth.documents(_t(spark, sf, "documents"))
    cut = F.when(F.col("path").cast("long") % 11 == 0, F.substring("content", F.lit(1), F.octet_length("content") - 3)).otherwise(F.col("content"))
    found = itl.decode(files.withColumn("content", cut))
    return itl.files(found).join(found.select("path", F.size("records").alias("n_records")), "path").select(_id(), "read_only", "n_records")


@query("""SELECT doc_id, 1 AS record_index, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 9 END AS declared_type, CASE WHEN doc_id % 5 = 2 THEN 2 END AS found_type
          FROM documents WHERE doc_id % 5 < 3 UNION ALL SELECT doc_id, 2, 14, NULL FROM documents WHERE doc_id % 5 = 3""")
def directory_join(spark, sf):
    """Positions where directory and records differ: a record cut off, or not of the declared type (neither can be read), a record without an entry, an entry without a record."""
    k = F.col("doc_id") % 5
    cnt = F.when(k == 1, "1\x1f1\x1e9\x1f00").when(k == 2, "1\x1f1").when(k == 3, "1\x1f2\x1e2\x1f00\x1e14\x1f00").otherwise("1\x1f1\x1e2\x1f00")
    first = synth.tagged(1, [(2, "0400"), (3, cnt), (9, "c"), (15, "003\x1fUTF-8")])
    record = synth.tagged(2, [(2, "00"), (3, F.col("lang"))])
    content = F.concat(first, F.when(k == 0, F.substring(record, F.lit(1), F.octet_length(record) - 1)).otherwise(record))
    files = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    found = ops.directory_mismatch(itl.decode(files, images=False, raw=False))
    return found.select(_id(), "record_index", "declared_type", F.col("record_type").alias("found_type"))


@query("SELECT doc_id, 3 AS field, 2::BIGINT AS n FROM documents WHERE doc_id % 6 = 0")
def duplicate_fields(spark, sf):
    docs = _t(spark, sf, "documents")
    twice = synth.tagged(2, [(2, "00"), (3, F.col("lang")), (3, F.col("lang"))])
    record = F.when(F.col("doc_id") % 6 == 0, twice).otherwise(synth.tagged(2, [(2, "00"), (3, F.col("lang"))]))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), synth.transaction("c", [(2, 0, record)]).alias("content"))
    return ops.duplicate_fields(itl.fields(itl.decode(files))).select(_id(), "field", "n")


# ---- edits ----------------------------------------------------------------------------------------------


def _drafts(spark, sf, field=3) -> DataFrame:
    docs = _t(spark, sf, "documents").where("doc_id % 3 = 0")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("record_index"), F.lit(field).alias("field"), F.lit("x\\x1ey\\\\").alias("draft_value"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(30) || 'y' || chr(92) ELSE lang END AS lang FROM documents")
def draft_upsert(spark, sf):
    edited = ops.apply_drafts(_documents(spark, sf, raw=True), _drafts(spark, sf))
    again = itl.decode(itl.encode(edited))
    return itl.fields(again).where("record_type = 2 AND field = 3").select(_id(), F.col("value").alias("lang"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(30) || 'y' || chr(92) ELSE lang END AS lang FROM documents")
def draft_join(spark, sf):
    f = itl.fields(_documents(spark, sf)).where("record_type = 2 AND field = 3")
    return ops.drafted_fields(f, _drafts(spark, sf)).select(_id(), F.col("value").alias("lang"))


@query("SELECT doc_id, 77 AS field FROM documents WHERE doc_id % 3 = 0")
def orphan_drafts(spark, sf):
    drafts = _drafts(spark, sf).unionByName(_drafts(spark, sf, 77))
    return ops.orphan_drafts(drafts, itl.fields(_documents(spark, sf))).select(_id(), "field")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Field 77 no longer exists' END AS edit_error, lang FROM documents")
def draft_failure(spark, sf):
    edited = ops.apply_drafts(_documents(spark, sf, raw=True), _drafts(spark, sf).unionByName(_drafts(spark, sf, 77)))
    f = itl.fields(edited).where("record_type = 2 AND field = 3").select("path", F.col("value").alias("lang"))
    return edited.select("path", "edit_error").join(f, "path").select(_id(), "edit_error", "lang")


@query("SELECT vec_id, vec_id % 4 = 0 AS image_changed FROM embeddings")
def image_changed(spark, sf):
    before = itl.records(_vectors(spark, sf)).where("record_index = 1")
    data = F.when(F.col("path").cast("long") % 4 == 0, F.concat(F.substring("image_data", 1, 63), F.unhex(F.lit("00")))).otherwise(F.col("image_data"))
    return ops.image_changed(before, before.withColumn("image_data", data)).select(_id("vec_id"), "image_changed")


# ---- text and numbers -----------------------------------------------------------------------------------

_RAW_SQL = "event_type || chr(30) || props || chr(92) || chr(31)"
_ESC_SQL = f"replace(replace(replace({_RAW_SQL}, chr(92), chr(92) || chr(92)), chr(30), chr(92) || 'x1e'), chr(31), chr(92) || 'x1f')"


def _raw_value():
    return F.concat("event_type", F.lit("\x1e"), F.coalesce("props", F.lit("")), F.lit("\\"), F.lit("\x1f"))


@query(f"SELECT event_id, {_ESC_SQL.replace('props', "coalesce(props, '')")} AS escaped FROM events")
def escape_value(spark, sf):
    return _t(spark, sf, "events").select("event_id", text.escape_value(_raw_value()).alias("escaped"))


@query(f"SELECT event_id, {_RAW_SQL.replace('props', "coalesce(props, '')")} AS value, NULL::VARCHAR AS bad FROM events")
def unescape_value(spark, sf):
    escaped = text.escape_value(_raw_value())
    return _t(spark, sf, "events").select("event_id", text.unescape_value(escaped).alias("value"), text.unescape_value(F.concat(escaped, F.lit("\\x20"))).alias("bad"))


@query("""SELECT p_partkey, p_partkey % 3 AS n_types, CASE WHEN p_partkey % 3 > 0 THEN '14' END AS first_type, p_partkey % 3 AS declared FROM part""")
def cnt_types(spark, sf):
    n = (F.col("p_partkey") % 3).cast("int")
    cnt = F.concat(F.lit("1\x1f"), n.cast("string"), F.array_join(F.array_repeat(F.lit("\x1e 14\x1f00"), n), ""), F.lit("\x1ebad\x1f01"))
    return _t(spark, sf, "part").select("p_partkey", F.size(text.cnt_types(cnt)).cast("long").alias("n_types"), F.get(text.cnt_types(cnt), F.lit(0)).cast("string").alias("first_type"), text.declared_records(cnt).alias("declared"))


@query("""SELECT p_partkey, p_size || '.' || lpad((p_partkey % 999)::VARCHAR, 3, '0') || ':' AS tag, lpad((p_partkey % 256)::VARCHAR, CASE WHEN p_partkey % 256 > 99 THEN 3 ELSE 2 END, '0') AS idc,
          p_partkey % 32 BETWEEN 28 AND 31 AS is_separator, CASE p_partkey % 3 WHEN 0 THEN 'DEFAULT' WHEN 1 THEN 'UTF16' ELSE 'UTF8' END AS charset, true AS ascii FROM part""")
def tags(spark, sf):
    dcs = F.element_at(F.array(F.lit("000"), F.lit("002\x1fUTF-16"), F.lit("003\x1fUTF-8")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _t(spark, sf, "part").select(
        "p_partkey", text.tag(F.col("p_size"), F.col("p_partkey") % 999).alias("tag"), text.idc_text(F.col("p_partkey") % 256).alias("idc"),
        codes.is_separator(F.col("p_partkey") % 32).alias("is_separator"), text.charset_of(dcs).alias("charset"), text.is_ascii(F.col("p_name")).alias("ascii"),
    )


@query("""SELECT p_partkey, (p_partkey % 256) || chr(30) || '255' || chr(30) || '255' || chr(30) || '255' || chr(30) || '255' || chr(30) || '0' AS fgp FROM part""")
def finger_positions(spark, sf):
    raw = F.concat(synth.number(F.col("p_partkey") % 256, 1), F.unhex(F.lit("FFFFFFFF00")))
    return _t(spark, sf, "part").select("p_partkey", text.finger_positions(raw).alias("fgp"))


@query("""SELECT p_partkey, greatest((p_partkey * 300 + greatest(p_size, 1) // 2) // greatest(p_size, 1), 1) AS dimension,
          ((p_size + 7) // 8 * 10)::BIGINT AS one_bit, (p_size * 10)::BIGINT AS gray, (p_size * 30)::BIGINT AS colour,
          CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS sign, ((1 << (p_partkey % 16)::INTEGER) - 1)::INTEGER AS mask FROM part""")
def geometry_numbers(spark, sf):
    w, h = F.col("p_size"), F.lit(10)
    return _t(spark, sf, "part").select(
        "p_partkey", geometry.proportional(F.col("p_partkey"), F.lit(300), w).alias("dimension"), geometry.raw_size(w, h, F.lit(1)).alias("one_bit"),
        geometry.raw_size(w, h, F.lit(8)).alias("gray"), geometry.raw_size(w, h, F.lit(24)).alias("colour"),
        geometry.sign_of_power(F.col("p_partkey")).alias("sign"), geometry.low_bits(F.col("p_partkey") % 16).alias("mask"),
    )


@query("""WITH s AS (SELECT p_partkey, (p_partkey % 3000)::INTEGER AS w, p_size AS h, least(1.0::FLOAT, (256::FLOAT / greatest((p_partkey % 3000)::INTEGER, p_size)::FLOAT)::FLOAT) AS k FROM part)
          SELECT p_partkey, CASE WHEN w = 0 OR h = 0 THEN 0 ELSE greatest(1, floor((w::FLOAT * k)::FLOAT + 0.5))::INTEGER END AS width,
          CASE WHEN w = 0 OR h = 0 THEN 0 ELSE greatest(1, floor((h::FLOAT * k)::FLOAT + 0.5))::INTEGER END AS height FROM s""")
def scaled_size(spark, sf):
    s = geometry.scaled_size((F.col("p_partkey") % 3000).cast("int"), F.col("p_size"), F.lit(256))
    return _t(spark, sf, "part").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))


@query("""WITH r AS (SELECT p_partkey, p_size AS n, (p_partkey - 100)::BIGINT AS i, greatest(2 * (p_size - 1), 1) AS span FROM part),
          m AS (SELECT *, ((i % span) + span) % span AS place FROM r)
          SELECT p_partkey, CASE WHEN n <= 1 THEN 0 ELSE least(place, span - place) END::BIGINT AS reflected FROM m""")
def reflect_index(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", geometry.reflect(F.col("p_partkey") - 100, F.col("p_size")).alias("reflected"))


@query("""SELECT p_partkey, CASE WHEN p_size % 20 NOT IN (3,4,5,6,8,10,13,14,15,16,17) THEN 'Resizing is not supported for Type-' || (p_size % 20)
          WHEN p_partkey % 7 = 0 THEN 'Width and height must be greater than zero'
          WHEN p_partkey % 7 IN (1, 2) AND p_size % 20 IN (5,6,8,10,17) THEN 'This record type cannot store a resized WSQ image'
          WHEN p_partkey % 7 = 1 THEN 'WSQ resizing supports dimensions from 128 to 65535 pixels; the original image is kept for unsupported sizes'
          WHEN p_partkey % 7 = 3 AND p_size % 20 < 9 THEN 'Legacy binary records support dimensions of at most 65535 pixels'
          WHEN p_partkey % 7 = 4 AND p_size % 20 > 8 THEN 'Requested image exceeds the image processing memory limit; choose smaller dimensions'
          WHEN p_partkey % 7 = 4 THEN 'Legacy binary records support dimensions of at most 65535 pixels' END AS problem FROM part""")
def resize_check(spark, sf):
    width = F.element_at(F.array(*[F.lit(n) for n in (0, 127, 128, 65536, 2_000_000, 300, 65535)]), (F.col("p_partkey") % 7 + 1).cast("int"))
    wsq_ = (F.col("p_partkey") % 7).isin(1, 2)
    return _t(spark, sf, "part").select("p_partkey", geometry.resize_error(F.col("p_size") % 20, width, F.lit(200), wsq_).alias("problem"))


# ---- binary ---------------------------------------------------------------------------------------------

_PAYLOAD = "CASE p_partkey % 4 WHEN 0 THEN 'FFA0' WHEN 1 THEN 'FFD8' WHEN 2 THEN '89504E47' ELSE '0102' END"


def _payload():
    return F.unhex(F.element_at(F.array(F.lit("FFA0"), F.lit("FFD8"), F.lit("89504E47"), F.lit("0102")), (F.col("p_partkey") % 4 + 1).cast("int")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'WSQ20' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'PNG' END AS compression FROM part")
def sniff_compression(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", codes.sniff_compression(_payload()).alias("compression"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN CASE p_size % 6 WHEN 0 THEN 'NONE' WHEN 1 THEN 'WSQ20' WHEN 2 THEN 'JPEGB' WHEN 3 THEN 'JPEGL' ELSE 'UNKNOWN(' || (p_size % 6) || ')' END
          WHEN p_partkey % 4 = 0 THEN 'WSQ20' WHEN p_partkey % 4 = 1 THEN 'JPEG' ELSE 'PNG' END AS compression FROM part""")
def gca_names(spark, sf):
    """GCA of Type-4 records with short payloads, as the reader shows it."""
    record = synth.binary_image(F.lit(1), F.lit(99), F.lit(99), F.col("p_size") % 6, _payload())
    files = _t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), synth.transaction("c", [(4, 1, record)]).alias("content"))
    return itl.records(itl.decode(files)).where("record_index = 1").select(_id("p_partkey"), ops.field_value("GCA").alias("compression"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'WSQ20' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'PNG' ELSE 'NONE' END AS gca, CASE WHEN p_partkey % 4 = 3 THEN 'NONE' WHEN p_partkey % 4 = 2 THEN 'PNG'
          WHEN p_partkey % 4 = 0 THEN 'NONE' ELSE 'NONE' END AS exact FROM part""")
def signature_compression(spark, sf):
    w = F.when(F.octet_length(_payload()) == 2, 16).otherwise(99)
    return _t(spark, sf, "part").select(
        "p_partkey", codes.signature_compression(F.lit(1), _payload(), F.lit(9), F.lit(2)).alias("gca"), codes.signature_compression(F.lit(0), _payload(), w, F.lit(1)).alias("exact")
    )


@query("SELECT p_partkey, ['SOI', 'EOI', 'SOF', 'SOB', 'DTT', 'DQT', 'DHT', 'DRT', 'COM', NULL, NULL, NULL][p_partkey % 12 + 1] AS marker FROM part")
def wsq_marker(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", codes.wsq_marker(F.lit(0xFFA0) + F.col("p_partkey") % 12).alias("marker"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AND p_size % 7 IN (0, 2) AS plain FROM part")
def png_ihdr(spark, sf):
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D494844520000000100000001")), synth.number(F.when(F.col("p_partkey") % 2 == 0, 8).otherwise(16), 1), synth.number(F.col("p_size") % 7, 1))
    return _t(spark, sf, "part").select("p_partkey", codes.png_is_plain(head).alias("plain"))


def _kernel(df: DataFrame, f, schema: str) -> DataFrame:
    """Rows (key, data) through a Python function of the data that returns a tuple."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            made = [f(d) for d in b.column(1).to_pylist()]
            columns = [pa.array([m[i] for m in made]) if made else None for i in range(len(names))]
            if made:
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["key", *names])

    return df.select("key", "data").mapInArrow(run, f"key long, {schema}")


@query("SELECT p_partkey AS key, p_partkey % 2 = 0 AND p_size % 4 IN (1, 3) AS baseline FROM part")
def jpeg_baseline(spark, sf):
    frame = F.when(F.col("p_partkey") % 2 == 0, F.unhex(F.lit("FFC0"))).otherwise(F.unhex(F.lit("FFC2")))
    n = F.col("p_size") % 4
    data = F.concat(F.unhex(F.lit("FFD8FFE00004AAAA")), frame, F.unhex(F.lit("0011080010001001")).substr(F.lit(1), F.lit(7)), synth.number(n, 1), F.unhex(F.lit("011100021101031101")))
    return _kernel(_t(spark, sf, "part").select(F.col("p_partkey").alias("key"), data.alias("data")), lambda d: (raster.baseline_jpeg(d),), "baseline boolean")


# ---- images ---------------------------------------------------------------------------------------------

_Q = "list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::BIGINT)"


@query(f"SELECT vec_id, 8 AS width, 8 AS height, list_min({_Q}) AS lo, list_max({_Q}) AS hi, list_sum({_Q})::BIGINT AS total FROM embeddings")
def raw_image_stats(spark, sf):
    shown = image_ops.images(itl.records(_vectors(spark, sf)))
    stats = _kernel(shown.select(_id("key"), F.col("pixels").alias("data")), lambda p: (min(p), max(p), sum(p)), "lo long, hi long, total long")
    return stats.join(shown.select(_id("key"), "width", "height"), "key").select(F.col("key").alias("vec_id"), "width", "height", "lo", "hi", "total")


def _bitonal(spark, sf) -> DataFrame:
    """Type-6 transactions with the embeddings' dark pixels as ink."""
    bits = F.transform("embedding", lambda x: F.when(F.floor((x.cast("double") + 1) * 127.5) < 128, "1").otherwise("0"))
    packed = F.unhex(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0"))
    record = synth.binary_image(F.lit(1), F.lit(8), F.lit(8), F.lit(0), packed)
    return itl.decode(_t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), synth.transaction("c", [(6, 1, record)]).alias("content")))


@query(f"SELECT vec_id, len(list_filter({_Q}, lambda v: v < 128)) AS ink FROM embeddings")
def bitonal_unpack(spark, sf):
    shown = image_ops.images(itl.records(_bitonal(spark, sf)))
    return _kernel(shown.select(_id("key"), F.col("pixels").alias("data")), lambda p: (p.count(0),), "ink long").withColumnRenamed("key", "vec_id")


@query(f"SELECT vec_id, list_sum(list_transform(list_zip({_Q}, generate_series(0, 63)), lambda z: CASE WHEN z[1] < 128 THEN (z[2] + 1) * (1 << (7 - z[2] % 8)::INTEGER) ELSE 0 END))::BIGINT AS packed FROM embeddings")
def bitonal_pack(spark, sf):
    """A check sum of packed bits: place times the value of the bit."""

    def check(p: bytes):
        packed = raster.pack_bitonal(np.frombuffer(p, np.uint8).reshape(8, 8))
        return (sum((8 * i + k + 1) * (1 << (7 - k)) for i, b in enumerate(packed) for k in range(8) if b >> (7 - k) & 1),)

    shown = image_ops.images(itl.records(_vectors(spark, sf)))
    return _kernel(shown.select(_id("key"), F.col("pixels").alias("data")), check, "packed long").withColumnRenamed("key", "vec_id")


@query(f"SELECT vec_id, 4 AS width, 4 AS height, len(list_filter([1, 3, 5, 7], lambda y: true)) * 0 + len(list_filter(flatten(list_transform([1, 3, 5, 7], lambda y: list_transform([1, 3, 5, 7], lambda x: ({_Q})[y * 8 + x + 1]))), lambda v: v < 128)) AS ink FROM embeddings")
def resize_nearest(spark, sf):
    sizes = _t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(1).alias("record_index"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    shown = image_ops.images(itl.records(image_ops.resize_images(_bitonal(spark, sf), sizes)))
    ink = _kernel(shown.select(_id("key"), F.col("pixels").alias("data")), lambda p: (p.count(0),), "ink long")
    return ink.join(shown.select(_id("key"), "width", "height"), "key").select(F.col("key").alias("vec_id"), "width", "height", "ink")


@query("SELECT p_partkey AS key, ((p_size * (p_partkey % 256) + 255 * (255 - p_partkey % 256) + 127) // 255)::BIGINT AS shown FROM part")
def on_white(spark, sf):
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat(synth.number(F.col("p_size"), 1), synth.number(F.col("p_partkey") % 256, 1)).alias("data"))
    return _kernel(rows, lambda d: (int(raster.on_white(np.frombuffer(d, np.uint8).reshape(1, 1, 2))[0, 0, 0]),), "shown long")


@query("SELECT vec_id, 'PNG' AS compression, 'GRAY' AS space, '8' AS hll, NULL::VARCHAR AS edit_error, true AS same FROM embeddings")
def replace_image(spark, sf):
    """Type-10 images replaced by PNG files of themselves, upside down."""
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), synth.pixels(F.col("embedding")).alias("data"))
    files = _kernel(vectors, lambda p: (raster.write_png(np.frombuffer(p, np.uint8).reshape(8, 8, 1)[::-1]),), "png binary")
    todo = files.select(F.col("key").cast("string").alias("path"), F.lit(1).alias("record_index"), F.col("png").alias("data"))
    made = image_ops.replace_images(_vectors(spark, sf, 10), todo)
    r = itl.records(made).where("record_index = 1")
    own = r.select("path", ops.compression_algorithm().alias("compression"), ops.field_value("CSP").alias("space"), ops.field_value("HLL").alias("hll"), F.sha2("image_data", 256).alias("a"))
    return own.join(todo.select("path", F.sha2("data", 256).alias("b")), "path").join(made.select("path", "edit_error"), "path").select(
        _id("vec_id"), "compression", "space", "hll", "edit_error", (F.col("a") == F.col("b")).alias("same")
    )


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN 'Field 88 no longer exists' WHEN vec_id % 3 = 2 THEN 'Width and height must be greater than zero' END AS edit_error,
          CASE WHEN vec_id % 3 = 0 THEN '12' ELSE '8' END AS hll, CASE WHEN vec_id % 3 = 0 THEN 'x' || chr(30) ELSE 'vec-' || vec_id END AS tcn, CASE WHEN vec_id % 3 = 0 THEN 144 ELSE 64 END AS n FROM embeddings""")
def edit_together(spark, sf):
    """Drafts, a replacement and a new size as one edit: a file with a bad draft or a bad size keeps all it had."""
    ids = _t(spark, sf, "embeddings").select(F.col("vec_id"), F.col("vec_id").cast("string").alias("path"), synth.pixels(F.col("embedding")).alias("data"))
    drafts = ids.select("path", F.lit(0).alias("record_index"), F.lit(9).alias("field"), F.lit("x\\x1e").alias("draft_value"))
    drafts = drafts.unionByName(ids.where("vec_id % 3 = 1").select("path", F.lit(1).alias("record_index"), F.lit(88).alias("field"), F.lit("y").alias("draft_value")))
    files = _kernel(ids.select(F.col("vec_id").alias("key"), "data"), lambda p: (raster.write_png(np.frombuffer(p, np.uint8).reshape(8, 8, 1)),), "png binary")
    replacements = files.select(F.col("key").cast("string").alias("path"), F.lit(1).alias("record_index"), F.col("png").alias("data"))
    sizes = ids.select("path", F.lit(1).alias("record_index"), F.when(F.col("vec_id") % 3 == 2, 0).otherwise(12).alias("width"), F.lit(12).alias("height"))
    made = image_ops.edit_files(_vectors(spark, sf), drafts, replacements, sizes)
    r = itl.records(made)
    first = r.where("record_index = 0").select("path", ops.field_value("TCN").alias("tcn"))
    image = r.where("record_index = 1").select("path", ops.field_value("HLL").alias("hll"), F.octet_length("image_data").alias("n"))
    return made.select("path", "edit_error").join(first, "path").join(image, "path").select(_id("vec_id"), "edit_error", "hll", "tcn", "n")


@query(f"""SELECT vec_id, unnest([0, 1]) AS record_index, unnest([1, 4]) AS record_type, unnest([5, 8]) AS n_fields, unnest([NULL, 64]) AS image_bytes, unnest([NULL, 'raw']) AS source,
           unnest([NULL, list_min({_Q})])::INTEGER AS low, unnest([NULL, list_max({_Q})])::INTEGER AS high, unnest([NULL, list_sum({_Q})::BIGINT // 64])::INTEGER AS mean FROM embeddings""")
def record_dump(spark, sf):
    return image_ops.dump(_vectors(spark, sf)).select(_id("vec_id"), "record_index", "record_type", "n_fields", "image_bytes", "source", "low", "high", "mean")


@query("SELECT n_nationkey AS key, 'WSQ' AS source, 128 AS width, 130 AS height, (n_nationkey * 10 + 5)::INTEGER AS mean FROM nation")
def bare_streams(spark, sf):
    """WSQ streams that are files of their own."""
    flat = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), synth.number(F.col("n_nationkey") * 10 + 5, 1).alias("data"))
    files = _kernel(flat, lambda v: (wsq.encode(v * (128 * 130), 128, 130),), "content binary").select(F.col("key").cast("string").alias("path"), "content")
    return image_ops.image_stats(image_ops.read_images(files)).select(_id("key"), "source", "width", "height", "mean")


@query("SELECT vec_id, '16' AS hll, '4' AS vll, 82::BIGINT AS byte_length, NULL::VARCHAR AS edit_error FROM embeddings")
def resize_image(spark, sf):
    sizes = _t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(1).alias("record_index"), F.lit(16).alias("width"), F.lit(4).alias("height"))
    made = image_ops.resize_images(_vectors(spark, sf), sizes)
    r = itl.records(made).where("record_index = 1")
    return r.join(made.select("path", "edit_error"), "path").select(_id("vec_id"), ops.field_value("HLL").alias("hll"), ops.field_value("VLL").alias("vll"), "byte_length", "edit_error")


@query(f"SELECT vec_id, true AS same FROM embeddings")
def png_export(spark, sf):
    shown = image_ops.images(itl.records(_vectors(spark, sf)))
    png = image_ops.export_png(shown)
    back = _kernel(png.select(_id("key"), F.col("png").alias("data")), lambda d: (raster.read_png(d).pixels.tobytes(),), "pixels binary")
    return back.join(shown.select(_id("key"), F.col("pixels").alias("p")), "key").select(F.col("key").alias("vec_id"), (F.col("pixels") == F.col("p")).alias("same"))


@query(f"""SELECT vec_id, len(list_filter({_Q}, lambda v: v < 255))::INTEGER AS n_different, 1 AS largest FROM embeddings""")
def pixel_difference(spark, sf):
    v = _t(spark, sf, "embeddings")
    brighter = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.lit(255).cast("long"), F.floor((x.cast("double") + 1) * 127.5).cast("long") + 1)), 2, "0")), ""))
    a, b = v.select(F.col("vec_id").alias("key"), synth.pixels(F.col("embedding")).alias("pixels")), v.select(F.col("vec_id").alias("key"), brighter.alias("pixels"))
    return ops.pixel_difference(a, b).select(F.col("key").alias("vec_id"), "n_different", "largest")


# ---- codec ----------------------------------------------------------------------------------------------

_COEF = "list_transform(embedding, lambda x: (round(x::DOUBLE * 20))::BIGINT)"


def _coefficients(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 20).cast("long")).alias("c"))


@query(f"SELECT v + 180 AS symbol, count(*) AS n FROM (SELECT unnest({_COEF}) AS v FROM embeddings) WHERE v BETWEEN -73 AND 74 AND v <> 0 GROUP BY v")
def symbol_histogram(spark, sf):
    """Literal symbols of the tokeniser, counted."""

    def run(batches):
        for b in batches:
            symbols = [s for c in b.column(0).to_pylist() for s, _, _ in wsq.tokens(np.array(c, np.int64)) if s > 106]
            yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int64())], ["symbol"])

    return _coefficients(spark, sf).select("c").mapInArrow(run, "symbol long").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS (SELECT vec_id, unnest({_COEF}) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
           g AS (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM e WHERE v = 0),
           r AS (SELECT vec_id, island, count(*) AS run FROM g GROUP BY vec_id, island)
           SELECT run, count(*) AS n FROM r GROUP BY run""")
def zero_runs(spark, sf):
    """Runs of zeros by the tokeniser (runs of at most 64 are one symbol each)."""

    def run(batches):
        for b in batches:
            runs = [s for c in b.column(0).to_pylist() for s, _, _ in wsq.tokens(np.array(c, np.int64)) if s <= 100]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64())], ["run"])

    return _coefficients(spark, sf).select("c").mapInArrow(run, "run long").groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id AS key, round((SELECT var_samp(v) FROM (SELECT unnest({_Q}) AS v)), 6) AS variance FROM embeddings")
def subband_variance(spark, sf):
    band = ((0, 8, False), (0, 8, False))
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), synth.pixels(F.col("embedding")).alias("data"))
    made = _kernel(rows, lambda p: (wsq.band_variance(np.frombuffer(p, np.uint8).reshape(8, 8), band, False),), "variance double")
    return made.select("key", F.round("variance", 6).alias("variance"))


@query("""SELECT n_nationkey AS key, (n_nationkey * 10 + 5)::BIGINT AS lo, (n_nationkey * 10 + 5)::BIGINT AS hi, 128::BIGINT AS width, 130::BIGINT AS height FROM nation""")
def wsq_flat(spark, sf):
    """Flat images come back exact."""

    def trip(v: bytes):
        back = wsq.decode(wsq.encode(v * (128 * 130), 128, 130))
        return min(back.pixels), max(back.pixels), back.width, back.height

    rows = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), synth.number(F.col("n_nationkey") * 10 + 5, 1).alias("data"))
    return _kernel(rows, trip, "lo long, hi long, width long, height long")


@query(f"""WITH p AS (SELECT vec_id AS key, list_avg({_Q}) AS m, list_min({_Q}) AS lo, list_max({_Q}) AS hi FROM embeddings)
           SELECT key, round(m * 64)::BIGINT AS shift_64, round(greatest(m - lo, hi - m) * 64)::BIGINT AS scale_8192 FROM p""")
def wsq_normalise(spark, sf):
    def measure(p: bytes):
        _, shift, scale = wsq.normalise(np.frombuffer(p, np.uint8).reshape(8, 8))
        return round(float(shift) * 64), round(float(scale) * 8192)

    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), synth.pixels(F.col("embedding")).alias("data"))
    return _kernel(rows, measure, "shift_64 long, scale_8192 long")


@query(f"""WITH v AS (SELECT unnest({_COEF}) * 97 AS v FROM embeddings)
           SELECT CASE WHEN v > 255 THEN 103 WHEN v > 74 THEN 101 WHEN v < -255 THEN 104 ELSE 102 END AS symbol, abs(v) AS extra, count(*) AS n FROM v WHERE v > 74 OR v < -73 GROUP BY ALL""")
def escape_symbols(spark, sf):
    """Levels beyond the literal symbols: escapes of one and two bytes, by sign."""

    def run(batches):
        for b in batches:
            made = [t for c in b.column(0).to_pylist() for t in wsq.tokens(np.array(c, np.int64) * 97) if 101 <= t[0] <= 104]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in made], pa.int64()), pa.array([t[1] for t in made], pa.int64())], ["symbol", "extra"])

    return _coefficients(spark, sf).select("c").mapInArrow(run, "symbol long, extra long").groupBy("symbol", "extra").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT vec_id AS key, list_sum(list_transform(generate_series(1, 32), lambda k: (2 * k - 1) * (c[k] - c[k + 32]) + 2 * k * (c[k] + c[k + 32])))::BIGINT AS weighed
           FROM (SELECT vec_id, {_COEF} AS c FROM embeddings)""")
def wsq_even_filters(spark, sf):
    """Lines of 32 low and 32 high samples by a table of filters of two taps: the sum of all pixels times their place."""

    def run(batches):
        low, high = wsq._read_filters(struct.pack(">BBBBIBBI", 2, 2, 0, 0, 1, 1, 0, 1))
        for b in batches:
            if len(b):
                lines = b.column(1).flatten().to_numpy().reshape(len(b), 64).astype(np.float32)
                made = wsq.synthesise(lines, False, low, high).astype(np.int64) @ np.arange(1, 65)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], ["key", "weighed"])

    return _coefficients(spark, sf).select(F.col("vec_id").alias("key"), "c").mapInArrow(run, "key long, weighed long")


@query("""WITH v AS (SELECT key, x * x * 4000 AS var, k FROM (SELECT vec_id AS key, unnest(embedding[1:60])::DOUBLE AS x, unnest(generate_series(0, 59)) AS k FROM embeddings)),
          r AS (SELECT key, k, var, CASE WHEN k < 4 THEN 1.0 ELSE 10 / (CASE k WHEN 52 THEN 1.32 WHEN 54 THEN 1.42 WHEN 56 THEN 1.32 WHEN 57 THEN 1.42 WHEN 53 THEN 1.08 WHEN 55 THEN 1.08
                WHEN 58 THEN 1.08 WHEN 59 THEN 1.08 ELSE 1.0 END * ln(var)) END::DOUBLE AS rel, CASE WHEN k < 4 THEN 1 / 1024 WHEN k < 51 THEN 1 / 256 ELSE 1 / 16 END::DOUBLE AS w FROM v WHERE var >= 1.01),
          f AS (SELECT *, ln(rel / (5 * sqrt(var))) AS f FROM r),
          c AS (SELECT *, (0.75 * ln(2) + sum(f * w) OVER (PARTITION BY key ORDER BY f, k)) / sum(w) OVER (PARTITION BY key ORDER BY f, k) AS level FROM f),
          l AS (SELECT key, max_by(level, f) AS level FROM c WHERE level > f GROUP BY key)
          SELECT key, count(*) AS bands, round(sum(rel * exp(-l.level)), 6) AS steps, round(max(rel * exp(-l.level)), 6) AS widest FROM r JOIN l USING (key) GROUP BY key""")
def band_steps(spark, sf):
    """Bit allocation over variances made of the embeddings."""

    def run(batches):
        for b in batches:
            steps = [wsq.steps_of(np.array(x[:60], float) ** 2 * 4000, 0.75) for x in b.column(1).to_pylist()]
            columns = [[int(np.count_nonzero(s)) for s in steps], [round(float(s.sum()), 6) for s in steps], [round(float(s.max()), 6) for s in steps]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64()))]], ["key", "bands", "steps", "widest"])

    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return rows.mapInArrow(run, "key long, bands long, steps double, widest double").where("bands > 0")


@query()
def wsq_roundtrip(spark, sf):
    """Embeddings as smooth 128 by 128 images, coded and decoded: size of the stream and mean square error."""

    def trip(p: bytes):
        image = raster.resize(np.frombuffer(p, np.uint8).reshape(8, 8, 1), 128, 128, "triangle")
        stream = wsq.encode(image.tobytes(), 128, 128, 500)
        back = wsq.decode(stream)
        error = float(((np.frombuffer(back.pixels, np.uint8).astype(float) - image.ravel()) ** 2).mean())
        return back.width, back.height, back.ppi, len(stream), error

    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), synth.pixels(F.col("embedding")).alias("data")).repartition(8, "key")
    return _kernel(rows, trip, "width long, height long, ppi long, stream_bytes long, mean_square double")
