import os
import struct

import duckdb
import numpy as np
import pytest

from ridgeline.functions import raster, wsq
from ridgeline.functions.register import register
from ridgeline.operators import images, records
from ridgeline.plans import catalog
from ridgeline.sources import itl, sink
from ridgeline.streaming import ingest

# Bytes laid out by hand: a UTF-8 transaction with a Type-2 and a 2 by 2 Type-4 record.
GOLDEN = bytes.fromhex(
    "312e3030313a37341d312e3030323a303430301d312e3030333a311f321e321f30301e341f30311d312e3030393a"
    "7472616e73616374696f6e1d312e3031353a3030331f5554462d381c322e3030313a32371d322e3030323a30301d"
    "322e3030333ac3a91c00000016010001ffffffffff0000020002000064c8ff"
)


def tagged(kind, fields):
    body = b"".join(b"\x1d%d.%03d:" % (kind, n) + v for n, v in fields) + b"\x1c"
    head = b"%d.001:" % kind
    n = itl.length_of(len(head) + len(body))
    return head + str(n).encode() + body


def transaction(parts, dcs=None):
    cnt = b"\x1e".join([b"1\x1f%d" % len(parts), *(b"%d\x1f%02d" % (t, i) for t, i, _ in parts)])
    head = [(2, b"0400"), (3, cnt), (9, b"transaction")] + ([(15, dcs)] if dcs else [])
    return tagged(1, head) + b"".join(r for _, _, r in parts)


def binary(kind, idc, gca, width, height, payload):
    return struct.pack(">IBB6sBHHB", 18 + len(payload), idc, 0, b"\x01" + b"\xff" * 5, 0, width, height, gca) + payload


def test_golden_bytes():
    row = itl.parse(GOLDEN)
    assert row["warnings"] == [] and row["bytes_read"] == 123 and row["charset"] == "UTF8"
    assert [(r["record_type"], r["idc"], r["byte_offset"], r["byte_length"]) for r in row["records"]] == [(1, 0, 0, 74), (2, 0, 74, 27), (4, 1, 101, 22)]
    assert itl.value_of(row["records"][1], "UTF") == "é" and itl.value_of(row["records"][2], "FGP") == "\x1e".join(["1", *["255"] * 5])
    assert itl.value_of(row["records"][2], "GCA") == "NONE" and row["records"][2]["image_data"] == bytes([0, 100, 200, 255])
    assert itl.serialise(row["records"], []) == GOLDEN


def test_signature_and_other_binary_records():
    sig = bytes.fromhex("000000100900000100090002aa805500")
    data = transaction([(4, 0, binary(4, 0, 42, 9, 9, b"\x1c\x1d\x1e")), (8, 9, sig), (7, 1, struct.pack(">IB", 8, 1) + b"\x1c\x1d\x1e")])
    row = itl.parse(data)
    assert row["warnings"] == [] and itl.value_of(row["records"][1], "GCA") == "UNKNOWN(42)" and itl.value_of(row["records"][2], "GCA") == "NONE"
    assert images.decode_record(row["records"][2]).pixels[..., 0].tolist() == [[0, 255] * 4 + [0], [255, 0] * 4 + [255]]
    assert itl.serialise(row["records"], []) == data


def test_payload_of_separators_and_length_framing():
    payload = bytes.fromhex("ffd8001c1d1e1f1c")
    data = transaction([(14, 1, tagged(14, [(2, b"01"), (999, payload)]))])
    row = itl.parse(data)
    assert row["warnings"] == [] and row["records"][1]["image_data"] == payload and itl.serialise(row["records"], []) == data


@pytest.mark.parametrize("dcs, raw, text", [(b"003\x1fUTF-8", b"a\xff\xfe", "a��"), (b"002\x1fUTF-16", "Name ĝĜ😀".encode("utf-16-le"), "Name ĝĜ😀"), (None, b"R\xe9my", "Rémy")])
def test_character_sets_keep_their_bytes(dcs, raw, text):
    data = transaction([(2, 0, tagged(2, [(2, b"00"), (3, raw)]))], dcs)
    row = itl.parse(data)
    assert row["warnings"] == [] and itl.value_of(row["records"][1], "UTF") == text and itl.serialise(row["records"], []) == data


def test_damage_is_reported_and_not_saved():
    cut = itl.parse(GOLDEN[:-10])
    assert len(cut["records"]) == 2 and cut["warnings"][0].startswith("Stopped at byte 101: unexpected end of file") and cut["warnings"][-1].startswith("CNT does not match")
    with pytest.raises(itl.Malformed, match="Cannot save an incompletely parsed file"):
        itl.serialise(cut["records"], cut["warnings"])
    assert itl.parse(b"")["parse_error"] and itl.parse(b"2.001:9\x1c")["parse_error"].endswith("expected Type-1 tag, got Type-2")
    assert "1 input bytes could not be parsed" in itl.parse(GOLDEN + b"x")["warnings"]


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda r: r[1]["fields"].append({"field": 3, "code": "", "value": "x", "raw": None}), "Invalid or duplicate field 3"),
        (lambda r: r[1]["fields"][2].update(value="a\x1db"), "reserved FS or GS"),
        (lambda r: r[2]["fields"][3].update(value="1\x1e2"), "exactly six positions"),
        (lambda r: r[2]["fields"][5].update(value="65536"), "valid unsigned integer"),
        (lambda r: r[0]["fields"][4].update(value="001\x1fx", raw=None), "Unsupported character set"),
    ],
)
def test_save_errors(change, message):
    rows = itl.parse(GOLDEN)["records"]
    change(rows)
    with pytest.raises(itl.Malformed, match=message):
        itl.serialise(rows, [])


def test_set_field_keeps_order():
    record = {"fields": [{"field": 1, "value": "a"}, {"field": 9, "value": "b"}]}
    itl.set_field(record, 5, "X", "v")
    itl.set_field(record, 9, "Y", "w")
    assert [(f["field"], f["value"]) for f in record["fields"]] == [(1, "a"), (5, "v"), (9, "w")]


def test_views_drafts_and_sink(spark, tmp_path):
    files = spark.createDataFrame([("a.an2", GOLDEN), ("b.an2", GOLDEN[:-10]), ("c.an2", None)], "path string, content binary")
    found = itl.decode(files)
    itl.register_views(found)
    assert spark.sql("SELECT count(*) AS n FROM records r JOIN files f USING (path) WHERE NOT f.read_only").first().n == 3
    assert {(r.entry_pos, r.declared_type) for r in itl.cnt(found).where("path = 'a.an2'").collect()} == {(1, 2), (2, 4)}
    drafts = spark.createDataFrame([("a.an2", 1, 3, r"A\x1eB\\"), ("b.an2", 1, 3, "x")], "path string, record_index int, field int, draft_value string")
    edited = records.apply_drafts(found, drafts)
    errors = {r.path: r.edit_error for r in edited.collect()}
    assert errors["a.an2"] is None and "incompletely parsed" in errors["b.an2"]
    out = itl.encode(edited).where("path = 'a.an2'")
    assert itl.value_of(itl.parse(bytes(out.first().content))["records"][1], "UTF") == "A\x1eB\\"
    spark.dataSource.register(sink.AtomicFiles)
    target = tmp_path / "a.an2"
    target.write_bytes(b"old")
    os.chmod(target, 0o640)
    out.select("path", "content").write.format("atomic_files").option("path", str(tmp_path)).mode("append").save()
    assert target.read_bytes() == bytes(out.first().content) and oct(target.stat().st_mode)[-3:] == "640" and os.listdir(tmp_path) == ["a.an2"]
    assert itl.read_files(spark, str(tmp_path)).count() == 1
    query = ingest.read_stream(spark, str(tmp_path)).select("path", "bytes_read").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 1


def test_image_replacement_and_resizing():
    rng = np.random.default_rng(2)
    colour = rng.integers(0, 256, (9, 13, 4), dtype=np.uint8)
    data = transaction([(10, 1, tagged(10, [(2, b"01"), (999, b"x")])), (6, 2, binary(6, 2, 0, 9, 2, b"\xaa\x80\x55\x00"))])
    rows = itl.parse(data)["records"]
    images.replace_in(rows, [], 1, raster.write_png(colour))
    assert itl.value_of(rows[1], "CSP") == "RGB" and itl.value_of(rows[1], "HLL") == "13"
    assert (images.decode_record(rows[1]).pixels == raster.on_white(colour)).all()
    images.replace_in(rows, [], 2, raster.write_png(colour))
    assert rows[2]["image_data"] == raster.pack_bitonal(raster.luma(colour))
    again = itl.parse(itl.serialise(rows, []))
    assert again["warnings"] == []
    images.resize_in(rows, [], 2, 26, 18)
    assert images.decode_record(rows[2]).size == (26, 18)
    for index, width, message in ((0, 5, "not supported for Type-1"), (9, 5, "No record selected"), (1, 0, "greater than zero")):
        with pytest.raises(itl.Malformed, match=message):
            images.resize_in(rows, [], index, width, 5)


def test_wsq_payloads():
    y, x = np.mgrid[0:150, 0:140]
    gray = (128 + 90 * np.sin(x / 4 + np.sin(y / 17))).astype(np.uint8)
    stream = wsq.encode(gray.tobytes(), 140, 150, 500, 1.5)
    rows = itl.parse(transaction([(14, 1, tagged(14, [(2, b"01"), (999, b"x")]))]))["records"]
    images.replace_in(rows, [], 1, stream)
    assert itl.value_of(rows[1], "CGA") == "WSQ20" and rows[1]["image_data"] == stream and images.is_wsq(rows[1])
    images.resize_in(rows, [], 1, 200, 180)
    made = wsq.decode(rows[1]["image_data"])
    assert (made.width, made.height, made.ppi) == (200, 180, 500) and wsq.source_bitrate(rows[1]["image_data"]) == 1.5
    with pytest.raises(itl.Malformed, match="WSQ resizing supports"):
        images.resize_in(rows, [], 1, 100, 180)
    rows = itl.parse(transaction([(4, 1, binary(4, 1, 0, 2, 2, b"\xff\xa0\x00\x00"))]))["records"]
    assert not images.is_wsq(rows[1])


@pytest.mark.parametrize("value", [0, 128, 255])
def test_wsq_flat_images_are_exact(value):
    flat = bytes([value]) * (128 * 128)
    assert wsq.decode(wsq.encode(flat, 128, 128)).pixels == flat


def test_wsq_gradient_layout_and_limits():
    gray = np.add.outer(np.arange(128), np.arange(128)).astype(np.uint8)
    back = np.frombuffer(wsq.decode(wsq.encode(gray.tobytes(), 128, 128)).pixels, np.uint8).reshape(128, 128)
    assert ((back.astype(float) - gray) ** 2).mean() <= 64
    for w, h in ((128, 128), (257, 193), (131, 300)):
        nodes, bands = wsq.layout(w, h)
        cover = np.zeros((h, w), int)
        for b in bands:
            cover[wsq.window(b)] += 1
        assert len(nodes) == 20 and (cover == 1).all()
        noise = np.random.default_rng(0).normal(size=(h, w)).astype(np.float32)
        image = noise.copy()
        wsq.decompose(image, nodes)
        mirror = lambda taps: np.array([(-1) ** abs(k - len(taps) // 2) * c for k, c in enumerate(taps)], np.float32)
        wsq.reconstruct(image, nodes, mirror(wsq.HIGH), mirror(wsq.LOW))
        assert np.abs(image - noise).max() < 1e-4
    for args in ((bytes(100), 10, 10), (bytes(3), 128, 128)):
        with pytest.raises(wsq.WsqError):
            wsq.encode(*args)
    with pytest.raises(wsq.WsqError):
        wsq.encode(bytes(128 * 128), 128, 128, None, 3.0)


def test_wsq_damage_is_an_error():
    stream = wsq.encode(np.random.default_rng(1).integers(0, 256, 128 * 128, dtype=np.uint8).tobytes(), 128, 128)
    assert len(wsq.decode(stream).pixels) == 128 * 128
    for bad in (b"", b"\xff\xd8\xff\xd9", stream[:50], stream[: len(stream) // 2], stream[:4] + b"\xff" * 60):
        with pytest.raises(wsq.WsqError):
            wsq.decode(bad)


def test_huffman_codes_are_prefix_free_and_leave_all_ones():
    a, b, weights = 1, 1, {}
    for s in range(107, 147):
        weights[s], a, b = a, b, a + b
    table = wsq.Huffman([[(s, 0, 0)] * min(w, 3000) for s, w in weights.items()])
    words = [format(c, f"0{n}b") for c, n in table.codes.values()]
    assert max(map(len, words)) <= 16 and not any(set(w) == {"1"} for w in words)
    assert not any(x != y and y.startswith(x) for x in words for y in words)


def test_jpeg_bmp_and_tiff():
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    assert raster.read_image(bmp).pixels.tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    tags = [(256, 4, 1, 2), (257, 4, 1, 2), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, 4)]
    tiff = b"II*\0" + struct.pack("<I", 12) + bytes([1, 2, 3, 4]) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
    assert raster.read_image(tiff).pixels[..., 0].tolist() == [[1, 2], [3, 4]]
    # A gray 8 by 8 JPEG of one flat block: DC of 1 * 64 / 8 above 128, written by hand.
    jpeg = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([8] * 64) + b"\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"
    jpeg += b"\xff\xc4\x00\x14\x00" + bytes([1] + [0] * 15) + b"\x04" + b"\xff\xc4\x00\x14\x10" + bytes([1] + [0] * 15) + b"\x00"
    jpeg += b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + bytes([0b01010011]) + b"\xff\xd9"
    assert raster.baseline_jpeg(jpeg) and set(raster.read_image(jpeg).pixels.ravel().tolist()) == {138}
    with pytest.raises(raster.RasterError):
        raster.read_image(b"nothing")


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT sniff_compression(X'FFA000') AS a, proportional_dimension(10, 3, 4) AS b, field_tag(2, 3) AS c, items_of(concat('a', chr(31), 'b', chr(30), 'c')) AS d").first()
    assert (row.a, row.b, row.c, row.d) == ("WSQ20", 8, "2.003:", [["a", "b"], ["c"]])
    data = spark.createDataFrame([(GOLDEN,)], "content binary")
    assert data.selectExpr("itl_decode(content).bytes_read AS n").first().n == 123
    assert data.selectExpr("wsq_decode(content).error AS e").first().e.startswith("WSQ: not a WSQ file")


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, DATA)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = sorted(map(str, (tuple(r[n] for n in names) for r in got.collect())))
    assert rows == sorted(map(str, con.sql(f"SELECT {', '.join(names)} FROM ({catalog.ORACLES[name]})").fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_wsq_invalid_codes_are_an_error():
    stream = bytearray(wsq.encode(np.random.default_rng(1).integers(0, 256, 128 * 128, dtype=np.uint8).tobytes(), 128, 128))
    block = stream.index(b"\xff\xa3")
    stream[block + 10 : block + 400] = b"\xff\x00" * 195  # all ones: the code that no symbol has
    with pytest.raises(wsq.WsqError, match="huffman code too long"):
        wsq.decode(bytes(stream))


def _analysed(line, low_taps, high_taps):
    """Plain analysis by filters of even length over the half-sample extension of a line: its low and its high samples."""
    n = len(line)
    at = lambda i: line[i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)]
    part = lambda taps, count: [sum(c * at(2 * k + j - len(taps) // 2 + 1) for j, c in enumerate(taps)) for k in range(count)]
    return part(low_taps, n - n // 2) + part(high_taps, n // 2)


_TWO, _SIX = np.array([1, 1]) / 2**0.5, np.array([-1, 1, 8, 8, 1, -1]) * 2**0.5 / 16


@pytest.mark.parametrize(("low", "high"), [(_TWO, [-1, 1] * _TWO), (_SIX, [-1, 1] * _TWO), (_TWO, np.array([1, 1, -8, 8, -1, -1]) * 2**0.5 / 16)])
def test_wsq_filters_of_even_length(low, high):
    """The filters that a table's halves stand for undo a plain analysis, whatever the line's length and place."""
    halves = [low[len(low) // 2 :], -np.asarray(high)[len(high) // 2 :]]
    table = bytes([len(low), len(high)]) + b"".join(struct.pack(">BBI", int(c < 0), 9, round(abs(c) * 10**9)) for half in halves for c in half)
    taps = wsq._read_filters(table)
    for n in (1, 2, 3, 8, 9, 16, 21):
        line = np.random.default_rng(n).normal(size=n)
        made = _analysed(line, low, high)
        split = n - n // 2
        for mirrored, lines in ((False, made), (True, made[split:] + made[:split])):
            back = wsq.synthesise(np.array([lines], np.float32), mirrored, *taps)
            assert back.shape == (1, n) and np.abs(back[0] - line).max() < 1e-5, (n, mirrored)


def test_wsq_filters_that_do_not_fit_together():
    one = struct.pack(">BBI", 0, 0, 1)
    for table in (bytes([2, 3]) + 3 * one, bytes([0, 2]) + one, b"\x02"):
        with pytest.raises(wsq.WsqError):
            wsq._read_filters(table)


def test_band_steps_are_where_dropping_bands_ends():
    """The level of the water against the plain rule: take the factor for the bands in use, drop those it makes too coarse, again."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        variance = np.exp(rng.uniform(-3, 9, 60))
        rate = float(rng.uniform(0.05, 2.25))
        steps = wsq.steps_of(variance, rate)
        used = [k for k in range(60) if variance[k] >= 1.01]
        weight = lambda k: {52: 1.32, 53: 1.08, 54: 1.42, 55: 1.08, 56: 1.32, 57: 1.42, 58: 1.08, 59: 1.08}.get(k, 1.0)
        relative = {k: 1.0 if k < 4 else 10 / (weight(k) * np.log(variance[k])) for k in used}
        size = lambda k: 1 / 1024 if k < 4 else 1 / 256 if k < 51 else 1 / 16
        bands = list(used)
        while True:
            whole = sum(size(k) for k in bands)
            mean = sum(size(k) * np.log(np.sqrt(variance[k]) / relative[k]) for k in bands) / whole
            factor = 2 ** (rate / whole - 1) / 2.5 * np.exp(-mean)
            left = [k for k in bands if relative[k] / factor < 5 * np.sqrt(variance[k])]
            if left == bands:
                break
            bands = left
        assert all(steps[k] == pytest.approx(relative[k] / factor, rel=1e-9) for k in used)
        assert sorted(np.flatnonzero(steps)) == used


@pytest.mark.parametrize(("value", "want"), [(0, (0, 0)), (1, (4, 10000)), (6.5535, (3, 6554)), (6.5534, (4, 65534)), (65535, (0, 65535)), (70000, (0, 65535)), (0.1, (5, 10000)), (-2.5, (4, 25000))])
def test_wire_decimals(value, want):
    assert wsq.wire_decimal(value, 65535) == want


def test_sink_keeps_folders_and_refuses_equal_targets(spark, tmp_path):
    spark.dataSource.register(sink.AtomicFiles)
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x y.an2").write_bytes(folder.encode())
    found = itl.read_files(spark, str(tmp_path / "in"))
    out = tmp_path / "out"
    found.write.format("atomic_files").option("path", str(out)).option("root", str(tmp_path / "in")).mode("append").save()
    assert {f: (out / f / "x y.an2").read_bytes() for f in ("a", "b")} == {"a": b"a", "b": b"b"}
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "x y.an2").write_bytes(b"before")
    with pytest.raises(Exception, match="several rows"):
        found.write.format("atomic_files").option("path", str(flat)).mode("append").save()
    assert [p.name for p in flat.iterdir()] == ["x y.an2"] and (flat / "x y.an2").read_bytes() == b"before"


def test_batches_of_transactions_round_trip():
    import pyarrow as pa

    record = lambda n: {"record_index": n, "record_type": 2, "idc": n, "byte_offset": None, "byte_length": 5, "binary_header": b"h" * n, "image_data": None if n else b"", "fields": [{"field": k, "code": "UTF", "value": None if k else "é", "raw": b"x"} for k in range(n)]}
    rows = [{"path": str(i), "file_size": i, "bytes_read": 1, "charset": None, "warnings": ["w"] * i, "parse_error": None, "records": [record(k) for k in range(i)]} for i in range(5)]
    batch = itl.batch_of(rows, itl._TRANSACTION_TYPE)
    assert batch.to_pylist() == rows
    for at, n in ((0, 5), (2, 2), (4, 1), (1, 0)):
        assert itl.records_in(batch.slice(at, n).column("records")) == [r["records"] for r in rows[at : at + n]]
    nulls = pa.RecordBatch.from_pylist([{**rows[2], "records": None}, rows[3]], itl._TRANSACTION_TYPE)
    assert itl.records_in(nulls.column("records")) == [[], rows[3]["records"]]


def test_slices_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(list("abcde")), pa.array([b"x" * 10, None, b"x" * 40, b"", b"x"], pa.binary())], ["path", "content"])
    assert [s.column(0).to_pylist() for s in itl.sliced(batch, 1, 12)] == [["a", "b"], ["c"], ["d", "e"]]


# ---- image files ------------------------------------------------------------------------------------------


class JpegBits:
    def __init__(self):
        self.text = []

    def put(self, value, n):
        if n:
            self.text.append(format(value & ((1 << n) - 1), f"0{n}b"))

    def symbol(self, s, dc):  # DC: 4 bits a symbol; AC: symbols under 128 have 8 bits, the others 9
        self.put(s, 4) if dc else self.put(s, 8) if s < 128 else self.put(256 + s - 128, 9)

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)
        return n

    def done(self):
        text = "".join(self.text)
        text += "1" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""


def jpeg_segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def ac_first(bits, blocks, low, runs):
    """The AC coefficients without their `low` bits; runs: ends of blocks are counted together."""
    ended = 0

    def flush():
        nonlocal ended
        while ended:
            n = ended.bit_length() - 1
            bits.symbol(n << 4, False)
            bits.put(ended - (1 << n), n)
            ended = 0

    for block in blocks:
        zeros, values = 0, [abs(v) >> low if v >= 0 else -(abs(v) >> low) for v in block]
        for v in values[1:]:
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                bits.symbol(0xF0, False)
                zeros -= 16
            bits.symbol(zeros << 4 | abs(v).bit_length(), False)
            bits.signed(v)
            zeros = 0
        if zeros:
            ended += 1
            if not runs:
                flush()
    flush()


def ac_refine(bits, blocks):
    for block in blocks:
        new = [k for k in range(1, 64) if abs(block[k]) == 1]
        last, zeros, pending = new[-1] if new else 0, 0, []
        for k in range(1, 64):
            v = block[k]
            if v == 0:
                zeros += 1
                if zeros == 16 and k < last:
                    bits.symbol(0xF0, False)
                    [bits.put(x, 1) for x in pending]
                    zeros, pending = 0, []
            elif abs(v) > 1:
                pending.append(abs(v) & 1)
            else:
                bits.symbol(zeros << 4 | 1, False)
                bits.put(v > 0, 1)
                [bits.put(x, 1) for x in pending]
                zeros, pending = 0, []
        if last != 63:
            bits.symbol(0, False)
            [bits.put(x, 1) for x in pending]


def jpeg_file(coefficients, width, height, sampling, progressive):
    """A JPEG of blocks (component: rows by columns by 64, zigzag) with fixed codes."""
    head = [b"\xff\xd8", jpeg_segment(0xDB, bytes([0] + [2] * 64))]
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(coefficients)])
    frame += b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    head.append(jpeg_segment(0xC2 if progressive else 0xC0, frame))
    head.append(jpeg_segment(0xC4, bytes([0x00] + [0, 0, 0, 12] + [0] * 12) + bytes(range(12))))
    head.append(jpeg_segment(0xC4, bytes([0x10] + [0] * 7 + [128, 128] + [0] * 7) + bytes(range(256))))
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)

    def scan(names, first, last, high, low, body):
        return jpeg_segment(0xDA, bytes([len(names)]) + b"".join(bytes([c + 1, 0]) for c in names) + bytes([first, last, high << 4 | low])) + body

    def interleaved():
        for y in range(-(-height // (8 * down))):
            for x in range(-(-width // (8 * across))):
                for c, (h, v) in enumerate(sampling):
                    for i in range(v):
                        for j in range(h):
                            yield c, coefficients[c][y * v + i][x * h + j]

    def own(c):
        h, v = sampling[c]
        rows, columns = -(-(-(-height * v // down)) // 8), -(-(-(-width * h // across)) // 8)
        return [coefficients[c][y][x] for y in range(rows) for x in range(columns)]

    def dc(bits, low, blocks, whole):
        before = [0] * len(sampling)
        for c, block in blocks:
            v = block[0] >> low
            bits.symbol(abs(v - before[c]).bit_length(), True)
            bits.signed(v - before[c])
            before[c] = v
            if whole:
                ac_first(bits, [block], 0, False)

    every, bits = list(range(len(sampling))), JpegBits()
    if not progressive:
        dc(bits, 0, interleaved(), True)
        return b"".join([*head, scan(every, 0, 63, 0, 0, bits.done()), b"\xff\xd9"])
    dc(bits, 1, interleaved(), False)
    out = [*head, scan(every, 0, 0, 0, 1, bits.done())]
    for c in every:
        bits = JpegBits()
        ac_first(bits, own(c), 1, True)
        out.append(scan([c], 1, 63, 0, 1, bits.done()))
    bits = JpegBits()
    for _, block in interleaved():
        bits.put(block[0] & 1, 1)
    out.append(scan(every, 0, 0, 1, 0, bits.done()))
    for c in every:
        bits = JpegBits()
        ac_refine(bits, own(c))
        out.append(scan([c], 1, 63, 1, 0, bits.done()))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize(("width", "height", "sampling"), [(37, 21, [(1, 1)]), (50, 35, [(2, 2), (1, 1), (1, 1)]), (41, 17, [(2, 1), (1, 1), (1, 1)])])
def test_progressive_jpegs_decode_as_sequential_ones(width, height, sampling):
    rng = np.random.default_rng(width)
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    rows, columns = -(-height // (8 * down)), -(-width // (8 * across))
    made = []
    for h, v in sampling:
        blocks = rng.integers(-9, 10, (rows * v, columns * h, 64)) * (rng.random((rows * v, columns * h, 64)) < rng.choice([0.02, 0.2, 0.6], (rows * v, columns * h, 1)))
        blocks[..., 0] = rng.integers(-300, 300, blocks.shape[:2])
        made.append(blocks.tolist())
    plain, several = (jpeg_file(made, width, height, sampling, p) for p in (False, True))
    a, b = raster.read_image(plain), raster.read_image(several)
    assert raster.baseline_jpeg(plain) and not raster.baseline_jpeg(several) and a.size == (width, height)
    # Blocks beyond a component's edge are in interleaved scans only, and show nowhere.
    assert (a.pixels == b.pixels).all() and len(np.unique(a.pixels)) > 20
    for cut in (several[:60], several[: len(several) // 2][:-1], b"\xff\xd8\xff\xc9\x00\x0b" + several[40:60]):
        try:
            raster.read_image(cut)
        except raster.RasterError:
            pass


@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 8), (2, 8), (6, 16)])
def test_interlaced_png(colour, depth):
    import struct
    import zlib

    rng, (width, height), channels = np.random.default_rng(depth), (13, 11), {0: 1, 2: 3, 6: 4}[colour]
    pixels = rng.integers(0, 2 if depth == 1 else 256, (height, width, channels), dtype=np.uint8)
    raw = b""
    for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        part = pixels[y::dy, x::dx]
        for line in part if part.size else []:
            flat = line.ravel()
            raw += b"\0" + (np.packbits(flat).tobytes() if depth == 1 else flat.tobytes() if depth == 8 else np.repeat(flat, 2).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (raster.read_image(data).pixels == pixels * (255 if depth == 1 else 1)).all()


def tiff_lzw(data):
    """Clear, then codes of what was seen before, growing one code early."""
    table, text, last, width = {bytes([i]): i for i in range(256)}, [format(256, "09b")], b"", 9
    size = 258
    for byte in data:
        if last + bytes([byte]) in table:
            last += bytes([byte])
            continue
        text.append(format(table[last], f"0{width}b"))
        table[last + bytes([byte])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        last = bytes([byte])
        if size == 4094:
            text.append(format(table[last], f"0{width}b") + format(256, f"0{width}b"))
            table, size, width, last = {bytes([i]): i for i in range(256)}, 258, 9, b""
    if last:
        text.append(format(table[last], f"0{width}b"))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    whole = "".join(text) + format(257, f"0{width}b")
    whole += "0" * (-len(whole) % 8)
    return int(whole, 2).to_bytes(len(whole) // 8, "big")


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("differences", [1, 2])
def test_tiff_layouts(packing, tile, differences):
    import struct
    import zlib

    rng = np.random.default_rng(packing)
    pixels = np.repeat(rng.integers(0, 256, (37, 15, 3), dtype=np.uint8), 3, axis=1)
    height, width, channels = pixels.shape
    blocks = []
    for y in range(0, height, tile or 10):
        for x in range(0, width, tile or width):
            part = pixels[y : y + (tile or 10), x : x + (tile or width)]
            if tile:
                part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
            if differences == 2:
                part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
            raw = part.tobytes()
            blocks.append({1: lambda r: r, 5: tiff_lzw, 8: zlib.compress, 32773: lambda r: b"".join(bytes([len(r[i : i + 100]) - 1]) + r[i : i + 100] for i in range(0, len(r), 100)) + b"\x80\xff\x07"}[packing](raw))
    starts = np.cumsum([8] + [len(b) for b in blocks])[:-1].tolist()
    body = b"".join(blocks) + b"\0" * (sum(map(len, blocks)) % 2)
    lists = 8 + len(body)
    tags = [(256, 4, [width]), (257, 4, [height]), (259, 3, [packing]), (262, 3, [2]), (277, 3, [channels]), (317, 3, [differences])]
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, starts), (325, 4, [len(b) for b in blocks])] if tile else [(273, 4, starts), (278, 4, [10]), (279, 4, [len(b) for b in blocks])]
    extra, entries = b"", b""
    for tag, kind, values in sorted(tags):
        packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), lists + len(extra))
            extra += packed
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    data = b"II*\0" + struct.pack("<I", lists + len(extra)) + body + extra + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    assert (raster.read_image(data).pixels == pixels).all()
