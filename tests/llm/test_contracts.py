"""Each registered query on the driver's smallest tables: columns, types, one row a document, and values against plain rules."""

import hashlib
import re
import zlib

import pytest
import xxhash

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
HEX = re.compile(r"[0-9a-f]{64}")
CONTRACTS = {
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_substrings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, blob string",
    "op7_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint, copies int",
    "op8_imatch": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double, mixture string",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, texts, name):
    made = entry.queries()[name](spark, DATA)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema) == CONTRACTS[name]
    found = {r.doc_id: r for r in made.collect()}
    assert set(found) == set(texts) and made.count() == len(texts)
    return found


def test_op2(spark, texts):
    from tests.llm.test_operators import plain_pii

    for i, r in rows(spark, texts, "op2_pii").items():
        base = plain_pii(texts[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        names = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest() and set(filter(None, names.split(","))) <= set(r.spans.split(","))


def test_op3_and_op5(spark, texts):
    for i, r in rows(spark, texts, "op3_substrings").items():
        assert r.n_bytes == len(texts[i].encode()) and 0 <= r.n_removed <= r.n_bytes and HEX.fullmatch(r.kept_sha256)
        assert r.n_removed >= 100 * bool(r.n_spans) and (r.n_removed or r.kept_sha256 == hashlib.sha256(texts[i].encode()).hexdigest())
    from tests.llm.test_operators import plain_secrets

    for i, r in rows(spark, texts, "op5_secret_ledger").items():
        base = plain_secrets(texts[i])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def test_op4_and_op10(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    found = rows(spark, texts, "op4_quality")
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [i for i in labels if i in found and found[i].held_out and labels[i] is not None]
    assert sum(found[i].predicted == labels[i] for i in held) >= 0.85 * len(held)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = rows(spark, texts, "op10_language")
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred in {x for x in langs.values() if x} | {"und"} and (r.lang_pred == "und") >= (not any(c.isalpha() for c in texts[i]))
    held = [i for i in found if found[i].held_out and langs[i] and found[i].lang_pred != "und"]
    assert sum(found[i].lang_pred == langs[i] for i in held) >= 0.9 * len(held)


def test_op7(spark, texts):
    found = rows(spark, texts, "op7_mix_sources")
    taken: dict[float, list] = {}
    for i, r in found.items():
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) and r.taken <= 2 * r.size and r.copies <= 2
        taken.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), own in taken.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)


def test_op8(spark, texts):
    order = sorted(texts, reverse=True)
    found = rows(spark, texts, "op8_imatch")
    for n, i in enumerate(order):
        own, after, r = texts[i], texts[order[(n + 1) % len(order)]], found[i]
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text: dict[str, set] = {}
    for i, r in found.items():
        by_text.setdefault(texts[i], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_op9(spark, texts):
    from tests.llm.test_dedup import plain_components, plain_simhash

    found = rows(spark, texts, "op9_simhash")
    prints = {i: plain_simhash(t) for i, t in texts.items() if len(t) < 20_000}
    assert all(found[i].fingerprint == f"{p:016x}" for i, p in prints.items()) and xxhash.VERSION
    bits = {i: int(r.fingerprint, 16) for i, r in found.items()}
    assert {i: r.component_id for i, r in found.items()} == plain_components(sorted(bits), lambda a, b: (bits[a] ^ bits[b]).bit_count() <= 4)


def test_op1_and_op6_have_their_columns(spark):
    from ridgeline.llm import decontaminate

    found = entry.queries()["op1_decontaminate"](spark, DATA)
    items = {r.item_id: decontaminate.shingle_texts(r.text or "") for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    docs = {r.doc_id: decontaminate.shingle_texts(r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {(d, i) for d, own in docs.items() for i, wanted in items.items() if wanted and len(own & wanted) >= 0.8 * len(wanted) - 1e-9}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    made = entry.queries()["op6_warc"](spark, DATA).collect()
    assert len(made) == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert all(r.error is None and HEX.fullmatch(r.metadata_sha256) and HEX.fullmatch(r.conversion_sha256) and r.response_id != r.metadata_id != r.conversion_id for r in made)
