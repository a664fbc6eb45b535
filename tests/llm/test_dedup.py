import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, fingerprint string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", "clash") for i, t in zip(ids, texts)], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_simhash_matches_plain_version():
    rng = random.Random(3)
    for text in [None, "", " \n", "One", "one TWO three", "a b c d", prose(rng, 400), "É é x " * 9]:
        assert simhash.simhash(text) == plain_simhash(text)


def test_masks_cover_every_difference_within_the_radius():
    tables, rng = simhash.masks(), random.Random(5)
    assert len(tables) == 31 and all(24 <= m.bit_count() <= 40 for m in tables)
    for _ in range(3000):
        flip = sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4)))
        assert any(flip & m == 0 for m in tables)


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("limit", [1 << 14, 5])
def test_links_have_the_components_of_all_pairs(spark, limit):
    rng = random.Random(7)
    fps = {rng.getrandbits(63) for _ in range(60)}
    for f in list(fps)[:8]:
        for _ in range(12):
            fps.add(f ^ sum(1 << i for i in rng.sample(range(63), rng.randint(1, 6))))
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), limit)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = lambda m: sorted(sorted(x for x in fps if m.get(x, x) == r) for r in {m.get(x, x) for x in fps})
    assert groups(got) == groups(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(spark):
    rng = random.Random(1)
    body = prose(rng, 300)
    texts = [body, body, prose(rng, 300), None, "", "  ", body.upper()]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3, 6: 0}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, ["x", "x"], [4, 4])).count() == 2


@pytest.mark.parametrize("limit", [1 << 14, 8])
def test_near_copies_finds_similar_documents_only(spark, limit):
    rng = random.Random(2)
    texts, group = [], []
    for g in range(25):
        words = prose(rng, 160).split()
        for _ in range(4):
            own = list(words)
            for _ in range(2):  # two edits of 160 words: five-word similarity over 0.8
                own[rng.randrange(len(own))] = "edited" + str(rng.randrange(99))
            texts.append(" ".join(own))
            group.append(g)
    texts += ["", None]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts), limit=limit).collect()}
    sets = [decontaminate.shingle_texts(t or "") for t in texts]
    for i in range(100):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if alike >= 0.8:
                assert found[i] == found[j]
            if group[i] != group[j]:
                assert found[i] != found[j]
    assert found[100] == found[101]


def edited_pairs(rng):
    """Pairs of texts whose five-word similarity is 0.8 or more, by kind of edit."""
    for _ in range(12):
        words = prose(rng, 400).split()
        at = rng.randrange(360)
        yield "appended", words[:100], words[:100] + prose(rng, 20).split()
        yield "cut off", words, words[:330]
        yield "replaced", words, words[:at] + prose(rng, 36).split() + words[at + 36 :]
        yield "ten words", words[:10], words[:11]
        yield "long", words * 3 + prose(rng, 3000).split(), None


def copies_of(rng):
    for kind, a, b in edited_pairs(rng):
        b = a[:-500] if b is None else b
        yield kind, " ".join(a), " ".join(b)


@pytest.mark.parametrize("limit", [1 << 14, 8])
def test_near_copies_finds_every_kind_of_edit(spark, limit):
    pairs = list(copies_of(random.Random(6)))
    texts = [t for _, a, b in pairs for t in (a, b)]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts), limit=limit).collect()}
    shingles = [decontaminate.shingle_texts(t) for t in texts]
    for k, (kind, _, _) in enumerate(pairs):
        a, b = shingles[2 * k], shingles[2 * k + 1]
        assert len(a & b) >= 0.8 * len(a | b), kind
        assert found[2 * k] == found[2 * k + 1], kind


@pytest.mark.parametrize("limit", [1 << 14, 4])
def test_near_copies_are_the_components_of_exact_links(spark, limit):
    rng = random.Random(8)
    texts = []
    for _ in range(80):  # around the threshold
        words = prose(rng, 204).split()
        edits = rng.choice([4, 5, 24, 25])
        at = range(5, 205, 200 // edits) if edits < 6 else range(100, 100 + edits - 4)
        texts += [" ".join(words), " ".join("new" if i in at else w for i, w in enumerate(words)), " ".join(words[: rng.choice([160, 163, 164, 165])])]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts), limit=limit).collect()}
    sets = [decontaminate.shingle_texts(t) for t in texts]
    alike = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    want = {}
    for k in range(0, len(texts), 3):
        want |= plain_components([k, k + 1, k + 2], alike)
    assert found == want and 20 < sum(k != v for k, v in want.items()) < 140


@pytest.mark.parametrize("rounds", [2, 0])
def test_buckets_over_the_limit_lose_no_link(spark, monkeypatch, rounds):
    """Large groups around one passage: copies of copies, texts of many sizes that hold it, with and without blocks to join them first."""
    monkeypatch.setattr(simhash, "BLOCK_ROUNDS", rounds)
    rng = random.Random(12)
    base = prose(rng, 120).split()
    texts = [base]
    for k in range(120):
        own = list(rng.choice(texts[-30:]))
        own[rng.randrange(len(own))] = f"edited{k}"
        texts.append(own)
    texts += [base[:n] + prose(rng, extra).split() for n in range(30, 120, 10) for extra in (0, 4, 30)]
    texts = [" ".join(t) for t in texts]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts), limit=8).collect()}
    sets = [decontaminate.shingle_texts(t) for t in texts]
    alike = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    want = plain_components(range(len(texts)), alike)
    assert found == want and 2 < len(set(want.values())) < len(texts) - 60


def around(rng, passage, times, tail):
    """A text whose fingerprint follows a passage that it repeats, and that ends in words of its own."""
    return " ".join([*passage * times, *prose(rng, tail).split()])


def checked_link(texts):
    """The links of simhash.duplicates, from plain fingerprints and sets."""
    fps, sets = [plain_simhash(t) for t in texts], [decontaminate.shingle_texts(t) for t in texts]

    def linked(i, j):
        both, sizes = len(sets[i] & sets[j]), len(sets[i]) + len(sets[j])
        return 9 * both >= 4 * sizes or ((fps[i] ^ fps[j]).bit_count() <= 4 and 3 * both >= sizes)

    return fps, sets, linked


@pytest.mark.parametrize("limit", [1 << 14, 4])
def test_duplicates_are_the_components_of_fingerprint_links_and_copies(spark, limit):
    rng = random.Random(23)
    texts = ["", "  "]
    for _ in range(6):
        passage = prose(rng, 61).split()
        texts += [around(rng, passage, 20, tail) for tail in (8, 12, 15, 18, 40, 60, 60)]  # from 0.8 to well under a half
    line = prose(rng, 11).split()
    pages = [around(rng, line, 60, 150) for _ in range(12)]  # one line over and over, and texts that share nothing else
    texts += pages + [f"{p} more" for p in pages[:3]] + [prose(rng, 90) for _ in range(6)]
    fps, sets, linked = checked_link(texts)
    want = plain_components(range(len(texts)), linked)
    found = {r.doc_id: r.component_id for r in simhash.duplicates(frame(spark, texts), limit=limit).collect()}
    assert found == want
    copies = plain_components(range(len(texts)), lambda i, j: 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])))
    prints = plain_components(range(len(texts)), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert len(set(prints.values())) < len(set(want.values())) - 10 and len(set(want.values())) < len(set(copies.values())) - 5


def test_near_duplicate_stage_takes_fingerprint_links(spark):
    import corpus_pipeline

    rng = random.Random(24)
    passage, line = prose(rng, 61).split(), prose(rng, 11).split()
    texts = [around(rng, passage, 20, 15), around(rng, passage, 20, 15), around(rng, line, 60, 150), around(rng, line, 60, 150)]
    fps, sets, _ = checked_link(texts)
    shares = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (0, 2)]
    assert all((fps[i] ^ fps[i + 1]).bit_count() <= 4 for i in (0, 2)) and 0.5 <= shares[0] < 0.8 and shares[1] < 0.1
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_containment_search_matches_brute_force(spark):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (3, 5, 8, 20, 40, 60, 0)] + [None]
    docs = [prose(rng, 200) for _ in range(12)] + ["", None, items[0], items[1].upper()]
    for k, item in enumerate(items[2:6]):
        words = item.split()
        docs.append(prose(rng, 3000) + " " + item + ". " + prose(rng, 50))
        docs.append(prose(rng, 50) + " " + " ".join(words[: int(len(words) * 0.9)]) + " " + prose(rng, 60))
        docs.append(prose(rng, 50) + " " + " ".join(words[: int(len(words) * 0.6)]) + " " + prose(rng, 60))
    table = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(frame(spark, docs), table).collect()}
    want = set()
    for i, d in enumerate(docs):
        own = decontaminate.shingle_texts(d or "")
        for j, t in enumerate(items):
            wanted = decontaminate.shingle_texts(t or "")
            if wanted and len(own & wanted) >= 0.8 * len(wanted):
                want.add((i, j, len(own & wanted), len(wanted)))
    assert got == want and len(want) >= 8


def test_containment_search_edges(spark, monkeypatch):
    table = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.contaminated(frame(spark, ["a b c d e"]), table).count() == 0
    item = "one two three four five six seven"
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 200)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 40)
    index = decontaminate.Index([1], [item])
    long = prose(random.Random(4), 500) + " " + item + " " + prose(random.Random(5), 500)
    assert list(decontaminate.search(index, ["", long, item])) == [(1, 0, 3, 3), (2, 0, 3, 3)]


def test_an_item_across_the_last_border_of_a_long_text_is_found(monkeypatch):
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 200)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 40)
    rng = random.Random(14)
    for _ in range(20):
        item = prose(rng, 6)
        long = prose(rng, 79) + " " + item  # the last piece holds one shingle, the item's last
        index = decontaminate.Index([1], [item])
        for after in ([], ["short text"], ["short text", prose(rng, 12)]):
            assert list(decontaminate.search(index, [prose(rng, 3), long, *after])) == [(1, 0, 2, 2)]


def plain_removal(texts):
    seen, out = {}, {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batch", [10000, 7])
def test_substring_removal_matches_brute_force(spark, monkeypatch, batch):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (14, 25, 60)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 40)) for _ in range(3)]
        if i % 3:
            parts.insert(rng.randrange(3), rng.choice(passages))
        texts.append(rng.choice([" ", "\n", ""]).join(parts))
    texts += ["", None, "ab" * 300, "ab" * 200, "é" * 120, texts[0], texts[4] + "x", "The " * 80, "The " * 90 + passages[2]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    monkeypatch.setattr(substrings, "PHRASES", 60)
    monkeypatch.setattr(substrings, "ENTRIES", 20)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = substrings.deduplicated(frame(spark, texts, ids).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == plain_removal(list(zip(ids, texts)))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_substring_removal_edges(spark):
    assert substrings.deduplicated(frame(spark, [])).count() == 0
    same = "x" * 50 + "y" * 150
    rows = substrings.deduplicated(frame(spark, [same, same], [3, 3])).collect()
    assert len(rows) == 2 and len({r.n_removed for r in rows}) == 1
    crowded = substrings.parse([(0, 0, ("z" * 400).encode())])
    assert crowded["start"].tolist() == sorted(crowded["start"].tolist())


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_by_their_own_bytes(spark):
    rng = random.Random(12)
    passages = [prose(rng, 30) for _ in range(4)]
    rows = []
    for i in range(40):
        text = " ".join([prose(rng, rng.randint(5, 60)), rng.choice(passages), prose(rng, rng.randint(0, 30))])
        rows.append((rng.choice([None, None, 1, 5, 5, 7, 100 + i]), text))
    rows += [(None, prose(rng, 100)), (5, prose(rng, 100)), (5, rows[3][1]), rows[0], rows[1], (None, None), (5, ""), (None, rows[0][1])]
    ids = [r[0] for r in rows]

    def place(row):
        i, t = row
        tie = xxhash.xxh64((t or "").encode(), 42).intdigest()
        tie -= (tie >> 63) << 64
        return (1 << 63) - 1 if i is None else i, tie if i is None or ids.count(i) > 1 else 0

    want = plain_removal([(place(r), r[1]) for r in set(rows)])
    got = substrings.deduplicated(frame(spark, [r[1] for r in rows], ids)).collect()
    key = lambda i, values: (i is None, i or 0, values)
    assert sorted(key(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(key(r[0], want[place(r)]) for r in rows)
    unique = [r for r in got if r.n_bytes and r.n_removed == 0]
    assert len(unique) >= 3


def test_long_texts_are_parsed_in_pieces_that_meet(spark):
    rng = random.Random(13)
    border = substrings.PIECE
    long = prose(rng, 1)
    while len(long) < border + 5000:
        long += " " + prose(rng, 2000)
    texts = [long, prose(rng, 40) + long[border - 130 : border + 170] + prose(rng, 10), long[:150] + long[border - 5 : border + 95]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicated(frame(spark, texts)).collect()}
    assert got == plain_removal(list(enumerate(texts))) and got[1][1] >= 300 and got[2][1] >= 250


def test_entries_of_a_crowded_trigger_are_all_ambiguous():
    n = 300
    fields = [np.full(n, 5, "u8"), np.arange(n).astype("u8"), np.arange(n), np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, "u1"), np.zeros(n, "u1")]
    import pyarrow as pa

    t = pa.table({"bucket": [0, 0], "kind": [3, 1], "payload": [substrings._pack(fields), substrings._pack([np.array([5], "u8")])]})
    found = substrings._entries(t, 64)
    assert found.num_rows == n and set(found.column("salts").to_pylist()) == {64}


def test_null_ids_and_extra_columns(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f"], [None, 2])
    assert simhash.near_duplicates(docs).count() == 2
    assert substrings.deduplicated(docs.withColumn("start", F.lit(1))).count() == 2
