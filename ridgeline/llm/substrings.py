"""Repeated substrings by prefix-free parsing: bytes covered by a 100-byte string that also starts earlier.

Parse. A rolling hash of GRAM bytes is taken at every position; in each window of 100 bytes the least hash
is the trigger (the leftmost of equals). Which position triggers depends on the window's bytes alone, so
equal windows have equal triggers. A phrase is the stretch that the windows of one trigger span: windows
are dealt to phrases without overlap, and every window lies inside its phrase, so the first 100 bytes of
any suffix are in its phrase and the order of suffixes to that depth needs no look into the next phrase.

Dictionary. Phrases meet by trigger. Equal phrases are one dictionary entry; of its occurrences (the parse)
all but the first are repeats from their first window to their last, without a look at their bytes. A
trigger with a single entry is done. Only entries that share a trigger with another one are ambiguous:
equal windows may hide in different phrases.

Suffix order. Ambiguous entries (one copy each, at its first occurrence) meet by trigger again, now with
their bytes. Their suffixes are sorted to a depth of 100 bytes, and neighbours that agree to that depth are
equal windows; the one that starts first stays, the others are repeats. Suffixes whose fingerprint occurs
once are left out of the sort, as they have no equal. Entry order and occurrences together give the corpus
order to the depth that a 100-byte match can tell.

Scale. Entries travel as packed arrays, one row a batch and bucket; equal phrases of a batch are combined
before. The number of buckets follows the input. A trigger with very many entries is dealt by suffix
fingerprint over several groups (SALT_ENTRIES), so no group is without bound.

Rows. A row is known by its id and, where the id is null or repeats, by a hash of its text (`tie`, else 0),
in all joins and in the order.

Text counts as UTF-8 bytes. Defined results: null text is empty; texts under 100 bytes lose nothing; a null
doc_id comes last in the order; rows of one id (or without one) but with different texts are ordered by a hash
of the text, and each is judged by its own bytes; rows of the same id and text are one document: none is
earlier than the other, and all get its result; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import cut, small, table, text_of

WINDOW = 100
GRAM = 32
#: Starts of grams in a window.
REACH = WINDOW - GRAM + 1
#: Bytes that are parsed at once; a longer text is parsed in pieces that overlap by WINDOW - 1.
PIECE = 1 << 18
#: About so many phrases, and ambiguous entries, to a bucket.
PHRASES = 60_000
ENTRIES = 20_000
#: A batch sends at most so many entries of one trigger to the trigger's bucket; further ones go by phrase.
BATCH_ENTRIES = 256
SALT_ENTRIES = 20_000
LAST = (1 << 63) - 1

_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any substrings of a buffer, from running sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(16, int(len(data)).bit_length()))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k neighbours, by running minima in blocks of k from either side."""
    n = len(x)
    padded = np.full(-(-n // k) * k + k, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, k)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - k + 1], ahead[k - 1 : n])


def parse(pieces: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """Phrases of pieces (document index, offset, bytes): trigger, phrase (hashes), doc, start, more (windows after the first), off (trigger - start)."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
    empty = {k: np.empty(0, t) for k, t in (("trigger", "u8"), ("phrase", "u8"), ("doc", "i8"), ("start", "i8"), ("more", "u1"), ("off", "u1"))}
    if len(data) < WINDOW:
        return empty
    rolling = Rolling(data)
    grams = rolling.grams(GRAM)
    packed = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    trigger = (_least(packed, REACH) & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(trigger), bool)  # windows that do not cross a border of pieces
    for e in ends[:-1]:
        inside[max(0, e - WINDOW + 1) : e] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    t = trigger[at]
    new = np.concatenate(([True], (np.diff(t) != 0) | (np.diff(at) != 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    start, stop, t = at[first], at[last], t[first]
    piece = np.searchsorted(ends, start, side="right")
    begins = ends - sizes
    more, off = stop - start, t - start
    shape = _mix((off * 256 + more + 1).astype(np.uint64))
    return {
        "trigger": grams[t], "phrase": rolling(start, stop + WINDOW) ^ shape, "doc": np.array([p[0] for p in pieces], np.int64)[piece],
        "start": start - begins[piece] + np.array([p[1] for p in pieces], np.int64)[piece], "more": more.astype("u1"), "off": off.astype("u1"),
    }


def _grouped(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces of texts, in groups of about PIECE bytes."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[at : at + PIECE + WINDOW - 1]
            if len(part) >= WINDOW:
                group.append((i, at, part))
                size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


_FIELDS = (("trigger", "u8"), ("phrase", "u8"), ("doc", "i8"), ("tie", "i8"), ("start", "i8"), ("more", "u1"), ("off", "u1"))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array by significance, which packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(_planes(c) for c in columns)


def _unpack(payloads: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = len(p) // width, 0
        for k, kind in enumerate(kinds):
            size = n * np.dtype(kind).itemsize
            out[k].append(_unplanes(p[at : at + size], kind))
            at += size
    return [np.concatenate(c) if c else np.empty(0, kind) for c, kind in zip(out, kinds)]


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before in any of the columns; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _runs(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of window starts, [start, start + more], joined where they touch."""
    if not len(doc):
        return doc, tie, start, more
    order = np.lexsort((start, tie, doc))
    doc, tie, start, stop = doc[order], tie[order], start[order], (start + more)[order]
    # Stops of another row must not reach over: restart the running maximum by row.
    turns = _turns(doc, tie)
    place = np.cumsum(turns)
    reach = np.maximum.accumulate(stop + place * (1 << 40)) - place * (1 << 40)
    new = turns.copy()
    new[1:] |= start[1:] > reach[:-1] + 1
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], tie[first], start[first], reach[last] - start[first]


def _entries_of(f: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Phrases in the order of (trigger, phrase, place); which are the first of their entry; which others start elsewhere than that."""
    order = np.lexsort((f["start"], f["tie"], f["doc"], f["phrase"], f["trigger"]))
    f = {k: v[order] for k, v in f.items()}
    new = _turns(f["trigger"], f["phrase"])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return f, new, (f["doc"] != f["doc"][first]) | (f["tie"] != f["tie"][first]) | (f["start"] != f["start"][first])


def _parser(buckets: int):
    """Arrow batches (doc_id, tie, text) to rows (bucket, kind, payload): entries by trigger (0), markers of crowded triggers (1), ranges known to repeat (2), entries by phrase (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ties = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
            parts = [parse(g) for g in _grouped(texts)]
            del texts
            if not parts:
                continue
            f = {k: np.concatenate([p[k] for p in parts]) for k, _ in _FIELDS if k != "tie"}
            f["tie"] = ties[f["doc"]]
            f["doc"] = ids[f["doc"]]
            if not len(f["doc"]):
                continue
            f, new, again = _entries_of(f)
            rows: list[tuple[int, int, bytes]] = []
            known = _runs(f["doc"][again], f["tie"][again], f["start"][again], f["more"][again].astype(np.int64))
            to = (known[0] % buckets).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                rows.append((int(to[own[0]]), 2, _pack([c[own] for c in known])))
            f = {k: v[new] for k, v in f.items()}
            head = _turns(f["trigger"])
            heads = np.flatnonzero(head)
            rank = np.arange(len(head)) - heads[np.cumsum(head) - 1]
            crowded = rank >= BATCH_ENTRIES
            key = np.where(crowded, f["phrase"], f["trigger"]) % np.uint64(buckets)
            for t in np.unique(f["trigger"][crowded]):  # few: each has more than BATCH_ENTRIES entries here
                rows.append((int(t % np.uint64(buckets)), 1, _pack([np.array([t])])))
            place = np.lexsort((np.arange(len(key)), key, crowded))
            border = np.flatnonzero(np.concatenate(([True], (np.diff(key[place].astype(np.int64)) != 0) | (np.diff(crowded[place].astype(np.int8)) != 0), [True]))) if len(key) else []
            for x, y in zip(border[:-1], border[1:]):
                own = place[x:y]
                rows.append((int(key[own[0]]), 3 if crowded[own[0]] else 0, _pack([f[k][own].astype(t, copy=False) for k, t in _FIELDS])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "payload"]
            )

    return run


_FOUND = "doc_id long, tie long, start long, more long, off int, salts int"


def _found(doc, tie, start, more, off=None, salts=None) -> pa.Table:
    n = len(doc)
    return pa.table(
        {
            "doc_id": pa.array(doc, pa.int64()), "tie": pa.array(tie, pa.int64()), "start": pa.array(start, pa.int64()), "more": pa.array(np.asarray(more, np.int64)),
            "off": pa.array(np.full(n, -1) if off is None else off.astype(np.int32), pa.int32()), "salts": pa.array(np.zeros(n) if salts is None else salts, pa.int32()),
        }
    )


def _dictionary(crowd: int):
    return lambda t: _entries(t, crowd)


def _entries(t: pa.Table, crowd: int) -> pa.Table:
    """A bucket's rows to ranges that repeat (salts 0) and ambiguous entries (salts: the number of groups their trigger is dealt to)."""
    kinds, payloads = t.column("kind").to_numpy(), t.column("payload").to_pylist()
    of = lambda *k: [p for p, q in zip(payloads, kinds) if q in k]
    known = _unpack(of(2), ["i8"] * 4)
    marked = np.unique(_unpack(of(1), ["u8"])[0])
    plain, dealt = of(0), of(3)
    width = sum(np.dtype(x).itemsize for _, x in _FIELDS)
    f = dict(zip([k for k, _ in _FIELDS], _unpack(plain + dealt, [x for _, x in _FIELDS])))
    by_phrase = np.arange(len(f["doc"])) >= sum(len(p) for p in plain) // width
    if not len(by_phrase):
        return _found(*known)
    f, new, again = _entries_of(f | {"by_phrase": by_phrase})
    by_phrase = f["by_phrase"]
    group = np.cumsum(_turns(f["trigger"])) - 1
    entries = np.bincount(group, weights=new).astype(np.int64)[group]
    ambiguous = new & ((entries > 1) | by_phrase | np.isin(f["trigger"], marked))
    # Crowded triggers have entries that this bucket does not see: theirs are dealt to a number of groups that all buckets know.
    salts = np.where(by_phrase | np.isin(f["trigger"], marked), crowd, -(-entries // SALT_ENTRIES))
    repeated = _runs(*(np.concatenate((k, f[c][again].astype(np.int64))) for k, c in zip(known, ("doc", "tie", "start", "more"))))
    a = ambiguous
    return pa.concat_tables([_found(*repeated), _found(f["doc"][a], f["tie"][a], f["start"][a], f["more"][a], f["off"][a], salts[a])])


def _shipper(buckets: int):
    """(doc_id, tie, text, entries) to rows (bucket, payload): the bytes of ambiguous entries, by trigger and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1000):
                yield _shipped(b.slice(at, 1000), buckets)

    return run


def _shipped(b: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    out: dict[int, tuple[list, list[bytes]]] = {}
    for doc, tie, text, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
        data = text.as_py().encode("utf-8", "surrogatepass")
        e = entries.values
        for start, more, off, salts in zip(*[e.field(k).to_pylist() for k in ("start", "more", "off", "salts")]):
            phrase = data[start : start + more + WINDOW]
            trigger = int.from_bytes(hashlib.blake2b(phrase[off : off + GRAM], digest_size=7).digest(), "big")
            groups = [0] if salts == 1 else sorted({int(h) for h in _window_hashes(phrase) % np.uint64(salts)})
            for g in groups:
                rows, texts = out.setdefault((trigger + g * 7919) % buckets, ([], []))
                rows.append((doc, tie, start, len(phrase), salts, g))
                texts.append(phrase)
    payloads = [np.array(rows, np.int64).tobytes() for rows, _ in out.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(out), pa.int32()), pa.array(payloads, pa.binary()), pa.array([b"".join(t) for _, t in out.values()], pa.binary())], ["bucket", "rows", "bytes"]
    )


def _window_hashes(phrase: bytes) -> np.ndarray:
    return Rolling(np.frombuffer(phrase, np.uint8)).grams(WINDOW)


def _suffix_order(t: pa.Table) -> pa.Table:
    """Ambiguous entries of a bucket to windows that start earlier in another entry."""
    rows = np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 6) for r in t.column("rows").to_pylist()])
    data = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8)
    if not len(rows):
        return _found(*np.empty((4, 0), np.int64))
    doc, tie, start, size, salts, salt = rows.T
    begins = np.concatenate(([0], np.cumsum(size)[:-1]))
    windows = size - WINDOW + 1
    entry = np.repeat(np.arange(len(rows)), windows)
    inner = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[entry] + inner
    prints = np.concatenate([Rolling(data[a:b]).grams(WINDOW) for a, b in _slices(len(data))])[at]
    own = (salts[entry] == 1) | (prints % np.maximum(salts[entry], 1).astype(np.uint64) == salt[entry].astype(np.uint64))
    at, entry, inner, prints = at[own], entry[own], inner[own], prints[own]
    order = np.argsort(prints, kind="stable")
    same = np.diff(prints[order]) == 0
    twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    if not len(twice):
        return _found(*np.empty((4, 0), np.int64))
    at, doc, tie, start = at[twice], doc[entry[twice]], tie[entry[twice]], start[entry[twice]] + inner[twice]
    # The suffix array of what is left, to a depth of WINDOW bytes: big-endian words compare as bytes do.
    suffixes = np.zeros((len(at), 104), np.uint8)
    suffixes[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]
    words = suffixes.view(">u8").astype(np.uint64)
    order = np.lexsort((start, tie, doc, *words.T[::-1]))
    differs = np.concatenate(([True], (words[order][1:] != words[order][:-1]).any(axis=1)))
    first = order[np.flatnonzero(differs)[np.cumsum(differs) - 1]]
    again = (doc[order] != doc[first]) | (tie[order] != tie[first]) | (start[order] != start[first])
    left = order[again]
    return _found(*_runs(doc[left], tie[left], start[left], np.zeros(len(left), np.int64)))


def _slices(n: int) -> Iterator[tuple[int, int]]:
    """Stretches that hold all windows of a buffer of n bytes once."""
    for a in range(0, max(1, n - WINDOW + 1), PIECE):
        yield a, min(n, a + PIECE + WINDOW - 1)


def _remover(keep: bool):
    """(doc_id, text, ranges) to the result rows; keep: with the remaining bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ranges in zip(b.column(1), b.column(2)):
                kept, removed, spans = remove(text.as_py().encode("utf-8", "surrogatepass"), ranges.values if ranges.is_valid else [])
                out.append((len(kept) + removed, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep else None))
            ids = [None if v == LAST else v for v in b.column(0).to_pylist()]
            numbers = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            rest = [pa.array([r[4] for r in out], pa.binary())] if keep else []
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *numbers, pa.array([r[3] for r in out], pa.string()), *rest], names[: 5 + keep])

    return run


def remove(data: bytes, ranges) -> tuple[bytes, int, int]:
    """(bytes kept, number removed, maximal removed runs), for ranges of window starts as struct array (start, more)."""
    if not len(ranges):
        return data, 0, 0
    start = ranges.field("start").to_numpy(zero_copy_only=False)
    stop = np.minimum(start + ranges.field("more").to_numpy(zero_copy_only=False) + WINDOW, len(data))
    edge = np.zeros(len(data) + 1, np.int64)
    ok = start < stop
    np.add.at(edge, start[ok], 1)
    np.add.at(edge, stop[ok], -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (LAST for null), tie, text: the two that know a row, and its text."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    source = docs.select(own.alias("doc_id"), text_of(text_col).alias("text"))
    many = cut(source.where(F.col("doc_id") != LAST).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("many")), "substring-repeated")
    if not many.isEmpty():
        source = source.join(small(many), "doc_id", "left")
    else:
        source = source.withColumn("many", F.lit(False))
    tie = F.when(F.coalesce("many", F.lit(False)) | (F.col("doc_id") == LAST), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return source.select("doc_id", tie.alias("tie"), "text")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (the remaining bytes) for every row."""
    source = _placed(docs, id_col, text_col)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(1, round(size * 2 / (REACH + 1) / PHRASES))
    parsed = source.mapInArrow(_parser(buckets), "bucket int, kind int, payload binary").repartition(max(1, buckets // 3), "bucket")
    found = cut(parsed.groupBy("bucket").applyInArrow(_dictionary(64 + buckets), _FOUND), "substring-ranges")
    n = found.where("salts > 0").count()
    parts = max(1, round(n / ENTRIES))
    row = ["doc_id", "tie"]
    entries = found.where("salts > 0").groupBy(*row).agg(F.collect_list(F.struct("start", "more", "off", "salts")).alias("entries"))
    shipped = source.join(entries, row).select(*row, "text", "entries").mapInArrow(_shipper(parts), "bucket int, rows binary, bytes binary")
    hidden = shipped.repartition(max(1, parts // 3), "bucket").groupBy("bucket").applyInArrow(_suffix_order, _FOUND)
    every = found.where("salts = 0").select(*row, "start", "more").unionByName(hidden.select(*row, "start", "more"))
    ranges = every.groupBy(*row).agg(F.collect_list(F.struct("start", "more")).alias("ranges"))
    return source.join(ranges, row, "left").select("doc_id", "text", "ranges").mapInArrow(
        _remover(keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    )


def op3_substrings(spark, sf_dir) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), keep=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
f AS (SELECT s, min(struct_pack(doc_id := doc_id, p := p)) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS starts
      FROM w JOIN f USING (s) WHERE struct_pack(doc_id := doc_id, p := p) <> first),
g AS (SELECT doc_id, p, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
per AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last FROM runs GROUP BY doc_id),
parts AS (SELECT doc_id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS kept FROM runs JOIN d USING (doc_id)),
heads AS (SELECT doc_id, string_agg(kept, '' ORDER BY a) AS kept FROM parts GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(heads.kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN heads ON heads.doc_id = d.doc_id
"""
