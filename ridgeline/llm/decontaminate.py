"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts become sets of five-word shingles over lower-cased runs of letters and digits. A document is
contaminated by a test item if it holds at least 80 % of the item's distinct shingles, however long the
document is.

Search: items are partitioned by their number of shingles (powers of two). An item's MinHash sketch is
its bottom-k shingle hashes with k = m - ceil(0.8 m) + 1: a document that holds 80 % of the m shingles
lacks fewer than k of them, so it holds one of the k at least (pigeonhole; no candidate is missed). Each
partition is an index of its own with a threshold, the largest hash of its sketches; a document's sketch for
the partition is its shingle hashes up to that threshold, and a document whose whole text has too few shingles
for the partition is skipped. A common hash in the sketches makes a candidate, which is verified by exact containment of shingle texts.

The search is one pass over the documents: nothing of them is shuffled. Items reach the tasks in blocks
of bounded size (BLOCK_ITEMS and BLOCK_BYTES, read off before); a larger benchmark takes more blocks.

Defined results: null text is empty; a text of fewer than five words is one shingle of all its words, so
such an item only matches a document with the same words; texts without words match nothing; repeated
rows give repeated results; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ridgeline.llm.common import table, text_of

WORDS = 5
CONTAINMENT = 0.8
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 16 << 20
#: Documents are hashed in groups of about so many bytes.
GROUP_BYTES = 1 << 18
#: A longer text is hashed in pieces of so many words that overlap by four.
PIECE_WORDS = 100_000

#: 1 for bytes of a word: digits, letters and all of multi-byte characters.
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_ODD = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the hash."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for b in (_ODD, pow(_ODD, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def words_of(text: str) -> list[str]:
    """The words of a text: lower case, split at what is no ASCII letter or digit and below U+0080."""
    return "".join(c if c.isalnum() or c >= "\x80" else " " for c in text.lower()).split(" ")


def shingle_texts(text: str) -> set[str]:
    words = [w for w in words_of(text) if w]
    if not words:
        return set()
    return {" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of all shingles of lower-cased UTF-8 texts, in one pass of array operations.

    A word's hash is a difference of running sums of byte * base**position, moved to position 0.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    inside = _IN_WORD[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, "u8"), np.empty(0, np.int64)
    run = np.concatenate((np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * up[: len(data)])))
    word = _mix((run[end] - run[start]) * down[start] + (end - start).astype("u8"))
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    text = np.searchsorted(bounds, start, side="right")
    count = np.bincount(text, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    n = len(word)
    rolled = np.zeros(n, "u8")
    for j in range(WORDS):
        part = np.zeros(n, "u8")
        part[: max(0, n - j)] = word[j:]
        rolled = rolled * np.uint64(0xFF51AFD7ED558CCD) + part
    place = np.arange(n) - first[text]
    full = place <= count[text] - WORDS
    hashes, owner = _mix(rolled[full]), text[full]
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if len(few):  # all words of a short text, marked by their number
        short = []
        for t in few:
            h = 0
            for w in word[first[t] : first[t] + count[t]].tolist():
                h = (h * 0xFF51AFD7ED558CCD + w) & (1 << 64) - 1
            short.append((h + int(count[t])) & (1 << 64) - 1)
        hashes, owner = np.concatenate((hashes, _mix(np.array(short, "u8")))), np.concatenate((owner, few))
    return hashes, owner


class Partition:
    """Sketches of the items of one size class: hashes in order with their items, and what a text needs to hold one of them."""

    BITS = 18

    def __init__(self, key: np.ndarray, item: np.ndarray, need: int):
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.need = key[order], item[order], need
        self.top = self.key[-1]
        self._mark()

    def _mark(self) -> None:
        self.marks = np.zeros(1 << self.BITS, bool)  # of the leading bits, to pass over most hashes fast
        self.marks[(self.key >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __getstate__(self):
        return self.key, self.item, self.need, self.top

    def __setstate__(self, state) -> None:
        self.key, self.item, self.need, self.top = state
        self._mark()

    def meet(self, hashes: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs that share a hash of the item's sketch. hashes: ascending, so a text's sketch is what comes up to the threshold."""
        n = int(np.searchsorted(hashes, self.top, "right"))
        hit = np.flatnonzero(self.marks[(hashes[:n] >> np.uint64(64 - self.BITS)).astype(np.int64)])
        hit = hit[size[owner[hit]] >= self.need]
        lo, hi = np.searchsorted(self.key, hashes[hit], "left"), np.searchsorted(self.key, hashes[hit], "right")
        times = hi - lo
        ends = np.cumsum(times)
        at = np.arange(int(times.sum())) - np.repeat(ends - times, times) + np.repeat(lo, times)
        return np.repeat(owner[hit], times), self.item[at]


class Index:
    """Sketches of a block of items, by size partition. It is built once, and travels as arrays."""

    def __init__(self, ids: list, texts: list[str], containment: float = CONTAINMENT):
        self.ids, self.texts, self.containment = ids, texts, containment
        hashes, owner = shingle_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
        pairs = np.unique(np.stack((owner.astype("u8"), hashes)), axis=1)  # by item, then hash: sets, ascending
        owner, hashes = pairs[0].astype(np.int64), pairs[1]
        m = np.bincount(owner, minlength=len(texts))
        need = np.ceil(containment * m - 1e-9).astype(np.int64)
        place = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(m)[:-1]))[owner] if len(owner) else owner
        sketch = place < (m - need + 1)[owner]
        part = np.floor(np.log2(np.maximum(m, 1))).astype(np.int64)[owner[sketch]]
        self.parts = []
        for p in np.unique(part):
            own = part == p
            self.parts.append(Partition(hashes[sketch][own], owner[sketch][own], int(need[owner[sketch][own]].min())))

    def candidates(self, hashes: np.ndarray, owner: np.ndarray, size: np.ndarray) -> dict[int, set[int]]:
        """Text index to the items whose sketch meets the text's sketch for the item's partition. size: shingles of each whole text, or more."""
        found: dict[int, set[int]] = {}
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        for part in self.parts:
            for t, i in zip(*(x.tolist() for x in part.meet(hashes, owner, size))):
                found.setdefault(t, set()).add(i)
        return found

    @lru_cache(4096)  # noqa: B019
    def shingles(self, i: int) -> frozenset[str]:
        return frozenset(shingle_texts(self.texts[i]))


def _pieces(texts: list[str]) -> Iterator[tuple[int, bytes, int]]:
    """(text, lower-cased piece, shingles of the whole text or 0 for one that is not cut); the pieces of a very long text hold all its shingles."""
    for i, t in enumerate(texts):
        if len(t) <= GROUP_BYTES:
            yield i, t.lower().encode("utf-8", "surrogatepass"), 0
            continue
        words = [w for w in words_of(t) if w]
        count = max(1, len(words) - WORDS + 1)
        for at in range(0, count, PIECE_WORDS):
            yield i, " ".join(words[at : at + PIECE_WORDS + WORDS - 1]).encode("utf-8", "surrogatepass"), count


def _groups(texts: list[str]) -> Iterator[tuple[list[int], list[bytes], dict[int, int]]]:
    """(text of each piece, pieces, shingles of the texts that were cut)."""
    ids, some, whole, size = [], [], {}, 0
    for i, t, count in _pieces(texts):
        ids.append(i)
        some.append(t)
        if count:
            whole[i] = count
        size += len(t)
        if size >= GROUP_BYTES:
            yield ids, some, whole
            ids, some, whole, size = [], [], {}, 0
    if ids:
        yield ids, some, whole


def search(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, shared, size of item) for all pairs that reach the containment."""
    found: dict[int, set[int]] = {}
    for ids, some, whole in _groups(texts):
        hashes, owner = shingle_hashes(some)
        owner = np.array(ids, np.int64)[owner] - ids[0]  # pieces of one text count together
        size = np.bincount(owner, minlength=ids[-1] - ids[0] + 1)
        for i, count in whole.items():
            size[i - ids[0]] = count
        for t, items in index.candidates(hashes, owner, size).items():
            found.setdefault(t + ids[0], set()).update(items)
    for t, items in sorted(found.items()):
        own = shingle_texts(texts[t])
        for i in sorted(items):
            wanted = index.shingles(i)
            shared = len(wanted & own)
            if shared >= index.containment * len(wanted) - 1e-9:
                yield t, i, shared, len(wanted)


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over blocks of the items, each of bounded size."""
    items = items.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == k)
        rows = own.orderBy("id", "t").collect()
        if rows:
            yield Index([r[0] for r in rows], [r[1] for r in rows])


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text") -> DataFrame:
    """One row per (document, item) with containment of 0.8 or more: doc_id, item_id, n_shared, n_item, containment."""
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, n_shared long, n_item long, containment double"
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    found = None
    for index in blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        part = source.mapInArrow(_searcher(shared, to_arrow_type(items.schema[item_id].dataType)), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _searcher(shared, item_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = list(search(index, b.column(1).to_pylist()))
            t = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(t), pa.array([index.ids[r[1]] for r in rows], item_kind), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()), pa.array([r[2] / r[3] for r in rows], pa.float64()),
                ],
                ["doc_id", "item_id", "n_shared", "n_item", "containment"],
            )

    return run


def op1_decontaminate(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""
