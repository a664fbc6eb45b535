"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints: 64 bits from XXH64 (seed 42) of four-word shingles; a bit is 1 if it is set in more than
half of them. Two fingerprints link if at most RADIUS bits differ.

Covering tables: bit i gets a code m(i), a non-zero vector of RADIUS + 1 bits. Table v, for each of the
2**(RADIUS + 1) - 1 non-zero vectors v, keeps the bits i whose <m(i), v> is 1. The codes of any RADIUS
differing bits span at most RADIUS dimensions, so some v is orthogonal to all of them: in that table the
two masked fingerprints are equal. Every pair within the radius collides in some table, without exception.
The codes are dealt evenly, so each table keeps about half of the bits.

Buckets hold distinct fingerprints only (copies are one row from the start). In a bucket no list of pairs
is made: a search from leader to leader removes what it reaches, and what comes out is a spanning forest.
A bucket over BUCKET_LIMIT is covered again: its fingerprints are equal in the bits its table keeps, so tables
over the bits that it drops (about half of them each) cover all its pairs, at 31 rows a fingerprint. What they
leave equal is all but about 15 bits, which bounds a bucket's size whatever the corpus is; one that is still
over the limit is searched as all pairs of its blocks, of which there are three at most. Components over the forests come from distributed
large-star/small-star rounds; nothing but counters reaches the driver.

Defined results: null text is empty; a text without a word has fingerprint zero, linked like any other;
fewer than four words are one shingle; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import attach, cut, small, table

SHINGLE = 4
RADIUS = 4
BUCKET_LIMIT = 1 << 14
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < k:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-k])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]
    counts, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, CHUNK):
        part = np.array(hashes[at : at + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([simhash(t.as_py()) for t in b.column(1)], "u8").view("i8")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bit masks of the covering tables."""
    codes = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(codes) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least of its local component) of a spanning forest over distinct unsigned fingerprints.

    Each reached fingerprint is compared with those not reached yet only, so a dense bucket costs little
    more than its size and memory is a few arrays of its length.
    """
    rest, nodes, roots = np.unique(fps), [], []
    while len(rest) > 1:
        frontier, root, rest = [rest[:1]], rest[0], rest[1:]
        while frontier and len(rest):
            near = np.zeros(len(rest), bool)
            for x in frontier.pop():
                left = np.flatnonzero(~near)
                near[left[np.bitwise_count(rest[left] ^ x) <= radius]] = True
                if near.all():
                    break
            if near.any():
                hit = rest[near]
                nodes.append(hit)
                roots.append(np.full(len(hit), root))
                frontier.append(hit)
                rest = rest[~near]
    if not nodes:
        return np.empty(0, "u8"), np.empty(0, "u8")
    return np.concatenate(nodes), np.concatenate(roots)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = [np.empty(0, "u8")], [np.empty(0, "u8")]
        for x in b.column(0):
            found = spanning(np.asarray(x.values).view("u8"))
            a.append(found[0])
            c.append(found[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view("i8")), pa.array(np.concatenate(c).view("i8"))], ["a", "b"])


def finer_masks(mask: int) -> list[int]:
    """Masks of covering tables for fingerprints that are equal in the bits of a mask: those bits and half of the others."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << free[k] for k in range(len(free)) if inner >> k & 1) for inner in masks(bits=len(free))]


def _bucket_links(rows: DataFrame, key: list[str], limit: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, fp): edges of the buckets up to the limit, and the larger buckets (key, n)."""
    # Most buckets hold one fingerprint. Two are compared by what an ordinary aggregate keeps; only buckets of more are gathered.
    sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    sums = cut(sums.where("n > 1"), label)
    pairs = sums.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS)).select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    some = sums.where((F.col("n") > 2) & (F.col("n") <= limit)).select(*key)
    groups = rows.join(small(some), key).groupBy(*key).agg(F.collect_list("fp").alias("fps"))
    return pairs.unionByName(groups.select("fps").mapInArrow(_forests, "a long, b long")), sums.where(F.col("n") > limit).select(*key, "n")


def links(distinct: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose components are those of all links within RADIUS."""
    keyed = [F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked")) for n, m in enumerate(masks())]
    rows = distinct.select("fp", F.explode(F.array(*keyed)).alias("k")).select("k.t", "k.masked", "fp")
    found, large = _bucket_links(rows, ["t", "masked"], limit, "simhash-buckets")
    if large.isEmpty():
        return found.distinct()
    finer = F.array(*[F.array(*[F.lit(_signed(f)) for f in finer_masks(m)]) for m in masks()])
    again = rows.join(small(large), ["t", "masked"]).select("t", "fp", F.posexplode(F.get(finer, F.col("t"))).alias("u", "mask"))
    again = again.select("t", "u", F.col("fp").bitwiseAND(F.col("mask")).alias("masked"), "fp")
    more, large = _bucket_links(again, ["t", "u", "masked"], limit, "simhash-finer")
    found = found.unionByName(more)
    if large.isEmpty():
        return found.distinct()
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    dealt = again.join(small(large).withColumn("parts", parts), ["t", "u", "masked"]).withColumn("own", own)
    groups = dealt.select("t", "u", "masked", F.explode(pairs).alias("p"), "fp").groupBy("t", "u", "masked", "p").agg(F.collect_list("fp").alias("fps"))
    return found.unionByName(groups.select("fps").mapInArrow(_forests, "a long, b long")).distinct()


def _state(edges: DataFrame):
    h = F.xxhash64("a", "b")
    return edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()


#: Edges that one task contracts to a forest.
CONTRACT = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to a star forest with the same components, in pieces of bounded size."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
        if sum(len(a) for a, _ in held) >= 4 * CONTRACT:
            held = [_stars(held)]
    if held:
        a, c = _stars(held)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])


def _stars(edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        least, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of an edge, by large-star and small-star rounds.

    Each round is two joinless group steps over the edges, written to the shared folder; it ends when a
    round changes nothing. Stars of a hot node are never collected: a node's least neighbour is an aggregate,
    joined back to its edges.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    # A node of a dense group has an edge from each bucket; first each task leaves a forest of its share.
    parts = max(1, -(-_state(now)[0] // CONTRACT))
    now = cut(now.coalesce(parts).mapInArrow(_contract, "a long, b long").distinct(), "cc-forest")
    before = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.a", "e.b").where("a <> b").distinct(), "cc-edges")
        state = _state(after)
        now = after
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links reach, itself included. One row per input row."""
    prints = cut(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    ids = _component_ids(distinct, cut(components(links(distinct.select("fp"))), "simhash-roots"), "fp")
    return attach(prints, ids, "fp", "n").select("doc_id", "fp", "component_id")


def _component_ids(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """key, n, component_id (the least id of the node's component) of all nodes (key, least, n)."""
    roots = roots.withColumnRenamed("node", key)
    of_root = nodes.select(key, "least").join(roots, key).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(of_root, "root").select(key, "component_id")
    return cut(nodes.join(linked, key, "left").select(key, "n", F.coalesce("component_id", "least").alias("component_id")), "simhash-ids")


# ---- near copies at a similarity of 0.8 -----------------------------------------------------------------
#
# One 64-bit fingerprint of shingles moves by about eight bits when a document's five-word shingles agree to
# 0.8, too far for tables that keep enough bits. Candidates come from the shingles themselves: all shingles
# have one order, rarest first, and two sets of m shingles that agree to 0.8 share one of the first
# m - ceil(0.8 m) + 1 of each (prefix filter). So every such pair meets in a bucket, whatever the edit was.
# The order is by counts in a sample, then by hash; any order finds all pairs, a good one keeps buckets small.
#
# In a bucket two bounds pass over pairs that cannot agree to 0.8: sizes, and bitmaps of parity, which differ
# in no more bits than the sets differ in shingles. Neither loses a pair. Bitmaps have two to four bits a
# shingle, at any length, so few pairs below 0.8 pass.
#
# The search leaves a spanning forest of pairs that passed. Its edges are settled by the sets of shingles
# themselves, as 48-bit hashes. A component whose edges all hold is done. Where one fails the component falls
# into pieces; all members but those of its largest piece are compared with all members by their sets.
#
# duplicates() starts from the links of the fingerprints, found by the covering tables as for near_duplicates(),
# and adds these. A fingerprint follows the shingles that a text repeats most, so texts that share little but a
# repeated line may link: the links are settled by the sets too, at a half, and searched again in the same way.
# They reach copies with edits all over, whose shingles agree to less than 0.8.

COPY_WORDS = 5
#: Kinds of links: what sets of shingles must agree to, as a fraction, and how many bits of the fingerprints may differ.
COPY, PRINT = 0, 1
RULES = ((4, 5, 64), (1, 2, RADIUS))
#: Fewest bits of a bitmap (a power of two).
MAP_BITS = 256
#: Documents whose shingles are counted for the order, and most shingles that count as common.
ORDER_SAMPLE = 8_000
MOST_COMMON = 1 << 18
#: Shingles of one block of a component, for each row of a block of a bucket.
BLOCK_SHINGLES = 64
#: Bytes of bitmaps that count as one row of a bucket.
ROW_BYTES = 128
#: Size classes of a large bucket: a little wider than the ratio of two sets that agree to 0.8.
CLASS_RATIO = 1.26
#: How often a large class is dealt into blocks before members apart meet all others.
BLOCK_ROUNDS = 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def copy_shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, ascending; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    k = min(COPY_WORDS, len(h))
    shingles = np.full(len(h) - k + 1, k, "u8")
    for j in range(k):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return np.unique(_mix(shingles) >> np.uint64(16))


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which two sets that agree to 0.8 share one: the first m - ceil(0.8 m) + 1, rare ones before common ones."""
    known, counts = common
    rank = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.argsort(rank, kind="stable")[: len(shingles) - (4 * len(shingles) + 4) // 5 + 1]]


def map_bits(m: int) -> int:
    """Bits of the bitmap of m shingles: the power of two from 2 m on."""
    return max(MAP_BITS, 1 << max(0, 2 * m - 1).bit_length())


def parity(shingles: np.ndarray, bits: int = 0) -> bytes:
    """A bitmap of the parity of how many shingles fall on each bit. Its two halves, combined by XOR, are the bitmap of half the bits."""
    bits = bits or map_bits(len(shingles))
    at = (shingles >> np.uint64(4)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


def folded(data: bytes, bits: int) -> np.ndarray:
    """A bitmap as words, folded to so many bits."""
    out = np.frombuffer(data, "u8")
    while len(out) * 64 > bits:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _packed(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(copy_shingles(t.as_py()).view("i8"))], ["h"])


def common_shingles(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of shingles that several documents of a sample share. They set an order and nothing else."""
    share = min(1.0, ORDER_SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(text_col, F.lit(11)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(F.col(text_col))
    counted = some.mapInArrow(_count_shingles, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    known, counts = np.array([r[0] for r in rows], "i8").view("u8"), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(known)
    return known[order], counts[order]


def _node(shingles: np.ndarray, fp: int = 0) -> int:
    """What texts of the same set and fingerprint share."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), fp % (1 << 64))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _printer(shared, prints: bool):
    """Rows with sets of shingles described, and with their fingerprints (zero unless prints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            sets = [copy_shingles(t.as_py()) for t in b.column(1)]
            fps = [simhash(t.as_py()) if prints else 0 for t in b.column(1)]
            node = np.array([_node(s, fp) for s, fp in zip(sets, fps)], "u8").view("i8")
            first = [prefix(s, shared.value).view("i8") for s in sets]
            columns = [
                b.column(0), b.column(2), pa.array(node), pa.array(np.array(fps, "u8").view("i8")), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(first, pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "node", "fp", "m", "first", "bits"])

    return run


def _may_agree(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """False only where two sets cannot agree to 0.8. Rows: a bitmap's words, then the size of the set."""
    a, b = np.int64(x[-1]), rest[:, -1].astype(np.int64)
    possible = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)).copy()
    at = np.flatnonzero(possible)
    differ = np.bitwise_count(rest[at, :-1] ^ x[:-1]).sum(axis=1, dtype=np.int64)
    possible[at] = 9 * differ <= a + b[at]
    return possible


def _agree(x: tuple, rest: np.ndarray) -> np.ndarray:
    """Whether sets of shingles agree with x to the share of its rule or more, by count. Rows: (size, bitmap, set, fingerprint, kind), of one kind."""
    n, bits, own, fp, kind = x
    part, whole, radius = RULES[kind]
    sizes = np.fromiter((r[0] for r in rest), np.int64, len(rest))
    out = whole * np.minimum(sizes, n) >= part * np.maximum(sizes, n)
    if radius < 64:
        out &= np.bitwise_count(np.fromiter((r[3] for r in rest), "u8", len(rest)) ^ fp) <= radius
    at = np.flatnonzero(out)
    if len(at):  # the bound of the bitmaps first
        differ = np.bitwise_count(np.stack([r[1] for r in rest[at]]) ^ bits).sum(axis=1, dtype=np.int64)
        possible = (whole + part) * differ <= (whole - part) * (sizes[at] + n)
        out[at] = possible
        at = at[possible]
    if len(at):
        flat = np.concatenate([r[2] for r in rest[at]])
        same = own[np.minimum(np.searchsorted(own, flat), n - 1)] == flat
        both = np.add.reduceat(same.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[at])[:-1])))
        out[at] = (whole + part) * both >= part * (sizes[at] + n)
    return out


def forest(ids: np.ndarray, rows: np.ndarray, alike) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, the node that reached it) of a spanning forest over rows that alike(row, rows) links; a search as in spanning()."""
    ids, first = np.unique(ids, return_index=True)
    rows, nodes, parents = rows[first], [], []
    while len(ids) > 1:
        frontier, ids, rows = [(ids[:1], rows[:1])], ids[1:], rows[1:]
        while frontier and len(ids):
            by = np.full(len(ids), -1)
            names, some = frontier.pop()
            for k, x in enumerate(some):
                left = np.flatnonzero(by < 0)
                by[left[alike(x, rows[left])]] = k
                if (by >= 0).all():
                    break
            near = by >= 0
            if near.any():
                nodes.append(ids[near])
                parents.append(names[by[near]])
                frontier.append((ids[near], rows[near]))
                ids, rows = ids[~near], rows[~near]
    if not nodes:
        return np.empty(0, "i8"), np.empty(0, "i8")
    return np.concatenate(nodes), np.concatenate(parents)


def _group_forests(parts, alike):
    """Rows of grouped members to forest edges. parts(members) gives (nodes, rows) to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(np.empty(0, "i8"), np.empty(0, "i8"))]
            for group in b.column(0):
                found += [forest(ids, rows, alike) for ids, rows in parts(group.values)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["a", "b"])

    return run


def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        near = 5 * np.minimum(a, c) >= 4 * np.maximum(a, c)
        for k in np.flatnonzero(near):
            x, y = b.column(4)[k].as_buffer(), b.column(5)[k].as_buffer()
            bits = 8 * min(len(x), len(y))
            near[k] = 9 * int(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum(dtype=np.int64)) <= a[k] + c[k]
        yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])


def _by_bitmap(members) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members by the length of their bitmaps, each with the longer ones that may agree with the largest set of this length."""
    ids, m = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "m"))
    data = members.field("bits")
    length = 8 * np.fromiter((len(x.as_buffer()) for x in data), np.int64, len(ids))
    for bits in np.unique(length):
        own = np.flatnonzero((length == bits) | ((length == 2 * bits) & (4 * m <= 5 * (bits // 2))))
        if len(own) > 1:
            rows = np.stack([folded(data[int(k)].as_buffer(), int(bits)) for k in own])
            yield ids[own], np.column_stack((rows, m[own].view("u8")))


def _by_set(members) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    out = np.empty(len(members), object)
    sets = [_unpacked(x.as_buffer()) for x in members.field("shingles")]
    # Bitmaps as long as the largest set asks for, within 64 MB.
    bits = 1 << min(16, max(10, (2 * max(map(len, sets))).bit_length()), max(10, ((64 << 23) // len(sets)).bit_length() - 1))
    fps, kinds = (members.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "kind"))
    for k, x in enumerate(sets):
        out[k] = (len(x), np.frombuffer(parity(x, bits), "u8"), x, fps.view("u8")[k], kinds[k])
    yield members.field("node").to_numpy(zero_copy_only=False), out


def _gathered(members: DataFrame, key: list, columns: list[str]) -> DataFrame:
    """Members (key, node, columns) as one list a key."""
    return members.groupBy(*key).agg(F.collect_list(F.struct("node", *columns)).alias("members")).select("members")


def _dealt_minors(members: DataFrame, key: str, columns: list[str], limit: int) -> DataFrame:
    """Members (key, node, columns, minor, n_minor, n_major) as lists in which every minor member meets every member.

    Blocks of minor members come first, then blocks of the others; groups are the pairs whose first block is a
    minor one. So the others are copied once for each block of minor members, of which there is mostly one.
    """
    whole = F.col("n_minor") + F.col("n_major") <= F.lit(limit)
    few, more = (F.when(whole, 0).otherwise(F.ceil(F.col(c) / F.lit(limit))).cast("int") for c in ("n_minor", "n_major"))
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(n, F.lit(1))).cast("int")
    dealt = members.withColumn("few", few).withColumn("more", more)
    dealt = dealt.withColumn("own", F.when(F.col("minor"), at(F.col("few"))).otherwise(F.col("few") + at(F.col("more"))))
    pair = lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"))
    last = F.when(F.col("minor"), F.col("few") + F.col("more") - 1).otherwise(F.col("few") - 1)
    pairs = F.when(F.col("few") == 0, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), last), pair))
    return _gathered(dealt.withColumn("p", F.explode(pairs)), [key, "p"], columns)


def _kept_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to a spanning forest of them, in pieces of bounded size. Unlike _contract it keeps only edges that it was given."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= 2 * CONTRACT:
            held = [_spanning_edges(held)]
    if held:
        yield _spanning_edges(held)


def _spanning_edges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    up, keep = list(range(len(ids))), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "b"])


def spanning_forest(edges: DataFrame) -> DataFrame:
    """A subset of the edges (a, b) with the same components; while that pays, shares of the edges lose what closes a circle."""
    now = cut(edges, "simhash-edges")
    n = now.count()
    while n:
        parts = -(-n // CONTRACT)
        now = cut(now.repartition(parts, F.least("a", "b")).mapInArrow(_kept_forest, "a long, b long"), "simhash-edges")
        left = now.count()
        if parts == 1 or left > 0.8 * n:
            break
        n = left
    return now


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, kind, set of a, set of b) to (a, b, kind, whether the sets agree to the share of the kind)."""
    for batch in batches:
        out = []
        for k, kind in enumerate(batch.column(2).to_pylist()):
            x, y = (_unpacked(batch.column(c)[k].as_buffer()) for c in (3, 4))
            part, whole, _ = RULES[kind]
            out.append((whole + part) * len(np.intersect1d(x, y, assume_unique=True)) >= part * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(out, pa.bool_())], ["a", "b", "kind", "holds"])


def _largest_pieces(members: DataFrame, key: str, size: str) -> DataFrame:
    """Of members (key, piece, size): key, major (its largest piece), n_major and n_minor (sizes of that piece and of all others)."""
    pieces = members.groupBy(key, "piece").agg(F.sum(size).alias(size))
    return pieces.groupBy(key).agg(F.max_by("piece", F.struct(size, "piece")).alias("major"), F.max(size).alias("n_major"), (F.sum(size) - F.max(size)).alias("n_minor"))


def _rows() -> Column:
    """How many rows of a bucket a member counts as: more than one if its bitmap is long."""
    return F.greatest(F.lit(1.0), F.octet_length("bits") / F.lit(ROW_BYTES))


def _links_of_large(members: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Edges within buckets over the limit. members: bucket, node, m, bits; found: edges of the other buckets.

    Members fall into size classes, each with the next one, as sets that agree to 0.8 are of one class or of neighbours.
    Classes over the limit are searched in blocks, dealt anew for each of BLOCK_ROUNDS, at a row a member. What is in one
    component by then needs no look at its pairs: only members outside their class's largest piece meet all others. So the
    work follows the number of rows where copies make a bucket large, and nothing is left out.
    """
    search = _group_forests(_by_bitmap, _may_agree)
    size_class = F.floor(F.log("m") / F.log(F.lit(CLASS_RATIO)))
    finer = members.withColumn("class", F.explode(F.array(size_class, size_class + 1))).withColumn("bucket", F.xxhash64("bucket", "class")).drop("class")
    finer = cut(finer, "simhash-classes")
    sizes = cut(finer.groupBy("bucket").agg(F.sum(_rows()).alias("n")), "simhash-sizes")
    few = finer.join(small(sizes.where(F.col("n") <= limit).select("bucket")), "bucket")
    found = found.unionByName(_gathered(few, ["bucket"], ["m", "bits"]).mapInArrow(search, "a long, b long"))
    large = sizes.where(F.col("n") > limit)
    if large.isEmpty():
        return found
    many = finer.join(small(large), "bucket")
    for seed in range(BLOCK_ROUNDS):
        block = F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col("n") / F.lit(limit)))
        found = found.unionByName(_gathered(many.withColumn("block", block), ["bucket", "block"], ["m", "bits"]).mapInArrow(search, "a long, b long"))
    found = cut(found.distinct(), "simhash-blocks")
    pieces = cut(components(found), "simhash-block-roots").withColumnRenamed("root", "piece")
    told = many.select("bucket", "node", _rows().alias("size")).join(pieces, "node", "left")
    told = cut(told.select("bucket", "node", F.coalesce("piece", "node").alias("piece"), "size"), "simhash-told")
    apart = cut(_largest_pieces(told, "bucket", "size").where("n_minor > 0"), "simhash-apart")
    left = told.join(small(apart), "bucket").select("bucket", "node", (F.col("piece") != F.col("major")).alias("minor"), "n_minor", "n_major")
    left = left.join(many.select("bucket", "node", "m", "bits"), ["bucket", "node"])
    return found.unionByName(_dealt_minors(left, "bucket", ["m", "bits"], limit).mapInArrow(search, "a long, b long"))


def prefix_links(prints: DataFrame, nodes: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Candidate edges (a, b) between nodes. prints: node, first (a row a document); nodes: node, m, bits (a row a node).

    One exchange of (bucket, node) finds the buckets with two nodes or more; bitmaps join the few rows of those.
    """
    rows = prints.select("node", F.explode("first").alias("bucket"))
    met = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    shared = cut(rows.join(small(cut(met, "simhash-met")), "bucket").select("bucket", "node").distinct(), "simhash-shared")
    sums = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"))
    # Copies share many shingles: of the buckets with the same members one is enough.
    sums = cut(sums.groupBy("n", "lo", "hi", "x").agg(F.min("bucket").alias("bucket")), "simhash-buckets")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("m").alias(f"m_{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = sums.where("n = 2").select(F.col("hi").alias("a"), F.col("lo").alias("b")).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.select("a", "b", "m_a", "m_b", "bits_a", "bits_b").mapInArrow(_possible_pairs, "a long, b long")
    members = cut(shared.join(sums.where("n > 2").select("bucket"), "bucket").join(nodes.select("node", "m", "bits"), "node"), "simhash-members")
    size = cut(members.groupBy("bucket").agg(F.sum(_rows()).alias("n")), "simhash-bucket-sizes")
    large = size.where(F.col("n") > limit).select("bucket")
    if large.isEmpty():
        groups = _gathered(members, ["bucket"], ["m", "bits"])
        return pairs.unionByName(groups.mapInArrow(_group_forests(_by_bitmap, _may_agree), "a long, b long")).distinct()
    large = small(large)
    groups = _gathered(members.join(large, "bucket", "left_anti"), ["bucket"], ["m", "bits"])
    found = pairs.unionByName(groups.mapInArrow(_group_forests(_by_bitmap, _may_agree), "a long, b long"))
    return _links_of_large(members.join(large, "bucket", "left_semi"), found, limit).distinct()


def print_links(nodes: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between nodes (node, fp) of equal or linked fingerprints, with the components of all such pairs."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    edges = spanning_forest(links(prints.select("fp"), limit))
    of = lambda x: prints.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    same = attach(nodes.select("node", "fp"), prints.where("n > 1"), "fp", "n").where("node <> rep")
    return cut(between.unionByName(same.select(F.col("node").alias("a"), F.col("rep").alias("b"))), "simhash-print-links")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node, fp) to (node, shingles) where the text is the node's."""
    for b in _sliced(batches):
        found = [copy_shingles(t.as_py()) for t in b.column(0)]
        own = pa.array([_node(s, fp) == n % (1 << 64) for s, n, fp in zip(found, b.column(1).to_pylist(), b.column(2).to_pylist())], pa.bool_())
        packed = pa.array([_packed(s) for s in found], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(1).filter(own), packed.filter(own)], ["node", "shingles"])


def _of_kind(name: str) -> Column:
    """A node as another one for each kind of links."""
    return F.col(name).bitwiseXOR(F.xxhash64("kind"))


def _exact_roots(edges: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """node, root of the components of all links, of all kinds, for the nodes of edges (a, b, kind): of each kind a spanning forest of its candidate links.

    sets: node, fp, shingles and uses, the number of edges that a node has.
    """
    of = lambda x: sets.select(F.col("node").alias(x), "uses", F.col("shingles").alias(f"of_{x}"))
    both = attach(attach(edges, of("a"), "a", "uses"), of("b"), "b", "uses").select("a", "b", "kind", "of_a", "of_b")
    tried = cut(both.mapInArrow(_hold, "a long, b long, kind int, holds boolean"), "simhash-tried")
    roots = cut(components(tried.where("holds").select("a", "b")), "simhash-pieces")
    failed = tried.where("not holds").select(_of_kind("a").alias("at"))
    if failed.isEmpty():
        return roots
    # Where a link fails, the component of its kind is compared anew but for what links of any kind have joined.
    loose = cut(components(tried.select(_of_kind("a").alias("a"), _of_kind("b").alias("b"))), "simhash-loose").withColumnRenamed("node", "at")
    torn = failed.join(loose, "at").select("root").distinct()
    names = tried.select("kind", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", _of_kind("node"))
    members = loose.join(torn, "root").join(names, "at").join(roots.withColumnRenamed("root", "piece"), "node", "left").join(sets.select("node", F.octet_length("shingles").alias("size")), "node")
    members = cut(members.select("root", "node", "kind", F.coalesce("piece", "node").alias("piece"), F.expr("size div 6").alias("m")), "simhash-torn")
    sizes = _largest_pieces(members, "root", "m")
    members = members.join(sizes, "root").withColumn("minor", F.col("piece") != F.col("major")).join(sets.select("node", "shingles", "fp"), "node")
    more = _dealt_minors(members, "root", ["shingles", "fp", "kind"], limit * BLOCK_SHINGLES).mapInArrow(_group_forests(_by_set, _agree), "a long, b long")
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return cut(components(stars.unionByName(more)), "simhash-roots")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, component_id for every row: documents whose five-word shingles agree to 0.8 or more share a component."""
    return _linked(docs, id_col, text_col, limit, False)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, component_id for every row: near duplicates share a component.

    A link: fingerprints within RADIUS of texts whose five-word shingles agree to a half, or shingles that agree to 0.8.
    """
    return _linked(docs, id_col, text_col, limit, True)


def _linked(docs: DataFrame, id_col: str, text_col: str, limit: int, by_print: bool) -> DataFrame:
    """Texts are read twice: once for fingerprints, bitmaps and prefixes, and again, for nodes with a candidate link only, for their sets."""
    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(made))
    prints = cut(made.mapInArrow(_printer(common, by_print), f"doc_id {kind}, h long, node long, fp long, m long, first array<long>, bits binary"), "simhash-prints")
    same = [F.first(c).alias(c) for c in ("fp", "m", "bits")]  # equal for all rows of a node
    rep = F.min(F.struct("doc_id", "h")).alias("rep")
    nodes = cut(prints.groupBy("node").agg(*same, F.min("doc_id").alias("least"), rep, F.count(F.lit(1)).alias("n")), "simhash-nodes")
    edges = spanning_forest(prefix_links(prints, nodes, limit)).withColumn("kind", F.lit(COPY))
    if by_print:
        edges = print_links(nodes, limit).withColumn("kind", F.lit(PRINT)).unionByName(edges)
    uses = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("uses"))
    wanted = cut(nodes.join(uses, "node").select("node", "fp", "uses", F.col("rep.doc_id").alias("id"), F.col("rep.h").alias("rep_h")), "simhash-wanted")
    near = small(wanted)
    texts = made.join(near, (made["h"] == near["rep_h"]) & made["doc_id"].eqNullSafe(near["id"])).select("text", "node", "fp")
    sets = texts.mapInArrow(_sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = cut(sets.join(wanted.select("node", "fp", "uses"), "node"), "simhash-sets")
    roots = _exact_roots(edges, sets, limit)
    ids = _component_ids(nodes.select("node", "least", "n"), roots, "node")
    return attach(prints.select("doc_id", "node"), ids, "node", "n").select("doc_id", "component_id")


def op9_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
