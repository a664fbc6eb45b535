"""I-Match document fingerprints over randomised lexicons (DataFrame operations only).

Terms are lower-cased runs of letters and digits. A term belongs to the lexicon if its document
frequency lies in a band: too frequent terms say nothing, terms below the band change with every typo.
Document frequencies are counted over all documents in hash slots, so the table that reaches every task is one
bitmap however large the corpus is. A slot also counts the rare terms that fall into it by chance, about
(terms per document) / slots of all documents; so the number of slots follows the mean length of the texts and
keeps that below the band (slot_bits). MOST_SLOT_BITS bounds the bitmap (2 MB), which is enough up to a mean of
33,000 characters a text; for longer ones rare terms enter the lexicon, and fingerprints change with more edits.

A randomised lexicon keeps each term of the band by its hash, at one of four rates (1/32 to 1/2048), twelve
lexicons a rate. For each one the distinct kept terms are sorted and hashed. The fingerprint is the 48
hashes, six hex digits each (dashes: the document has no term there). Coarse rates suit short documents,
fine rates long ones. Likeness of two fingerprints is the best over the rates of (lexicons that agree) /
(lexicons in which either document has a term), over rates with at least four such lexicons, or over all.

Defined results: null text is empty; a text without a term of the band gets a hash of the whole text in
place of lexicon hashes, so that equal texts have equal fingerprints and others differ; likeness of equal
fingerprints is 1. Rows that repeat a doc_id are ordered by their text. A single document's next document
is itself. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.common import cut, table, text_of

LEAST_SLOT_BITS, MOST_SLOT_BITS = 20, 24
RATES = (32, 128, 512, 2048)
PER_RATE = 12
#: A term is in the lexicon if the share of documents in its slot lies in this band.
BAND = (0.0004, 0.02)
#: About so many documents share a range of ids in which the next document is found.
RANGE_ROWS = 1 << 15
LEAST_LEXICONS = 4
#: A text has a distinct term in about so many characters, or fewer.
CHARS_A_TERM = 10


def term_hashes(text: Column) -> Column:
    """Distinct hashes of a text's terms."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def _slot(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1))


def slot_bits(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> int:
    """Bits of a slot's number: chance puts a text with a term every CHARS_A_TERM characters into half the band's floor of all slots."""
    mean = docs.agg(F.coalesce(F.avg(F.char_length(text_of(text_col))), F.lit(0.0))).first()[0]
    wanted = 2 * mean / CHARS_A_TERM / band[0]
    return min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, math.ceil(math.log2(max(1.0, wanted)))))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> tuple[Column, int]:
    """The bitmap of in-band slots, as a scalar subquery of longs, and the bits of a slot's number.

    Below the band are also terms of fewer than two documents, which cannot link any.
    """
    bits = slot_bits(docs, text_col, band)
    slots = docs.select(F.explode(F.array_distinct(F.transform(term_hashes(text_of(text_col)), lambda h: _slot(h, bits)))).alias("slot"))
    df = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = df.where((F.col("df") >= 2) & (F.col("df") >= F.lit(band[0]) * n.scalar()) & (F.col("df") <= F.greatest(F.lit(band[1]) * n.scalar(), F.lit(2))))
    words = df.groupBy(F.shiftright("slot", 6).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    every = docs.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("w"))
    packed = every.join(cut(words, "imatch-lexicon"), "w", "left").select(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    packed = packed.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("bits"))  # 2**(bits - 6) longs
    return cut(packed, "imatch-bitmap").scalar(), bits


def in_band(text: Column, bitmap: Column, bits: int) -> Column:
    """The sorted hashes of a text's terms that are in the lexicon."""
    held = lambda h: F.call_function("getbit", F.get(bitmap, F.shiftright(_slot(h, bits), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.array_sort(F.filter(term_hashes(text), held))


def fingerprint(text: Column, bitmap: Column, bits: int) -> Column:
    """The 48 lexicon hashes of a text as one string of hex digits."""
    whole = F.concat(F.lit("="), F.hex(F.xxhash64(text)))
    return _let(in_band(text, bitmap, bits), lambda kept: F.when(F.size(kept) == 0, whole).otherwise(_from_rate(kept, 0)))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _from_rate(terms: Column, n: int) -> Column:
    """Hashes of the lexicons at rate n and finer. The lexicons at a finer rate are inside those before, so each filter reads what the last one kept."""
    if n == len(RATES):
        return F.lit("")
    cell = lambda h: F.shiftrightunsigned(h, MOST_SLOT_BITS).bitwiseAND(F.lit(RATES[n] - 1))
    digits = lambda own: F.when(F.size(own) == 0, F.lit("------")).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(own).bitwiseAND(F.lit(0xFFFFFF)))), 6, "0"))
    each = lambda some: F.concat(*[_let(F.filter(some, lambda h: cell(h) == F.lit(j)), digits) for j in range(PER_RATE)])  # noqa: E731, B023
    return _let(F.filter(terms, lambda h: cell(h) < PER_RATE), lambda some: F.concat(each(some), _from_rate(some, n + 1)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints."""
    every = F.sequence(F.lit(0), F.lit(len(RATES) * PER_RATE - 1))
    parts = lambda x: F.transform(every, lambda i: x.substr(i * 6 + 1, F.lit(6)))
    # Of each lexicon: 0 neither has a term, 1 they differ, 2 they agree.
    state = F.zip_with(parts(a), parts(b), lambda u, v: F.when(u != v, 1).when(u == "------", 0).otherwise(2))
    whole = a.startswith("=") | b.startswith("=")
    return F.when(a == b, 1.0).when(whole, 0.0).otherwise(_let(state, _best)).cast("double")


def _best(state: Column) -> Column:
    used = lambda x: F.size(F.filter(x, lambda c: c > 0))
    same = lambda x: F.size(F.filter(x, lambda c: c == 2))
    rates = F.transform(F.sequence(F.lit(0), F.lit(len(RATES) - 1)), lambda n: F.slice(state, n * PER_RATE + 1, F.lit(PER_RATE)))
    shares = F.transform(F.filter(rates, lambda x: used(x) >= LEAST_LEXICONS), lambda x: same(x) / used(x))
    return F.coalesce(F.array_max(shares), F.try_divide(same(state), used(state)), F.lit(0.0))


def next_ids(keys: DataFrame) -> DataFrame:
    """keys: doc_id, key, k, a row a key. Returns key, k, next_key: the next document in descending doc_id (after the last: the first).

    Keys are dealt by ranges of (doc_id, key), whatever the ids are, and written with the number of their range.
    Inside ranges the next one comes from a window; the last of a range gets the first of the next range, from a
    window over one row a range.
    """
    down = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    ranges = max(1, -(-keys.count() // RANGE_ROWS))
    dealt = cut(keys.repartitionByRange(ranges, *down).withColumn("range", F.spark_partition_id()), "imatch-ranges")
    inside = dealt.withColumn("next_key", F.lead("key").over(Window.partitionBy("range").orderBy(*down)))
    tops = dealt.groupBy("range").agg(F.max_by("key", F.struct(F.col("doc_id").isNotNull(), "doc_id", "key")).alias("top"))
    order = Window.orderBy("range")
    first = F.first("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.withColumn("below", F.coalesce(F.lead("top").over(order), first)).select("range", "below")
    return inside.join(F.broadcast(tops), "range").select("key", "k", F.coalesce("next_key", "below").alias("next_key"))


def edited_pairs(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, key, next_key, text, edited: the last third of the text replaced by the next document's start; whether rows repeat.

    Texts are dealt by key once; both joins read that one exchange.
    """
    text = text_of("text")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.xxhash64(text).cast("string"))
    texts = docs.select(key.alias("key"), text.alias("text"))
    keys = cut(docs.select("doc_id", key.alias("key"), F.floor(F.char_length(text) / 3).cast("int").alias("k")), "imatch-keys")
    alone = cut(keys.dropDuplicates(["key"]), "imatch-alone")
    repeated = alone.count() < keys.count()
    links = cut(next_ids(alone), "imatch-next")
    once = texts.dropDuplicates(["key"]) if repeated else texts
    starts = links.join(once.select(F.col("key").alias("next_key"), F.col("text").alias("t")), "next_key")
    starts = starts.select("key", "next_key", "k", F.col("t").substr(F.lit(1), F.col("k")).alias("start"))
    kept = F.col("text").substr(F.lit(1), F.char_length("text") - F.col("k"))
    doc_id = F.substring_index("key", ":", 1).try_cast("long")
    return texts.join(starts, "key").select(doc_id.alias("doc_id"), "key", "next_key", "text", F.concat(kept, "start").alias("edited")), repeated


def op8_imatch(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmap, bits = lexicon(docs)
    pairs, repeated = edited_pairs(docs)
    prints = pairs.withColumn("bits", bitmap).select(
        "doc_id", "key", "next_key", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("bits"), bits).alias("fingerprint"), fingerprint(F.col("edited"), F.col("bits"), bits).alias("edited_fingerprint"),
    )
    prints = cut(prints, "imatch-prints")
    after = prints.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    after = after.dropDuplicates(["next_key"]) if repeated else after
    return prints.join(after, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
