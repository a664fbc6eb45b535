"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Every row gets a uniform 60-bit hash of its id. Words are summed by (source, leading 12 bits); the
bucket in which a source's budget ends is the boundary bucket, and only its rows are summed again by
the next 20 and then the last 28 bits. That leaves one threshold per source, and the mix is a filter
``hash < threshold``: no row is sorted, and thresholds are nested (a larger budget keeps all that a
smaller one took).

Defined results: null text has size 0; a null source is a source of its own, ordered last; rows that
repeat an id share a hash and are taken or left together; an empty table gives an empty result; a
source of size 0 has target 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.common import WORD, cut, table, text_of

#: Bits of the three histogram levels; they sum to the 60 bits of the hash.
LEVELS = (12, 20, 28)
#: A threshold table of at most so many sources is broadcast.
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One narrow row per input row: id, source, its null-safe key, size in words, 60-bit hash."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("skey"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(h, F.lit(0)).alias("h"),
    )


def targets(skinny: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets by source: share of all words dealt by weight, capped at `most` times the source's size.

    What a cap frees is dealt again by weight until no source is above its cap. Ordered by cap per
    weight, a source is capped exactly if its cap fits into what is left when all before it are capped,
    so one running sum finds the fixed point.
    """
    by = skinny.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(in_order) - 1) % len(weights))
    by = by.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by = (
        by.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    left, w_left = F.col("budget") - F.col("cap_before"), F.col("w_all") - F.col("w_before")
    by = by.withColumn("capped", F.col("cap") * w_left <= F.col("w") * left)
    capped_cap = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    capped_w = F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0.0)).over(everything)
    by = by.withColumn("rest_cap", F.col("budget") - capped_cap).withColumn("rest_w", F.col("w_all") - capped_w)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.try_divide(F.col("w") * F.col("rest_cap"), F.col("rest_w")))
    full = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    return (
        by.withColumn("target", target)
        .withColumn("full", full)
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .select("skey", "source_size", "target", "full", "rest")
    )


def _boundary(hist: DataFrame, bucket: str) -> DataFrame:
    """Of a histogram (skey, bucket, words, rest): the bucket in which the running sum passes rest, and what is left of rest before it."""
    run = Window.partitionBy("skey").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("cum", F.sum("words").over(run))
    return cum.where((F.col("cum") > F.col("rest")) & (F.col("cum") - F.col("words") <= F.col("rest"))).select(
        "skey", bucket, (F.col("rest") - F.col("cum") + F.col("words")).alias("rest"), "words"
    )


def thresholds(skinny: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the hash below which the budget `rest` is taken (the nearer side of the last document)."""
    low = LEVELS[1] + LEVELS[2]
    b1 = F.shiftright("h", low).alias("b1")
    b2 = F.shiftright("h", LEVELS[2]).bitwiseAND(F.lit((1 << LEVELS[1]) - 1)).alias("b2")
    rows = skinny.select("skey", "size", "h", b1, b2)
    budgets = F.broadcast(goals.select("skey", "rest")) if goals_fit(goals) else goals.select("skey", "rest")
    first = _boundary(rows.groupBy("skey", "b1").agg(F.sum("size").alias("words")).join(budgets, "skey"), "b1")
    second = rows.join(_small(first.select("skey", "b1", "rest"), goals), ["skey", "b1"])
    second = _boundary(second.groupBy("skey", "b1", "b2", "rest").agg(F.sum("size").alias("words")), "b2")
    second = second.join(_small(first.select("skey", "b1"), goals), "skey").select("skey", "b1", "b2", "rest")
    third = rows.join(_small(second, goals), ["skey", "b1", "b2"])
    third = _boundary(third.groupBy("skey", "h", "rest").agg(F.sum("size").alias("words")), "h")
    nearer = F.col("words") - F.col("rest") < F.col("rest")
    return third.select("skey", (F.col("h") + F.when(nearer, 1).otherwise(0)).alias("below"))


def goals_fit(goals: DataFrame) -> bool:
    return goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def _small(per_source: DataFrame, goals: DataFrame) -> DataFrame:
    """Broadcasts a table with one row per source, after a check of how many sources there are."""
    return F.broadcast(per_source) if goals_fit(goals) else per_source


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    copies is how often the mix takes the document (0 to `most`), taken = copies * size.
    """
    skinny = cut(sized(docs, id_col, text_col, source_col), "mix-sized")
    goals = cut(targets(skinny, weights, share, most), "mix-goals")
    limits = goals.join(thresholds(skinny, goals), "skey", "left")
    # Where whole copies meet the target nothing is left to take, not even documents without a word.
    limits = cut(limits.withColumn("below", F.when(F.col("rest") > 0, F.col("below"))), "mix-limits")
    copies = F.col("full") + F.when(F.col("h") < F.coalesce("below", F.lit(0)), 1).otherwise(0)
    return skinny.join(_small(limits, limits), "skey").select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies")
    )


def op7_mix_sources(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighed AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS budget FROM per),
run AS (
  SELECT *, sum(w) OVER () AS w_all,
         coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM weighed),
flagged AS (SELECT *, cap * (w_all - w_before) <= w * (budget - cap_before) AS capped FROM run),
goal AS (
  SELECT skey, source_size,
         CASE WHEN capped THEN cap ELSE w * (budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
              / (w_all - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ()) END AS target FROM flagged),
budgeted AS (
  SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS full_copies FROM goal),
cumulated AS (
  SELECT s.*, b.source_size, b.target, b.full_copies, b.target - b.full_copies * b.source_size AS rest,
         sum(size) OVER (PARTITION BY s.skey ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         sum(size) OVER (PARTITION BY s.skey, h) AS tied
  FROM sized s JOIN budgeted b USING (skey)),
chosen AS (
  SELECT *, full_copies + CASE WHEN cum <= rest AND rest > 0 THEN 1
                               WHEN cum > rest AND cum - tied <= rest AND cum - rest < rest - (cum - tied) THEN 1 ELSE 0 END AS copies FROM cumulated)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies::INTEGER AS copies FROM chosen
"""
