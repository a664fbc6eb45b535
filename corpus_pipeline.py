"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, mixing.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all rows that the stage before kept.
All but the last return the columns they were given. Decisions on near duplicates and test items are made
and applied by a row key of the id and a hash of the text: rows without an id and rows that repeat one are
decided by their own text. Rows of the same key are copies of one another.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, mixing, pii, quality, simhash
from ridgeline.llm.common import cut, held, release, remove, shared_dir, small, table

_SCORE, _KEY = "__pipeline_score", "__pipeline_key"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble scores under 0.5. A text that is null or empty is scored as any other."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score=_SCORE).where(F.col(_SCORE) >= 0.5).drop(_SCORE)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a row key; keys are ordered by doc_id, rows without one last."""
    words = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(words).alias("h"), F.xxhash64(words, F.lit(1)).alias("h1"))
    return docs.withColumn(_KEY, key)


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose key is not in gone (column doc_id, a key), with the key. Texts move only if more keys go than a broadcast may hold."""
    gone = cut(gone.select(*[F.col(f"doc_id.{c}").alias(f"__gone_{c}") for c in ("id", "h", "h1")]).distinct(), "pipeline-gone")
    return keyed.join(small(gone), [F.col(f"{_KEY}.{c}").eqNullSafe(F.col(f"__gone_{c}")) for c in ("id", "h", "h1")], "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: that of the least doc_id, rows without an id last.

    Components are those of simhash.duplicates: op9's links, found as op9 finds them, whose texts agree to a half, and
    links of texts that agree to 0.8, which most fingerprints miss (both by five-word shingles).
    """
    keyed = _keyed(docs)
    found = cut(simhash.duplicates(keyed, _KEY), "pipeline-found")
    stay = F.col("component_id") == F.col("doc_id")
    kept = _without(keyed, found.where(~stay))
    # Rows of one key are copies of one another; few keys repeat, mostly none.
    repeated = cut(found.where(stay).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept.drop(_KEY)
    once = keyed.join(small(repeated), F.col(_KEY).eqNullSafe(repeated["doc_id"]), "left_semi")
    return _without(kept, repeated).unionByName(once.dropDuplicates([_KEY])).drop(_KEY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 80 % or more of a test item's shingles."""
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), _KEY)
    return _without(keyed, found).drop(_KEY)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars, where there is one, follows the text."""
    return pii.redacted(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, copies."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: A fitted rule ensemble and a random field are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. What a stage read goes when its rows are written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(remove, spark, base)
    for n, (_, stage) in enumerate(STAGES):
        before = held()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        docs = spark.read.parquet(f"{base}/{n}")
        release(before)
        if n:
            remove(spark, f"{base}/{n - 1}")
    return docs
