"""Language identification as a mixture over languages, per document.

Each language has a smoothed distribution over hashed byte trigrams of lower-cased letters. A document's
trigrams are modelled as drawn from a mixture of languages; expectation-maximisation estimates the
proportions. Sets are nested: the first k languages in the order of their proportions in the full mixture.
The set with the least penalised negative log likelihood (two nats and half a log of the trigrams for each
further language) is kept; sets are tried for as long as the best likelihood seen could pay for one more
language. The prediction is the language of the largest proportion in the set, the score that proportion.

The distributions are learned from a bounded sample (SAMPLE_ROWS rows, whole texts) of rows with a language
whose crc32(id as text) modulo 5 is not 0; counts are summed on the executors. The sample is spread over the
languages: each has an equal share, by hash of the ids, and what a rare one leaves goes to the others. Every
language that such a row has is learned, from one row at least; of more than MOST_LANGUAGES values (a column
that holds something else) the most frequent ones are, so the model has SLOTS * MOST_LANGUAGES numbers at most.

Defined results: null text or one without a letter gives `und`, score 0; with nothing to learn from every
text gives `und`; ties go to the language that comes first by code point; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import crc_mod, table, text_of

SLOTS = 1 << 14
SAMPLE_ROWS = 6_000
MOST_LANGUAGES = 400
SMOOTH = 0.05
STEPS = 12
#: Trigrams that one array operation handles.
CHUNK = 1 << 20

#: Bytes that are no ASCII letter (and no part of a multi-byte character) count as one blank.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Slots of the byte trigrams of a lower-cased text, framed by blanks; runs of other characters are one blank."""
    data = _FOLD[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    blank = data == 32
    data = data[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(data) < 3:
        return np.empty(0, np.int64)
    h = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    h = h * np.uint32(0x9E3779B1)
    return (h >> np.uint32(18)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if lang not in sums:
                sums[lang] = np.zeros(SLOTS, np.int64)
            sums[lang] += np.bincount(trigrams(text), minlength=SLOTS)
    for lang, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], ["lang", "slot", "n"])


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities by slot and language). The result has a fixed size for each language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (F.coalesce(crc_mod("id", 5), F.lit(0)) != 0))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    held = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()[::-1]
    if not held:
        return [], np.zeros((SLOTS, 0))
    limits, left = [], sample_rows
    for k, r in enumerate(held):  # from the rarest on
        quota = min(r["n"], max(1, left // (len(held) - k)))
        left -= quota
        limits.append((r["lang"], max(r["least"], 1 << 30 if quota == r["n"] else int(quota / r["n"] * (1 << 30)))))
    top = docs.sparkSession.createDataFrame(limits, "lang string, top long")
    rows = rows.join(F.broadcast(top), "lang").where(place <= F.col("top")).select("lang", "text")
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts})
    place = {x: k for k, x in enumerate(langs)}
    table_ = np.zeros((SLOTS, len(langs)))
    for lang, slot, n in counts:
        table_[slot, place[lang]] = n
    return langs, (table_ + SMOOTH) / (table_.sum(0) + SMOOTH * SLOTS)


def mixture(p: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log likelihood. p: slots by languages, n: their counts."""
    k, total = p.shape[1], n.sum()
    share = np.full(k, 1 / k)
    if k == 1:
        return share, float(n @ np.log(p[:, 0]))
    for _ in range(steps):
        share = share * (p.T @ (n / (p @ share))) / total
    return share, float(n @ np.log(p @ share))


def identify(text: str, langs: list[str], probabilities: np.ndarray) -> tuple[str, float, str]:
    """(language, score, all languages of the chosen set with proportions) of one text."""
    if not langs or not has_letter(text):
        return "und", 0.0, ""
    slots = trigrams(text)
    if not len(slots):
        return "und", 0.0, ""
    counts = np.bincount(slots, minlength=SLOTS)
    seen = np.flatnonzero(counts)
    n, p = counts[seen].astype(float), probabilities[seen]
    share, most = mixture(p, n)
    order = np.argsort(-share, kind="stable")
    fee = 2 + 0.5 * np.log(len(slots))
    best, chosen, cost = np.ones(1), [int(order[0])], np.inf
    for k in range(1, len(order) + 1):
        if -most + fee * (k - 1) >= cost:  # not even the likelihood of all languages would pay for k
            break
        tried = sorted(order[:k].tolist())
        now, likelihood = mixture(p[:, tried], n)
        most = max(most, likelihood)
        if -likelihood + fee * (k - 1) < cost:
            best, chosen, cost = now, tried, -likelihood + fee * (k - 1)
    top = int(np.argmax(best))
    return langs[chosen[top]], float(min(1.0, best[top])), ",".join(f"{langs[c]}:{s:.3f}" for c, s in zip(chosen, best))


def _identifier(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, probabilities = shared.value
        for b in batches:
            found = [identify(t.as_py() or "", langs, probabilities) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.string())],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    return run


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, mixture for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers a language
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_identifier(shared), f"doc_id {kind}, lang_pred string, score double, mixture string")


def op10_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, learn(docs))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "mixture")
