"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

1. Statistics of a text are Spark column expressions over its whole length (statistics()).
2. On a bounded sample of labelled rows (SAMPLE_ROWS, rows by hash of their id, documented bound) small
   trees are grown on bootstrap samples; each path from a root to a node becomes a conjunctive rule.
3. A logistic model over rules and clipped linear terms is fitted with a lasso penalty, which leaves few. Of the
   paths, the 3 * RULES that tell the labels apart best by themselves enter; if more than RULES stay, the
   strongest RULES are fitted once more without the others, so that the compiled model is a fitted one.
4. The rules that stay become one column expression; scoring runs in the JVM without a model object.

Ids, sources, languages and labels are never inputs of a score.

Defined results: null text is scored as the empty text; labels that are null or belong to no document are
passed over; a document with several labels counts each; without any usable label every score is 0.5;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACE, crc_mod, table, text_of

SAMPLE_ROWS = 12_000
TREES = 40
DEPTH = 3
LEAF = 12
BINS = 24
RULES = 120
SEED = 7

#: Names of columns in between; no table is expected to have them.
_TEXT, _LENGTH, _WORDS, _STATS = "__quality_text", "__quality_length", "__quality_words", "__quality_stats"


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _count(pattern: str) -> Column:
    return F.regexp_count(F.col(_TEXT), F.lit(pattern))


def _count_of(character: str) -> Column:
    """How many times a text has an ASCII character: the bytes it loses without it."""
    return F.octet_length(_TEXT) - F.octet_length(F.replace(F.col(_TEXT), F.lit(character), F.lit("")))


def _count_same(words: Column) -> Column:
    """How many words equal the word after them."""
    after = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    return F.size(F.filter(F.zip_with(words, after, lambda a, b: a == b), lambda same: same))


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the array of the values of statistics(), in their order.

    The array comes out of a generator (of one row), which no filter or projection is moved through: so each
    statistic is computed once a row, whatever is done with the score.
    """
    df = df.withColumn(_TEXT, text_of(text_col))
    df = df.withColumn(_LENGTH, F.char_length(_TEXT)).withColumn(_WORDS, F.split(F.trim(F.regexp_replace(_TEXT, rf"[{SPACE}]+", " ")), " "))
    values = F.array(*[F.coalesce(expr.cast("double"), F.lit(0.0)) for _, expr in statistics()])
    return df.withColumn(_STATS, F.explode(F.array(values))).drop(_TEXT, _LENGTH, _WORDS)


def statistics() -> tuple[tuple[str, Column], ...]:
    """(name, expression over the columns that with_statistics adds)."""
    n, w = F.col(_LENGTH), F.col(_WORDS)
    words = F.size(w)
    return (
        ("log of length", F.log1p(n)),
        ("words", F.log1p(words)),
        ("characters a word", _share(n, words)),
        ("share of upper case", _share(_count(r"\p{Lu}"), n)),
        ("share of digits", _share(_count(r"[0-9]"), n)),
        ("share of symbols", _share(_count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"), n)),
        ("share of ends of sentences", _share(_count(r"[.!?]"), words)),
        ("share of commas", _share(_count_of(","), words)),
        ("bars a word", _share(_count_of("|"), words)),
        ("shouts a word", _share(_count_of("!"), words)),
        ("lines a word", _share(_count_of("\n"), words)),
        ("share of distinct words", _share(F.size(F.array_distinct(w)), words)),
        ("repeats of the word before", _share(_count_same(w), words)),
    )


@dataclass
class Model:
    """score = logistic(bias + sum of weight * rule + sum of slope * clipped statistic)."""

    bias: float = 0.0
    #: (weight, ((statistic, above, threshold), ...)); a condition holds if (value > threshold) == above
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]] = field(default_factory=list)
    #: (slope, statistic, low, high, mean)
    linear: list[tuple[float, int, float, float, float]] = field(default_factory=list)

    def column(self, stats: str = "") -> Column:
        """The compiled score over the array of statistics.

        The rules are rows of one constant array that a higher-order function walks, so the generated code
        stays small however many rules there are.
        """
        x = F.col(stats or _STATS)
        total = F.lit(self.bias)
        for slope, i, low, high, mean in self.linear:
            total = total + F.lit(slope) * (F.least(F.greatest(x[i], F.lit(low)), F.lit(high)) - F.lit(mean))
        if self.rules:
            condition = lambda i, above, t: f"named_struct('i', {i}, 'above', {str(above).lower()}, 't', {t!r}D)"
            rows = (f"named_struct('w', {w!r}D, 'c', array({', '.join(condition(*c) for c in conditions)}))" for w, conditions in self.rules)
            holds = lambda r: F.forall(r["c"], lambda c: (F.get(x, c["i"]) > c["t"]) == c["above"])
            total = total + F.aggregate(F.expr(f"array({', '.join(rows)})"), F.lit(0.0), lambda acc, r: acc + F.when(holds(r), r["w"]).otherwise(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for w, conditions in self.rules:
            total += w * np.all([(x[:, i] > t) == a for i, a, t in conditions], axis=0)
        for slope, i, low, high, mean in self.linear:
            total += slope * (np.clip(x[:, i], low, high) - mean)
        return 1 / (1 + np.exp(-total))


def _grow(x, bins, edges, y, rows, depth, features, rng, path, out):
    """Splits rows by the best variance reduction over binned statistics; appends every node's path to out."""
    if depth == 0 or len(rows) < 2 * LEAF:
        return
    target = y[rows]
    best = (1e-9, None)
    for i in rng.permutation(x.shape[1])[:features]:
        b = bins[rows, i]
        n = np.bincount(b, minlength=BINS + 1)
        s = np.bincount(b, weights=target, minlength=BINS + 1)
        left_n, left_s = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
        right_n, right_s = len(rows) - left_n, target.sum() - left_s
        ok = (left_n >= LEAF) & (right_n >= LEAF)
        gain = np.where(ok, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1), 0) - target.sum() ** 2 / len(rows)
        gain = np.where(ok, gain, 0)
        k = int(np.argmax(gain))
        if gain[k] > best[0] and k < len(edges[i]):
            best = (gain[k], (int(i), k))
    if best[1] is None:
        return
    i, k = best[1]
    for above in (False, True):
        own = path + ((i, above, float(edges[i][k])),)
        out.append(own)
        _grow(x, bins, edges, y, rows[(bins[rows, i] > k) == above], depth - 1, features, rng, own, out)


def _lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the bias is free."""
    n, d = z.shape
    step = 1.0 / max(1e-9, 0.25 * np.linalg.norm(z * np.sqrt(weight / weight.sum())[:, None], 2) ** 2 + 0.25)
    w, bias, v, vb, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    share = weight / weight.sum()
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(z @ v + vb, -40, 40))) - y) * share
        new = v - step * (z.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = vb - step * r.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, seed: int = SEED) -> Model:
    """x: rows by statistics, y: 0 or 1. Rows are put in order of their values first, so the model does not depend on their order."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 0.01, 0.99))
        return Model(float(np.log(p / (1 - p))))
    order = np.lexsort(np.column_stack((x, y)).T)
    x, y = x[order], y[order].astype(float)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    # Both labels weigh the same, so that 0.5 parts them whatever their shares are.
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    paths: list[tuple] = []
    p = weight / weight.sum()
    for _ in range(TREES):
        rows = rng.choice(len(y), size=min(len(y), 4000), p=p)
        _grow(x, bins, edges, y - 0.5, rows, DEPTH, max(3, x.shape[1] // 2), rng, (), paths)
    paths = list(dict.fromkeys(tuple(sorted(set(q))) for q in paths))
    hold = np.column_stack([np.all([(x[:, i] > t) == a for i, a, t in q], axis=0) for q in paths]).astype(float) if paths else np.zeros((len(y), 0))
    _, first = np.unique(hold, axis=1, return_index=True) if paths else (None, np.empty(0, int))
    gap = np.abs(((hold - (hold * weight[:, None]).sum(0) / weight.sum()) * ((y - 0.5) * weight)[:, None]).sum(0)) / np.maximum(hold.std(0), 0.05)
    keep = sorted(first.tolist(), key=lambda k: (-gap[k], k))[: 3 * RULES]
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    mean, spread = clipped.mean(0), np.maximum(clipped.std(0), 1e-9)
    z = np.hstack((hold[:, keep], 0.4 * (clipped - mean) / spread))
    w, bias = _lasso(z, y, weight, penalty)
    if np.count_nonzero(np.abs(w[: len(keep)]) > 1e-4) > RULES:  # the strongest stay, and are fitted again without the others
        strong = np.sort(np.argsort(-np.abs(w[: len(keep)]), kind="stable")[:RULES])
        keep = [keep[k] for k in strong]
        z = np.hstack((z[:, strong], z[:, len(w) - x.shape[1] :]))
        w, bias = _lasso(z, y, weight, penalty)
    chosen = [(float(w[k]), paths[q]) for k, q in enumerate(keep) if abs(w[k]) > 1e-4]
    slopes = w[len(keep) :]
    linear = [(float(0.4 * s / spread[i]), i, float(low[i]), float(high[i]), float(mean[i])) for i, s in enumerate(slopes) if abs(s) > 1e-4 and high[i] > low[i]]
    return Model(float(bias), chosen, linear)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most about sample_rows labelled rows whose crc32(id as text) modulo 3 is not 1."""
    wanted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    wanted = wanted.where(crc_mod("id", 3) != 1)
    n = wanted.count()
    if n > sample_rows:  # a uniform share of the ids by hash, the same rows on every run
        wanted = wanted.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample_rows / n)))
    # The sample is at most about sample_rows rows of two numbers, so it is broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id")
    found = with_statistics(rows).select("y", _STATS).collect()
    if not found:
        return Model()
    return fit_rules(np.array([r[1] for r in found], float), np.array([r[0] for r in found], float))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with a score column (0 to 1; higher: quality 1 likelier)."""
    return with_statistics(docs, text_col).withColumn(score, model.column()).drop(_STATS)


def op4_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
