"""Secret scan with an incremental blob ledger (DataFrame operations only).

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one row per
(blob, rule, rule version) that was ever scanned. A run scans only pairs that the ledger lacks: each
unseen blob is read once, from one representative version, however many paths or versions share it,
and findings are joined back to every version with that content.

The ledger is a Parquet table that runs append to (Ledger): rows of one run become visible together, when its
write commits, and a run that dies leaves the ledger as it was. Two runs at once may scan a blob twice; their
rows are equal, and reading drops the second.

Match offsets come from splitting the text by a rule's pattern: a match starts after all earlier pieces
and matches, so a running sum of their lengths gives code-point offsets without leaving the JVM.

Defined results: null text is the empty blob; repeated rows and copies share one blob and get the same
findings; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.common import cut, scratch, table, text_of


@dataclass(frozen=True)
class Rule:
    """pattern finds leftmost non-overlapping matches; one is kept if its group has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = True


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")

RULES = (
    Rule("assign", 1, rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, base=False),
)

LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def address(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    return versions.select(F.col(path_col).alias("path"), F.sha2(text_of(text_col).cast("binary"), 256).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """Blobs with at least one rule version that the ledger lacks: blob, rep (the path to read), todo (kinds)."""
    blobs = paths.groupBy("blob").agg(F.min("path").alias("rep"))
    if ledger is None:
        return blobs.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    pairs = blobs.withColumn("r", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])))
    pairs = pairs.select("blob", "rep", "r.kind", "r.version").join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    return pairs.groupBy("blob", "rep").agg(F.collect_set("kind").alias("todo"))


def find(texts: DataFrame, rules=RULES) -> DataFrame:
    """texts: blob, content, todo. One row per kept match: blob, kind, rank, version, start, end."""
    found = []
    for rank, r in enumerate(rules):
        wanted = F.array_contains("todo", r.kind) & F.col("content").rlike(r.pattern)
        pattern = F.lit(r.pattern)
        found.append(
            F.when(
                wanted,
                F.struct(
                    F.lit(r.kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                    F.transform(F.split("content", r.pattern, -1), lambda x: F.char_length(x)).alias("gaps"),
                    F.transform(F.regexp_extract_all("content", pattern, F.lit(0)), lambda x: F.char_length(x)).alias("lens"),
                    F.transform(F.regexp_extract_all("content", pattern, F.lit(r.group)), lambda x: F.char_length(x)).alias("sizes"),
                ),
            )
        )
    hits = texts.select("blob", F.explode(F.array_compact(F.array(*found))).alias("m"))
    hits = hits.select("blob", "m.*")
    each = hits.select("blob", "kind", "rank", "version", "least", F.posexplode(F.arrays_zip("gaps", "lens", "sizes")).alias("i", "x"))
    run = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.where(F.col("x.lens").isNotNull()).dropDuplicates(["blob", "kind", "i"])
    each = each.withColumn("end", F.sum(F.col("x.gaps") + F.col("x.lens")).over(run).cast("int"))
    return each.where(F.col("x.sizes") >= F.col("least")).select("blob", "kind", "rank", "version", (F.col("end") - F.col("x.lens")).alias("start"), "end")


class Ledger:
    """The ledger as a table in a folder."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        """All rows, or nothing before the first run."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)

    def update(self, versions: DataFrame, path_col: str = "path", text_col: str = "text", rules=RULES) -> int:
        """Scans the pairs that the ledger lacks and appends them. Returns how many pairs those were."""
        source = versions.select(F.col(path_col).alias("path"), text_of(text_col).alias("content"))
        todo = cut(unseen(address(versions, path_col, text_col), self.read(), rules), "blob-todo")
        n = todo.agg(F.coalesce(F.sum(F.size("todo")), F.lit(0))).first()[0]
        if n:
            texts = source.join(todo, source["path"].eqNullSafe(todo["rep"])).where(F.sha2(F.col("content").cast("binary"), 256) == F.col("blob"))
            found = find(texts.select("blob", "content", "todo"), rules)
            spans = found.groupBy("blob", "kind").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
            scanned = todo.select("blob", F.explode("todo").alias("kind")).withColumn("version", F.element_at(_versions(rules), F.col("kind")))
            rows = scanned.join(spans, ["blob", "kind"], "left").select("blob", "kind", "version", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
            rows.write.mode("append").parquet(self.path)
        return n

    def findings(self, versions: DataFrame, path_col: str = "path", text_col: str = "text", rules=RULES) -> DataFrame:
        """path, blob, hits array<struct<start,rank,end,kind>> ordered by start, then rule, of every version: what the ledger says of its content."""
        paths = address(versions, path_col, text_col)
        known = self.read()
        if known is None:  # nothing was ever scanned
            return paths.select("path", "blob", F.lit(None).cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("hits"))
        ranks = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)])
        known = known.where(F.size("spans") > 0).where(F.try_element_at(_versions(rules), F.col("kind")) == F.col("version")).dropDuplicates(["blob", "kind"])
        hits = known.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(ranks, F.col("kind")).alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("h"))
        by_blob = hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("h"))).alias("hits"))
        return paths.join(by_blob, "blob", "left").select("path", "blob", "hits")


def _versions(rules) -> Column:
    return F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])


#: Session setting with the folder of a ledger that is kept from run to run.
LEDGER_SETTING = "spark.ridgeline.secrets.ledger"


def op5_secret_ledger(spark, sf_dir) -> DataFrame:
    """Findings of all documents by a ledger: the kept one, if the session names it, else one that begins with this run."""
    docs = table(spark, sf_dir, "documents")
    ledger = Ledger(spark, spark.conf.get(LEDGER_SETTING, None) or scratch(spark, "secret-ledger"))
    ledger.update(docs, "doc_id")
    found = ledger.findings(docs, "doc_id")
    base = [r.kind for r in RULES if r.base]
    hits = F.coalesce("hits", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(F.col("h"), lambda x: x["kind"] == F.lit(k))).cast("long")
    of_base = F.filter(F.col("h"), lambda x: x["rank"] < len(base))
    return found.withColumn("h", hits).select(
        F.col("path").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("h")).alias("spans"),
        "blob",
    )


def _matches_sql() -> str:
    """The patterns as RE2 and DuckDB read them, written out once more; (kind, rank, pattern, group, least)."""
    keys = "(?i:password|passwd|secret|token|api_?key)"
    rules = [
        ("assign", 0, rf"({keys})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", 1, "AKIA[A-Z0-9]+", 0, 20), ("hex", 2, "[0-9a-f]+", 0, 24),
        ("pem", 3, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1), ("jwt", 4, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ]
    each = "SELECT doc_id, '{0}' AS kind, {1} AS rank, {4} AS least, string_split_regex(t, '{2}') AS gaps, regexp_extract_all(t, '{2}') AS found, regexp_extract_all(t, '{2}', {3}) AS part FROM d"
    return " UNION ALL ".join(each.format(*r) for r in rules)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_matches_sql()}),
i AS (SELECT doc_id, kind, rank, least, len(unnest(gaps[1:len(found)])) AS gap, len(unnest(found)) AS size, len(unnest(part)) AS own, unnest(range(len(found))) AS i FROM m),
s AS (SELECT doc_id, kind, rank, least, own, size, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS stop FROM i),
k AS (SELECT doc_id, kind, rank, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM s WHERE own >= least),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN per USING (doc_id)
"""
