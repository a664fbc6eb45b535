"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that ends a word, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master, whose executors share the driver's disk, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/ridgeline-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of cut() that still exist.
_cuts: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again, which ends its lineage there.

    The files outlive lost executors; they are removed by release(), or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder, which goes as those of cut() do."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _cuts.append((spark, path))
    return path


def release(since: int = 0) -> None:
    """Removes the folders that cut() made after the first `since` ones; nothing may read them any more."""
    while len(_cuts) > since:
        remove(*_cuts.pop())


def held() -> int:
    return len(_cuts)


atexit.register(release)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already; the folder is temporary
        return


#: A written table of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000
#: A key that more than one row in so many has is heavy; so there are at most as many heavy keys.
HEAVY_ONE_IN = 1024


def small(table_: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table (its count reads file footers only), marked for broadcast if it has few rows; else it is joined by shuffle."""
    return F.broadcast(table_) if table_.count() <= rows else table_


def attach(rows: DataFrame, by_key: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to by_key (written; one row a key, with the number n of rows that have it), where any key may be hot.

    Values of heavy keys, of which there are HEAVY_ONE_IN at most, are broadcast; the others meet by shuffle.
    """
    total = by_key.agg(F.sum(n)).first()[0] or 0
    values = [c for c in by_key.columns if c not in (key, n)]
    heavy = F.col(n) * F.lit(HEAVY_ONE_IN) > F.lit(total)
    told = rows.join(F.broadcast(by_key.where(heavy).select(key, F.struct(*values).alias("__told"))), key, "left")
    hot = told.where("__told is not null").select(*rows.columns, *[F.col(f"__told.{v}").alias(v) for v in values])
    cold = told.where("__told is null").drop("__told").join(by_key.where(~heavy).drop(n), key).select(*rows.columns, *values)
    return hot.unionByName(cold)


def text_of(name: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(n)
