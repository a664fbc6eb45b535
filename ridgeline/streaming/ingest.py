"""Directory ingest: transactions of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.functions.codes import EXTENSIONS
from ridgeline.sources import itl

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str, glob: str = EXTENSIONS, files_per_trigger: int = 1000) -> DataFrame:
    """Nested transactions of the files that appear under a path, a bounded number a micro-batch."""
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return itl.decode(found.load(path).select("path", "content"))
