"""Image files that arrive in a folder, as a stream of headers or rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import images

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """(image_id, path, content) of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "content")


def arriving_headers(spark: SparkSession, path: str) -> DataFrame:
    return images.headers(arriving(spark, path))
