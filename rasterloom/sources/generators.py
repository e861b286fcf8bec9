"""Images that no file holds: constants, ramps, masks, kernels and palettes."""

from __future__ import annotations

import colorsys
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant(spark: SparkSession, w: int, h: int, color: list[float], image_id: int = 0) -> DataFrame:
    """w x h pixels of one to four channels."""
    if not (isinstance(w, int) and isinstance(h, int)) or w < 1 or h < 1 or not 1 <= len(color) <= 4:
        raise ValueError("whole sizes of at least 1 and one to four channels")
    at = spark.range(w * h).select(F.floor(F.col("id") / w).alias("y"), (F.col("id") % w).alias("x"))
    return at.select(F.lit(image_id).cast("bigint").alias("image_id"), "y", "x", *(F.lit(float(v)).alias(f"c{k}") for k, v in enumerate(color)))


def sequential(spark: SparkSession, start: float, stop: float, step: float = 1, n: int = 1) -> DataFrame:
    """One row from start to stop, both included."""
    count = math.floor((stop - start) / step) + 1
    v = F.lit(float(start)) + F.col("id") * F.lit(float(step))
    return spark.range(max(0, count)).select(F.lit(0).cast("bigint").alias("image_id"), F.lit(0).cast("bigint").alias("y"), F.col("id").alias("x"), *(v.alias(f"c{k}") for k in range(n)))


def disk(spark: SparkSession, radius: float) -> DataFrame:
    """1 within the radius, else 0."""
    r = math.ceil(radius)
    return constant(spark, 2 * r + 1, 2 * r + 1, [0]).withColumn("c0", (F.sqrt((F.col("x") - r) ** 2 + (F.col("y") - r) ** 2) <= radius).cast("double"))


def kernel_row(spark: SparkSession, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(values)], "image_id long, y long, x long, c0 double")


def gray_palette(spark: SparkSession) -> DataFrame:
    return spark.range(256).select(F.lit(0).cast("bigint").alias("image_id"), F.col("id").alias("idx"), *(F.col("id").cast("double").alias(f"c{k}") for k in range(3)))


def hue_palette(spark: SparkSession) -> DataFrame:
    """256 hues of full saturation and value."""
    rows = [(0, i, *(float(round(255 * v)) for v in colorsys.hsv_to_rgb(i / 256, 1, 1))) for i in range(256)]
    return spark.createDataFrame(rows, "image_id long, idx long, c0 double, c1 double, c2 double")


def constant_like(img: DataFrame, color: list[float]) -> DataFrame:
    """An image of one colour for each image of img, as large."""
    if not 1 <= len(color) <= 4:
        raise ValueError("one to four channels")
    return img.select("image_id", "y", "x", *(F.lit(float(v)).alias(f"c{k}") for k, v in enumerate(color)))


def ramps(ids: DataFrame, start: str, stop: float, step: float = 1) -> DataFrame:
    """An image of one row for each row of ids (image_id, start): from start to stop, both included; none where start lies beyond stop."""
    last = F.floor((F.lit(float(stop)) - F.col(start)) / F.lit(float(step))).cast("bigint")
    rows = ids.where(last >= 0).select("image_id", F.col(start).cast("double").alias("_s"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("x"))
    return rows.select("image_id", F.lit(0).cast("bigint").alias("y"), "x", (F.col("_s") + F.col("x") * F.lit(float(step))).alias("c0"))


def disk_element(radius: float) -> list[list[float]]:
    """A disk as the cells of a kernel: 1 within the radius, else 0."""
    r = math.ceil(radius)
    return [[float(math.hypot(x, y) <= radius) for x in range(-r, r + 1)] for y in range(-r, r + 1)]
