"""Images derived from the tables: embeddings as pixels, frames and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, p, q): each value as a sample of 0 to 255."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "v"))
    return e.select("vec_id", "label", F.col("p").cast("bigint").alias("p"), F.floor((F.col("v").cast("double") + 1) * 127.5).cast("double").alias("q"))


def wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gray image, a row for each vector."""
    return samples(spark, sf_dir).select(F.lit(0).cast("bigint").alias("image_id"), F.col("vec_id").alias("y"), F.col("p").alias("x"), F.col("q").alias("c0"))


def wall_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the wall as arrays."""
    q = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), q.alias("vals"))


def sized_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wall with its size, which the table of vectors tells without their values."""
    size = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("h")).select(F.lit(0).cast("bigint").alias("image_id"), "h", F.lit(64).cast("bigint").alias("w"))
    return wall(spark, sf_dir).join(F.broadcast(size), "image_id")  # one row


def sized_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).withColumns({"h": F.lit(8).cast("bigint"), "w": F.lit(8).cast("bigint")})


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gray image of 8 x 8 for each vector."""
    return samples(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.expr("p div 8").alias("y"), (F.col("p") % 8).alias("x"), F.col("q").alias("c0"))


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 4 x 4 pixels of four channels for each vector, cut from the array without a shuffle."""
    q = lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), (F.size("embedding") / 4).cast("int") - 1)).alias("i"))
    return e.select(F.col("vec_id").alias("image_id"), F.expr("cast(i div 4 as bigint)").alias("y"), (F.col("i") % 4).cast("bigint").alias("x"), *(q(F.get("embedding", F.col("i") * 4 + k)).alias(f"c{k}") for k in range(4)))


def tile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tiles as arrays."""
    q = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("double"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), q.alias("v"))
    return e.select("image_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("v") / 8).cast("int") - 1), lambda i: F.slice("v", i * 8 + 1, 8))).alias("y", "vals")).withColumn("y", F.col("y").cast("bigint"))


def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, frame, y, x, c0): an animation for each label, a frame for each of its vectors by number."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    order = e.select("vec_id", F.col("label").cast("bigint").alias("anim"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("bigint").alias("frame"))
    return tiles(spark, sf_dir).join(order, F.col("image_id") == F.col("vec_id")).select(F.col("anim").alias("image_id"), "frame", "y", "x", "c0")


def clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames and pixels (two channels) of an animation for each label: frames after the first are parts of the canvas of 8 x 8, and all ways of disposal and blending occur."""
    p = frame_pixels(spark, sf_dir)
    f, first = F.col("frame"), F.col("frame") == 0
    size = {"w": F.when(first, 8).otherwise(1 + f % 8), "h": F.when(first, 8).otherwise(1 + (f * 3) % 8)}
    place = {"x_off": F.when(first, 0).otherwise(f * 5 % (9 - F.col("w"))), "y_off": F.when(first, 0).otherwise(f * 7 % (9 - F.col("h")))}
    rest = {"delay_num": f % 7, "delay_den": f % 3 * 10, "dispose": F.get(F.array(F.lit("none"), F.lit("background"), F.lit("previous")), (f % 3).cast("int")), "blend": F.when(f % 2 == 0, "source").otherwise("over")}
    frames = p.select("image_id", "frame").distinct().withColumns(size).withColumns(place).withColumns(rest)
    frames = frames.select("image_id", "frame", *(F.col(c).cast("bigint").alias(c) for c in ("w", "h", "x_off", "y_off", "delay_num", "delay_den")), "dispose", "blend")
    alpha = F.when((F.col("x") + f) % 3 == 0, 0.0).when((F.col("x") + f) % 3 == 1, 255.0).otherwise(128.0)
    inside = p.join(frames.select("image_id", "frame", "w", "h"), ["image_id", "frame"]).where("x < w and y < h")
    return frames, inside.select("image_id", "frame", "y", "x", "c0", alpha.alias("c1"))
