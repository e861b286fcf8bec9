"""Operators on tables of chunks (image_id, seq, type, data, pos): diagnostics, additions, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunks as ch
from ..functions import registry
from ..sources.codec import ONCE

COLUMNS = ["image_id", "seq", "type", "data", "pos"]
TEXT_KINDS = ["tEXt", "zTXt", "iTXt"]


def diagnostics(chunks: DataFrame, color_types: DataFrame | None = None) -> DataFrame:
    """(image_id, seq, type, message): what is odd about chunks without making a file unreadable.

    Kinds that should occur once and don't; colour keys, backgrounds, chromaticities and
    offsets after the pixel data; units that aren't known; and, with a table color_types
    (image_id, color_type), colour keys of images that have alpha already.
    """
    twice = F.col("type").isin(*ONCE) & (F.col("_nth") > 1)
    late = F.col("type").isin("tRNS", "bKGD", "cHRM", "oFFs") & (F.col("pos") == "after_IDAT")
    unit = F.col("type").isin("pHYs", "oFFs") & (F.length("data") == 9) & (ch.read_uint(F.col("data"), 8, 1) > 1)
    tests = [(twice, "occurs more than once"), (late, "stands after the pixel data"), (unit, "has an unknown unit")]
    df = chunks.withColumn("_nth", F.row_number().over(Window.partitionBy("image_id", "type").orderBy("seq")))
    if color_types is not None:
        df = df.join(color_types.select("image_id", "color_type"), "image_id", "left")
        tests.append(((F.col("type") == "tRNS") & F.col("color_type").isin(4, 6), "isn't expected in an image with alpha"))
    told = F.filter(F.array(*(F.when(t, F.lit(m)) for t, m in tests)), lambda m: m.isNotNull())
    return df.select("image_id", "seq", "type", F.explode(told).alias("message"))


def chunk_map(chunks: DataFrame) -> DataFrame:
    """(image_id, chunks): a map of each kind to its data in order."""
    lists = chunks.groupBy("image_id", "type").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("v"))
    return lists.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("type", F.col("v.data")))).alias("chunks"))


def add_chunk(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks with those of new (image_id, type, data) after each image's others, at the place of their kind. One shuffle; neither table is computed twice."""
    fresh, own = new.select("image_id", F.lit(None).cast("int").alias("seq"), "type", "data", registry.position(F.col("type")).alias("pos"), F.lit(True).alias("_new")), Window.partitionBy("image_id")
    both = chunks.select(*COLUMNS, F.lit(False).alias("_new")).unionByName(fresh)
    number = F.row_number().over(own.orderBy(F.desc("_new"), "type", "data"))  # new ones first
    last = F.max(F.when(~F.col("_new"), F.col("seq"))).over(own)
    seq = F.when(F.col("_new"), (F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_n")).cast("int")).otherwise(F.col("seq")).alias("seq")
    return both.withColumns({"_n": number, "_last": last}).select("image_id", seq, "type", "data", "pos")


def add_text(chunks: DataFrame, texts: DataFrame, compressed: bool = False, international: bool = False) -> DataFrame:
    """chunks with a text chunk for each row of texts (image_id, keyword, text; for international ones language and translated_keyword too)."""
    key, text = F.col("keyword"), F.col("text")
    if international:
        kind, data = "iTXt", ch.itext_chunk(key, F.col("language"), F.col("translated_keyword"), text)
    else:
        kind, data = ("zTXt", ch.ztext_chunk(key, text)) if compressed else ("tEXt", ch.text_chunk(key, text))
    return add_chunk(chunks, texts.select("image_id", F.lit(kind).alias("type"), data.alias("data")))


def texts(chunks: DataFrame) -> DataFrame:
    """(image_id, rank, seq, type, keyword, text, language, translated_keyword): Latin-1 texts, then compressed, then international ones, each by seq."""
    only = lambda kind: F.when(F.col("type") == kind, F.col("data"))  # noqa: E731  Python functions get all rows, whatever stands around them
    plain, packed, wide = ch.parse_text_chunk(only("tEXt")), ch.parse_ztext_chunk(only("zTXt")), ch.parse_itext_chunk(only("iTXt"))
    by_kind = lambda *v: F.when(F.col("type") == "tEXt", v[0]).when(F.col("type") == "zTXt", v[1]).otherwise(v[2])
    none = F.lit(None).cast("string")
    return chunks.where(F.col("type").isin(*TEXT_KINDS)).select(
        "image_id", F.array_position(F.array(*map(F.lit, TEXT_KINDS)), F.col("type")).alias("rank"), "seq", "type",
        by_kind(plain["keyword"], packed["keyword"], wide["keyword"]).alias("keyword"), by_kind(plain["text"], packed["text"], ch.itext_text(wide)).alias("text"),
        by_kind(none, none, wide["language"]).alias("language"), by_kind(none, none, wide["translated_keyword"]).alias("translated_keyword"),
    )


def parsed(chunks: DataFrame, kind: str, name: str = "value") -> DataFrame:
    """(image_id, seq, value) of all chunks of a registered kind."""
    return chunks.where(F.col("type") == kind).select("image_id", "seq", registry.parsed(kind, F.col("data")).alias(name))


def raw(chunks: DataFrame) -> Column:
    """The bytes of each chunk as they stand in a file."""
    return ch.raw_chunk(F.col("type"), F.col("data"))
