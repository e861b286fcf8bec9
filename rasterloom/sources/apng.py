"""Animated PNG files as tables of frames and pixels, and back, put together and taken apart by column expressions.

Frames: (image_id, frame, w, h, x_off, y_off, delay_num, delay_den, dispose, blend), frame
counted from 0, and rows (image_id, frame, y, vals) of a frame's own pixels. Only zlib
streams and the undoing of row filters run in Python, frame by frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunks as ch
from ..functions import registry
from . import images
from .codec import MAGIC

FRAME = ["w", "h", "x_off", "y_off", "delay_num", "delay_den", "dispose", "blend"]
_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}


def _joined(parts: Column) -> Column:
    """Binary parts of an array after one another."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


def _raw(kind: str, data: Column) -> Column:
    return ch.raw_chunk(F.lit(kind), data)


def _size(w: Column, h: Column, rest: Column) -> Column:
    return _raw("IHDR", F.concat(ch.uint(w, 4), ch.uint(h, 4), rest))


def _more(chunks: DataFrame) -> DataFrame:
    """(image_id, early, late): ancillary chunks that stand before and after the pixel data, as they are written."""
    place = F.coalesce("pos", registry.position(F.col("type")))
    some = chunks.where("substr(type, 1, 1) between 'a' and 'z' and type not in ('acTL', 'fcTL', 'fdAT')").select("image_id", (place == "after_IDAT").alias("_late"), F.struct("seq", ch.raw_chunk(F.col("type"), F.col("data")).alias("raw")).alias("c"))
    lists = some.groupBy("image_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("_late") == late, F.col("c")))).alias(name) for name, late in (("early", False), ("late", True))))
    return lists.select("image_id", F.col("early.raw").alias("early"), F.col("late.raw").alias("late"))


def encode(frames: DataFrame, rows: DataFrame, n: int, n_plays: int = 0, chunks: DataFrame | None = None) -> DataFrame:
    """(image_id, content) of animations of 8-bit samples with n channels.

    The first frame is the picture that other readers show. Frames that are numbered with
    gaps or reach beyond the first one raise, and so do frames without all of their rows or
    rows of another length than their frame. Of chunks (image_id, seq, type, data, pos), the
    ancillary ones are written at their places, in the order of seq.
    """
    by = ["image_id", "frame"]
    line = F.concat(F.unhex(F.lit("00")), ch.pack_array(F.transform("vals", lambda v: F.pmod(v.cast("bigint"), F.lit(256))), 1))
    lines = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("y", line.alias("line")))).alias("l"), F.min(F.size("vals")).alias("_short"), F.max(F.size("vals")).alias("_long"))
    streams = lines.select(*by, F.col("l.y").alias("_ys"), "_short", "_long", ch.deflate(_joined(F.col("l.line"))).alias("stream"))
    first = F.col("frame") == 0
    heads = frames.groupBy("image_id").agg(F.max(F.when(first, F.col("w"))).alias("_w"), F.max(F.when(first, F.col("h"))).alias("_h"), F.count("*").alias("_n"), F.max("frame").alias("_last"))
    df = frames.join(heads, "image_id").join(streams, by, "left")
    one = F.lit(1).cast("bigint")
    whole = (F.col("_ys").cast("array<bigint>") == F.sequence(one - 1, F.col("h").cast("bigint") - 1)) & (F.col("_short") == F.col("w") * n) & (F.col("_long") == F.col("w") * n)
    stream = F.when(F.coalesce(whole, F.lit(False)), F.col("stream")).otherwise(F.raise_error(F.lit("a frame lacks rows, or has rows of another length")).cast("binary"))
    inside = (F.col("_n") == F.col("_last") + 1) & (F.col("x_off") + F.col("w") <= F.col("_w")) & (F.col("y_off") + F.col("h") <= F.col("_h"))
    seq = F.when(first, 0).otherwise(2 * F.col("frame") - 1)
    control = ch.frame_control_chunk(seq, *(F.col(c) for c in FRAME))
    data = F.when(first, _raw("IDAT", stream)).otherwise(_raw("fdAT", ch.frame_data_chunk(2 * F.col("frame"), stream)))
    part = F.when(inside, F.concat(_raw("fcTL", control), data)).otherwise(F.raise_error(F.lit("a frame is missing or reaches beyond the first one")).cast("binary"))
    whole = df.select("image_id", "_w", "_h", "_n", "frame", part.alias("part")).groupBy("image_id", "_w", "_h", "_n").agg(F.sort_array(F.collect_list(F.struct("frame", "part"))).alias("p"))
    depth = F.unhex(F.lit(f"08{_TYPES[n]:02X}000000"))
    none = F.array().cast("array<binary>")
    if chunks is None:
        whole = whole.withColumns({"early": none, "late": none})
    else:
        whole = whole.join(_more(chunks), "image_id", "left")
    at = lambda place: F.coalesce(F.col(place), none)
    pieces = F.concat(F.array(F.lit(MAGIC), _size(F.col("_w"), F.col("_h"), depth)), at("early"), F.array(_raw("acTL", ch.animation_control_chunk(F.col("_n"), F.lit(n_plays)))), F.col("p.part"), at("late"), F.array(_raw("IEND", F.unhex(F.lit("")))))
    return whole.select("image_id", _joined(pieces).alias("content"))


def _frame_parts(chunks: DataFrame) -> DataFrame:
    """Frame controls, frame data and pixel data of chunks with the number of their frame: of the controls before them. Pixel data before any control is no frame's."""
    w = Window.partitionBy("image_id").orderBy("seq")
    return chunks.where(F.col("type").isin("fcTL", "fdAT", "IDAT")).withColumn("frame", F.sum((F.col("type") == "fcTL").cast("bigint")).over(w) - 1).where("frame >= 0")


def create_frames(chunks: DataFrame) -> DataFrame:
    """(image_id, frame, FRAME, content) of chunks (image_id, seq, type, data): each frame as an image file of its own, its data put together."""
    parts = _frame_parts(chunks)
    control = parts.where("type = 'fcTL'").select("image_id", "frame", ch.parse_frame_control_chunk(F.col("data")).alias("c")).select("image_id", "frame", *(F.col(f"c.{c}") for c in FRAME))
    body = F.when(F.col("type") == "fdAT", F.substr(F.col("data"), F.lit(5))).otherwise(F.col("data"))
    streams = parts.where("type <> 'fcTL'").groupBy("image_id", "frame").agg(F.sort_array(F.collect_list(F.struct("seq", body.alias("body")))).alias("l"))
    one = lambda kind: F.max(F.when(F.col("type") == kind, F.col("data"))).alias(kind)
    heads = chunks.where(F.col("type").isin("IHDR", "PLTE", "tRNS")).groupBy("image_id").agg(one("IHDR"), one("PLTE"), one("tRNS"))
    df = control.join(streams, ["image_id", "frame"]).join(heads, "image_id")
    none = F.unhex(F.lit(""))
    maybe = lambda kind: F.coalesce(_raw(kind, F.col(kind)), none)
    content = F.concat(F.lit(MAGIC), _size(F.col("w"), F.col("h"), F.substr(F.col("IHDR"), F.lit(9))), maybe("PLTE"), maybe("tRNS"), _raw("IDAT", _joined(F.col("l.body"))), _raw("IEND", none))
    return df.select("image_id", "frame", *FRAME, content.alias("content"))


def frame_rows(created: DataFrame, errors: str = "raise") -> DataFrame:
    """(image_id, frame, y, channels, vals) of create_frames."""
    return images.rows(created, ["image_id", "frame"], errors=errors)


def validity(chunks: DataFrame) -> DataFrame:
    """(image_id, valid, reasons) of chunks (image_id, seq, type, data, pos) of each image that has any of an animation.

    An animation has one acTL, before the pixel data, that tells the number of frames;
    controls and data numbered from 0 without gaps, in order; data for every control; and
    frames inside the canvas. Frames may have their data in several chunks.
    """
    some = chunks.where(F.col("type").isin("acTL", "fcTL", "fdAT", "IDAT", "IHDR"))
    number = F.when(F.col("type").isin("fcTL", "fdAT"), ch.read_uint(F.col("data"), 0, 4))
    w = Window.partitionBy("image_id").orderBy("seq")
    live = some.where(F.col("type") != "IHDR").select("image_id", "seq", "type", "data", "pos", number.alias("n"), F.lead("type").over(w).alias("after"))
    count = lambda kind: F.count_if(F.col("type") == kind)
    control = ch.parse_frame_control_chunk(F.col("data"))
    frame = F.col("type") == "fcTL"
    told = live.groupBy("image_id").agg(
        count("acTL").alias("actl"), count("fcTL").alias("fctl"), count("fdAT").alias("fdat"),
        F.max(F.when(F.col("type") == "acTL", ch.read_uint(F.col("data"), 0, 4))).alias("n_frames"), F.bool_or((F.col("type") == "acTL") & (F.col("pos") == "after_IDAT")).alias("late"),
        F.count_distinct("n").alias("numbers"), F.min("n").alias("least"), F.max("n").alias("most"), F.bool_or(frame & ~F.coalesce(F.col("after").isin("fdAT", "IDAT"), F.lit(False))).alias("empty"),
        F.max(F.when(frame, control["x_off"] + control["w"])).alias("right"), F.max(F.when(frame, control["y_off"] + control["h"])).alias("low"),
        F.sort_array(F.collect_list(F.when(frame | (F.col("type") == "fdAT"), F.struct("seq", "n")))).alias("order"),
    ).where("actl + fctl + fdat > 0")
    sizes = some.where("type = 'IHDR'").select("image_id", ch.read_uint(F.col("data"), 0, 4).alias("w"), ch.read_uint(F.col("data"), 4, 4).alias("h"))
    df = told.join(sizes, "image_id", "left")
    total = F.col("fctl") + F.col("fdat")
    tests = [
        (F.col("actl") == 0, "no acTL"), (F.col("fctl") == 0, "no frame control"), (F.col("fdat") == 0, "no frame data"), (F.col("actl") > 1, "more than one acTL"), (F.col("late"), "acTL after the pixel data"),
        ((F.col("numbers") != total) | (F.col("least") != 0) | (F.col("most") != total - 1) | (F.col("order.n") != F.sort_array("order.n")), "sequence numbers aren't 0, 1, 2 and so on"),
        (F.col("n_frames") != F.col("fctl"), "acTL tells another number of frames"), (F.col("empty"), "a frame control without data"), ((F.col("right") > F.col("w")) | (F.col("low") > F.col("h")), "a frame reaches beyond the canvas"),
    ]
    reasons = F.filter(F.array(*(F.when(t, F.lit(m)) for t, m in tests)), lambda m: m.isNotNull())
    return df.select("image_id", (F.size(reasons) == 0).alias("valid"), reasons.alias("reasons"))


_ANIMATED = ["acTL", "fcTL", "fdAT"]


def _salvaged(chunks: DataFrame) -> DataFrame:
    """(image_id, seq, type, n, first): the controls and data of frames that can be kept, numbered from 0 as n.

    They are read by their own numbers until the first that breaks the order: data before
    any control, a control after one that has no data yet, or one whose frame reaches beyond
    the canvas. Of the first two controls after one another, the first is the picture's;
    any other control without data is left out. Without any data, nothing is kept.
    """
    size = chunks.where("type = 'IHDR'").select("image_id", ch.read_uint(F.col("data"), 0, 4).alias("_w"), ch.read_uint(F.col("data"), 4, 4).alias("_h"))
    control = ch.parse_frame_control_chunk(F.col("data"))
    reach = F.when(F.col("type") == "fcTL", F.struct((control["x_off"] + control["w"]).alias("x"), (control["y_off"] + control["h"]).alias("y")))
    parts = chunks.where("type in ('fcTL', 'fdAT') and length(data) >= 4").select("image_id", "seq", "type", ch.read_uint(F.col("data"), 0, 4).alias("_n"), reach.alias("_r")).join(size, "image_id")
    order = Window.partitionBy("image_id").orderBy("_n", F.desc("type"), "seq")  # controls before data of the same number
    parts = parts.withColumns({"_k": F.row_number().over(order), "_before": F.lag("type").over(order)})
    control, data = F.col("type") == "fcTL", F.col("type") == "fdAT"
    broken = (F.col("_before").isNull() & data) | (control & (F.col("_before") == "fcTL") & (F.col("_k") > 2)) | (F.col("_r.x") > F.col("_w")) | (F.col("_r.y") > F.col("_h"))
    upto = F.sum(F.coalesce(broken, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = parts.withColumn("_broken", upto).where("_broken = 0")
    kept = kept.withColumns({"_after": F.lead("type").over(order), "_any": F.count_if(data).over(Window.partitionBy("image_id"))})
    kept = kept.where((F.col("_any") > 0) & (data | (F.coalesce("_after", F.lit("")) == "fdAT") | ((F.col("_k") == 1) & (F.col("_after") == "fcTL"))))
    number = (F.row_number().over(order) - 1).cast("bigint")
    return kept.select("image_id", "seq", "type", number.alias("n"), ((F.col("_k") == 1) & (F.col("_after") == "fcTL")).alias("first"))


def repaired(chunks: DataFrame) -> DataFrame:
    """chunks (image_id, seq, type, data, pos) whose animations are sound.

    Those of images that `validity` passes come back as they are. Of others, the frames
    that can be kept stay, with their data, numbered anew; acTL tells their number and how
    often they are played, as before if it is known. An image without such frames has a
    picture only. Windows go over an image's chunks without their data.
    """
    told = validity(chunks).select("image_id", "valid")
    columns = ["image_id", "seq", "type", "data", "pos"]
    chunks = chunks.select(*columns)
    sound = chunks.join(told.where("not valid"), "image_id", "left_anti")
    ill = chunks.join(told.where("not valid").select("image_id"), "image_id", "left_semi")
    kept = _salvaged(ill)
    plays = F.coalesce(F.min(F.when((F.col("type") == "acTL") & (F.length("data") == 8), ch.read_uint(F.col("data"), 4, 4))), F.lit(0))
    edge = F.min(F.when(F.col("type") == "IDAT", F.col("seq")))
    about = ill.groupBy("image_id").agg(plays.alias("_plays"), edge.alias("_edge"), F.bool_or(F.col("type") == "PLTE").alias("_plte"))
    early = F.when(F.col("_plte"), "after_PLTE").otherwise("after_IHDR")
    # where a chunk goes: others before the pixel data, acTL, the picture's control, pixel data, frames, others, IEND
    others = ill.where(~F.col("type").isin(*_ANIMATED)).join(about, "image_id")
    part = F.when(F.col("type") == "IEND", 6).when(F.col("type") == "IDAT", 3).when(F.coalesce(F.col("seq") < F.col("_edge"), F.lit(True)), 0).otherwise(5)
    others = others.select("image_id", part.alias("_part"), F.col("seq").cast("bigint").alias("_at"), "type", "data", "pos")
    mine = ill.join(kept.select("image_id", "seq", "n", "first"), ["image_id", "seq"]).join(about, "image_id")
    frames = mine.select("image_id", F.when(F.col("first"), 2).otherwise(4).alias("_part"), F.col("n").alias("_at"), "type", F.concat(ch.uint(F.col("n"), 4), F.substr("data", F.lit(5))).alias("data"), F.when(F.col("first"), early).otherwise("after_IDAT").alias("pos"))
    counts = kept.groupBy("image_id").agg(F.count_if(F.col("type") == "fcTL").alias("_n")).join(about, "image_id")
    heads = counts.select("image_id", F.lit(1).alias("_part"), F.lit(0).cast("bigint").alias("_at"), F.lit("acTL").alias("type"), ch.animation_control_chunk(F.col("_n"), F.col("_plays")).alias("data"), early.alias("pos"))
    whole = others.unionByName(frames).unionByName(heads)
    place = (F.row_number().over(Window.partitionBy("image_id").orderBy("_part", "_at")) - 1).cast(chunks.schema["seq"].dataType)
    return sound.unionByName(whole.withColumn("seq", place).select(*columns))
