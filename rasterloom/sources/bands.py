"""One large image as a PNG file that many tasks put together.

Rows are dealt into bands. Each band is filtered and deflated in a task of its own, up to a
full flush, so the streams can stand after one another; a last part ends the stream with
the checksum of all bands, which is combined from theirs. A file is written by a task that
holds one band at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunks as ch
from . import codec, datasource

BASE = 65521  # of Adler-32


def combined(sums: Column) -> Column:
    """The Adler-32 of bytes after one another, from an array of (sum, size) of each run."""
    low, high = lambda v: v.bitwiseAND(F.lit(0xFFFF)), lambda v: F.shiftright(v, 16)
    step = lambda a, b: F.struct(
        F.pmod(a["low"] + low(b["sum"]) - 1, F.lit(BASE)).alias("low"),
        F.pmod(F.pmod(b["size"], F.lit(BASE)) * (a["low"] - 1) + a["high"] + high(b["sum"]), F.lit(BASE)).alias("high"),
    )
    one = F.struct(F.lit(1).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
    return F.aggregate(sums, one, step, lambda a: F.shiftleft(a["high"], 16) + a["low"])


def encode(rows: DataFrame, n: int, band_rows: int = 256, bit_depth: int = 8, level: int = 6) -> DataFrame:
    """(image_id, part, content): the parts, in order, of PNG files of rows (image_id, y, vals) of n channels.

    The first row of a band is filtered by its own pixels only, others as deflates best of
    them all by the sum of residuals. Images with missing or repeated rows, or rows of unequal length, raise.
    """
    if bit_depth not in (8, 16) or n not in (1, 2, 3, 4):
        raise ValueError("bit depth 8 or 16, one to four channels")
    bands = rows.withColumn("band", F.expr(f"y div {int(band_rows)}")).groupBy("image_id", "band").agg(F.sort_array(F.collect_list(F.struct("y", "vals"))).alias("p"))
    bands = bands.select(F.col("image_id").cast("long"), F.col("band").cast("long"), F.col("p.y").cast("array<bigint>").alias("ys"), F.col("p.vals").cast("array<array<double>>").alias("vals"))
    bpp = n * bit_depth // 8

    def deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                image, band, ys, lists = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values
                widths = np.unique(lists.value_lengths().to_numpy())
                if len(widths) != 1 or widths[0] % n or (ys != np.arange(band * band_rows, band * band_rows + len(ys))).any():
                    raise codec.ImageError("an image lacks rows, or has rows twice or of unequal length")
                values = np.trunc(lists.flatten().to_numpy()).astype(np.int64).reshape(len(ys), -1) % (1 << bit_depth)
                lines = np.ascontiguousarray(values.astype(">u2" if bit_depth == 16 else np.uint8)).view(np.uint8).reshape(len(ys), -1)
                found = np.stack(codec._filters(lines, bpp))
                cost = np.abs(found.view(np.int8).astype(np.int64)).sum(2)
                cost[2:, 0] = np.iinfo(np.int64).max  # the row above is another band's
                kinds = cost.argmin(0)
                raw = np.concatenate([kinds[:, None].astype(np.uint8), found[kinds, np.arange(len(ys))]], 1).tobytes()
                pack = zlib.compressobj(level, zlib.DEFLATED, -15)
                body = pack.compress(raw) + pack.flush(zlib.Z_FULL_FLUSH)
                out.append((image, band, len(ys), int(widths[0]) // n, codec.chunk("IDAT", (b"\x78\x9c" if band == 0 else b"") + body), zlib.adler32(raw), len(raw)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["image_id", "band", "rows", "width", "content", "sum", "size"])

    from ..session import stored

    done = stored(bands.mapInArrow(deflated, "image_id long, band long, rows long, width long, content binary, sum long, size long"), "bands")
    about = done.groupBy("image_id").agg(F.sum("rows").alias("h"), F.min("width").alias("w"), F.max("width").alias("_w"), F.max("band").alias("last"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("band", "sum", "size"))).alias("s"), F.count_if((F.col("rows") < band_rows)).alias("short"))
    sound = (F.col("w") == F.col("_w")) & (F.col("n") == F.col("last") + 1) & (F.col("h") > F.col("last") * band_rows) & (F.col("short") <= 1)
    about = about.withColumn("h", F.when(sound, F.col("h")).otherwise(F.raise_error(F.lit("an image lacks rows, or has rows twice or of unequal length")).cast("bigint")))
    color = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    size = F.concat(ch.uint(F.col("w"), 4), ch.uint(F.col("h"), 4), F.lit(struct.pack(">BBBBB", bit_depth, color, 0, 0, 0)))
    head = about.select("image_id", F.lit(-1).cast("bigint").alias("part"), F.concat(F.lit(codec.MAGIC), ch.raw_chunk(F.lit("IHDR"), size)).alias("content"))
    end = F.concat(F.lit(b"\x03\x00"), ch.uint(combined(F.col("s")), 4))  # an empty last block, and the sum of all bytes
    tail = about.select("image_id", (F.col("last") + 1).alias("part"), F.concat(ch.raw_chunk(F.lit("IDAT"), end), ch.raw_chunk(F.lit("IEND"), F.unhex(F.lit("")))).alias("content"))
    return head.unionByName(done.select("image_id", F.col("band").alias("part"), "content")).unionByName(tail)


def save(parts: DataFrame, path: str) -> None:
    """Write the parts of encode as files <image_id>.png; the task that writes a file holds one part at a time."""
    datasource.register(parts.sparkSession)
    parts.repartition("image_id").sortWithinPartitions("image_id", "part").select("image_id", "content").write.format("raster").mode("append").save(path)
