"""Aggregates, windows, palettes and the order-dependent parts of the enumerable surface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import with_sizes
from .pixels import AT, channels


def pixel(img: DataFrame) -> Column:
    return F.struct(*channels(img))


def minmax(img: DataFrame) -> DataFrame:
    """(image_id, low, high) over single samples."""
    own = channels(img)
    low = F.least(*own) if len(own) > 1 else F.col(own[0])
    high = F.greatest(*own) if len(own) > 1 else F.col(own[0])
    return img.groupBy("image_id").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def channel_stats(img: DataFrame) -> DataFrame:
    """Least, greatest and sum of each channel."""
    return img.groupBy("image_id").agg(*(f(c).alias(f"{n}_{c}") for c in channels(img) for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))))


def tally(img: DataFrame) -> DataFrame:
    """How often each pixel value occurs in an image."""
    return img.groupBy("image_id", *channels(img)).agg(F.count("*").alias("n"))


def count_colors(img: DataFrame) -> DataFrame:
    """Distinct colours, alpha left aside."""
    own = channels(img)
    return img.groupBy("image_id").agg(F.count_distinct(F.struct(*own[: 3 if len(own) > 2 else 1])).alias("colors"))


def histogram(img: DataFrame, channel: str = "c0") -> DataFrame:
    return img.groupBy("image_id", F.col(channel).alias("value")).agg(F.count("*").alias("n"))


def palette(img: DataFrame, most: int | None = None) -> DataFrame:
    """(image_id, idx, colours): distinct colours by first appearance, row by row.

    Colours are combined before the shuffle, and only they are ranked. With `most`, images
    of more colours have no palette: they are told by a count before any ranking.
    """
    own = channels(img)[:3]
    first = img.groupBy("image_id", *own).agg(F.min(F.struct("y", "x")).alias("at"))
    if most is not None:
        first = first.join(first.groupBy("image_id").count().where(F.col("count") <= most).select("image_id"), "image_id", "left_semi")
    return first.select("image_id", (F.row_number().over(Window.partitionBy("image_id").orderBy("at")) - 1).cast("bigint").alias("idx"), *own)


def distinct_colors(img: DataFrame, most: int = 257) -> DataFrame:
    """(image_id, colors): distinct colours, alpha left aside, counted up to `most`.

    A task keeps at most so many colours of an image and gives up at that number, so many
    colours are neither kept nor shuffled; what the tasks have found is told apart once more.
    """
    own = channels(img)[: 3 if len(channels(img)) > 2 else 1]
    names = ["image_id", *own]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            samples = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(own))], 1)
            fresh = []
            for i in np.unique(ids):
                held = seen.setdefault(int(i), set())
                if len(held) >= most:
                    continue
                for color in map(tuple, np.unique(samples[ids == i], axis=0).tolist()):
                    if color not in held and len(held) < most:
                        held.add(color)
                        fresh.append((int(i), *color))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*fresh) if fresh else [[]] * len(names), [pa.int64(), *[pa.float64()] * len(own)])], names)

    found = img.select(*names).mapInArrow(some, "image_id long, " + ", ".join(f"{c} double" for c in own))
    return found.distinct().groupBy("image_id").agg(F.least(F.count("*"), F.lit(most)).alias("colors"))


def palettable(img: DataFrame, most: int = 256) -> DataFrame:
    """(image_id, palettable): whether an image has at most `most` colours."""
    return distinct_colors(img, most + 1).select("image_id", (F.col("colors") <= most).alias("palettable"))


def to_indexed(img: DataFrame, pal: DataFrame) -> DataFrame:
    """Palette indexes as a one-channel image."""
    own = channels(pal)
    return img.join(pal, ["image_id", *own]).select(*AT, F.col("idx").cast("double").alias("c0"))


def depalette(indexed: DataFrame, pal: DataFrame) -> DataFrame:
    """Colours of a palette (image_id, idx, colours, optional alpha); a missing alpha is 255, an unknown index stays null."""
    own = channels(pal)
    p = pal.select("image_id", F.col("idx").cast("double").alias("c0"), *(F.col(c).alias(f"p{c[1:]}") for c in own), *(["alpha"] if "alpha" in pal.columns else []))
    out = indexed.join(p, ["image_id", "c0"], "left")
    return out.select(*AT, *(F.col(f"p{c[1:]}").alias(c) for c in own), *([F.coalesce("alpha", F.lit(255.0)).alias(f"c{len(own)}")] if "alpha" in pal.columns else []))


def color_key(img: DataFrame, key: list[float]) -> DataFrame:
    """Alpha 0 where a pixel equals the key, else 255."""
    own = channels(img)
    same = F.lit(True)
    for c, v in zip(own, key):
        same = same & (F.col(c) == v)
    return img.select(*AT, *own, F.when(same, 0.0).otherwise(255.0).alias(f"c{len(own)}"))


def with_index(img: DataFrame) -> DataFrame:
    """The row-major position of each pixel, from its coordinates."""
    from .geometry import with_sizes

    return with_sizes(img).select("image_id", (F.col("y") * F.col("w") + F.col("x")).alias("i"), *channels(img))


def each_slice(img: DataFrame, n: int) -> DataFrame:
    """(image_id, slice, values): n pixels after one another, of the first channel."""
    rows = with_index(img).groupBy("image_id", F.floor(F.col("i") / n).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("i", "c0"))).alias("v"))
    return rows.select("image_id", "slice", F.col("v.c0").alias("values"))


def each_cons(img: DataFrame) -> DataFrame:
    """(image_id, y, x, c0, next): each pixel and the one to its right."""
    return img.select(*AT, "c0", F.lead("c0").over(Window.partitionBy("image_id", "y").orderBy("x")).alias("next"))


def chunk_while(img: DataFrame, same: Callable[[Column, Column], Column]) -> DataFrame:
    """(image_id, run, start, values): runs of pixels in row-major order, of the first channel, whose neighbours `same` holds for.

    Runs begin where it doesn't: with equality these are the runs of a value, with `<=`
    the rising ones. They may go on from row to row: runs are counted in each row, then
    over the rows of an image, so only one value a row goes through a window by image.
    """
    from .geometry import with_sizes

    df = with_sizes(img).select("image_id", "y", "x", (F.col("y") * F.col("w") + F.col("x")).alias("i"), "c0")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    ends = df.groupBy("image_id", "y").agg(F.max_by("c0", "x").alias("_end"))
    prior = ends.select("image_id", (F.col("y") + 1).alias("y"), "_end")
    df = df.join(prior, ["image_id", "y"], "left").withColumn("_before", F.coalesce(F.lag("c0").over(row), F.when(F.col("x") == 0, F.col("_end"))))
    df = df.withColumn("_new", F.when(F.col("_before").isNull() | ~same(F.col("_before"), F.col("c0")), 1).otherwise(0))
    counts = df.groupBy("image_id", "y").agg(F.sum("_new").alias("_n"))
    above = counts.select("image_id", "y", (F.sum("_n").over(Window.partitionBy("image_id").orderBy("y")) - F.col("_n")).alias("_above"))
    runs = df.join(above, ["image_id", "y"]).select("image_id", (F.col("_above") + F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("run"), "i", "c0")
    grouped = runs.groupBy("image_id", "run").agg(F.sort_array(F.collect_list(F.struct("i", "c0"))).alias("v"))
    return grouped.select("image_id", "run", F.col("v")[0]["i"].alias("start"), F.col("v.c0").alias("values"))


def slice_when(img: DataFrame, cut: Callable[[Column, Column], Column]) -> DataFrame:
    """Runs as of chunk_while, which begin where `cut` holds for two neighbours."""
    return chunk_while(img, lambda a, b: ~cut(a, b))


def fold(img: DataFrame, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(image_id, y, value): an order-dependent fold of each row's first channel."""
    rows = img.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "c0"))).alias("v"))
    return rows.select("image_id", "y", F.aggregate(F.col("v.c0"), start, step).alias("value"))


def inject(img: DataFrame, f: Callable[[Column], Column] = F.sum, name: str = "total") -> DataFrame:
    """(image_id, total): an aggregate of each image's first channel that doesn't depend on order."""
    return img.groupBy("image_id").agg(f(F.col("c0")).alias(name))


def pixel_minmax(img: DataFrame) -> DataFrame:
    """(image_id, low, high): the least and greatest pixels, compared channel by channel."""
    return img.groupBy("image_id").agg(F.min(pixel(img)).alias("low"), F.max(pixel(img)).alias("high"))


def uniq(img: DataFrame) -> DataFrame:
    """The distinct pixels of all images."""
    return img.select(*channels(img)).distinct()


def sort_pixels(img: DataFrame) -> DataFrame:
    """Pixels by their channels, ties by place."""
    return img.orderBy(*channels(img), *AT)


def set_palette(img: DataFrame, palette: list[int], bit_depth: int = 8) -> DataFrame:
    """(image_id, idx, c0, c1, c2) for each image of img: a palette of r, g, b, r, g, b, ... values for one-channel images."""
    if channels(img) != ["c0"]:
        raise ValueError("palettes are for one-channel images")
    if not palette or len(palette) % 3 or len(palette) > 3 << bit_depth:
        raise ValueError(f"a palette has three values for each of 1 to {1 << bit_depth} colours")
    colors = [tuple(map(float, palette[k : k + 3])) for k in range(0, len(palette), 3)]
    rows = F.array(*(F.struct(F.lit(i).cast("bigint").alias("idx"), *(F.lit(v).alias(f"c{k}") for k, v in enumerate(c))) for i, c in enumerate(colors)))
    return img.select("image_id").distinct().select("image_id", F.inline(rows))


def to_rows(img: DataFrame) -> DataFrame:
    """(image_id, y, vals): interleaved samples of each row."""
    own = channels(img)
    rows = img.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", F.array(*own).alias("v")))).alias("p"))
    return rows.select("image_id", "y", F.flatten(F.col("p.v")).alias("vals"))


def to_blob(img: DataFrame, x: int = 0, y: int = 0, w: int | None = None, h: int | None = None, alpha: bool = True) -> DataFrame:
    """(image_id, vals): the values of a window of each image, row after row, channels interleaved.

    A place wraps around; without w and h the window reaches the image's end. A window that
    reaches beyond an image raises, one of no pixels gives no row. Without alpha, the last of
    two or four channels is left out.
    """
    if (w or 0) < 0 or (h or 0) < 0:
        raise ValueError("a window's size can't be negative")
    own = channels(img)
    kept = own[:-1] if not alpha and len(own) in (2, 4) else own
    left, top = F.pmod(F.lit(x), F.col("w")), F.pmod(F.lit(y), F.col("h"))
    right, bottom = (F.col("w") if w is None else left + w), (F.col("h") if h is None else top + h)
    within = (F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom)
    fits = (right <= F.col("w")) & (bottom <= F.col("h"))
    cut = with_sizes(img).where(F.when(fits, within).otherwise(F.raise_error(F.lit("the window reaches beyond the image")).cast("boolean")))
    some = cut.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", F.array(*kept).alias("v")))).alias("p"))
    return some.select("image_id", F.flatten("p.v").alias("vals"))


def from_rows(rows: DataFrame, n: int) -> DataFrame:
    """Pixels of rows of n interleaved channels, in one pass over each row."""
    px = rows.select("image_id", "y", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("vals") / n).cast("int") - 1), lambda i: F.slice("vals", i * n + 1, n))).alias("x", "v"))
    return px.select("image_id", "y", F.col("x").cast("bigint").alias("x"), *(F.col("v")[k].cast("double").alias(f"c{k}") for k in range(n)))


def png_filter(img: DataFrame, kind: str) -> DataFrame:
    """Residuals of one-byte pixels under a PNG row filter: sub, up, average or paeth.

    Each pixel sends itself to the neighbours that are guessed from it, and one
    aggregation by place gathers them, so no task holds a row or column.
    """
    sent = {"sub": [(0, 1, "a")], "up": [(1, 0, "b")], "average": [(0, 1, "a"), (1, 0, "b")], "paeth": [(0, 1, "a"), (1, 0, "b"), (1, 1, "c")]}[kind]
    to = F.expr("array(" + ", ".join(f"named_struct('dy', {y}L, 'dx', {x}L, 'n', '{n}')" for y, x, n in [(0, 0, "v"), *sent]) + ")")
    rows = img.select("image_id", "y", "x", F.col("c0").cast("bigint").alias("s"), F.explode(to).alias("o"))
    rows = rows.select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "s", F.col("o.n").alias("n"))
    df = rows.groupBy(*AT).agg(*(F.max(F.when(F.col("n") == n, F.col("s"))).alias(n) for n in ["v", *(n for _, _, n in sent)])).where("v is not null")
    a, b, c = (F.coalesce(n, F.lit(0).cast("bigint")) if n in df.columns else F.lit(0) for n in "abc")
    if kind == "paeth":
        pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
        guess = F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)
    else:
        guess = {"sub": a, "up": b, "average": F.floor((a + b) / 2)}[kind]
    return df.select(*AT, F.pmod(F.col("v") - guess, F.lit(256)).cast("double").alias("c0"))


def sub_defilter(img: DataFrame) -> DataFrame:
    """The pixels of sub residuals: a running sum of each row."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return img.select(*AT, F.pmod(F.sum(F.col("c0").cast("bigint")).over(row), F.lit(256)).cast("double").alias("c0"))


def first_n(img: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n pixels of all images by image, row and column."""
    return img.orderBy(*AT).offset(offset).limit(n)


def top_k(img: DataFrame, k: int) -> DataFrame:
    """The k greatest pixels, ties by place."""
    return img.orderBy(F.desc("c0"), *AT).limit(k)


def _ordered(img: DataFrame, by: list, n: int | None = None) -> DataFrame:
    """img with the place i of each pixel in its image's order, of the first n only: tasks keep no more of an image before the shuffle."""
    out = img.withColumn("i", F.row_number().over(Window.partitionBy("image_id").orderBy(*by)))
    out = out if n is None else out.where(F.col("i") <= n)
    return out.withColumn("i", (F.col("i") - 1).cast("bigint"))


def ranked(img: DataFrame) -> DataFrame:
    """Each image's pixels with their place i in the order of channels, ties by place."""
    return _ordered(img, [*channels(img), "y", "x"])


def greatest(img: DataFrame, n: int) -> DataFrame:
    """The n greatest pixels of each image, compared channel by channel, with their place i from the greatest on; ties by place."""
    return _ordered(img, [*(F.desc(c) for c in channels(img)), "y", "x"], n)


def least(img: DataFrame, n: int) -> DataFrame:
    """The n least pixels of each image, with their place i from the least on; ties by place."""
    return _ordered(img, [*channels(img), "y", "x"], n)


def take(img: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n pixels of each image in row-major order after the first `offset`, told by their coordinates."""
    from .geometry import with_sizes

    at = F.col("y") * F.col("w") + F.col("x")
    return with_sizes(img).where(at.between(offset, offset + n - 1)).select(*AT, *channels(img))


def _stops(img: DataFrame, holds: Column) -> DataFrame:
    """img with the first place in row-major order of its image where `holds` doesn't, null if it does everywhere. One aggregate a image, no order."""
    stop = F.min(F.when(~F.coalesce(holds, F.lit(False)), F.struct("y", "x")))
    return img.join(img.groupBy("image_id").agg(stop.alias("_stop")), "image_id")


def take_while(img: DataFrame, holds: Column) -> DataFrame:
    """Each image's pixels in row-major order up to the first that `holds` is false or null for."""
    return _stops(img, holds).where(F.col("_stop").isNull() | (F.struct("y", "x") < F.col("_stop"))).select(*AT, *channels(img))


def drop_while(img: DataFrame, holds: Column) -> DataFrame:
    """Each image's pixels in row-major order from the first that `holds` is false or null for."""
    return _stops(img, holds).where(F.struct("y", "x") >= F.col("_stop")).select(*AT, *channels(img))
