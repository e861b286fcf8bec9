"""Operators that move, cut, resize and draw.

Images may carry their sizes in columns h and w; where they don't, these are counted from
the pixels, by image, which reads them once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import AT, channels, inside


def sizes(img: DataFrame) -> DataFrame:
    """(image_id, h, w)"""
    return img.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def with_sizes(img: DataFrame) -> DataFrame:
    """img with h and w, its own if it carries them."""
    return img if {"h", "w"} <= set(img.columns) else img.join(sizes(img), "image_id")


def transpose(img: DataFrame) -> DataFrame:
    return img.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), *channels(img))


def copy_window(img: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The rectangle between two corners, both included, in any order; a corner outside an image raises."""
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    if x0 < 0 or y0 < 0:
        raise ValueError("corner outside the image")
    return copy(inside(img, x1, y1, _within(x0, y0, x1, y1)), x0, y0, x1 - x0 + 1, y1 - y0 + 1)


def _within(x0: int, y0: int, x1: int, y1: int) -> Column:
    return F.col("x").between(x0, x1) & F.col("y").between(y0, y1)


def copy(img: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """A rectangle of w x h pixels from (x0, y0) on, as far as it lies in the image."""
    return img.where(_within(x0, y0, x0 + w - 1, y0 + h - 1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


#: Indexes of all images together that are broadcast.
_FEW = 100_000


def pick(img: DataFrame, ys: list[int], xs: list[int]) -> DataFrame:
    """Rows and columns by index, in the given order; indexes wrap around.

    The indexes of all images are sorted and merged with the pixels unless they are few.
    """
    at = lambda values: F.posexplode(F.array(*(F.lit(v).cast("bigint") for v in values)))
    rows = sizes(img).select("image_id", "w", at(ys).alias("ny", "sy"), "h").select("image_id", "w", "ny", F.pmod("sy", "h").alias("sy"))
    grid = rows.select("image_id", "ny", "sy", at(xs).alias("nx", "sx"), "w").select("image_id", "ny", "sy", "nx", F.pmod("sx", "w").alias("sx"))
    grid = grid.withColumnsRenamed({"sy": "y", "sx": "x"})
    most = _FEW // max(1, len(ys) * len(xs))
    few = img.select("image_id").distinct().limit(most + 1).count() <= most
    found = img.join(F.broadcast(grid) if few else grid.hint("merge"), AT)
    return found.select("image_id", F.col("ny").cast("bigint").alias("y"), F.col("nx").cast("bigint").alias("x"), *channels(img))


def move(img: DataFrame, dx: int, dy: int) -> DataFrame:
    """Shifted right and down; what comes in is 0. Both parts are projections of the pixels, without a join."""
    own = channels(img)
    sized = with_sizes(img)
    ty, tx = F.col("y") + dy, F.col("x") + dx
    inside = tx.between(0, F.col("w") - 1) & ty.between(0, F.col("h") - 1)
    moved = sized.where(inside).select("image_id", ty.alias("y"), tx.alias("x"), *own)
    covered = (F.col("x") - dx).between(0, F.col("w") - 1) & (F.col("y") - dy).between(0, F.col("h") - 1)
    return moved.unionByName(sized.where(~covered).select(*AT, *(F.lit(0.0).alias(c) for c in own)))


def canvas(img: DataFrame, w: int, h: int) -> DataFrame:
    """Cut or filled up with 0 at the right and below."""
    own = channels(img)
    fill = sizes(img).select("image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(h - 1).cast("bigint"))).alias("y"), F.col("h").alias("oh"), F.col("w").alias("ow"))
    fill = fill.select("image_id", "y", "oh", "ow", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(w - 1).cast("bigint"))).alias("x")).where("y >= oh or x >= ow")
    return img.where((F.col("x") < w) & (F.col("y") < h)).unionByName(fill.select(*AT, *(F.lit(0.0).alias(c) for c in own)))


def paste(base: DataFrame, over: DataFrame, x: int, y: int) -> DataFrame:
    """over's pixels replace those of base from (x, y) on."""
    own = channels(base)
    if own != channels(over):
        raise ValueError("images differ in channels")
    o = over.select("image_id", (F.col("y") + y).alias("y"), (F.col("x") + x).alias("x"), *(F.col(c).alias(f"o{c[1:]}") for c in own))
    return base.join(o, AT, "left").select(*AT, *(F.coalesce(f"o{c[1:]}", c).alias(c) for c in own))


def alpha_over(fg: DataFrame, bg: DataFrame) -> DataFrame:
    """fg composited over bg, both with alpha in the last channel; anchored at the origin, truncated to whole samples."""
    own = channels(bg)
    if len(own) not in (2, 4) or own != channels(fg):
        raise ValueError("both images need the same channels and alpha")
    n = len(own) - 1
    f = fg.select(*AT, *(F.col(c).alias(f"o{c[1:]}") for c in own))
    af, ab = F.col(f"o{n}") / 255.0, F.col(f"c{n}") / 255.0
    alpha = af + ab * (1 - af)
    keep, take = F.coalesce(F.col(f"o{n}"), F.lit(0.0)) == 0, F.col(f"o{n}") == 255
    blend = lambda c: F.floor((F.col(f"o{c}") * af + F.col(f"c{c}") * ab * (1 - af)) / alpha).cast("double")
    out = [F.when(keep, F.col(f"c{c}")).when(take, F.col(f"o{c}")).otherwise(blend(c)).alias(f"c{c}") for c in range(n)]
    out.append(F.when(keep, F.col(f"c{n}")).when(take, F.col(f"o{n}")).otherwise(F.floor(255 * alpha).cast("double")).alias(f"c{n}"))
    return bg.join(f, AT, "left").select(*AT, *out)


def alpha_under(bg: DataFrame, fg: DataFrame) -> DataFrame:
    """bg put under fg: alpha_over with the images the other way round."""
    return alpha_over(fg, bg)


def _reach(axis: str, n: str, scale: float, out: Column, half: float) -> Column:
    """The output indexes whose centre lies less than half a source pixel, or a whole one, off source index `axis`, clamped at the edges."""
    at = lambda v: (v + 0.5) * scale - 0.5
    low = F.when(F.col(axis) == 0, F.lit(0.0)).otherwise(F.greatest(F.ceil(at(F.col(axis) - half) - 1e-9), F.lit(0)))
    high = F.when(F.col(axis) == F.col(n) - 1, out - 1).otherwise(F.least(F.floor(at(F.col(axis) + half) + 1e-9), out - 1))
    low, high = low.cast("bigint"), high.cast("bigint")
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _source(t: Column, scale: float) -> Column:
    return (t + 0.5) / scale - 0.5


def _weight(axis: str, t: Column, n: str, scale: float) -> Column:
    """The part of source index `axis` in output index t."""
    at = _source(t, scale)
    low, high = F.floor(at), F.ceil(at)
    lo, hi = F.when(low < 0, high).otherwise(low), F.when(high > F.col(n) - 1, low).otherwise(high)
    part = at - low
    return F.when(lo == hi, (F.col(axis) == lo).cast("double")).otherwise(F.when(F.col(axis) == lo, 1 - part).when(F.col(axis) == hi, part).otherwise(0.0))


def resize(img: DataFrame, sx: float, sy: float | None = None, method: str = "bilinear") -> DataFrame:
    """Resized by factors; every source pixel is sent to the output pixels that read it, so nothing is joined.

    Centres are at half pixels and edges are clamped. nearest needs no shuffle at all,
    bilinear takes x, then y; either sums at most two parts of each output pixel,
    combined before the shuffle.
    """
    sy = sx if sy is None else sy
    if sx <= 0 or sy <= 0 or method not in ("nearest", "bilinear"):
        raise ValueError("a positive scale and a known method are needed")
    own = channels(img)
    df = with_sizes(img)
    axes = [("x", "w", sx), ("y", "h", sy)]
    for axis, n, scale in axes:
        out = F.round(F.col(n) * scale).cast("bigint")
        if method == "nearest":
            hit = lambda t: F.least(F.greatest(F.round(_source(t, scale)), F.lit(0.0)), F.col(n) - 1.0) == F.col(axis)  # noqa: B023, E731
            df = df.select("image_id", "h", "w", *own, *(a for a, _, _ in axes if a != axis), F.explode(F.filter(_reach(axis, n, scale, out, 0.5), hit)).alias(axis))
        else:
            parts = F.transform(_reach(axis, n, scale, out, 1.0), lambda t: F.struct(t.alias("t"), _weight(axis, t, n, scale).alias("k")))  # noqa: B023
            df = df.select("image_id", "h", "w", *own, *(a for a, _, _ in axes if a != axis), F.explode(F.filter(parts, lambda p: p["k"] > 0)).alias("p"))
            df = df.withColumn(axis, F.col("p.t")).groupBy(*AT, "h", "w").agg(*(F.sum(F.col(c) * F.col("p.k")).alias(c) for c in own))
    return df.select(*AT, *own)


def _mix(img: DataFrame, cover: Column, color: list[float]) -> DataFrame:
    return img.withColumn("_k", cover).select(*AT, *(F.when(F.col("_k") == 0, F.col(c)).otherwise(F.col("_k") * v + (1 - F.col("_k")) * F.col(c)).alias(c) for c, v in zip(channels(img), color)))


def _clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def draw_disk(img: DataFrame, x0: float, y0: float, r: float, color: list[float]) -> DataFrame:
    """A disk with a soft edge of one pixel."""
    if r < 0 or len(color) != len(channels(img)):
        raise ValueError("a radius of at least 0 and a value for each channel")
    dist = F.sqrt((F.col("x") - F.lit(float(x0))) ** 2 + (F.col("y") - F.lit(float(y0))) ** 2)
    return _mix(img, _clamp(r - dist + 0.5), color)


def draw_line(img: DataFrame, x0: float, y0: float, x1: float, y1: float, color: list[float], width: float = 1.0) -> DataFrame:
    """A line with round caps and a soft edge of one pixel: all places within half its width of the segment.

    A pixel is covered by how far its distance to the nearest point of the segment stays
    under half the width and half a pixel. A segment without length is a disk.
    """
    if width < 0 or len(color) != len(channels(img)):
        raise ValueError("a width of at least 0 and a value for each channel")
    dx, dy = float(x1 - x0), float(y1 - y0)
    px, py = F.col("x") - F.lit(float(x0)), F.col("y") - F.lit(float(y0))
    along = _clamp((px * dx + py * dy) / (dx * dx + dy * dy)) if dx or dy else F.lit(0.0)
    dist = F.sqrt((px - along * dx) ** 2 + (py - along * dy) ** 2)
    return _mix(img, _clamp(width / 2 + 0.5 - dist), color)
