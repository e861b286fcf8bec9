"""Point-wise operators over pixel tables (image_id, y, x, c0, c1, ...).

Everything here is a projection, or one equi-join on the pixel's coordinates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = ["image_id", "y", "x"]
Operand = DataFrame | float | int | Sequence[float]


def channels(img: DataFrame) -> list[str]:
    return [c for c in img.columns if re.fullmatch(r"c\d", c)]


def mapped(img: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Every sample through f, coordinates kept."""
    own = channels(img)
    return img.select(*(F.expr(c) if c not in own else f(F.col(c)).alias(c) for c in img.columns))


def mapped_pixels(img: DataFrame, f: Callable[..., Sequence[Column]], with_coordinates: bool = False) -> DataFrame:
    """Every pixel through f, which may change the number of channels; with coordinates, x and y come after the channels."""
    args = [F.col(c) for c in channels(img)] + ([F.col("x"), F.col("y")] if with_coordinates else [])
    return img.select(*AT, *(v.alias(f"c{i}") for i, v in enumerate(f(*args))))


def joined(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """Pixels of both images side by side, b's channels as o0, o1, ... A pixel that only one has raises, unless strict is off, which leaves it out."""
    other = b.select(*AT, *(F.col(c).alias(f"o{c[1:]}") for c in channels(b)))
    if not strict:
        return a.join(other, AT)
    out = a.withColumn("_a", F.lit(1)).join(other.withColumn("_b", F.lit(1)), AT, "full")
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("images differ in size"))).otherwise(F.lit(True))
    return out.where(ok).drop("_a", "_b")


def binary(a: DataFrame, b: Operand, f: Callable[[Column, Column], Column], strict: bool = True) -> DataFrame:
    """f of each sample of a and b's: an image of the same size, one number, or a number for each channel."""
    own = channels(a)
    if isinstance(b, DataFrame):
        if len(channels(b)) != len(own):
            raise ValueError("images differ in channels")
        return joined(a, b, strict).select(*AT, *(f(F.col(c), F.col(f"o{c[1:]}")).alias(c) for c in own))
    values = [float(b)] * len(own) if isinstance(b, (int, float)) else [float(v) for v in b]
    if len(values) != len(own):
        raise ValueError("one value for each channel")
    return a.select(*AT, *(f(F.col(c), F.lit(v)).alias(c) for c, v in zip(own, values)))


def add(a: DataFrame, b: Operand) -> DataFrame:
    return binary(a, b, lambda x, y: x + y)


def sub(a: DataFrame, b: Operand) -> DataFrame:
    return binary(a, b, lambda x, y: x - y)


def mul(a: DataFrame, b: Operand) -> DataFrame:
    return binary(a, b, lambda x, y: x * y)


def power(a: DataFrame, b: Operand) -> DataFrame:
    return binary(a, b, lambda x, y: F.pow(x, y))


def divide(a: DataFrame, b: Operand) -> DataFrame:
    """Quotients; by zero they are infinite, or NaN for 0 / 0 and where the dividend is null. Other quotients of nulls, and by null, are null."""
    inf = float("inf")

    def f(x: Column, y: Column) -> Column:
        return F.when((y != 0) | y.isNull(), F.try_divide(x, y)).when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(float("nan")))

    return binary(a, b, f)


UNARY: dict[str, Callable[[Column], Column]] = {
    "neg": lambda v: -v, "abs": F.abs, "round": lambda v: F.round(v), "ceil": lambda v: F.ceil(v).cast("double"), "floor": lambda v: F.floor(v).cast("double"), "truncate": lambda v: v.cast("bigint").cast("double"),
    "cos": F.cos, "sin": F.sin, "tan": F.tan, "acos": F.acos, "asin": F.asin, "atan": F.atan,
}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b,
}


def unary(img: DataFrame, name: str) -> DataFrame:
    """acos and asin raise outside -1..1."""
    f = UNARY[name]
    if name in ("acos", "asin"):
        return mapped(img, lambda v: F.when(F.abs(v) > 1, F.raise_error(F.lit(f"{name} outside -1..1")).cast("double")).otherwise(f(v)))
    return mapped(img, f)


def compare(a: DataFrame, b: Operand, name: str) -> DataFrame:
    """1 where the comparison holds, else 0."""
    return binary(a, b, lambda x, y: COMPARE[name](x, y).cast("double"))


def atan2(a: DataFrame, b: DataFrame) -> DataFrame:
    if len(channels(a)) != 1 or len(channels(b)) != 1:
        raise ValueError("one channel each")
    return binary(a, b, F.atan2)


def rescale(img: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Samples of each image moved linearly to low..high by the least and greatest of all its channels; a constant image becomes low."""
    own = channels(img)
    ends = img.groupBy("image_id").agg(F.min(F.least(*own) if len(own) > 1 else F.col(own[0])).alias("_low"), F.max(F.greatest(*own) if len(own) > 1 else F.col(own[0])).alias("_high"))
    f = lambda c: F.when(F.col("_high") == F.col("_low"), F.lit(low)).otherwise((F.col(c) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * (high - low) + low)
    return img.join(ends, "image_id").select(*AT, *(f(c).alias(c) for c in own))


def normalize(img: DataFrame) -> DataFrame:
    """Samples of each image scaled so that the greatest is 255, rounded."""
    own = channels(img)
    top = img.groupBy("image_id").agg(F.max(F.greatest(*own) if len(own) > 1 else F.col(own[0])).alias("_high"))
    return img.join(top, "image_id").select(*AT, *(F.round(F.try_divide(F.col(c) * 255, F.col("_high"))).alias(c) for c in own))


def brightness(img: DataFrame) -> DataFrame:
    """Luma of colour pixels; gray ones stay."""
    if len(channels(img)) < 3:
        return img.select(*AT, "c0")
    return img.select(*AT, (0.2125 * F.col("c0") + 0.7154 * F.col("c1") + 0.0721 * F.col("c2")).alias("c0"))


def is_valid(img: DataFrame, depth: int = 8) -> DataFrame:
    """(image_id, valid): all samples whole and within the bit depth."""
    ok = F.lit(True)
    for c in channels(img):
        ok = ok & F.col(c).between(0, 2**depth - 1) & (F.col(c) == F.floor(c))
    return img.groupBy("image_id").agg(F.bool_and(ok).alias("valid"))


#: A 4 x 4 ordered dithering mask (fixed values).
DITHER = [[1, 9, 3, 11], [13, 5, 15, 7], [4, 12, 2, 10], [16, 8, 14, 6]]


def dither(img: DataFrame) -> DataFrame:
    """The mask's value where a sample passes its threshold, else 0."""
    mask = F.expr("array(" + ", ".join(str(float(v)) + "D" for row in DITHER for v in row) + ")")
    value = F.get(mask, (F.col("y") % 4 * 4 + F.col("x") % 4).cast("int"))
    return mapped(img, lambda v: F.when(v > F.lit(255.0) / 17 * value, value).otherwise(0.0))


def get_channel(img: DataFrame, k: int) -> DataFrame:
    if f"c{k}" not in img.columns:
        raise ValueError(f"no channel {k}")
    return img.select(*AT, F.col(f"c{k}").alias("c0"))


def inside(img: DataFrame, x: int | None, y: int | None, condition: Column | None = None) -> DataFrame:
    """The pixels that a condition holds for, all without one; an image without column x or row y raises.

    The test of the size and the condition are one predicate, so that Spark doesn't drop
    the test where the condition holds nowhere.
    """
    from .geometry import with_sizes

    keep = F.lit(True) if condition is None else condition
    for axis, v, n in (("column", x, "w"), ("row", y, "h")):
        if v is not None:
            keep = F.when((F.lit(v) >= 0) & (F.col(n) > v), keep).otherwise(F.raise_error(F.concat(F.lit(f"{axis} {v} is outside 0.."), F.col(n) - 1)).cast("boolean"))
    return with_sizes(img).where(keep).select(*AT, *channels(img))


def get_row(img: DataFrame, k: int, y: int) -> DataFrame:
    """(image_id, x, c0): a row of channel k; one outside an image raises."""
    get_channel(img, k)
    return inside(img, None, y, F.col("y") == y).select("image_id", "x", F.col(f"c{k}").alias("c0"))


def get_pixel(img: DataFrame, x: int, y: int) -> DataFrame:
    """The pixel at (x, y) of each image; a place outside raises, negative ones as well."""
    return inside(img, x, y, (F.col("x") == x) & (F.col("y") == y))


def set_pixel(img: DataFrame, x: int, y: int, values: Sequence[float]) -> DataFrame:
    """Each image with other values at (x, y); a place outside raises."""
    own = channels(img)
    if len(values) != len(own):
        raise ValueError("one value for each channel")
    here = (F.col("x") == x) & (F.col("y") == y)
    return inside(img, x, y).select(*AT, *(F.when(here, float(v)).otherwise(F.col(c)).alias(c) for c, v in zip(own, values)))


def select(img: DataFrame, condition: Column) -> DataFrame:
    """The pixels that a condition on channels and coordinates holds for."""
    return img.where(condition)


def any_all_count(img: DataFrame, some: Column, every: Column, counted: Column) -> DataFrame:
    """(image_id, any, all, n): whether a condition holds anywhere, whether one holds everywhere, and how often one does."""
    return img.groupBy("image_id").agg(F.bool_or(some).alias("any"), F.bool_and(every).alias("all"), F.count_if(counted).alias("n"))


def set_channel(img: DataFrame, k: int, value: DataFrame | float) -> DataFrame:
    """Channel k replaced by a one-channel image or a number."""
    if f"c{k}" not in img.columns:
        raise ValueError(f"no channel {k}")
    if isinstance(value, DataFrame):
        return joined(img, value).select(*AT, *(F.col("o0" if c == f"c{k}" else c).alias(c) for c in channels(img)))
    return img.withColumn(f"c{k}", F.lit(float(value)))


def stack(*images: DataFrame) -> DataFrame:
    """One to four one-channel images as the channels of one."""
    if not 1 <= len(images) <= 4 or any(channels(i) != ["c0"] for i in images):
        raise ValueError("one to four one-channel images")
    out = images[0]
    for k, img in enumerate(images[1:], 1):
        out = joined(out, img).withColumnRenamed("o0", f"c{k}")
    return out


def to_gray(img: DataFrame) -> DataFrame:
    """Rounded luma; alpha stays."""
    own = channels(img)
    if len(own) < 3:
        return img
    gray = F.round(0.299 * F.col("c0") + 0.587 * F.col("c1") + 0.114 * F.col("c2")).alias("c0")
    return img.select(*AT, gray, *([F.col("c3").alias("c1")] if len(own) == 4 else []))


def to_rgb(img: DataFrame) -> DataFrame:
    own = channels(img)
    return img.select(*AT, *(F.col("c0" if len(own) < 3 else f"c{k}").alias(f"c{k}") for k in range(3)))


def to_rgba(img: DataFrame) -> DataFrame:
    """Gray is repeated; a missing alpha is 255."""
    own = channels(img)
    alpha = {2: F.col("c1"), 4: F.col("c3")}.get(len(own), F.lit(255.0))
    return img.select(*AT, *(F.col("c0" if len(own) < 3 else f"c{k}").alias(f"c{k}") for k in range(3)), alpha.alias("c3"))


def remove_alpha(img: DataFrame) -> DataFrame:
    return img.drop({2: "c1", 4: "c3"}.get(len(channels(img)), ""))


def map_channels(img: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each channel, as a one-channel image, through f, which keeps the size."""
    return stack(*(f(get_channel(img, k)) for k in range(len(channels(img)))))
