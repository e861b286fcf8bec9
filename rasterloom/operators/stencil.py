"""Convolution, blurring, gradients and morphology.

Images are cut into tiles that carry what they read of their neighbours, borders included
(`tiles`); smaller images are a tile each, and a task works on many.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .geometry import with_sizes
from .pixels import AT, channels

BORDERS = ("zero", "symmetric", "replicate", "circular")
Kernel = Sequence[Sequence[float]]


def convolve(img: DataFrame, kernel: Kernel | Sequence[Kernel], border: str = "zero") -> DataFrame:
    """True convolution, the kernel turned by half a circle, its centre at half its size, the output as large as the input.

    A kernel of one channel is used for all channels; a list of as many kernels of one
    size as the image has channels gives each channel its own.
    """
    return _convolved(img, kernel, border).select(*AT, *channels(img))


def _convolved(img: DataFrame, kernel: Kernel | Sequence[Kernel], border: str) -> DataFrame:
    """The same, with sizes in columns h and w, for passes that follow."""
    if border not in BORDERS:
        raise ValueError(f"border is one of {BORDERS}")
    own = channels(img)
    many = isinstance(kernel[0][0], Sequence)
    kernels = list(kernel) if many else [kernel] * len(own)
    if len(kernels) != len(own) or len({(len(k), len(k[0])) for k in kernels}) != 1:
        raise ValueError("one kernel, or one of the same size for each channel")
    kh, kw = len(kernels[0]), len(kernels[0][0])
    # out[y] = sum of k[kh-1-i] * img[y - kh//2 + i]
    return tiles.stencil(img, (kh // 2, kh - 1 - kh // 2, kw // 2, kw - 1 - kw // 2), border, 0.0, tiles.weighted(kernels))


def gaussian(sigma: float = 1.0, cutoff: float | None = None) -> list[float]:
    """A normalised Gaussian over -ceil(cutoff)..ceil(cutoff); the cutoff is 3 sigma unless given."""
    n = math.ceil(3 * sigma if cutoff is None else cutoff)
    g = [math.exp(-(x * x) / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma) for x in range(-n, n + 1)]
    return [v / sum(g) for v in g]


def gaussian_deriv(sigma: float = 1.0, cutoff: float | None = None) -> list[float]:
    cutoff = 3.5 * sigma if cutoff is None else cutoff
    n = math.ceil(cutoff)
    return [-(g * x) / (sigma * sigma) for g, x in zip(gaussian(sigma, cutoff), range(-n, n + 1))]


def _row(values: list[float]) -> Kernel:
    return [values]


def _column(values: list[float]) -> Kernel:
    return [[v] for v in values]


def blur(img: DataFrame, sigma: float = 1.0, border: str = "replicate") -> DataFrame:
    """Two one-dimensional passes."""
    g = gaussian(sigma)
    return convolve(_convolved(img, _row(g), border), _column(g), border)


def gradient(img: DataFrame, sigma: float = 1.0, border: str = "replicate") -> DataFrame:
    """Derivatives of a one-channel image along x and y as channels c0 and c1."""
    d, g = gaussian_deriv(sigma), gaussian(sigma)
    img = with_sizes(img)
    dx = convolve(_convolved(img, _row(d), border), _column(g), border)
    dy = convolve(_convolved(img, _column(d), border), _row(g), border)
    return dx.join(dy.select(*AT, F.col("c0").alias("c1")), AT)


def magnitude_and_angle(grad: DataFrame) -> DataFrame:
    return grad.select(*AT, F.sqrt(F.col("c0") ** 2 + F.col("c1") ** 2).alias("c0"), F.atan2("c1", "c0").alias("c1"))


def _morph(img: DataFrame, element: Kernel, sign: int) -> DataFrame:
    h, w = len(element), len(element[0])
    above, left = (h - 1 - h // 2, w - 1 - w // 2) if sign > 0 else (h // 2, w // 2)
    return tiles.stencil(img, (above, h - 1 - above, left, w - 1 - left), "zero", float("-inf") * sign, tiles.extremum(element, sign)).select(*AT, *channels(img))


def dilate(img: DataFrame, element: Kernel) -> DataFrame:
    """The greatest of img[p - s] + element[s]; cells of minus infinity are left out, pixels outside ignored."""
    return _morph(img, element, 1)


def erode(img: DataFrame, element: Kernel) -> DataFrame:
    """The least of img[p + s] - element[s]."""
    return _morph(img, element, -1)


def opened(img: DataFrame, element: Kernel) -> DataFrame:
    return dilate(erode(img, element), element)


def closed(img: DataFrame, element: Kernel) -> DataFrame:
    return erode(dilate(img, element), element)
