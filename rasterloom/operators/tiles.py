"""Stencils over packed tiles.

Pixels are packed into square tiles; each tile sends the strips that its neighbours read to
them, borders included, so a tile with its halo is put together in one task and worked on
with numpy at once. What is shuffled is the pixels once and a strip for each neighbour,
whatever the number of kernel cells. Tiles stream through their tasks one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import with_sizes
from .pixels import channels

SIDE = 64
_PIECE = "image_id long, ty long, tx long, h long, w long, sy long, sx long, ys array<long>, xs array<long>, data binary"


def border_index(i: np.ndarray, n: int, border: str) -> np.ndarray:
    """The index in 0..n-1 that a border takes for each index, -1 for none."""
    if border == "replicate":
        return np.clip(i, 0, n - 1)
    if border == "circular":
        return i % n
    if border == "symmetric":
        period = max(2 * (n - 1), 1)
        j = i % period
        return np.minimum(j, period - j) if n > 1 else np.zeros_like(i)
    return np.where((i >= 0) & (i < n), i, -1)


def _read_by(tile: int, n: int, before: int, after: int, border: str, side: int) -> np.ndarray:
    """What a tile reads along an axis: source indexes for its padded positions."""
    return border_index(np.arange(tile * side - before, min((tile + 1) * side, n) + after), n, border)


def _readers(tile: int, n: int, before: int, after: int, border: str, side: int) -> list[int]:
    """Tiles that may read this one: those in reach, and those that a border leads to it."""
    count = -(-n // side)
    far = -(-max(before, after) // side) + 1
    near = range(max(0, tile - far), min(count, tile + far + 1))
    round_ = {t % count for t in range(tile - far - 1, tile + far + 2)} if border == "circular" else set()
    return sorted({*near, *round_})


def _blocks(img: DataFrame, side: int) -> DataFrame:
    """(image_id, ty, tx, h, w, p): the pixels of each tile, as (place in it, samples)."""
    own = channels(img)
    place = ((F.col("y") % side) * side + F.col("x") % side).cast("int")
    at = [F.expr(f"{a} div {side}").alias(f"t{a}") for a in "yx"]
    return with_sizes(img).groupBy("image_id", *at, F.col("h").cast("bigint").alias("h"), F.col("w").cast("bigint").alias("w")).agg(F.collect_list(F.struct(place.alias("i"), *own)).alias("p"))


def _lists(columns: list[list[np.ndarray]]) -> list[pa.Array]:
    """Arrow lists of the arrays of each column."""
    return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(v) for v in c)]), pa.int32()), pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64())) for c in columns]


def stencil(img: DataFrame, reach: tuple[int, int, int, int], border: str, fill: float, work: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """work over the tiles of img, each with a halo of (above, below, left, right) pixels; outside, and where pixels are missing, is `fill`.

    work gets channels x rows x columns with the halo and gives the same without it.
    """
    own, n = channels(img), len(channels(img))
    above, below, left, right = reach

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, ty, tx, h, w = (batch.column(k).to_numpy() for k in range(5))
            lists = batch.column(5)
            heads, ys, xs, data = [], [], [], []
            for r in range(batch.num_rows):
                p = lists[r].values
                i = p.field(0).to_numpy()
                full = np.full((n, side * side), fill)
                for c in range(n):
                    full[c, i] = p.field(c + 1).to_numpy(zero_copy_only=False)
                full = full.reshape(n, side, side)
                rows = [(t, _read_by(t, h[r], above, below, border, side)) for t in _readers(ty[r], h[r], above, below, border, side)]
                cols = [(t, _read_by(t, w[r], left, right, border, side)) for t in _readers(tx[r], w[r], left, right, border, side)]
                rows = [(t, u[u // side == ty[r]]) for t, v in rows for u in [np.unique(v[v >= 0])]]
                cols = [(t, u[u // side == tx[r]]) for t, v in cols for u in [np.unique(v[v >= 0])]]
                for a, y in rows:
                    for b, x in cols:
                        if len(y) and len(x):
                            heads.append((image[r], a, b, h[r], w[r], ty[r], tx[r]))
                            ys.append(y)
                            xs.append(x)
                            data.append(full[:, y[:, None] % side, x % side].tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (zip(*heads) if heads else [[]] * 7)), *_lists([ys, xs]), pa.array(data, pa.binary())], [x.split()[0] for x in _PIECE.split(", ")])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            fixed = [batch.column(k).to_pylist() for k in range(5)]
            for r in range(batch.num_rows):
                here = tuple(c[r] for c in fixed)
                if here[:3] != (key or here)[:3]:
                    yield done(key, held)
                    held = []
                key = here
                held.append((batch.column(7)[r].values.to_numpy(), batch.column(8)[r].values.to_numpy(), batch.column(9)[r].as_py()))
        if key is not None:
            yield done(key, held)

    def done(key: tuple, held: list) -> pa.RecordBatch:
        image, ty, tx, h, w = key
        ry, rx = _read_by(ty, h, above, below, border, side), _read_by(tx, w, left, right, border, side)
        source_y, source_x = np.unique(ry[ry >= 0]), np.unique(rx[rx >= 0])
        whole = np.full((n, len(source_y), len(source_x)), fill)
        for ys, xs, data in held:
            whole[:, np.searchsorted(source_y, ys)[:, None], np.searchsorted(source_x, xs)] = np.frombuffer(data).reshape(n, len(ys), len(xs))
        padded = whole[:, np.searchsorted(source_y, ry).clip(0, len(source_y) - 1)[:, None], np.searchsorted(source_x, rx).clip(0, len(source_x) - 1)]
        padded[:, ry < 0, :], padded[:, :, rx < 0] = fill, fill
        out = work(padded)
        y, x = np.arange(ty * side, ty * side + out.shape[1]), np.arange(tx * side, tx * side + out.shape[2])
        at = [np.full(out[0].size, image), np.repeat(y, len(x)), np.tile(x, len(y)), np.full(out[0].size, h), np.full(out[0].size, w)]
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in at), *(pa.array(c.reshape(-1)) for c in out)], ["image_id", "y", "x", "h", "w", *own])

    pieces = _blocks(img, side).mapInArrow(send, _PIECE).repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx")
    return pieces.mapInArrow(receive, "image_id long, y long, x long, h long, w long, " + ", ".join(f"{c} double" for c in own))


def weighted(kernels: list[list[list[float]]]) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of neighbours by the cells of each channel's kernel, in the order in which they are laid over the image."""
    k = np.array(kernels, float)[:, ::-1, ::-1]

    def work(padded: np.ndarray) -> np.ndarray:
        kh, kw = k.shape[1:]
        out = np.zeros((len(padded), padded.shape[1] - kh + 1, padded.shape[2] - kw + 1))
        for i in range(kh):
            for j in range(kw):
                if k[:, i, j].any():
                    out += k[:, i, j][:, None, None] * padded[:, i : i + out.shape[1], j : j + out.shape[2]]
        return out

    return work


def running(values: np.ndarray, width: int, best: np.ufunc, none: float) -> np.ndarray:
    """The best of each `width` neighbours along the last axis: of blocks of that width, the best so far and the best from here on meet in every window, so the work doesn't grow with it."""
    n = values.shape[-1]
    fill = np.full((*values.shape[:-1], -n % width), none)
    blocks = np.concatenate([values, fill], -1).reshape(*values.shape[:-1], -1, width)
    upto = best.accumulate(blocks, -1).reshape(*values.shape[:-1], -1)
    onward = best.accumulate(blocks[..., ::-1], -1)[..., ::-1].reshape(*values.shape[:-1], -1)
    return best(onward[..., : n - width + 1], upto[..., width - 1 : n])


def extremum(element: list[list[float]], sign: int) -> Callable[[np.ndarray], np.ndarray]:
    """The greatest of neighbours plus an element's cells (sign 1), or the least of neighbours less them (sign -1). Flat rectangles take two running passes."""
    e = np.array(element, float)
    if sign > 0:
        e = e[::-1, ::-1]
    best, none = (np.maximum, -np.inf) if sign > 0 else (np.minimum, np.inf)

    def work(padded: np.ndarray) -> np.ndarray:
        if np.isfinite(e[0, 0]) and (e == e[0, 0]).all():
            rows = running(padded, e.shape[1], best, none)
            return running(rows.swapaxes(1, 2), e.shape[0], best, none).swapaxes(1, 2) + sign * e[0, 0]
        out = np.full((len(padded), padded.shape[1] - e.shape[0] + 1, padded.shape[2] - e.shape[1] + 1), none)
        for i, j in np.argwhere(e != -np.inf):
            best(out, padded[:, i : i + out.shape[1], j : j + out.shape[2]] + sign * e[i, j], out=out)
        return out

    return work
