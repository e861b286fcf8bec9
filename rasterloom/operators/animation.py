"""Animations: frames (image_id, frame, w, h, x_off, y_off, delay_num, delay_den, dispose, blend) and frame pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import BLEND, DISPOSE


def delay() -> Column:
    """Seconds of a frame; a denominator of 0 counts as 100."""
    return F.col("delay_num") / F.when(F.col("delay_den") == 0, 100).otherwise(F.col("delay_den"))


def animation_time(frames: DataFrame) -> DataFrame:
    """(image_id, seconds, n_frames)"""
    return frames.groupBy("image_id").agg(F.sum(delay()).alias("seconds"), F.count("*").alias("n_frames"))


def frame_at(frames: DataFrame, n: int) -> DataFrame:
    """The frame that a jump to n shows; n wraps around."""
    count = frames.groupBy("image_id").agg(F.count("*").alias("_n"))
    return frames.join(count, "image_id").where(F.col("frame") == F.pmod(F.lit(n).cast("bigint"), F.col("_n"))).drop("_n")


def pop_frame(frames: DataFrame) -> DataFrame:
    """All frames but each image's last."""
    last = frames.groupBy("image_id").agg(F.max("frame").alias("_last"))
    return frames.join(last, "image_id").where("frame < _last").drop("_last")


def push_frame(frames: DataFrame, frame: DataFrame) -> DataFrame:
    """A frame (one row for each image, without a number) after the last one."""
    last = frames.groupBy("image_id").agg((F.max("frame") + 1).alias("frame"))
    return frames.unionByName(frame.join(last, "image_id").select(frames.columns))


#: What a frame that is pushed has unless it is told.
PUSHED = {"x_off": 0, "y_off": 0, "delay_num": 1, "delay_den": 24, "dispose": "none", "blend": "source"}


def push(frames: DataFrame, pixels: DataFrame, new: DataFrame, new_pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames and pixels with a frame more for each image of new (image_id, w, h, and any of PUSHED), its pixels (image_id, y, x, c0...) cut to the canvas.

    The canvas is the first frame. A frame that is larger, has other channels, a delay that
    isn't between 0 and 65535, or an unknown way of disposal or blending raises; what lies
    outside is as of `cropped`.
    """
    own = [c for c in pixels.columns if c not in ("image_id", "frame", "y", "x")]
    if [c for c in new_pixels.columns if c not in ("image_id", "y", "x")] != own:
        raise ValueError("a pushed frame has the channels of the others")
    ok = F.col("delay_num").between(0, 0xFFFF) & F.col("delay_den").between(0, 0xFFFF) & F.col("dispose").isin(*DISPOSE) & F.col("blend").isin(*BLEND)
    after = frames.groupBy("image_id").agg((F.max("frame") + 1).alias("frame"), F.max(F.when(F.col("frame") == 0, F.struct("w", "h"))).alias("_canvas"))
    told = new.select("image_id", "w", "h", *(F.coalesce(c, F.lit(v)).alias(c) if c in new.columns else F.lit(v).alias(c) for c, v in PUSHED.items())).join(after, "image_id")
    told = told.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a delay or an operation of a pushed frame is out of range")).cast("boolean")))
    told = told.select(*(F.col(c).cast(frames.schema[c].dataType).alias(c) for c in frames.columns), "_canvas")
    cut, kept = cropped(told, new_pixels.join(after.select("image_id", "frame"), "image_id").select("image_id", "frame", "y", "x", *own), F.col("_canvas.w"), F.col("_canvas.h"))
    return frames.unionByName(cut.select(frames.columns)), pixels.unionByName(kept.select(pixels.columns))


def cropped(frames: DataFrame, pixels: DataFrame, w: int | Column, h: int | Column) -> tuple[DataFrame, DataFrame]:
    """Frames with offsets of any sign, and their pixels (image_id, frame, y, x, c0...), cut to a canvas of w x h.

    A frame that is larger than the canvas raises. One that lies outside becomes a
    transparent pixel at the origin that is blended over, or raises where there is no alpha.
    """
    own = [c for c in pixels.columns if c not in ("image_id", "frame", "y", "x")]
    col = F.col
    fits = F.when((col("w") <= w) & (col("h") <= h), True).otherwise(F.raise_error(F.lit("a frame is larger than the canvas")).cast("boolean"))
    cut = frames.where(fits).withColumns({"_l": F.greatest(-col("x_off"), F.lit(0)), "_t": F.greatest(-col("y_off"), F.lit(0))})
    cut = cut.withColumns({"_r": F.least(w - 1 - col("x_off"), col("w") - 1), "_b": F.least(h - 1 - col("y_off"), col("h") - 1)})
    empty = (col("_l") > col("_r")) | (col("_t") > col("_b"))
    if len(own) not in (2, 4):
        empty = F.when(empty, F.raise_error(F.lit("an empty frame needs an image with alpha")).cast("boolean")).otherwise(False)
    cut = cut.withColumn("_e", empty)
    new = {"w": col("_r") - col("_l") + 1, "h": col("_b") - col("_t") + 1, "x_off": F.greatest("x_off", F.lit(0)), "y_off": F.greatest("y_off", F.lit(0))}
    out = cut.withColumns({c: F.when(col("_e"), {"w": 1, "h": 1}.get(c, 0)).otherwise(v).cast(frames.schema[c].dataType) for c, v in new.items()})
    out = out.withColumn("blend", F.when(col("_e"), "over").otherwise(col("blend"))).select(frames.columns)
    seen = pixels.join(cut.select("image_id", "frame", "_l", "_t", "_r", "_b", "_e"), ["image_id", "frame"])
    kept = seen.where(~col("_e") & col("x").between(col("_l"), col("_r")) & col("y").between(col("_t"), col("_b"))).select("image_id", "frame", (col("y") - col("_t")).alias("y"), (col("x") - col("_l")).alias("x"), *own)
    zero = F.lit(0).cast("bigint")
    return out, kept.unionByName(cut.where("_e").select("image_id", "frame", zero.alias("y"), zero.alias("x"), *(F.lit(0.0).alias(c) for c in own)))


def _at(frames: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """frames, and whether a row is frame n of its image, counted from the end if negative. An animation of |n| frames or fewer raises."""
    count = frames.groupBy("image_id").agg(F.count("*").alias("_n"))
    fits = F.when(F.col("_n") > abs(n), True).otherwise(F.raise_error(F.concat(F.lit(f"no frame {n} among "), F.col("_n"))).cast("boolean"))
    return frames.join(count.where(fits), "image_id"), F.col("frame") == (F.lit(n) if n >= 0 else F.col("_n") + n)


def set_delay(frames: DataFrame, n: int, num: int, den: int) -> DataFrame:
    if not (0 <= num <= 0xFFFF and 0 <= den <= 0xFFFF):
        raise ValueError("delays are between 0 and 65535")
    df, here = _at(frames, n)
    return df.withColumns({"delay_num": F.when(here, num).otherwise(F.col("delay_num")), "delay_den": F.when(here, den).otherwise(F.col("delay_den"))}).drop("_n")


def set_offset(frames: DataFrame, n: int, x: int, y: int) -> DataFrame:
    """Frame n moved to (x, y). The first frame stays where it is, and none may reach beyond it."""
    df, here = _at(frames, n)
    heads = frames.where("frame = 0").select("image_id", F.col("w").alias("_w"), F.col("h").alias("_h"))
    ok = (F.col("frame") > 0) & (F.col("w") + x <= F.col("_w")) & (F.col("h") + y <= F.col("_h")) & F.lit(x >= 0 and y >= 0)
    moved = F.when(here & ~ok, F.raise_error(F.lit("the first frame can't be moved, nor another beyond it")).cast("int"))
    df = df.join(heads, "image_id")
    return df.withColumns({c: F.when(here, F.coalesce(moved, F.lit(v)).cast(frames.schema[c].dataType)).otherwise(F.col(c)) for c, v in (("x_off", x), ("y_off", y))}).select(frames.columns)


def last_write(pixels: DataFrame) -> DataFrame:
    """What is seen after all frames (image_id, frame, y, x, c0...) that overwrite and keep: the last one at each place."""
    own = [c for c in pixels.columns if c not in ("image_id", "frame", "y", "x")]
    return pixels.groupBy("image_id", "y", "x").agg(F.max_by(F.struct(*own), "frame").alias("v")).select("image_id", "y", "x", "v.*")


def composed_source(pixels: DataFrame) -> DataFrame:
    """Every frame's canvas for frames that overwrite and keep: the last value at each place so far."""
    w = Window.partitionBy("image_id", "y", "x").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.select("image_id", "frame", "y", "x", F.last("c0", ignorenulls=True).over(w).alias("c0"))


def over(fg: np.ndarray, bg: np.ndarray) -> np.ndarray:
    """Pixels with alpha last over others, truncated to whole samples."""
    af, ab = fg[..., -1:] / 255.0, bg[..., -1:] / 255.0
    alpha = af + ab * (1 - af)
    color = np.floor((fg[..., :-1] * af + bg[..., :-1] * ab * (1 - af)) / np.where(alpha == 0, 1, alpha))
    mixed = np.concatenate([color, np.floor(255 * alpha)], -1)
    return np.where(fg[..., -1:] == 0, bg, np.where(fg[..., -1:] == 255, fg, mixed))


Before = tuple[int, int, int, int, str, np.ndarray]


def advance(canvas: np.ndarray, before: Before | None, px: np.ndarray, x: int, y: int, dispose: str, blend: str) -> Before:
    """Show a frame on the canvas: the one before is disposed of, its rectangle kept aside, then the frame is blended. Gives what the next frame needs to know."""
    if before is not None:
        bx, by, bh, bw, how, saved = before
        if how == "background":
            canvas[by : by + bh, bx : bx + bw] = 0
        elif how == "previous":
            canvas[by : by + bh, bx : bx + bw] = saved
    h, w = px.shape[:2]
    area = (slice(y, y + h), slice(x, x + w))
    after = (x, y, h, w, "background" if before is None and dispose == "previous" else dispose, canvas[area].copy())
    canvas[area] = over(px, canvas[area]) if blend == "over" else px
    return after


def play(canvas: np.ndarray, frames: Iterator[tuple[np.ndarray, int, int, str, str]]) -> Iterator[np.ndarray]:
    """The canvas after each frame (pixels, x, y, dispose, blend)."""
    before = None
    for px, x, y, dispose, blend in frames:
        before = advance(canvas, before, px, x, y, dispose, blend)
        yield canvas


#: What a row of a canvas is after a frame: its samples, and the part that the frame covers, to be disposed of.
STATE = "canvas array<double>, part_x int, part_w int, dispose string, saved array<double>"
_STATE = [x.split()[0] for x in STATE.split(", ")]


def _folded(frames: DataFrame, pixels: DataFrame, w: int, h: int, n_channels: int, start: DataFrame | None, run, schema: str) -> DataFrame:
    """run over the rows of each image's canvas, frame after frame, as a stream: whatever the number of frames, a task holds one row's state and one batch."""
    names = [f"c{k}" for k in range(n_channels)]
    bands = pixels.groupBy("image_id", "frame", F.col("y").alias("_in")).agg(F.sort_array(F.collect_list(F.struct("x", F.array(*names).alias("v")))).alias("_px"))
    bands = bands.select("image_id", "frame", "_in", F.flatten("_px.v").alias("_px"))
    shown = frames.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("_in", (F.col("y") - F.col("y_off")).cast("bigint"))
    rows = shown.join(bands, ["image_id", "frame", "_in"], "left").select("image_id", "frame", F.col("y").cast("bigint").alias("y"), "x_off", F.col("dispose").alias("how"), "blend", F.col("_px").alias("px"))
    none = rows.sparkSession.createDataFrame([], f"image_id long, frame long, y long, {STATE}") if start is None else start
    rows = rows.unionByName(none.select("image_id", "frame", "y", *_STATE), allowMissingColumns=True)
    return rows.repartition("image_id", "y").sortWithinPartitions("image_id", "y", "frame").mapInPandas(run, schema)


def _states(parts: Iterator[pd.DataFrame], w: int, n_channels: int) -> Iterator[list[tuple[int, int, int, np.ndarray, Before | None]]]:
    """(image_id, frame, y, canvas, what the next frame needs) after each row of _folded."""
    at, canvas, before = None, None, None
    for pdf in parts:
        out = []
        for r in pdf.itertuples(index=False):
            if (r.image_id, r.y) != at:
                at, canvas, before = (r.image_id, r.y), np.zeros((1, w, n_channels)), None
            if r.canvas is not None:
                canvas = np.asarray(r.canvas, float).reshape(1, w, n_channels).copy()
                before = (int(r.part_x), 0, 1, int(r.part_w), r.dispose, np.asarray(r.saved, float).reshape(1, -1, n_channels))
                continue
            px = np.zeros((1, 0, n_channels)) if r.px is None else np.asarray(r.px, float).reshape(1, -1, n_channels)
            before = advance(canvas, before, px, int(r.x_off), 0, r.how, r.blend)
            out.append((r.image_id, r.frame, r.y, canvas[0].copy(), before))
        yield out


def composed(frames: DataFrame, pixels: DataFrame, w: int, h: int, n_channels: int = 4, start: DataFrame | None = None) -> DataFrame:
    """(image_id, frame, y, x, c0...): the canvas after every frame.

    Blending and disposal act on each place alone, so the unit of state is one row of
    one image's canvas: its frames are folded in order as they stream by, and the rows of a
    long animation spread over the cluster. Pixels of a frame count from its own corner.
    With start, rows of `checkpoints`, frames are those that come after.
    """
    names = [f"c{k}" for k in range(n_channels)]
    schema = "image_id long, frame long, y long, x long, " + ", ".join(f"{c} double" for c in names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for states in _states(parts, w, n_channels):
            flat = np.concatenate([s[3] for s in states]) if states else np.zeros((0, n_channels))
            told = [np.repeat(np.array([s[k] for s in states], np.int64), w) for k in range(3)]
            yield pd.DataFrame({"image_id": told[0], "frame": told[1], "y": told[2], "x": np.tile(np.arange(w), len(states)), **{c: flat[:, k] for k, c in enumerate(names)}})

    return _folded(frames, pixels, w, h, n_channels, start, run, schema)


def checkpoints(frames: DataFrame, pixels: DataFrame, w: int, h: int, every: int, n_channels: int = 4) -> DataFrame:
    """(image_id, frame, y, STATE): what the rows of the canvas are after each frame before a multiple of `every`, for replays that begin there."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for states in _states(parts, w, n_channels):
            kept = [(i, f, y, c.reshape(-1), b[0], b[3], b[4], b[5].reshape(-1)) for i, f, y, c, b in states if (f + 1) % every == 0]
            yield pd.DataFrame(kept, columns=["image_id", "frame", "y", *_STATE])

    return _folded(frames, pixels, w, h, n_channels, None, run, f"image_id long, frame long, y long, {STATE}")


def canvas_at(frames: DataFrame, pixels: DataFrame, n: int, w: int, h: int, n_channels: int = 4, stored: DataFrame | None = None) -> DataFrame:
    """The canvas that a jump to frame n shows; n wraps around. Frames are replayed from the nearest of the stored checkpoints, or from the first one."""
    shown = frame_at(frames, n).select("image_id", F.col("frame").alias("_shown"))
    upto = frames.join(shown, "image_id").where("frame <= _shown")
    start = None
    if stored is not None:
        near = stored.select("image_id", "frame").distinct().join(shown, "image_id").where("frame < _shown").groupBy("image_id").agg(F.max("frame").alias("_from"))
        start = stored.join(near, "image_id").where("frame = _from").drop("_from")
        upto = upto.join(near, "image_id", "left").where("_from is null or frame > _from").drop("_from")
    done = composed(upto.drop("_shown"), pixels.join(upto.select("image_id", "frame"), ["image_id", "frame"], "left_semi"), w, h, n_channels, start)
    return done.join(shown, "image_id").where("frame = _shown").drop("_shown")
