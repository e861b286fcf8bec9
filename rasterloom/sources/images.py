"""Image files as tables, and tables as image files. Decoding and encoding run per file in Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..functions.chunks import file_type
from . import codec

HEADER = "image_id long, format string, width int, height int, bit_depth int, color_type int, channels int, interlace int, has_alpha boolean, n_frames int, n_plays int, background array<int>, warnings array<string>, error string"
CHUNKS = "image_id long, seq int, type string, data binary, pos string, crc_ok boolean"
ROWS = "y long, channels int, vals array<double>"
_PARTS = "array<struct<seq: int, type: string, data: binary, pos: string>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, content) of image files; the id is a hash of the path."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("image_id"), "path", "content")


#: Bytes of files that a Python task holds at a time as objects, beside the Arrow batch that they come in.
SLICE_BYTES = 1 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in views of about SLICE_BYTES, at least a row each. What a task makes of one is handed on before the next."""
    for batch in batches:
        n = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.get_total_buffer_size()))
        for at in range(0, max(1, batch.num_rows), n):
            yield batch.slice(at, n)


def formats(files: DataFrame) -> DataFrame:
    return files.select("image_id", file_type(F.col("content")).alias("format"))


def _decoded(contents: list[bytes | None], errors: str = "keep", **options) -> Iterator[tuple[int, codec.Image | None, str | None]]:
    """(place, image, error) of each file. errors: keep gives a broken file's error, skip leaves it out, raise fails."""
    for i, content in enumerate(contents):
        try:
            yield i, codec.decode(content or b"", **options), None
        except Exception as e:  # noqa: BLE001  a broken deflate stream has errors of its own
            if errors == "raise":
                raise
            if errors == "keep":
                yield i, None, f"{type(e).__name__ if isinstance(e, (codec.ImageError, ValueError, OSError, EOFError)) else 'ImageError'}: {e}"


def _mode(errors: str) -> str:
    if errors not in ("raise", "skip"):
        raise ValueError("errors is raise or skip")
    return errors


def headers(files: DataFrame, skip_crc: bool = False, skip_ancillary: bool = False) -> DataFrame:
    """A row for each file (image_id, content): its header, without inflating pixels; broken files have an error instead."""
    names = [x.split()[0] for x in HEADER.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 6, pa.bool_(), *[pa.int32()] * 2, pa.list_(pa.int32()), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for i, im, error in _decoded(batch.column(1).to_pylist(), only_metadata=True, skip_crc=skip_crc, skip_ancillary=skip_ancillary):
                told = [None] * 12 if im is None else [im.format, im.width, im.height, im.bit_depth, im.color_type, codec.CHANNELS[im.color_type], im.interlace, im.has_alpha, im.n_frames, im.n_plays, im.background, im.warnings]
                rows.append([batch.column(0)[i].as_py(), *told, error])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    return files.select("image_id", "content").mapInArrow(run, HEADER)


def chunks(files: DataFrame, skip_ancillary: bool = False, skip_crc: bool = False, errors: str = "raise") -> DataFrame:
    """The chunks of PNG files in order. A broken file fails the query unless errors is skip."""
    mode = _mode(errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [(batch.column(0)[i].as_py(), k, *c) for i, im, _ in _decoded(batch.column(1).to_pylist(), mode, only_metadata=True, skip_ancillary=skip_ancillary, skip_crc=skip_crc) for k, c in enumerate(im.chunks)]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], [x.split()[0] for x in CHUNKS.split(", ")])

    return files.select("image_id", "content").mapInArrow(run, CHUNKS)


def _lines(im: codec.Image) -> list[pa.Array]:
    """The y, channels and vals of an image's rows."""
    h, w, n = im.samples.shape
    vals = pa.ListArray.from_arrays(pa.array(np.arange(0, h * w * n + 1, w * n, dtype=np.int32)), pa.array(im.samples.reshape(-1).astype(float)))
    return [pa.array(np.arange(h)), pa.array([n] * h, pa.int32()), vals]


def rows(files: DataFrame, by: Sequence[str] = ("image_id",), skip_ancillary: bool = False, skip_crc: bool = False, errors: str = "raise") -> DataFrame:
    """The sample rows of files (by..., y, channels, vals); pixels follow by `relations.from_rows`. A broken file fails the query unless errors is skip.

    skip_ancillary leaves colour keys out as well.
    """
    mode, by = _mode(errors), list(by)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*by).schema.fields), ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, im, _ in _decoded(batch.column(len(by)).to_pylist(), mode, skip_ancillary=skip_ancillary, skip_crc=skip_crc):
                lines = _lines(im)
                ids = [pa.array([batch.column(k)[i].as_py()] * len(lines[0]), batch.schema.field(k).type) for k in range(len(by))]
                yield pa.RecordBatch.from_arrays([*ids, *lines], [*by, "y", "channels", "vals"])

    return files.select(*by, "content").mapInArrow(run, schema)


def encode(
    sample_rows: DataFrame, n: int, kind: str = "png", level: int = 0, bit_depth: int = 8, chunks: DataFrame | None = None, skip_ancillary: bool = False, background: Sequence[float] | None = None, by: Sequence[str] = ("image_id",), interlace: bool = False
) -> DataFrame:
    """(by..., content): image files of rows (by..., y, vals) of n channels. One image is encoded in one task; `bands.encode` spreads one over many.

    An image whose rows don't run from 0 without gaps or repetitions, or differ in length, raises.

    chunks (by..., seq, type, data, pos) are written into PNG files, ancillary ones only, in
    the order of seq at their place: pos, or where it is null that of their kind;
    skip_ancillary leaves them out. PNG files may be interlaced. BMP files blend alpha onto background, if given.
    """
    if kind not in ("png", "bmp"):
        raise ValueError("png or bmp")
    by = list(by)
    whole = sample_rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("y", "vals"))).alias("p")).select(*by, F.col("p.vals").alias("p"), F.col("p.y").cast("array<bigint>").alias("ys"))
    if chunks is None or skip_ancillary or kind == "bmp":
        whole = whole.withColumn("more", F.lit(None).cast(_PARTS))
    else:
        place = F.coalesce("pos", registry.position(F.col("type"))).alias("pos")
        parts = chunks.where("substr(type, 1, 1) between 'a' and 'z'").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "type", "data", place))).alias("more"))
        whole = whole.join(parts, by, "left")
    fields = whole.select(*by).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "content binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out, pixels, ys, more = [], *(batch.column(len(by) + k) for k in range(2)), batch.column(len(by) + 2).to_pylist()
            for i in range(batch.num_rows):
                lines = pixels[i].values
                if ys[i].as_py() != list(range(len(lines))) or len(set(lines.value_lengths().to_pylist())) > 1:
                    raise codec.ImageError("an image lacks rows, or has rows twice or of unequal length")
                samples = lines.flatten().to_numpy().reshape(len(lines), -1, n)
                ancillary = [(c["type"], c["data"], c["pos"]) for c in more[i] or ()]
                out.append(codec.encode_bmp(samples, background) if kind == "bmp" else codec.encode_png(samples, bit_depth, level, ancillary, interlace=int(interlace)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(out, pa.binary())], [*by, "content"])

    return whole.mapInArrow(run, schema)


def save(files: DataFrame, path: str, kind: str = "png") -> None:
    """Write (image_id, content) as files of their own, <image_id>.<kind>, into a folder of any file system that pyarrow knows by its address. A failed write leaves no file."""
    from . import datasource

    datasource.register(files.sparkSession)
    files.select("image_id", "content").write.format("raster").option("kind", kind).mode("append").save(path)
