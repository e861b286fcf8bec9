"""Image files as Spark data sources, after register(spark).

raster: rows of samples, read, and files, written. raster_headers and raster_chunks: what
stands in files besides pixels, read by seeking from chunk to chunk.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .codec import CHANNELS, MAGIC
from .images import ROWS, _decoded, _lines, _mode


@dataclass
class Files(InputPartition):
    paths: list[str]


class _FileReader(DataSourceReader):
    """Files are dealt into partitions of about partition_bytes."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.errors = _mode(options.get("errors", "raise"))
        self.skip = {k: options.get(k, "false").lower() == "true" for k in ("skip_ancillary", "skip_crc")}

    def partitions(self) -> list[Files]:
        store, at = fs.FileSystem.from_uri(self.path)
        here = store.get_file_info(at)
        if here.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if here.type == fs.FileType.Directory else [here]
        hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path[len(at) :].split("/")) if f.path != at else False
        out, size = [Files([])], 0
        for info in sorted((f for f in found if f.type == fs.FileType.File and not hidden(f)), key=lambda f: f.path):
            if size and size + self.weight(info) > self.partition_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(info.path)
            size += self.weight(info)
        return out

    def weight(self, info: fs.FileInfo) -> int:
        """The bytes that a file counts for when it is dealt."""
        return info.size


class RasterReader(_FileReader):
    """A file is decoded in one task, as rows."""

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                content = file.read()
            for _, im, _ in _decoded([content], self.errors, **self.skip):
                lines = _lines(im)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines[0])), *lines], ["path", "y", "channels", "vals"])


class _Ranges:
    """Ranged reads of a file, and how many bytes they were."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.bytes = file, 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        self.bytes += len(got)
        if len(got) < n:
            raise ValueError("the file is cut off")
        return got

    def chunks(self) -> Iterator[tuple[int, str, int]]:
        """Place, type and length of a PNG file's chunks; nothing of their data is read."""
        at, kind = len(MAGIC), ""
        while kind != "IEND":
            length, name = struct.unpack(">I4s", self.read(at, 8))
            kind = name.decode("latin-1")
            yield at, kind, length
            at += 12 + length


def _header(ranges: _Ranges) -> dict:
    """The header of a file, without what follows it up to the pixel data but colour keys and animation controls."""
    if ranges.read(0, 2) == b"BM":
        _, size, w, h, _, bits, how = struct.unpack("<IIiiHHI", ranges.read(10, 24))
        if size != 40 or bits != 24 or how or w < 1 or h < 1:
            raise ValueError("only 24 bits, uncompressed, with a header of 40 bytes")
        return {"format": "bmp", "width": w, "height": h, "bit_depth": 24, "color_type": 2, "channels": 3, "interlace": 0, "has_alpha": False}
    if ranges.read(0, 8) != MAGIC:
        raise ValueError("Unknown image format.")
    out: dict = {}
    for at, kind, length in ranges.chunks():
        if not out and kind != "IHDR":
            raise ValueError("IHDR comes first")
        if kind == "IHDR":
            w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", ranges.read(at + 8, 13))
            if color not in CHANNELS:
                raise ValueError("the header's values don't go together")
            out = {"format": "png", "width": w, "height": h, "bit_depth": depth, "color_type": color, "channels": CHANNELS[color], "interlace": lace, "has_alpha": color in (4, 6)}
        elif kind == "tRNS":
            out["has_alpha"] = True
        elif kind == "acTL" and length == 8:
            out["n_frames"], out["n_plays"] = struct.unpack(">II", ranges.read(at + 8, 8))
        elif kind == "IDAT":
            return out
    raise ValueError("no pixel data")


HEADERS = "path string, format string, width int, height int, bit_depth int, color_type int, channels int, interlace int, has_alpha boolean, n_frames long, n_plays long, read_bytes long, error string"
CHUNKS = "path string, seq int, type string, length long, at long, pos string, data binary, crc_ok boolean"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields], [n for n, _ in fields])


#: A batch of rows of many files goes on with so many rows, or bytes of data.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def _batches(files: Iterator[list[dict]], schema: str) -> Iterator[pa.RecordBatch]:
    """The rows of one file after another, in batches of bounded size."""
    rows, size = [], 0
    for told in files:
        rows += told
        size += sum(len(r.get("data") or b"") for r in told)
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(rows, schema)
            rows, size = [], 0
    yield _batch(rows, schema)


class HeaderReader(_FileReader):
    def weight(self, info: fs.FileInfo) -> int:
        return 4096  # a seek costs more than the bytes that are read

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _batches(self._told(partition), HEADERS)

    def _told(self, partition: Files) -> Iterator[list[dict]]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                ranges = _Ranges(file)
                try:
                    told = _header(ranges)
                except (ValueError, struct.error) as e:
                    told = {"error": str(e)}
                yield [{"path": path, "read_bytes": ranges.bytes, **told}]


class ChunkReader(_FileReader):
    """Only the kinds that a pushed filter on type asks for are read, and data only where a column needs it."""

    def __init__(self, options: dict[str, str], schema: str):
        super().__init__(options)
        self.schema = schema
        self.kinds: set[str] | None = None
        self.pixels = options.get("pixels", "false").lower() == "true"
        self.data = any(x.split()[0] in ("data", "crc_ok") for x in schema.split(", "))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("type",):
                kinds = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = kinds if self.kinds is None else self.kinds & kinds
            else:
                yield f

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _batches(self._told(partition), self.schema)

    def _told(self, partition: Files) -> Iterator[list[dict]]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            rows = []
            with store.open_input_file(path) as file:
                ranges, place = _Ranges(file), "after_IHDR"
                try:
                    if ranges.read(0, 8) != MAGIC:
                        raise ValueError("Unknown image format.")
                    for seq, (at, kind, length) in enumerate(ranges.chunks()):
                        place = {"PLTE": "after_PLTE", "IDAT": "after_IDAT"}.get(kind, place)
                        if self.kinds is not None and kind not in self.kinds or self.skip["skip_ancillary"] and kind[:1].islower():
                            continue
                        row = {"path": path, "seq": seq, "type": kind, "length": length, "at": at, "pos": place}
                        if self.data and (self.pixels or kind not in ("IDAT", "fdAT")):
                            raw = ranges.read(at + 8, length + 4)
                            row["data"] = raw[:-4]
                            row["crc_ok"] = self.skip["skip_crc"] or struct.unpack(">I", raw[-4:])[0] == zlib.crc32(kind.encode("latin-1") + raw[:-4])
                        rows.append(row)
                except (ValueError, struct.error):
                    if self.errors == "raise":
                        raise
                    rows = []
            yield rows


#: Tasks whose files are moved to their places at a time.
MOVES = 16


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class RasterWriter(DataSourceWriter):
    """Tasks write into folders of their own beside the files, hidden from readers; only when all are done are the files moved to their places. A job that fails leaves none."""

    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "png"), overwrite
        if self.kind not in ("png", "bmp"):
            raise ValueError("png or bmp")
        if "content" not in columns or not {"name", "image_id"} & set(columns):
            raise ValueError("files have a name or an image_id, and content")
        self.named = "name" in columns
        self.staging = f"_staging-{uuid.uuid4().hex}"
        store, root = self._store()
        store.create_dir(f"{root}/{self.staging}", recursive=True)

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator) -> Written:
        store, root = self._store()
        folder = f"{self.staging}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(f"{root}/{folder}", recursive=False)  # a task that starts after the job was given up makes no folder anew
        names: list[str] = []
        taken: set[str] = set()
        out = None
        for row in rows:
            name = row.name if self.named else f"{row.image_id}.{self.kind}"
            if not names or names[-1] != name:  # parts of a file come after one another
                if name in taken or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"{name} is no name of a file, or its parts don't come together")
                if out is not None:
                    out.close()
                names.append(name)
                taken.add(name)
                out = store.open_output_stream(f"{root}/{folder}/{name}")
            out.write(bytes(row.content))
        if out is not None:
            out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written]) -> None:
        store, root = self._store()
        names = [n for m in messages for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote files of one name")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda m: [store.move(f"{root}/{m.folder}/{n}", f"{root}/{n}") for n in m.names], messages):
                pass
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class RasterSource(DataSource):
    """(path, y, channels, vals) of the image files in a folder or of one file, in any file system that pyarrow knows.

    Options: partition_bytes, errors (raise or skip a broken file), skip_ancillary, skip_crc.
    Files and folders whose names begin with _ or . are left out. A path that doesn't exist raises.
    Rows (name or image_id, content) are written as files of their own; rows of one name
    after one another are parts of a file. Option kind: png or bmp, for files by image_id.
    """

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return f"path string, {ROWS}"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, schema.names, overwrite)


class HeaderSource(DataSource):
    """A row for each file: its header, and read_bytes, which doesn't grow with the image. A broken file has an error instead."""

    @classmethod
    def name(cls) -> str:
        return "raster_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


class ChunkSource(DataSource):
    """A row for each chunk of the PNG files. Pixel data is stepped over unless the option pixels is true.

    The option columns names the columns that are wanted; without data and crc_ok, no data is
    read. Filters on type reach the reader, which then reads no other chunk's data.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_chunks"

    def schema(self) -> str:
        if "columns" not in self.options:
            return CHUNKS
        kinds = dict(x.split() for x in CHUNKS.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in (x.strip() for x in self.options["columns"].split(",")))

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options, self.schema())


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, which is told to hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RasterSource, HeaderSource, ChunkSource):
        spark.dataSource.register(source)
