"""PNG and BMP files to rows of samples and back, with numpy, for use inside Arrow tasks."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels of each PNG colour type, and the bit depths it may have (fixed values).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First row, first column, row step and column step of the seven interlace passes (fixed values).
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


#: Chunk types that should occur once (fixed values).
ONCE = ["cHRM", "gAMA", "iCCP", "sBIT", "sRGB", "bKGD", "hIST", "tRNS", "pHYs", "tIME", "acTL"]


class ImageError(ValueError):
    """A file that isn't an image of a known kind."""


class HeaderError(ImageError):
    """A header with values that don't go together."""


class ChunkError(ImageError):
    """Chunks that are missing, broken or out of place."""


@dataclass
class Image:
    format: str
    width: int
    height: int
    bit_depth: int
    color_type: int
    interlace: int = 0
    samples: np.ndarray | None = None  # height x width x channels
    chunks: list[tuple[str, bytes, str, bool]] = field(default_factory=list)  # type, data, position, whether the CRC holds
    palette: np.ndarray | None = None
    alpha: bytes | None = None
    background: list[int] | None = None
    warnings: list[str] = field(default_factory=list)
    has_alpha: bool = False
    n_frames: int | None = None
    n_plays: int | None = None


def chunks_of(content: bytes, skip_crc: bool = False):
    """(type, data, crc holds) of each chunk; a cut-off chunk raises."""
    at = len(MAGIC)
    while at < len(content):
        if at + 12 > len(content):
            raise ChunkError("a chunk is cut off")
        size, kind = struct.unpack_from(">I", content, at)[0], content[at + 4 : at + 8]
        data = content[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(content):
            raise ChunkError("a chunk is cut off")
        crc = struct.unpack_from(">I", content, at + 8 + size)[0]
        yield kind.decode("latin-1"), data, skip_crc or crc == zlib.crc32(kind + data)
        at += 12 + size


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def _unfilter(raw: np.ndarray, rows: int, stride: int, bpp: int) -> np.ndarray:
    """The bytes of filtered rows. A pixel needs its left, upper and upper left neighbours only, so all pixels of a diagonal are undone at once."""
    lines = raw.reshape(rows, stride + 1)
    kinds, body = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ImageError(f"unknown row filter {kinds.max()}")
    if not kinds.any():
        return body
    n = -(-stride // bpp)
    wide = np.zeros((rows, n * bpp), np.uint8)
    wide[:, :stride] = body
    res = wide.reshape(rows, n, bpp).astype(np.int16)
    out = np.zeros((rows + 1, n + 1, bpp), np.int16)
    if kinds.max() <= 2:
        for y, kind in enumerate(kinds):
            line = np.cumsum(res[y], axis=0) if kind == 1 else res[y] + out[y, 1:] if kind == 2 else res[y]
            out[y + 1, 1:] = line & 255
    else:
        for d in range(rows + n - 1):
            y = np.arange(max(0, d - n + 1), min(rows, d + 1))
            x = d - y
            a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
            k = kinds[y][:, None]
            guess = np.where(k == 4, _paeth(a, b, c), np.where(k == 3, (a + b) >> 1, np.where(k == 2, b, np.where(k == 1, a, 0))))
            out[y + 1, x + 1] = (res[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(rows, -1)[:, :stride]


def _samples(lines: np.ndarray, width: int, n: int, depth: int) -> np.ndarray:
    if depth == 16:
        return lines.copy().view(">u2").astype(np.int64).reshape(len(lines), width, n)
    if depth == 8:
        return lines.astype(np.int64).reshape(len(lines), width, n)
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    values = bits @ (1 << np.arange(depth)[::-1])
    return values[:, : width * n].astype(np.int64).reshape(len(lines), width, n)


def _inflate(im: Image, stream: bytes) -> np.ndarray:
    n = CHANNELS[im.color_type]
    raw = np.frombuffer(zlib.decompressobj().decompress(stream), np.uint8)
    bits = n * im.bit_depth
    bpp = max(1, bits // 8)
    parts = [(0, 0, 1, 1)] if not im.interlace else PASSES
    out, at = np.zeros((im.height, im.width, n), np.int64), 0
    for y0, x0, dy, dx in parts:
        rows, width = -(-max(0, im.height - y0) // dy), -(-max(0, im.width - x0) // dx)
        if not rows or not width:
            continue
        stride = (width * bits + 7) // 8
        part = raw[at : at + rows * (stride + 1)]
        at += rows * (stride + 1)
        if len(part) < rows * (stride + 1):
            im.warnings.append("pixel data is missing; rows are filled up with 0")
            part = np.concatenate([part[: len(part) // (stride + 1) * (stride + 1)], np.zeros(rows * (stride + 1), np.uint8)])[: rows * (stride + 1)]
        out[y0::dy, x0::dx] = _samples(_unfilter(part, rows, stride, bpp), width, n, im.bit_depth)
    if at < len(raw):
        im.warnings.append("surplus pixel data is dropped")
    return out


def background_of(body: bytes, im: Image) -> list[int]:
    """The colour of a bKGD chunk: gray levels scaled to 8 bits, palette indexes looked up, three levels as they are; empty, with a warning, where their number doesn't fit."""
    levels = list(body) if len(body) == 1 else list(struct.unpack(f">{len(body) // 2}H", body[: len(body) // 2 * 2]))
    if len(levels) != (3 if im.color_type in (2, 6) else 1) or im.color_type == 3 and (im.palette is None or levels[0] >= len(im.palette)):
        im.warnings.append(f"a background of {levels} doesn't fit the image")
        return []
    if im.color_type == 3:
        return im.palette[levels[0]].tolist()
    return levels if im.color_type in (2, 6) else [min(levels[0], 256) * (255 // ((1 << min(im.bit_depth, 8)) - 1))]


def decode_png(content: bytes, only_metadata: bool = False, skip_ancillary: bool = False, skip_crc: bool = False) -> Image:
    """An image with its chunks; a colour key and a palette's alpha become an alpha channel."""
    im, data, place, ended, seen = None, [], "after_IHDR", False, None
    trns = back = None
    for kind, body, ok in chunks_of(content, skip_crc):
        if ended:
            raise ChunkError("a chunk after IEND")
        if kind == "CgBI":
            raise ChunkError("CgBI: a file of another format that poses as PNG")
        if im is None and kind != "IHDR":
            raise ChunkError("IHDR comes first")
        critical = kind[:1].isupper()
        if not critical and skip_ancillary:
            continue
        if kind == "IHDR":
            w, h, depth, color, comp, flt, lace = struct.unpack(">IIBBBBB", body)
            if im is not None or not w or not h or color not in CHANNELS or depth not in DEPTHS[color] or comp or flt or lace > 1:
                raise HeaderError("the header's values don't go together")
            im = Image("png", w, h, depth, color, lace)
        elif kind == "PLTE":
            if im.color_type in (0, 4) or data or not body or len(body) % 3:
                raise ChunkError("a palette that is empty, late or of a gray image")
            im.palette, place = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64), "after_PLTE"
        elif kind == "IDAT":
            if im.color_type == 3 and im.palette is None or data and seen != "IDAT":
                raise ChunkError("pixel data out of place")
            data.append(body)
            place = "after_IDAT"
        elif kind == "IEND":
            if not data:
                raise ChunkError("no pixel data")
            ended = True
        elif critical:
            raise ChunkError(f"unknown critical chunk {kind}")
        elif kind == "tRNS":
            if im.color_type in (4, 6):
                im.warnings.append("tRNS isn't expected in an image with alpha")
            elif data:
                im.warnings.append("tRNS stands after the pixel data and is left out")
            else:
                trns = body
        elif kind == "bKGD":
            back = body
            if data:
                im.warnings.append("bKGD stands after the pixel data")
        elif kind in ("cHRM", "oFFs") and (data or im.palette is not None and kind == "cHRM"):
            im.warnings.append(f"{kind} is out of place")
        elif kind == "acTL" and len(body) == 8:
            im.n_frames, im.n_plays = struct.unpack(">II", body)
        if kind in ONCE and any(c[0] == kind for c in im.chunks):
            im.warnings.append(f"{kind} occurs more than once")
        if not ok:
            im.warnings.append(f"the CRC of {kind} doesn't hold")
        im.chunks.append((kind, body, place, ok))
        seen = kind
    if im is None or not data:
        raise ChunkError("no image data")
    if not ended:
        im.warnings.append("IEND is missing")
    im.has_alpha = im.color_type in (4, 6) or trns is not None
    if back is not None:
        im.background = background_of(back, im)
    if only_metadata:
        return im
    px = _inflate(im, b"".join(data))
    if im.color_type == 3:
        index = px[..., 0]
        if index.max(initial=0) >= len(im.palette):
            raise ChunkError("a palette index out of range")
        px = im.palette[index]
        if trns is not None:
            alpha = np.full(len(im.palette), 255)
            alpha[: len(trns)] = list(trns[: len(alpha)])
            px = np.concatenate([px, alpha[index][..., None]], -1)
    elif trns is not None and im.color_type in (0, 2):
        key = np.array(struct.unpack(f">{len(trns) // 2}H", trns))
        px = np.concatenate([px, np.where((px == key).all(-1), 0, 255)[..., None]], -1)
    im.samples = px
    return im


def _filters(lines: np.ndarray, bpp: int) -> list[np.ndarray]:
    """Residuals of all rows under the five filters."""
    x = lines.astype(np.int16)
    a, b, c = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    a[:, bpp:], b[1:], c[1:, bpp:] = x[:, :-bpp], x[:-1], x[:-1, :-bpp]
    return [(x - g).astype(np.uint8) for g in (np.zeros_like(x), a, b, (a + b) // 2, _paeth(a, b, c))]


def chunk(kind: str, body: bytes) -> bytes:
    raw = kind.encode("latin-1") + body
    return struct.pack(">I", len(body)) + raw + struct.pack(">I", zlib.crc32(raw))


def encode_png(samples: np.ndarray, bit_depth: int = 8, level: int = 0, ancillary: list[tuple[str, bytes, str]] = (), filters: list[int] | None = None, interlace: int = 0) -> bytes:
    """A PNG file of height x width x channels samples.

    Samples are truncated and wrap at the bit depth. Level 0 filters nothing; level 1
    rounds, takes a palette for colour images of at most 256 colours, else for each row
    the filter under which it deflates to the fewest bytes, of equal ones the first.
    `filters` fixes the filters of the rows in turn. Ancillary chunks are (type, data, position).
    """
    h, w, n = samples.shape
    if bit_depth not in (8, 16) or level not in (0, 1):
        raise ValueError("bit depth 8 or 16, level 0 or 1")
    values = (np.rint(samples) if level else np.trunc(samples)).astype(np.int64)
    values %= 1 << bit_depth
    color, palette = {1: 0, 2: 4, 3: 2, 4: 6}[n], b""
    if level and n == 3 and bit_depth == 8:
        flat = values.reshape(-1, 3)
        colors, first, index = np.unique(flat, axis=0, return_index=True, return_inverse=True)
        if len(colors) <= 256:
            order = np.argsort(first)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            palette, color = chunk("PLTE", colors[order].astype(np.uint8).tobytes()), 3
            values = rank[index.reshape(-1)].reshape(h, w, 1)
    depth_bytes = bit_depth // 8
    bpp = values.shape[2] * depth_bytes
    stream = []
    for y0, x0, dy, dx in PASSES if interlace else [(0, 0, 1, 1)]:
        part = values[y0::dy, x0::dx]
        if not part.size:
            continue
        lines = np.ascontiguousarray(part.astype(">u2" if depth_bytes == 2 else np.uint8)).view(np.uint8).reshape(part.shape[0], -1)
        if filters:
            kinds = np.array([filters[y % len(filters)] for y in range(len(lines))])
        elif level and color != 3:
            kinds = np.array([[len(zlib.compress(line, 9)) for line in r] for r in _filters(lines, bpp)]).argmin(0)
        else:
            kinds = np.zeros(len(lines), int)
        found = _filters(lines, bpp) if kinds.any() else [lines]
        stream += [bytes([k]) + found[k][y].tobytes() for y, k in enumerate(kinds)]
    head = chunk("IHDR", struct.pack(">IIBBBBB", w, h, bit_depth, color, 0, 0, interlace))
    at = lambda place: b"".join(chunk(t, d) for t, d, p in ancillary if p == place)
    return MAGIC + head + at("after_IHDR") + palette + at("after_PLTE") + chunk("IDAT", zlib.compress(b"".join(stream), 9)) + at("after_IDAT") + chunk("IEND", b"")


def decode_bmp(content: bytes) -> Image:
    """A 24-bit uncompressed BMP file."""
    if len(content) < 54:
        raise HeaderError("the header is cut off")
    start, dib, w, h, _, bits, comp = struct.unpack_from("<IIiiHHI", content, 10)
    if dib != 40 or bits != 24 or comp or w < 1 or h < 1:
        raise HeaderError("only 24 bits, uncompressed, with a header of 40 bytes")
    im, stride = Image("bmp", w, h, 24, 2), (3 * w + 3) // 4 * 4
    raw = np.frombuffer(content, np.uint8)[start : start + stride * h]
    if len(raw) < stride * h:
        im.warnings.append("pixel data is missing; rows are filled up with 0")
        raw = np.concatenate([raw, np.zeros(stride * h - len(raw), np.uint8)])
    im.samples = raw.reshape(h, stride)[::-1, : 3 * w].reshape(h, w, 3)[..., ::-1].astype(np.int64)
    return im


def encode_bmp(samples: np.ndarray, background: list[float] | None = None) -> bytes:
    """A 24-bit BMP file; alpha is blended onto a background if one is given, else dropped."""
    h, w, n = samples.shape
    if n < 3:
        raise ImageError("BMP files need colour")
    rgb = samples[..., :3].astype(float)
    if n == 4 and background is not None:
        a = samples[..., 3:] / 255.0
        rgb = rgb * a + np.array(background, float) * (1 - a)
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = (np.trunc(rgb).astype(np.int64) % 256)[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(content: bytes, **options) -> Image:
    if content[:2] == b"BM":
        return decode_bmp(content)
    if content[:8] == MAGIC:
        return decode_png(content, **options)
    raise ImageError("Unknown image format.")
