"""Chunk codecs as Column expressions: packing and parsing of image file metadata."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

DISPOSE = ["none", "background", "previous"]
BLEND = ["source", "over"]


def uint(v: Column, n: int) -> Column:
    """A number as n big-endian bytes; one that they can't hold raises."""
    v, most = v.cast("bigint"), (1 << (8 * n)) - 1
    fits = v.isNull() | v.between(0, most)
    return F.when(fits, F.unhex(F.lpad(F.hex(v), 2 * n, "0"))).otherwise(F.raise_error(F.lit(f"a number outside 0..{most}")).cast("binary"))


def wrapped(v: Column, n: int) -> Column:
    """A number as n big-endian bytes, modulo what they can hold."""
    return F.unhex(F.lpad(F.hex(F.pmod(v.cast("bigint"), F.lit(1 << (8 * n)).cast("bigint"))), 2 * n, "0"))


def int32(v: Column) -> Column:
    """A signed number as four big-endian bytes, two's complement."""
    v = v.cast("bigint")
    fits = v.isNull() | v.between(-(1 << 31), (1 << 31) - 1)
    return F.when(fits, wrapped(v, 4)).otherwise(F.raise_error(F.lit("a number outside 32 bits")).cast("binary"))


def _keyword(keyword: Column) -> Column:
    """A keyword's Latin-1 bytes, 1 to 79 of them."""
    n = F.length(keyword)
    return F.when(keyword.isNull() | n.between(1, 79), F.encode(keyword, "ISO-8859-1")).otherwise(F.raise_error(F.lit("a keyword has 1 to 79 bytes")).cast("binary"))


def read_uint(data: Column, at: int, n: int) -> Column:
    """n big-endian bytes from a 0-based place."""
    return F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("bigint")


def read_int32(data: Column, at: int) -> Column:
    v = read_uint(data, at, 4)
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def text_chunk(keyword: Column, text: Column) -> Column:
    """tEXt: keyword, zero byte, Latin-1 text."""
    return F.concat(_keyword(keyword), F.unhex(F.lit("00")), F.encode(text, "ISO-8859-1"))


def _zero(data: Column, start: Column | int = 1) -> Column:
    """The 1-based place of the first zero byte from start on, 0 for none. A byte is two digits, so only odd places count."""
    rest = F.substr(F.hex(data), (F.lit(start) if isinstance(start, int) else start) * 2 - 1)
    place = F.length(F.regexp_extract(rest, "^((?:(?!00)..)*)00", 1))
    return F.when(F.regexp_like(rest, F.lit("^(?:(?!00)..)*00")), F.floor(place / 2) + (F.lit(start) if isinstance(start, int) else start)).otherwise(0).cast("int")


def parse_text_chunk(data: Column) -> Column:
    """struct(keyword, text); without a zero byte the keyword is empty."""
    at = _zero(data)
    key = F.when(at > 0, F.decode(F.substr(data, F.lit(1), at - 1), "ISO-8859-1")).otherwise("")
    return F.struct(key.alias("keyword"), F.decode(F.substr(data, at + 1), "ISO-8859-1").alias("text"))


def itext_chunk(keyword: Column, language: Column, translated: Column, text: Column) -> Column:
    """iTXt without compression."""
    zero = F.unhex(F.lit("00"))
    return F.concat(_keyword(keyword), F.unhex(F.lit("000000")), F.encode(language, "US-ASCII"), zero, F.encode(translated, "UTF-8"), zero, F.encode(text, "UTF-8"))


def parse_itext_chunk(data: Column) -> Column:
    """struct(keyword, compressed, language, translated_keyword, data): data is the text's bytes as stored."""
    a = _zero(data)
    b = _zero(data, a + 3)
    c = _zero(data, b + 1)
    cut = lambda x, y: F.substr(data, x, y - x)
    return F.struct(
        F.decode(cut(F.lit(1), a), "ISO-8859-1").alias("keyword"), (F.hex(F.substr(data, a + 1, F.lit(1))) == "01").alias("compressed"), F.decode(cut(a + 3, b), "US-ASCII").alias("language"),
        F.decode(cut(b + 1, c), "UTF-8").alias("translated_keyword"), F.substr(data, c + 1).alias("data"),
    )


def _inflated(data: bytes | None) -> bytes | None:
    try:
        return None if data is None else zlib.decompress(data)
    except zlib.error:
        return None


@F.pandas_udf(BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    """zlib streams, which Spark has no function for."""
    return data.map(lambda d: None if d is None else zlib.compress(d, 9))


@F.pandas_udf(BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    """What zlib streams hold; null for broken ones."""
    return data.map(_inflated)


def ztext_chunk(keyword: Column, text: Column) -> Column:
    """zTXt: keyword, zero byte, method 0, deflated Latin-1 text."""
    return F.concat(_keyword(keyword), F.unhex(F.lit("0000")), deflate(F.encode(text, "ISO-8859-1")))


def parse_ztext_chunk(data: Column) -> Column:
    """struct(keyword, method, text); text is null for a broken stream, everything for a chunk without a zero byte."""
    at = _zero(data)
    part = lambda x, n=None: F.when(at > 0, F.substr(data, x, n) if n is not None else F.substr(data, x))
    method = F.conv(F.hex(part(at + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.struct(F.decode(part(F.lit(1), at - 1), "ISO-8859-1").alias("keyword"), method.alias("method"), F.decode(inflate(part(at + 2)), "ISO-8859-1").alias("text"))


def itext_text(parsed: Column) -> Column:
    """The text of a parsed iTXt chunk, compressed or not."""
    return F.decode(F.when(parsed["compressed"], inflate(F.when(parsed["compressed"], parsed["data"]))).otherwise(parsed["data"]), "UTF-8")


def time_chunk(ts: Column) -> Column:
    """tIME: two bytes of year, then month to second, in UTC."""
    return F.concat(uint(F.year(ts), 2), *(uint(f(ts), 1) for f in (F.month, F.day, F.hour, F.minute, F.second)))


def parse_time_chunk(data: Column) -> Column:
    part = lambda at, n=1: read_uint(data, at, n).cast("int")
    return F.make_timestamp(part(0, 2), part(2), part(3), part(4), part(5), part(6))


def gamma_chunk(v: Column) -> Column:
    """gAMA: hundred-thousandths."""
    return uint(F.round(v * 100000), 4)


def parse_gamma_chunk(data: Column) -> Column:
    return read_uint(data, 0, 4) / 100000.0


def decoding_exponent(gamma: Column, display: float = 2.2) -> Column:
    return 1.0 / (gamma * display)


def chroma_chunk(*v: Column) -> Column:
    """cHRM: eight values in hundred-thousandths."""
    return F.concat(*(gamma_chunk(x) for x in v))


def parse_chroma_chunk(data: Column) -> Column:
    return F.array(*(read_uint(data, 4 * k, 4) / 100000.0 for k in range(8)))


def phys_chunk(x: Column, y: Column, unit: Column) -> Column:
    return F.concat(uint(x, 4), uint(y, 4), uint(unit, 1))


def parse_phys_chunk(data: Column) -> Column:
    return F.struct(read_uint(data, 0, 4).alias("x"), read_uint(data, 4, 4).alias("y"), read_uint(data, 8, 1).alias("unit"))


def offs_chunk(x: Column, y: Column, unit: Column) -> Column:
    """oFFs: two signed numbers and a unit."""
    return F.concat(int32(x), int32(y), uint(unit, 1))


def parse_offs_chunk(data: Column) -> Column:
    """struct(x, y, unit) of an oFFs chunk."""
    return F.struct(read_int32(data, 0).alias("x"), read_int32(data, 4).alias("y"), read_uint(data, 8, 1).alias("unit"))


def bytes_array(data: Column, width: int = 1) -> Column:
    """All numbers of `width` bytes: sBIT and palettes by 1, hIST by 2."""
    return F.transform(F.sequence(F.lit(0), (F.length(data) / width).cast("int") - 1), lambda i: F.conv(F.hex(F.substring(data, i * width + 1, F.lit(width))), 16, 10).cast("bigint"))


def pack_array(values: Column, width: int = 1) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2 * width, "0")), ""))


def background(data: Column) -> Column:
    """bKGD and tRNS colours by length: an index, a gray level or three levels."""
    n = F.length(data)
    return F.when(n == 1, F.array(read_uint(data, 0, 1))).when(n == 2, F.array(read_uint(data, 0, 2))).otherwise(F.array(*(read_uint(data, 2 * k, 2) for k in range(3))))


def read_grayscale(v: Column, bit_depth: Column) -> Column:
    """A gray level of a bit depth on the scale of 8 bits; depths over 8 keep theirs, at most 256."""
    depth = F.least(bit_depth.cast("int"), F.lit(8))
    return F.least(v, F.lit(256)) * F.floor(F.lit(255) / (F.pow(F.lit(2.0), depth) - 1)).cast("bigint")


def background_color(data: Column, color_type: Column, bit_depth: Column, palette: Column) -> Column:
    """The background that a bKGD chunk tells for an image: gray levels scaled to 8 bits, palette indexes looked up in an array of colours, three levels as they are; null where their number doesn't fit the colour type."""
    v, one = background(data), color_type.isin(0, 3, 4)
    fits = F.when(one, F.size(v) == 1).otherwise(F.size(v) == 3)
    gray = F.array(read_grayscale(v[0], bit_depth))
    return F.when(fits & color_type.isin(0, 4), gray).when(fits & (color_type == 3), F.get(palette, v[0].cast("int"))).when(fits, v)


def background_chunk(color: Column, n_channels: int) -> Column:
    """bKGD in its 16-bit form: one level for gray images, three for others; null where there are more or fewer."""
    n = 1 if n_channels < 3 else 3
    return F.when(F.size(color) == n, F.concat(*(uint(F.get(color, F.lit(k)), 2) for k in range(n))))


def frame_data_chunk(seq: Column, stream: Column) -> Column:
    """fdAT: a sequence number and a part of a deflated stream."""
    return F.concat(uint(seq, 4), stream)


def animation_control_chunk(n_frames: Column, n_plays: Column) -> Column:
    """acTL: eight bytes."""
    return F.concat(uint(n_frames, 4), uint(n_plays, 4))


def parse_animation_control_chunk(data: Column) -> Column:
    return F.struct(read_uint(data, 0, 4).alias("n_frames"), read_uint(data, 4, 4).alias("n_plays"))


def _one_of(names: list[str], v: Column) -> Column:
    """The place of a name as a byte; an unknown one raises."""
    at = F.array_position(F.array(*map(F.lit, names)), v)
    return F.when(at > 0, uint(at - 1, 1)).otherwise(F.raise_error(F.lit(f"none of {', '.join(names)}")).cast("binary"))


def frame_control_chunk(seq: Column, w: Column, h: Column, x: Column, y: Column, num: Column, den: Column, dispose: Column, blend: Column) -> Column:
    """fcTL: 26 bytes. Numbers that don't fit and unknown operations raise."""
    return F.concat(*(uint(v, 4) for v in (seq, w, h, x, y)), uint(num, 2), uint(den, 2), _one_of(DISPOSE, dispose), _one_of(BLEND, blend))


def parse_frame_control_chunk(data: Column) -> Column:
    names = ["seq", "w", "h", "x_off", "y_off"]
    word = [read_uint(data, 4 * k, 4).alias(n) for k, n in enumerate(names)]
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), read_uint(data, at, 1).cast("int"))
    return F.struct(*word, read_uint(data, 20, 2).alias("delay_num"), read_uint(data, 22, 2).alias("delay_den"), pick(DISPOSE, 24).alias("dispose"), pick(BLEND, 25).alias("blend"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def raw_chunk(kind: Column, data: Column) -> Column:
    """Length, type, data and CRC of a chunk. Data of 2 ** 31 bytes and more raises."""
    fits = lambda d: F.when(d.isNull() | (F.length(d) < (1 << 31) - 1), d).otherwise(F.raise_error(F.lit("a chunk's data is too long")).cast("binary"))
    body = lambda d: once(F.concat(F.encode(kind, "US-ASCII"), d), lambda b: F.concat(b, uint(F.crc32(b), 4)))
    return once(data, lambda d: F.concat(uint(F.length(fits(d)), 4), body(d)))


def parse_raw_chunk(chunk: Column) -> Column:
    """struct(length, type, data, crc, crc_ok) of a single chunk."""
    n = read_uint(chunk, 0, 4)
    body = F.substr(chunk, F.lit(5), (n + 4).cast("int"))
    crc = F.conv(F.hex(F.substr(chunk, (n + 9).cast("int"), F.lit(4))), 16, 10).cast("bigint")
    return F.struct(n.alias("length"), F.decode(F.substr(chunk, F.lit(5), F.lit(4)), "US-ASCII").alias("type"), F.substr(chunk, F.lit(9), n.cast("int")).alias("data"), crc.alias("crc"), (crc == F.crc32(body)).alias("crc_ok"))


def flags(kind: Column) -> Column:
    """struct(ancillary, private, reserved, safe) from the letters' case; a name that is not four letters raises."""
    low = lambda k: F.regexp_like(F.substring(kind, k, 1), F.lit("[a-z]"))
    ok = F.regexp_like(kind, F.lit("^[A-Za-z]{4}$"))
    first = F.when(ok, low(1)).otherwise(F.raise_error(F.lit("a chunk name has four letters")).cast("boolean"))
    return F.struct(first.alias("ancillary"), low(2).alias("private"), low(3).alias("reserved"), low(4).alias("safe"))


def file_type(content: Column) -> Column:
    """bmp, png or unknown, by signature."""
    return F.when(F.hex(F.substring(content, 1, 2)) == "424D", "bmp").when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", "png").otherwise("unknown")
