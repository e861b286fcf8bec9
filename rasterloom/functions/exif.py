"""EXIF blocks as tables of fields, in column expressions: nothing is shuffled and no Python runs.

A block is a TIFF header and directories of 12-byte entries: IFD0, the Exif and GPS
directories that IFD0 points to, and IFD1, which holds the thumbnail. Numbers follow the
TIFF specification in either byte order, signed types and rationals included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import wrapped as uint  # places and counts of blocks, which fit

# Fixed values of the TIFF and EXIF specifications.
#: Bytes of a value by type number: none, BYTE, ASCII, SHORT, LONG, RATIONAL, SBYTE, UNDEFINED, SSHORT, SLONG, SRATIONAL, FLOAT, DOUBLE.
WIDTHS = [None, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8]
EXIF_POINTER, GPS_POINTER = 34665, 34853
MAIN_NAMES = {
    256: "ImageWidth", 257: "ImageLength", 259: "Compression", 271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software",
    306: "DateTime", 315: "Artist", 513: "JPEGInterchangeFormat", 514: "JPEGInterchangeFormatLength", 531: "YCbCrPositioning", 33432: "Copyright", 34665: "ExifIFD", 34853: "GPS_IFD",
}
EXIF_NAMES = {36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37121: "ComponentsConfiguration", 37385: "Flash", 37510: "UserComment", 40960: "FlashpixVersion", 40961: "ColorSpace"}
NAMES = {"IFD0": MAIN_NAMES, "IFD1": MAIN_NAMES, "ExifIFD": EXIF_NAMES}
#: What a number of a tag says.
MEANINGS = {296: {2: "inches", 3: "centimeters"}, 531: {1: "centered", 2: "co-sited"}, 40961: {1: "sRGB", 65535: "Uncalibrated"}}
COMPONENTS = ["", "Y", "Cb", "Cr", "R", "G", "B"]


def _bytes(data: Column, at: Column, n: Column) -> Column:
    """n bytes from a 0-based place; null where the block doesn't hold them all."""
    inside = (at >= 0) & (n >= 0) & (at + n <= F.length(data))
    return F.when(inside, F.substr(data, (at + 1).try_cast("int"), n.try_cast("int")))


def _unsigned(raw: Column, n: int, little: Column) -> Column:
    """All of up to 4 bytes as an unsigned number."""
    swapped = raw if n == 1 else F.concat(*(F.substr(raw, F.lit(k), F.lit(1)) for k in range(n, 0, -1)))
    return F.conv(F.hex(raw if n == 1 else F.when(little, swapped).otherwise(raw)), 16, 10).cast("bigint")


def _number(data: Column, at: Column, n: int, little: Column) -> Column:
    """Up to 4 bytes from a 0-based place as an unsigned number; null where the block doesn't hold them all."""
    return _unsigned(_bytes(data, at, F.lit(n).cast("bigint")), n, little)


def _entries(data: Column, at: Column, little: Column) -> Column:
    """The 1-based places of the entries of the directory at a place, as many as the block holds."""
    room = F.floor((F.length(data) - at - 2) / 12)
    n = F.least(_number(data, at, 2, little), room.cast("bigint"))
    first = (at + 3).try_cast("int")
    return F.when(n > 0, F.sequence(first, first + (n.try_cast("int") - 1) * 12, F.lit(12)))


def _float(sign: Column, exponent: Column, fraction: Column, bias: int) -> Column:
    """An IEEE 754 number of its parts; fraction is in [0, 1)."""
    size = F.when(exponent == 0, fraction * 2.0 ** (1 - bias)).otherwise((1 + fraction) * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
    size = F.when(exponent == 2 * bias + 1, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(size)
    return F.when(sign == 1, -size).otherwise(size)


def _value(raw: Column, kind: Column, i: Column, little: Column) -> Column:
    """The i-th number, an int from 0 on, of a value's bytes, which hold it; a rational with denominator 0 is null."""
    part = lambda n, at=0, step=None: _unsigned(F.substr(raw, i * (step or n) + at + 1, F.lit(n)), n, little)
    signed = lambda v, n: F.when(v >= 1 << (8 * n - 1), v - (1 << (8 * n))).otherwise(v)
    one, two, four, a, b = part(1), part(2), part(4), part(4, 0, 8), part(4, 4, 8)
    high, low = F.when(little, b).otherwise(a), F.when(little, a).otherwise(b)
    ratio = lambda x, y: F.when(y != 0, x / y)
    single = _float(F.shiftright(four, 31), F.shiftright(four, 23).bitwiseAND(F.lit(255)), four.bitwiseAND(F.lit((1 << 23) - 1)) / float(1 << 23), 127)
    double = _float(F.shiftright(high, 31), F.shiftright(high, 20).bitwiseAND(F.lit(2047)), high.bitwiseAND(F.lit((1 << 20) - 1)) / float(1 << 20) + low / 2.0**52, 1023)
    d = lambda c: c.cast("double")
    return (
        F.when(kind.isin(1, 7), d(one)).when(kind == 3, d(two)).when(kind == 4, d(four)).when(kind == 5, ratio(a, b)).when(kind == 6, d(signed(one, 1)))
        .when(kind == 8, d(signed(two, 2))).when(kind == 9, d(signed(four, 4))).when(kind == 10, ratio(signed(a, 4), signed(b, 4))).when(kind == 11, single).when(kind == 12, double)
    )


def _comment(raw: Column, little: Column) -> Column:
    """A comment after its 8-byte character set."""
    rest = F.substr(raw, F.lit(9))
    wide = F.hex(F.substr(raw, F.lit(1), F.lit(7))) == F.lit(b"UNICODE".hex().upper())
    return F.when(wide, F.when(little, F.decode(rest, "UTF-16LE")).otherwise(F.decode(rest, "UTF-16BE"))).otherwise(F.decode(rest, "ISO-8859-1"))


def _text(tag: Column, kind: Column, raw: Column, numbers: Column, little: Column) -> Column:
    """What a field says in words, null for plain numbers."""
    plain = F.decode(raw, "ISO-8859-1")
    owners = F.array_join(F.filter(F.transform(F.split(plain, "\x00", -1), lambda x: F.trim(x)), lambda x: x != ""), ", ")
    parts = F.array_join(F.transform(numbers, lambda n: F.get(F.array(*map(F.lit, COMPONENTS)), n.cast("int"))), "")
    out = F.when((tag == 33432) & (kind == 2), owners).when(kind == 2, F.regexp_replace(plain, "\\x00+$", "")).when(tag.isin(36864, 40960), plain).when(tag == 37510, _comment(raw, little)).when(tag == 37121, parts)
    for t, says in MEANINGS.items():
        out = out.when(tag == t, F.try_element_at(F.create_map(*[x for k, v in says.items() for x in (F.lit(float(k)), F.lit(v))]), F.get(numbers, F.lit(0))))
    return out


#: What users add: (directory, tag) to a name and a decoder of (raw, numbers, little-endian) to a string column.
Decoder = Callable[[Column, Column, Column], Column]
_ADDED: dict[tuple[str, int], tuple[str, Decoder | None]] = {}


def register(ifd: str, tag: int, name: str, decode: Decoder | None = None) -> None:
    """A field of the user's own, or another name or decoder for a known one: `fields` gives its name, and what decode tells as its text. A number that is no tag, or a directory that isn't one, raises."""
    if ifd not in ("IFD0", "ExifIFD", "GPS_IFD", "IFD1") or not 0 <= tag <= 0xFFFF:
        raise ValueError("a directory is IFD0, ExifIFD, GPS_IFD or IFD1, a tag between 0 and 65535")
    _ADDED[ifd, tag] = (name, decode)


def unregister(ifd: str, tag: int) -> None:
    _ADDED.pop((ifd, tag), None)


def fields(blocks: DataFrame, data: str = "data", names: dict[str, dict[int, str]] | None = None) -> DataFrame:
    """A row for each field of the blocks in column `data`, beside the other columns of the table.

    Columns: ifd, seq (its place in the directory), tag, name, type, count, numbers,
    text, raw. names adds names of tags by directory; fields of `register` have its names
    and texts; others are `Unknown <tag>`. Null
    blocks, blocks without a TIFF header and empty directories give no rows; a value
    beyond the block's end or of an unknown type is null. Rows of a block that repeats
    repeat. Columns of the table that have one of the names above are replaced.
    """
    own = ["ifd", "seq", "tag", "name", "type", "count", "numbers", "text", "raw"]
    rest = [F.col(f"`{c}`") for c in blocks.columns if c != data and c not in own]
    d, le, e = F.col("_d"), F.col("_le"), F.col("_e")
    # A filter on the header would be pushed below the column of blocks and compute each block twice.
    head = F.hex(F.substring(d, 1, 4))
    at = blocks.select(F.struct(*rest, F.lit(0).alias("_")).alias("_rest"), F.col(data).alias("_d")).withColumn("_le", F.when(head == "49492A00", True).when(head == "4D4D002A", False))
    at = at.withColumn("_first", _number(d, F.lit(4).cast("bigint"), 4, le)).withColumn("_main", _entries(d, F.col("_first"), le))

    def pointer(tag: int) -> Column:
        big = tag.to_bytes(2, "big")
        wanted = F.when(le, F.lit(bytearray(big[::-1]))).otherwise(F.lit(bytearray(big)))
        found = F.get(F.filter("_main", lambda p: F.substr(d, p, F.lit(2)) == wanted), F.lit(0))
        return _unsigned(F.substr(d, found + 8, F.lit(4)), 4, le)

    following = _number(d, F.col("_first") + 2 + 12 * _number(d, F.col("_first"), 2, le), 4, le)
    place = lambda name, offset: F.struct(F.lit(name).alias("ifd"), offset.alias("at"))
    at = at.withColumns({"_exif": pointer(EXIF_POINTER), "_gps": pointer(GPS_POINTER), "_next": following})
    places = F.array(place("IFD0", F.col("_first")), place("ExifIFD", F.col("_exif")), place("GPS_IFD", F.col("_gps")), place("IFD1", F.col("_next")))
    at = at.select("_rest", "_d", "_le", F.explode(F.when(le.isNotNull(), places)).alias("_i")).where("_i.at > 0")
    at = at.select("_rest", "_d", "_le", F.col("_i.ifd").alias("ifd"), F.posexplode(_entries(d, F.col("_i.at"), le)).alias("seq", "_p"))
    part = lambda k, n: _unsigned(F.substr(e, F.lit(k), F.lit(n)), n, le)
    at = at.withColumn("_e", F.substr(d, F.col("_p"), F.lit(12))).select("_rest", "_d", "_le", "ifd", F.col("seq").cast("bigint").alias("seq"), "_p", "_e", part(1, 2).alias("tag"), part(3, 2).alias("type"), part(5, 4).alias("count"))
    width = F.get(F.array(*map(F.lit, WIDTHS)), F.col("type").cast("int")).cast("bigint")
    at = at.withColumn("_size", F.col("count") * width)
    at = at.withColumn("_start", F.when(F.col("_size") <= 4, F.col("_p").cast("bigint") + 7).otherwise(part(9, 4)))
    at = at.select("_rest", "_le", "ifd", "seq", "tag", "type", "count", _bytes(d, F.col("_start"), F.col("_size")).alias("raw"))
    some = F.col("raw").isNotNull() & (F.col("count") > 0) & (F.col("type") != 2)
    at = at.withColumn("numbers", F.when(some, F.transform(F.sequence(F.lit(0), F.col("count").try_cast("int") - 1), lambda i: _value(F.col("raw"), F.col("type"), i, le))))
    known = {ifd: NAMES.get(ifd, {}) | {t: n for (i, t), (n, _) in _ADDED.items() if i == ifd} | (names or {}).get(ifd, {}) for ifd in ("IFD0", "ExifIFD", "GPS_IFD", "IFD1")}
    name = F.concat(F.lit("Unknown "), F.col("tag").cast("string"))
    for ifd, tags in known.items():
        if tags:
            named = F.create_map(*[x for t, n in tags.items() for x in (F.lit(t).cast("bigint"), F.lit(n))])
            name = F.when(F.col("ifd") == ifd, F.coalesce(F.try_element_at(named, F.col("tag")), F.concat(F.lit("Unknown "), F.col("tag").cast("string")))).otherwise(name)
    text = _text(F.col("tag"), F.col("type"), F.col("raw"), F.col("numbers"), le)
    for (ifd, tag), (_, decode) in _ADDED.items():
        if decode is not None:
            text = F.when((F.col("ifd") == ifd) & (F.col("tag") == tag), decode(F.col("raw"), F.col("numbers"), le)).otherwise(text)
    at = at.withColumns({"name": name, "text": text})
    return at.select(*(F.col("_rest").getField(c).alias(c) for c in blocks.columns if c != data and c not in own), *own)


def flash(value: Column) -> Column:
    """struct(fired, returned, mode, absent, red_eye) of a Flash number, by the specification's bits."""
    bits = lambda at, n: F.shiftright(value.cast("bigint"), at).bitwiseAND(F.lit((1 << n) - 1))
    return F.struct((bits(0, 1) == 1).alias("fired"), bits(1, 2).alias("returned"), bits(3, 2).alias("mode"), (bits(5, 1) == 1).alias("absent"), (bits(6, 1) == 1).alias("red_eye"))


def moment(text: Column) -> Column:
    """A date field's timestamp, null if it tells none."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def thumbnails(blocks: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, compression, thumbnail) of blocks whose IFD1 gives a thumbnail's place and length. key tells blocks apart."""
    one = lambda tag: F.max(F.when(F.col("tag") == tag, F.get("numbers", F.lit(0)))).cast("bigint")
    small = fields(blocks.select(key, data, F.col(data).alias("_block")), data).where("ifd = 'IFD1' and tag in (259, 513, 514)")
    told = small.groupBy(key).agg(one(259).alias("compression"), one(513).alias("_at"), one(514).alias("_n"), F.first("_block").alias("_block")).where("_at is not null and _n is not null")
    return told.select(key, "compression", _bytes(F.col("_block"), F.col("_at"), F.col("_n")).alias("thumbnail"))


Field = tuple[int, int, Column, Column]


def _directory(entries: list[Field], start: Column, following: Column | None = None) -> Column:
    """A big-endian directory at a place, with the place of the one that follows it, its longer values behind it."""
    place, table, area = start + 2 + 12 * len(entries) + 4, [], []
    for tag, kind, count, payload in entries:
        away = F.length(payload) > 4
        value = F.when(away, uint(place, 4)).otherwise(F.rpad(payload, F.lit(4), F.unhex(F.lit("00"))))
        table.append(F.concat(uint(F.lit(tag), 2), uint(F.lit(kind), 2), uint(count, 4), value))
        area.append(F.when(away, payload).otherwise(F.unhex(F.lit(""))))
        place = place + F.when(away, F.length(payload)).otherwise(0)
    return F.concat(uint(F.lit(len(entries)), 2), *table, uint(F.lit(0) if following is None else following, 4), *area)


def _length(entries: list[Field]) -> Column:
    """What _directory takes, told without building it."""
    out = F.lit(2 + 12 * len(entries) + 4)
    for _, _, _, payload in entries:
        out = out + F.when(F.length(payload) > 4, F.length(payload)).otherwise(0)
    return out


def block(main: list[Field], exif: list[Field] = (), thumbnail: Column | None = None, compression: Column | int = 6) -> Column:
    """A big-endian EXIF block of (tag, type, count, bytes) fields of IFD0 and, if any, of the Exif directory.

    A thumbnail's bytes stand at the end, behind IFD1, which tells their place, length and
    compression (6: JPEG). The block of a null thumbnail is null.
    """
    head, one = F.unhex(F.lit("4D4D002A00000008")), F.lit(1)
    pointing = lambda at: [*main, (EXIF_POINTER, 4, one, uint(at, 4))] if exif else main
    after = F.lit(8) + _length(pointing(F.lit(0)))
    more = _directory(list(exif), after) if exif else F.unhex(F.lit(""))
    if thumbnail is None:
        return F.concat(head, _directory(pointing(after), F.lit(8)), more)
    second = after + _length(exif) if exif else after
    small = [(259, 3, one, uint(F.lit(compression), 2)), (513, 4, one, uint(second + 2 + 12 * 3 + 4, 4)), (514, 4, one, uint(F.length(thumbnail), 4))]
    return F.concat(head, _directory(pointing(after), F.lit(8), second), more, _directory(small, second), thumbnail)
