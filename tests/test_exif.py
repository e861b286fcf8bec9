import struct
import zlib

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import chunks as ch
from rasterloom.functions import exif as ex

ASCII, SHORT, LONG, RATIONAL, UNDEFINED, SRATIONAL = 2, 3, 4, 5, 7, 10


def directory(order, at, entries, following=0):
    area, place = b"", at + 2 + 12 * len(entries) + 4
    out = struct.pack(order + "H", len(entries))
    for tag, kind, count, value in entries:
        out += struct.pack(order + "HHI", tag, kind, count)
        if len(value) <= 4:
            out += value.ljust(4, b"\0")
        else:
            out += struct.pack(order + "I", place + len(area))
            area += value
    return out + struct.pack(order + "I", following) + area


def block(order):
    p = lambda form, *v: struct.pack(order + form, *v)
    head = (b"II*\0" if order == "<" else b"MM\0*") + p("I", 8)
    exif = [
        (36864, UNDEFINED, 4, b"0232"), (37121, UNDEFINED, 4, b"\1\2\3\0"), (37385, SHORT, 1, p("H", 0b1011101)),
        (37510, UNDEFINED, 14, b"UNICODE\0" + "abc".encode("utf-16-le" if order == "<" else "utf-16-be")), (40961, SHORT, 1, p("H", 65535)),
    ]
    main = [
        (271, ASCII, 6, b"Maker\0"), (282, RATIONAL, 1, p("II", 72, 5)), (296, SHORT, 1, p("H", 3)), (306, ASCII, 20, b"2021:02:03 04:05:06\0"), (33432, ASCII, 9, b"Ann\0 Bob\0"),
        (50001, SRATIONAL, 2, p("iiii", -3, 4, 1, 0)), (50002, 9, 1, p("i", -7)), (50003, 6, 2, b"\xff\x05"), (50004, 8, 2, p("hh", -2, 3)), (50005, 11, 2, p("ff", -1.5, 1e-40)), (50006, 12, 2, p("dd", 3.25e-200, float("-inf"))),
    ]
    size = len(directory(order, 8, [*main, (34665, LONG, 1, p("I", 0)), (34853, LONG, 1, p("I", 0))]))
    second = directory(order, 8 + size, exif)
    gps = directory(order, 8 + size + len(second), [(1, ASCII, 2, b"N\0")])
    last = 8 + size + len(second) + len(gps)
    photo = last + 2 + 36 + 4
    first = directory(order, 8, [*main, (34665, LONG, 1, p("I", 8 + size)), (34853, LONG, 1, p("I", 8 + size + len(second)))], last)
    return head + first + second + gps + directory(order, last, [(259, SHORT, 1, p("H", 6)), (513, LONG, 1, p("I", photo)), (514, LONG, 1, p("I", 4))]) + b"JPEG" + b"rest"


@pytest.mark.parametrize("order", "<>")
def test_fields_of_both_byte_orders(spark, order):
    df = spark.createDataFrame([(1, bytearray(block(order)))], "id long, data binary")
    got = {(r.ifd, r.name): r for r in ex.fields(df).collect()}
    assert len(got) == 13 + 5 + 1 + 3
    main = lambda n: got["IFD0", n]
    assert (main("Make").text, main("ResolutionUnit").text, main("Copyright").text) == ("Maker", "centimeters", "Ann, Bob")
    assert main("XResolution").numbers == [14.4]
    assert main("Unknown 50001").numbers == [-0.75, None]
    assert main("Unknown 50002").numbers == [-7] and main("Unknown 50003").numbers == [-1, 5] and main("Unknown 50004").numbers == [-2, 3]
    assert main("Unknown 50005").numbers == list(struct.unpack("<ff", struct.pack("<ff", -1.5, 1e-40)))
    assert main("Unknown 50006").numbers == [3.25e-200, float("-inf")]
    says = {n: got["ExifIFD", n].text for n in ex.EXIF_NAMES.values() if ("ExifIFD", n) in got}
    assert says == {"ExifVersion": "0232", "ComponentsConfiguration": "YCbCr", "Flash": None, "UserComment": "abc", "ColorSpace": "Uncalibrated"}
    assert got["GPS_IFD", "Unknown 1"].text == "N"
    f = ex.fields(df).where("name = 'Flash'").select(ex.flash(F.get("numbers", F.lit(0))).alias("f")).first().f
    assert tuple(f) == (True, 2, 3, False, True)
    assert str(ex.fields(df).where("name = 'DateTime'").select(ex.moment(F.col("text"))).first()[0]) == "2021-02-03 04:05:06"
    assert [(r.compression, bytes(r.thumbnail)) for r in ex.thumbnails(df, "id").collect()] == [(6, b"JPEG")]
    assert ex.fields(df, names={"GPS_IFD": {1: "GPSLatitudeRef"}}).where("ifd = 'GPS_IFD'").first().name == "GPSLatitudeRef"


def test_thumbnails_of_written_blocks(spark):
    df = spark.createDataFrame([(1, b"JPEG" * 50, 6), (2, b"", 1), (3, None, 6)], "id long, t binary, c int")
    main, sub = [(274, 3, F.lit(1), ex.uint(F.lit(3), 2))], [(40961, 3, F.lit(1), ex.uint(F.lit(1), 2))]
    for exif in ((), sub):
        made = df.select("id", ex.block(main, exif, F.col("t"), F.col("c")).alias("data"))
        assert sorted((r.id, r.compression, bytes(r.thumbnail)) for r in ex.thumbnails(made, "id").collect()) == [(1, 6, b"JPEG" * 50), (2, 1, b"")]
        assert {(r.id, r.ifd, r.tag) for r in ex.fields(made).collect()} >= {(1, "IFD0", 274), (1, "IFD1", 259), (2, "IFD1", 513)}
        assert ex.fields(made).where("ifd = 'ExifIFD' and tag = 40961").count() == (2 if exif else 0)


def test_broken_blocks_give_no_or_null_fields(spark):
    whole = block("<")
    bad = [None, b"", b"II", b"II*\0", b"JUNKJUNKJUNK", b"II*\0\xff\xff\xff\xff", whole[:60], b"MM\0*\0\0\0\x08\xff\xff"]
    df = spark.createDataFrame([(i, "x", None if b is None else bytearray(b)) for i, b in enumerate(bad)], "id long, name string, data binary")
    rows = ex.fields(df).collect()
    assert {r.id for r in rows} == {6} and rows[0].raw is None
    assert ex.fields(df.limit(0)).count() == 0


def test_blocks_are_computed_once(spark):
    told = F.encode(F.sha2(F.col("id").cast("string").cast("binary"), 256), "US-ASCII")
    blocks = spark.range(40).select("id", ex.block([(271, ASCII, F.length(told), told)], [(37385, SHORT, F.lit(1), ex.uint(F.col("id"), 2))]).alias("data"))
    got = ex.fields(blocks).where("tag <> 34665")
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    assert len([line for line in plan if "sha2" in line]) == 1  # no filter computes the blocks as well
    assert sorted((r.id, r.tag, r.numbers) for r in got.where("tag = 37385").collect()) == [(i, 37385, [float(i)]) for i in range(40)]


def test_compressed_texts(spark):
    raw = b"Key\0\0" + zlib.compress("héllo".encode("latin-1"))
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"Key\0\0junk")), (3, bytearray(b"nozero")), (4, None)], "id long, data binary")
    got = [tuple(r.t) for r in df.select("id", ch.parse_ztext_chunk(F.col("data")).alias("t")).orderBy("id").collect()]
    assert got == [("Key", 0, "héllo"), ("Key", 0, None), (None, None, None), (None, None, None)]
    both = [b"K\0\1\0en\0t\0" + zlib.compress("日本".encode()), b"K\0\0\0en\0t\0" + "日本".encode()]
    df = spark.createDataFrame([(bytearray(b),) for b in both], "data binary")
    assert [r[0] for r in df.select(ch.parse_itext_chunk(F.col("data")).alias("p")).select(ch.itext_text(F.col("p"))).collect()] == ["日本"] * 2


def test_fields_of_the_users_own(spark):
    from pyspark.sql import functions as F

    from rasterloom.functions import chunks as ch
    from rasterloom.functions import exif as ex

    one = F.lit(1)
    data = ex.block([(271, 2, F.lit(4), F.lit(bytearray(b"abc\0"))), (274, 3, one, ch.uint(F.lit(6), 2))], [(50000, 3, one, ch.uint(F.lit(70), 2))])
    blocks = spark.range(1).select("id", data.alias("data"))
    ex.register("ExifIFD", 50000, "Coolness", lambda raw, numbers, little: F.concat(F.get(numbers, F.lit(0)).cast("int").cast("string"), F.lit(" degrees")))
    ex.register("IFD0", 274, "Turned", None)
    ex.register("IFD0", 271, "Maker", lambda raw, numbers, little: F.upper(F.decode(raw, "US-ASCII")))
    try:
        got = {r.tag: (r.name, r.text) for r in ex.fields(blocks).collect()}
        assert got[50000] == ("Coolness", "70 degrees") and got[274][0] == "Turned" and got[271] == ("Maker", "ABC\0")
        for bad in (("IFD9", 1), ("IFD0", 70_000), ("IFD0", -1)):
            with pytest.raises(ValueError):
                ex.register(*bad, "x")
    finally:
        for key in (("ExifIFD", 50000), ("IFD0", 274), ("IFD0", 271)):
            ex.unregister(*key)
    assert {r.tag: r.name for r in ex.fields(blocks).collect()}[50000] == "Unknown 50000"
