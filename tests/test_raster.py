import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import chunks as ch
from rasterloom.functions import registry
from rasterloom.operators import animation as an
from rasterloom.operators import chunk_tables as ct
from rasterloom.operators import geometry as geo
from rasterloom.operators import pixels as px
from rasterloom.operators import relations as rel
from rasterloom.operators import stencil as st
from rasterloom.sources import codec, generators, images


def image(spark, a):
    a = np.asarray(a, float)
    a = a[..., None] if a.ndim == 2 else a
    rows = [(0, y, x, *map(float, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y long, x long, " + ", ".join(f"c{k} double" for k in range(a.shape[2])))


def array(df):
    rows = df.orderBy("y", "x").collect()
    h, w = rows[-1].y + 1, rows[-1].x + 1
    own = [c for c in df.columns if c[0] == "c" and c[1:].isdigit()]
    out = np.array([[r[c] for c in own] for r in rows]).reshape(h, w, len(own))
    return out[..., 0] if len(own) == 1 else out


def border(i, n, how):
    if 0 <= i < n:
        return i
    if how == "zero":
        return None
    if how == "replicate":
        return min(max(i, 0), n - 1)
    if how == "circular":
        return i % n
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


def convolved(a, k, how):
    out = np.zeros(a.shape)
    kh, kw = len(k), len(k[0])
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            for i in range(kh):
                for j in range(kw):
                    sy, sx = border(y - kh // 2 + i, a.shape[0], how), border(x - kw // 2 + j, a.shape[1], how)
                    if sy is not None and sx is not None:
                        out[y, x] += k[kh - 1 - i][kw - 1 - j] * a[sy, sx]
    return out


@pytest.mark.parametrize("how", st.BORDERS)
@pytest.mark.parametrize("shape,kernel", [((4, 5), [[1, 2, 3], [0, -1, 4]]), ((1, 3), [[1, 2, 3, 4, 5, 6, 7, 8, 9]]), ((3, 1), [[1], [0], [2], [5]])])
def test_convolution(spark, how, shape, kernel):
    a = np.random.default_rng(0).integers(0, 9, shape)
    assert np.allclose(array(st.convolve(image(spark, a), kernel, how)), convolved(a, kernel, how))


def test_kernel_without_centre_fills_zero(spark):
    assert array(st.convolve(image(spark, [[1, 2, 3]]), [[5, 0, 0]], "zero")).tolist() == [[10, 15, 0]]
    with pytest.raises(ValueError):
        st.convolve(image(spark, [[1]]), [[1]], "mirror")


def test_gaussian_sums_to_one():
    assert abs(sum(st.gaussian(1.3)) - 1) < 1e-12 and len(st.gaussian(1.3)) == 9 and len(st.gaussian_deriv(1.0)) == 9


def test_morphology(spark):
    inf = float("-inf")
    a = np.array([[0, 5, 1], [7, 2, 9], [3, 3, 3]])
    assert array(st.dilate(image(spark, a), [[0, 0, 0]])).tolist() == [[5, 5, 5], [7, 9, 9], [3, 3, 3]]
    assert array(st.erode(image(spark, a), [[0], [0], [0]])).tolist() == [[0, 2, 1], [0, 2, 1], [3, 2, 3]]
    assert array(st.dilate(image(spark, a), [[inf, inf, 1]])).tolist() == [[inf, 1, 6], [inf, 8, 3], [inf, 4, 4]]
    b = np.random.default_rng(3).integers(0, 20, (6, 7)).astype(float)
    element = [[inf, 1, inf], [0, 2, 0]]
    cells = [(i - 1, j - 1, v) for i, row in enumerate(element) for j, v in enumerate(row) if v != inf]

    def slow(img, sign):
        out = np.full(img.shape, inf * sign)
        for y in range(6):
            for x in range(7):
                near = [img[y - sign * dy, x - sign * dx] + sign * v for dy, dx, v in cells if 0 <= y - sign * dy < 6 and 0 <= x - sign * dx < 7]
                out[y, x] = (max if sign > 0 else min)(near, default=inf * sign)
        return out

    assert (array(st.closed(image(spark, b), element)) == slow(slow(b, 1), -1)).all()
    assert (array(st.opened(image(spark, b), element)) == slow(slow(b, -1), 1)).all()


def test_resize_clamps_and_keeps_constant(spark):
    assert array(geo.resize(image(spark, [[4, 8]]), 2)).tolist() == [[4, 5, 7, 8]] * 2
    rng = np.random.default_rng(4)
    for sx, sy in ((1.5, 1), (0.4, 2.3), (3, 0.5), (1, 1)):
        a = rng.integers(0, 99, (5, 7)).astype(float)
        h, w = (int(np.floor(n * s + 0.5)) for n, s in ((5, sy), (7, sx)))
        near, mixed = np.zeros((h, w)), np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                v, u = (y + 0.5) / sy - 0.5, (x + 0.5) / sx - 0.5
                half = lambda t: int(np.floor(abs(t) + 0.5) * (1 if t > 0 else -1))
                near[y, x] = a[min(max(half(v), 0), 4), min(max(half(u), 0), 6)]
                y0, x0 = int(np.floor(v)), int(np.floor(u))
                part = lambda t, i, n: {0: 1.0} if n == 1 else {min(max(i, 0), n - 1): 1 - (t - i)} if i < 0 or i >= n - 1 else {i: 1 - (t - i), i + 1: t - i}
                ky, kx = part(v, y0, 5), part(u, x0, 7)
                mixed[y, x] = sum(a[i, j] * p * q for i, p in ky.items() for j, q in kx.items()) / (sum(ky.values()) * sum(kx.values()))
        assert (array(geo.resize(image(spark, a), sx, sy, "nearest")) == near).all()
        assert np.allclose(array(geo.resize(image(spark, a), sx, sy)), mixed)
    assert set(array(geo.resize(image(spark, np.full((5, 3), 7)), 2.7, 0.6)).reshape(-1).round(9)) == {7}
    with pytest.raises(ValueError):
        geo.resize(image(spark, [[1]]), 0)


def test_move_pick_paste_and_errors(spark):
    img = image(spark, [[1, 2], [3, 4]])
    assert array(geo.move(img, 1, 0)).tolist() == [[0, 1], [0, 3]]
    assert array(geo.move(img, 0, -1)).tolist() == [[3, 4], [0, 0]]
    assert array(geo.pick(img, [-1], [1, -2])).tolist() == [[4, 3]]
    assert array(geo.canvas(img, 3, 1)).tolist() == [[1, 2, 0]]
    with pytest.raises(ValueError):
        px.add(img, [1, 2])
    with pytest.raises(Exception, match="differ in size"):
        px.binary(img, image(spark, [[1]]), lambda a, b: a + b, strict=True).collect()
    with pytest.raises(ValueError):
        px.get_channel(img, 1)


def test_chunks_that_are_added_to_are_computed_once(spark):
    none = spark.createDataFrame([], "image_id long, seq int, type string, data binary, pos string")
    docs = spark.range(6).select((F.col("id") % 3).alias("image_id"), F.lit("key").alias("keyword"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    added = ct.add_text(ct.add_text(none, docs, compressed=True), docs)
    plan = added._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    assert sorted((r.image_id, r.seq, r.type) for r in added.collect()) == [(i, k, t) for i in range(3) for k, t in enumerate(["zTXt", "zTXt", "tEXt", "tEXt"])]
    assert sorted((r.image_id, r.text) for r in ct.texts(added).collect()) == sorted((k % 3, f"text {k}") for k in range(6) for _ in range(2))


def test_files_are_held_in_slices_of_a_batch():
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([bytes([k]) * (1 << 20) for k in range(8)])], ["image_id", "content"])
    parts = list(images._slices(iter([whole, whole.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == 1 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole]))


def test_quotients_of_nulls(spark):
    df = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate([5.0, -5.0, 0.0, None, float("nan")])], "image_id long, y long, x long, c0 double")
    by_zero = [r.c0 for r in px.divide(df, 0).orderBy("x").collect()]
    assert by_zero[:2] == [np.inf, -np.inf] and np.isnan(by_zero[2:4]).all() and by_zero[4] == np.inf
    assert [r.c0 for r in px.divide(df, 2).where("x < 4").orderBy("x").collect()] == [2.5, -2.5, 0, None]
    assert [r.c0 for r in px.divide(px.set_channel(df, 0, 3), df).where("x < 4").orderBy("x").collect()] == [3 / 5, -3 / 5, np.inf, None]


def test_sizes_and_places_outside_raise(spark):
    img, other = image(spark, [[1, 2], [3, 4]]), image(spark, [[1, 2, 3], [4, 5, 6]])
    for f in (px.add, px.sub, px.mul, px.power, px.divide, px.atan2, lambda a, b: px.compare(a, b, "gt"), lambda a, b: px.set_channel(a, 0, b), px.stack):
        for pair in ((img, other), (other, img)):
            with pytest.raises(Exception, match="differ in size"):
                f(*pair).collect()
    assert px.binary(img, other, lambda a, b: a + b, strict=False).count() == 4
    assert array(geo.copy_window(other, 1, 0, 2, 1)).tolist() == [[2, 3], [5, 6]] and array(geo.copy(other, 1, 1, 9, 9)).tolist() == [[5, 6]]
    assert px.get_pixel(other, 2, 1).first().c0 == 6 and [r.c0 for r in px.get_row(other, 0, 1).orderBy("x").collect()] == [4, 5, 6]
    assert array(px.set_pixel(other, 0, 1, [9])).tolist() == [[1, 2, 3], [9, 5, 6]]
    for df in (geo.copy_window(other, 1, 0, 3, 1), px.get_pixel(other, 0, 2), px.get_pixel(other, -1, 0), px.get_row(other, 0, 2), px.set_pixel(other, 3, 0, [1])):
        with pytest.raises(Exception, match="outside"):
            df.collect()
    for bad in ([], [1, 2], [0] * 9):
        with pytest.raises(ValueError):
            rel.set_palette(img, bad, bit_depth=1)
    with pytest.raises(ValueError):
        st.convolve(px.to_rgb(img), [[[1]], [[2]]])


def test_kernels_of_their_own_for_each_channel(spark):
    a = np.random.default_rng(6).integers(0, 9, (4, 5, 2)).astype(float)
    kernels = [[[1, 0, 2], [0, 3, 0]], [[0, 5, 0], [-1, 0, 1]]]
    for how in st.BORDERS:
        got = array(st.convolve(image(spark, a), kernels, how))
        assert np.allclose(got, np.stack([convolved(a[..., k], kernels[k], how) for k in range(2)], -1))


def test_runs_of_pixels_go_on_over_rows(spark):
    a = [[1, 1, 2], [2, 2, 1], [1, 1, 1]]
    got = [(r.start, r["values"]) for r in rel.chunk_while(image(spark, a), lambda x, y: x == y).orderBy("run").collect()]
    assert got == [(0, [1, 1]), (2, [2, 2, 2]), (5, [1, 1, 1, 1])]


def test_sizes_that_images_carry_are_not_counted_again(spark):
    from pyspark.sql import functions as F

    img = image(spark, np.arange(20).reshape(4, 5))
    carried = img.withColumns({"h": F.lit(4).cast("bigint"), "w": F.lit(5).cast("bigint")})
    assert np.allclose(array(st.blur(carried)), array(st.blur(img)))
    assert st.blur(carried)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_drawing(spark):
    img = image(spark, np.zeros((9, 9)))
    d = array(geo.draw_disk(img, 4, 4, 2, [10]))
    assert d[4, 4] == 10 and d[4, 6] == 5 and d[0, 0] == 0
    line = array(geo.draw_line(img, 1, 4, 7, 4, [10], 1))
    assert (line[4, 2:7] > 4).all() and line[0].sum() == 0
    assert np.allclose(array(geo.draw_line(img, 4, 1, 4, 7, [10], 1)), line.T)
    assert np.allclose(array(geo.draw_line(img, 4, 4, 4, 4, [10], 4)), d)
    for (x0, y0, x1, y1), width in (((1, 2, 7.5, 5), 3), ((8, 0, 0, 8), 0.5), ((2, 6, 5, 1), 1)):
        want = np.zeros((9, 9))
        for y in range(9):
            for x in range(9):
                near = min(np.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)) for t in np.linspace(0, 1, 4001))
                want[y, x] = 10 * min(max(width / 2 + 0.5 - near, 0), 1)
        assert np.allclose(array(geo.draw_line(img, x0, y0, x1, y1, [10], width)), want, atol=1e-4)


def filtered(values, depth, n, kinds, lace):
    """A PNG stream by an encoder of its own, for all depths, filters and interlacing."""
    h, w = values.shape[:2]
    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if lace else [(0, 0, 1, 1)]
    out = b""
    for y0, x0, dy, dx in passes:
        part = values[y0:h:dy, x0:w:dx]
        if not part.size:
            continue
        bpp, before = max(1, n * depth // 8), None
        for y, row in enumerate(part):
            bits = "".join(format(int(v), f"0{depth}b") for v in row.reshape(-1))
            bits += "0" * (-len(bits) % 8)
            raw = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
            up = before or [0] * len(raw)
            kind = kinds[y % len(kinds)]
            res = []
            for i, v in enumerate(raw):
                a, b, c = (raw[i - bpp] if i >= bpp else 0), up[i], (up[i - bpp] if i >= bpp else 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                res.append((v - [0, a, b, (a + b) // 2, near][kind]) % 256)
            out += bytes([kind, *res])
            before = raw
    return out


def png(head, chunks):
    return codec.MAGIC + codec.chunk("IHDR", head) + b"".join(codec.chunk(t, d) for t, d in chunks) + codec.chunk("IEND", b"")


@pytest.mark.parametrize("color,depth", [(c, d) for c, ds in codec.DEPTHS.items() for d in ds])
@pytest.mark.parametrize("lace", [0, 1])
def test_png_decoding(color, depth, lace):
    rng = np.random.default_rng(depth * 10 + color)
    n, (h, w) = codec.CHANNELS[color], (9, 11)
    values = rng.integers(0, 2**depth, (h, w, n))
    palette = rng.integers(0, 256, (2**depth, 3)).astype(np.uint8) if color == 3 else None
    body = [("PLTE", palette.tobytes())] if color == 3 else []
    stream = zlib.compress(filtered(values, depth, n, [0, 1, 2, 3, 4], lace))
    content = png(struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, lace), [*body, ("IDAT", stream[:20]), ("IDAT", stream[20:])])
    im = codec.decode(content)
    want = palette[values[..., 0]] if color == 3 else values
    assert (im.samples == want).all() and not im.warnings


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("level,depth,lace", [(0, 8, 0), (1, 8, 0), (0, 16, 1), (1, 16, 0), (1, 8, 1)])
def test_png_round_trip(n, level, depth, lace):
    a = np.random.default_rng(n).integers(0, 2**depth, (7, 13, n)).astype(float)
    assert (codec.decode(codec.encode_png(a, depth, level, interlace=lace)).samples == a).all()
    assert (codec.decode(codec.encode_png(a, depth, 0, filters=[4, 3, 2, 1, 0])).samples == a).all()


def test_samples_truncate_and_wrap_and_keys_become_alpha():
    a = np.array([[[-1.7], [256.0], [3.9]]])
    assert codec.decode(codec.encode_png(a)).samples[..., 0].tolist() == [[255, 0, 3]]
    a = np.array([[[1.0], [5.0]]])
    im = codec.decode(codec.encode_png(a, ancillary=[("tRNS", b"\0\5", "after_PLTE"), ("bKGD", b"\0\7", "after_PLTE")]))
    assert im.samples.tolist() == [[[1, 255], [5, 0]]] and im.background == [7] and im.has_alpha and not im.warnings


def test_broken_files():
    good = codec.encode_png(np.zeros((2, 2, 1)))
    for bad in (b"", b"GIF89a", good[:40], codec.MAGIC + good[33:], good.replace(b"IDAT", b"IDAX")):
        with pytest.raises((codec.ImageError, struct.error)):
            codec.decode(bad)
    flipped = bytearray(good)
    flipped[29] ^= 1
    assert codec.decode(bytes(flipped)).warnings == ["the CRC of IHDR doesn't hold"]
    short = png(struct.pack(">IIBBBBB", 2, 3, 8, 0, 0, 0, 0), [("IDAT", zlib.compress(b"\0\1\2\0\3\4"))])
    im = codec.decode(short)
    assert im.samples[..., 0].tolist() == [[1, 2], [3, 4], [0, 0]] and im.warnings
    with pytest.raises(codec.HeaderError):
        codec.decode(png(struct.pack(">IIBBBBB", 2, 3, 4, 2, 0, 0, 0), [("IDAT", b"")]))


def test_level_1_takes_the_filter_that_deflates_best():
    y, x = np.mgrid[:12, :30]
    a = np.stack([(x * 5 + y * y) % 256, np.random.default_rng(3).integers(0, 9, x.shape)], -1)
    wide = 1 + 30 * 2
    by_kind = [filtered(a, 8, 2, [k], 0) for k in range(5)]
    content = codec.encode_png(a, level=1)
    stream = zlib.decompress(b"".join(body for kind, body, _ in codec.chunks_of(content) if kind == "IDAT"))
    for at in range(0, 12 * wide, wide):
        sizes = [len(zlib.compress(s[at + 1 : at + wide], 9)) for s in by_kind]
        assert stream[at] == sizes.index(min(sizes)) and stream[at : at + wide] == by_kind[stream[at]][at : at + wide]
    assert (codec.decode(content).samples == a).all()


def test_bmp_round_trip_and_blending():
    a = np.random.default_rng(1).integers(0, 256, (3, 5, 3))
    assert (codec.decode(codec.encode_bmp(a)).samples == a).all()
    rgba = np.array([[[100.0, 100, 100, 0], [10, 20, 30, 255]]])
    assert codec.decode(codec.encode_bmp(rgba, [1, 2, 3])).samples.tolist() == [[[1, 2, 3], [10, 20, 30]]]
    with pytest.raises(codec.ImageError):
        codec.encode_bmp(np.zeros((1, 1, 1)))


def test_files_in_tables(spark, tmp_path):
    rows = spark.createDataFrame([(7, 1, [3.0, 4.0]), (7, 0, [1.0, 2.0])], "image_id long, y long, vals array<double>")
    files = images.encode(rows, 1)
    images.save(files, str(tmp_path / "out"))
    read = images.read_files(spark, str(tmp_path / "out"))
    assert array(rel.from_rows(images.rows(read), 1).drop("image_id")).tolist() == [[1, 2], [3, 4]]
    mixed = files.unionByName(spark.createDataFrame([(8, bytearray(b"junk")), (9, None)], "image_id long, content binary"))
    got = {r.image_id: (r.format, r.width, r.error) for r in images.headers(mixed).collect()}
    assert got[7] == ("png", 2, None) and got[8][2] == got[9][2] == "ImageError: Unknown image format."
    assert images.rows(mixed.limit(0)).count() == 0 and [r.type for r in images.chunks(mixed, True, errors="skip").collect()] == ["IHDR", "IDAT", "IEND"]
    assert images.rows(mixed, errors="skip").count() == 2
    for broken in (images.rows(mixed), images.chunks(mixed)):
        with pytest.raises(Exception, match="Unknown image format"):
            broken.collect()


def test_data_source(spark, tmp_path):
    from rasterloom.sources import datasource

    datasource.register(spark)
    rows = spark.createDataFrame([(i, y, [float(i), float(y)]) for i in range(5) for y in range(3)], "image_id long, y long, vals array<double>")
    at = tmp_path / "in"
    images.save(images.encode(rows, 1), str(at))
    (at / "_notes.txt").write_bytes(b"not an image")
    read = spark.read.format("raster").option("partition_bytes", "150").load(str(at))
    assert read.rdd.getNumPartitions() > 1
    assert sorted((r.path[-5:], r.y, r.channels, r.vals) for r in read.collect()) == [(f"{i}.png", y, 1, [i, y]) for i in range(5) for y in range(3)]
    assert spark.read.format("raster").load(str(at / "3.png")).count() == 3
    (at / "broken.png").write_bytes(b"junk")
    assert spark.read.format("raster").option("errors", "skip").load(str(at)).count() == 15
    with pytest.raises(Exception, match="Unknown image format"):
        spark.read.format("raster").load(str(at)).collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("raster").load(str(tmp_path / "none")).collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("raster").load(str(tmp_path / "empty")).count() == 0


def test_stream_of_files(spark, tmp_path):
    from rasterloom.streaming.files import arriving_headers

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.png").write_bytes(codec.encode_png(np.zeros((3, 4, 3))))
    query = arriving_headers(spark, str(src)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert [(r.width, r.height, r.channels) for r in spark.table("arrived").collect()] == [(4, 3, 3)]


def test_animation_disposal():
    f = lambda v, a=255: np.array([[[v, a]]], float)
    play = lambda *fr: [c[0, :, 0].tolist() for c in (x.copy() for x in an.play(np.zeros((1, 2, 2)), iter(fr)))]
    assert play((f(1), 0, 0, "none", "source"), (f(2), 1, 0, "background", "source"), (f(3), 0, 0, "previous", "over"), (f(4), 1, 0, "none", "source")) == [[1, 0], [1, 2], [3, 0], [1, 4]]
    assert play((f(9), 0, 0, "previous", "source"), (f(5), 1, 0, "none", "source")) == [[9, 0], [0, 5]]


def test_chunk_fields(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"Key\0caf\xe9"),), (bytearray(b"no zero"),), (bytearray(b"\x10\0x"),)], "d binary")
    assert [tuple(r.t) for r in df.select(ch.parse_text_chunk(F.col("d")).alias("t")).collect()] == [("Key", "café"), ("", "no zero"), ("\x10", "x")]
    one = spark.range(1).select(ch.parse_offs_chunk(ch.offs_chunk(F.lit(-42), F.lit(99), F.lit(1))).alias("o"), ch.parse_gamma_chunk(ch.gamma_chunk(F.lit(0.00042))).alias("g"), ch.file_type(F.unhex(F.lit("424D00"))).alias("t"), ch.parse_raw_chunk(F.lit(bytearray(codec.chunk("IEND", b"")))).alias("c")).first()
    assert tuple(one.o) == (-42, 99, 1) and one.g == 0.00042 and one.t == "bmp" and one.c.type == "IEND" and one.c.crc_ok and one.c.crc == 0xAE426082
    with pytest.raises(Exception, match="four letters"):
        spark.range(1).select(ch.flags(F.lit("ab1d"))).collect()


def test_constructors(spark):
    assert array(generators.constant(spark, 2, 1, [255, 42])).tolist() == [[[255, 42], [255, 42]]]
    for bad in ((0, 5, [1]), (5, 0, [1]), (1, 1, [1] * 5), (1.5, 1, [1])):
        with pytest.raises(ValueError):
            generators.constant(spark, *bad)
    assert array(generators.sequential(spark, 0, -2, -1)).tolist() == [[0, -1, -2]]
    assert generators.hue_palette(spark).count() == 256


def test_palette_is_by_first_appearance(spark):
    rng = random.Random(1)
    a = [[rng.randrange(5) for _ in range(6)] for _ in range(4)]
    seen = list(dict.fromkeys(v for row in a for v in row))
    pal = rel.palette(image(spark, a))
    assert [r.c0 for r in pal.orderBy("idx").collect()] == seen
    assert array(rel.depalette(rel.to_indexed(image(spark, a), pal), pal)).tolist() == a


def test_out_of_range_numbers_and_names_raise(spark):
    from pyspark.sql import functions as F

    from rasterloom.functions import registry

    one = spark.range(1)
    for bad in (ch.gamma_chunk(F.lit(42949.7)), ch.phys_chunk(F.lit(-1), F.lit(0), F.lit(0)), ch.phys_chunk(F.lit(1), F.lit(1 << 32), F.lit(0)), ch.offs_chunk(F.lit(1 << 31), F.lit(0), F.lit(0)), ch.frame_control_chunk(*map(F.lit, (0, 1, 1, 0, 0, 65536, 1, "none", "over")))):
        with pytest.raises(Exception, match="outside"):
            one.select(bad).collect()
    with pytest.raises(Exception, match="none of"):
        one.select(ch.frame_control_chunk(*map(F.lit, (0, 1, 1, 0, 0, 1, 1, "never", "over")))).collect()
    for key in ("", "k" * 80):
        with pytest.raises(Exception, match="1 to 79"):
            one.select(ch.text_chunk(F.lit(key), F.lit("t"))).collect()
    for name, flags in (("abcd", {}), ("ABcD", {}), ("abCd", {"safe": True}), ("aBcD", {}), ("aBCd", {}), ("a1Cd", {}), ("aBC", {})):
        with pytest.raises(ValueError):
            registry.ChunkKind(name, lambda d: d, **flags)
    registry.register(registry.ChunkKind("auDi", lambda d: ch.read_uint(d, 0, 4), public=False, safe=True, position="after_PLTE"))
    assert "auDi" in registry.registered() and one.select(registry.parsed("auDi", ch.uint(F.lit(77), 4)).alias("v")).first().v == 77
    assert [r[0] for r in spark.createDataFrame([("gAMA",), ("auDi",), ("noNe",)], "t string").select(registry.position(F.col("t"))).collect()] == ["after_IHDR", "after_PLTE", "after_IDAT"]
    with pytest.raises(KeyError):
        registry.parsed("zzZz", F.lit(b""))


def test_backgrounds_by_colour_type(spark):
    from pyspark.sql import functions as F

    rows = [(0, 4, b"\0\3", None, [51]), (0, 16, b"\1\2", None, [256]), (4, 8, b"\0\7", None, [7]), (2, 8, b"\0\1\0\2\0\3", None, [1, 2, 3]), (3, 8, b"\1", [[9, 8, 7], [6, 5, 4]], [6, 5, 4]), (2, 8, b"\0\1", None, None), (0, 8, b"\0\1\0\2\0\3", None, None)]
    df = spark.createDataFrame([(c, d, bytearray(b), p) for c, d, b, p, _ in rows], "color_type int, bit_depth int, data binary, palette array<array<bigint>>")
    assert [r[0] for r in df.select(ch.background_color(*(F.col(c) for c in ("data", "color_type", "bit_depth", "palette")))).collect()] == [w for *_, w in rows]
    assert [bytes(r[0]) if r[0] else None for r in spark.createDataFrame([([5],), ([1, 2, 3],)], "c array<int>").select(ch.background_chunk(F.col("c"), 1)).collect()] == [b"\0\5", None]
    for color, body, want in ((0, b"\0\3", [51]), (2, b"\0\3", [])):
        im = codec.decode(png(struct.pack(">IIBBBBB", 1, 1, 4 if color == 0 else 8, color, 0, 0, 0), [("bKGD", body), ("IDAT", zlib.compress(b"\0" + b"\0" * (1 if color == 0 else 3)))]))
        assert im.background == want and bool(im.warnings) == (want == [])


def test_chunk_tables(spark):
    from rasterloom.operators import chunk_tables as ct

    rows = [(1, 0, "IHDR", b"", "after_IHDR"), (1, 1, "gAMA", b"\0\0\0\1", "after_IHDR"), (1, 2, "gAMA", b"\0\0\0\2", "after_IHDR"), (1, 3, "tRNS", b"\0\1", "after_IDAT"), (1, 4, "pHYs", b"\0" * 8 + b"\7", "after_IHDR"), (2, 0, "tEXt", b"b\0B", "after_IDAT")]
    chunks = spark.createDataFrame([(i, s, t, bytearray(d), p) for i, s, t, d, p in rows], "image_id long, seq int, type string, data binary, pos string")
    got = {(r.image_id, r.seq, r.message) for r in ct.diagnostics(chunks, spark.createDataFrame([(1, 6)], "image_id long, color_type int")).collect()}
    assert got == {(1, 2, "occurs more than once"), (1, 3, "stands after the pixel data"), (1, 3, "isn't expected in an image with alpha"), (1, 4, "has an unknown unit")}
    whole = {r.image_id: r.chunks for r in ct.chunk_map(chunks).collect()}
    assert [bytes(v) for v in whole[1]["gAMA"]] == [b"\0\0\0\1", b"\0\0\0\2"] and set(whole[2]) == {"tEXt"}
    more = spark.createDataFrame([(2, "a", "Ä"), (3, "z", None)], "image_id long, keyword string, text string")
    added = ct.add_text(ct.add_text(chunks, more, compressed=True), more)
    assert [(r.image_id, r.type, r.keyword, r.text) for r in ct.texts(added).orderBy("image_id", "rank", "seq").collect() if r.text] == [(2, "tEXt", "b", "B"), (2, "tEXt", "a", "Ä"), (2, "zTXt", "a", "Ä")]
    assert [(r.seq, r.pos) for r in added.where("image_id = 2").orderBy("seq").collect()] == [(0, "after_IDAT"), (1, "after_IDAT"), (2, "after_IDAT")]


def test_files_with_chunks_from_tables(spark):
    rows = spark.createDataFrame([(7, 0, [1.0, 2.0]), (8, 0, [3.0, 4.0])], "image_id long, y long, vals array<double>")
    parts = [(7, 0, "IHDR", b"no", None), (7, 1, "prVt", b"x", "after_IHDR"), (7, 2, "gAMA", b"\0\0\0\1", None), (7, 3, "tRNS", b"\0\2", None), (7, 4, "tIME", b"\7\xd0\1\1\0\0\0", None)]
    chunks = spark.createDataFrame([(i, s, t, bytearray(d), p) for i, s, t, d, p in parts], "image_id long, seq int, type string, data binary, pos string")
    files = images.encode(rows, 1, chunks=chunks)
    got = {i: [r.type for r in images.chunks(files).where(f"image_id = {i}").orderBy("seq").collect()] for i in (7, 8)}
    assert got == {7: ["IHDR", "prVt", "gAMA", "tRNS", "IDAT", "tIME", "IEND"], 8: ["IHDR", "IDAT", "IEND"]}
    assert {r.image_id: r["vals"] for r in images.rows(files).collect()} == {7: [1, 255, 2, 0], 8: [3, 4]}
    assert {r.image_id: r["vals"] for r in images.rows(files, skip_ancillary=True).collect()} == {7: [1, 2], 8: [3, 4]}
    assert {r.has_alpha for r in images.headers(files).collect()} == {True, False} and images.encode(rows, 1, chunks=chunks, skip_ancillary=True).where("image_id = 7").first().content == codec.encode_png(np.array([[[1.0], [2.0]]]))
    rgba = spark.createDataFrame([(1, 0, [100.0, 100.0, 100.0, 0.0])], "image_id long, y long, vals array<double>")
    assert images.rows(images.encode(rgba, 4, "bmp", background=[1, 2, 3])).first()["vals"] == [1, 2, 3]


def test_blob_windows(spark):
    img = spark.createDataFrame([(i, y, x, 10.0 * y + x, 7.0) for i in (1, 2) for y in range(3) for x in range(2 + i)], "image_id long, y long, x long, c0 double, c1 double")
    got = lambda *a, **k: {r.image_id: r.vals for r in rel.to_blob(img, *a, **k).collect()}
    assert got(-1, 1, alpha=False) == {1: [12.0, 22.0], 2: [13.0, 23.0]}
    assert got(4, 0, 1, 1) == {1: [1.0, 7.0], 2: [0.0, 7.0]}
    assert got(0, 0, 0, 2) == {}
    with pytest.raises(Exception, match="beyond the image"):
        got(0, 0, 4, 1)
    with pytest.raises(ValueError):
        rel.to_blob(img, 0, 0, -1, 1)
    wide = spark.createDataFrame([(1, 0, 0, 1.0)], "image_id long, y long, x long, c0 double").select("*", F.lit(1).alias("h"), F.lit(1).alias("w"))
    assert rel.to_blob(wide, alpha=False).first().vals == [1.0] and rel.to_blob(wide.limit(0)).count() == 0


def test_name_conflicts_agree_with_kinds(spark):
    names = ["prVt", "PrVt", "prvt", "prVT", "PRVT", "pRVt", "abc", "", None, "a1Bc", "abcde"]
    rows = [(n, a, p, f) for n in names for a in (True, False) for p in (True, False) for f in (True, False)]
    df = spark.createDataFrame(rows, "n string, a boolean, p boolean, f boolean")
    for r in df.select("*", registry.conflict(F.col("n"), F.col("a"), F.col("p"), F.col("f")).alias("told")).collect():
        try:
            registry.ChunkKind(r.n or "", lambda d: d, r.a, r.p, r.f)
            want = None
        except ValueError as e:
            want = str(e)
        assert (r.told is None) == (want is None), r
        if want and "letter of" in want:
            assert r.told == want
