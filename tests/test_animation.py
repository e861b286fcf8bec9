import numpy as np
import pytest

from rasterloom.operators import animation as an
from rasterloom.sources import apng, codec, images

FRAMES = "image_id long, frame long, w long, h long, x_off long, y_off long, delay_num long, delay_den long, dispose string, blend string"


def test_rows_folded_apart_equal_the_whole_canvas(spark):
    rng = np.random.default_rng(5)
    w, h, frames, pixels, whole = 5, 4, [], [], []
    for n in range(7):
        fw, fh = (w, h) if n == 0 else (int(rng.integers(1, w + 1)), int(rng.integers(1, h + 1)))
        x, y = int(rng.integers(0, w - fw + 1)), int(rng.integers(0, h - fh + 1))
        dispose, blend = ["none", "background", "previous"][n % 3], ["source", "over"][n % 2]
        px = rng.integers(0, 256, (fh, fw, 2)).astype(float)
        px[..., 1] = rng.choice([0, 128, 255], (fh, fw))
        frames.append((1, n, fw, fh, x, y, dispose, blend))
        pixels += [(1, n, j, i, *map(float, px[j, i])) for j in range(fh) for i in range(fw)]
        whole.append((px, x, y, dispose, blend))
    want = {(n, j, i): tuple(c[j, i]) for n, c in enumerate(x.copy() for x in an.play(np.zeros((h, w, 2)), iter(whole))) for j in range(h) for i in range(w)}
    f = spark.createDataFrame(frames, "image_id long, frame long, w int, h int, x_off int, y_off int, dispose string, blend string")
    p = spark.createDataFrame(pixels, "image_id long, frame long, y long, x long, c0 double, c1 double")
    got = {(r.frame, r.y, r.x): (r.c0, r.c1) for r in an.composed(f, p, w, h, 2).collect()}
    assert got == want


def clip(spark, n=3):
    frames = spark.createDataFrame([(5, k, 3 - k % 2, 2 - k % 2, k % 2, k % 2, k, 10, "none", "over") for k in range(n)], FRAMES)
    rows = spark.createDataFrame([(5, k, y, [float(10 * k + y + v) for v in range(3 - k % 2)]) for k in range(n) for y in range(2 - k % 2)], "image_id long, frame long, y long, vals array<double>")
    return frames, rows


def test_animation_files(spark):
    frames, rows = clip(spark)
    files = apng.encode(frames, rows, 1, n_plays=4)
    content = files.first().content
    im = codec.decode(content)
    assert (im.width, im.height, im.n_frames, im.n_plays, im.warnings) == (3, 2, 3, 4, []) and im.samples[..., 0].tolist() == [[0, 1, 2], [1, 2, 3]]
    chunks = images.chunks(files)
    assert [r.type for r in chunks.orderBy("seq").collect()] == ["IHDR", "acTL", "fcTL", "IDAT", "fcTL", "fdAT", "fcTL", "fdAT", "IEND"]
    made = apng.create_frames(chunks)
    assert sorted(map(tuple, made.drop("content").collect())) == sorted(map(tuple, frames.collect()))
    assert sorted((r.frame, r.y, tuple(r["vals"])) for r in apng.frame_rows(made).collect()) == sorted((r.frame, r.y, tuple(r["vals"])) for r in rows.collect())
    # pixel data that no frame control stands before is no frame; data in several chunks is put together
    parts = [(t, d) for t, d, _, _ in im.chunks]
    first, second = parts[5][1][4:9], parts[5][1][9:]
    number = lambda n: n.to_bytes(4, "big")
    loose = [parts[0], parts[1], parts[3], ("fcTL", number(0) + parts[4][1][4:]), ("fdAT", number(1) + first), ("fdAT", number(2) + second), parts[8]]
    loose[1] = ("acTL", number(1) + number(0))
    table = spark.createDataFrame([(9, i, t, bytearray(d), "after_IDAT" if i > 2 else "after_IHDR") for i, (t, d) in enumerate(loose)], "image_id long, seq int, type string, data binary, pos string")
    assert [r["vals"] for r in apng.frame_rows(apng.create_frames(table)).collect()] == [[10, 11]]
    assert apng.validity(table).first().valid
    with pytest.raises(Exception, match="reaches beyond"):
        apng.encode(frames.replace(1, 2, "x_off"), rows, 1).collect()
    with pytest.raises(Exception, match="is missing"):
        apng.encode(frames.where("frame <> 1"), rows, 1).collect()


def test_validity(spark):
    chunks = images.chunks(apng.encode(*clip(spark), 1)).drop("crc_ok")
    rows = [tuple(r) for r in chunks.orderBy("seq").collect()]
    change = lambda k, **v: [r if i != k else tuple(v.get(n, x) for n, x in zip(("image_id", "seq", "type", "data", "pos"), r)) for i, r in enumerate(rows)]
    told = lambda rs: [r.reasons for r in apng.validity(spark.createDataFrame(rs, chunks.schema)).collect()]
    assert told(rows) == [[]]
    assert told([r for r in rows if r[2] not in ("acTL", "fcTL", "fdAT")]) == []
    assert told(change(1, pos="after_IDAT")) == [["acTL after the pixel data"]]
    assert told([*rows, (5, 20, *rows[1][2:])]) == [["more than one acTL"]]
    assert told(change(5, data=bytearray(b"\0\0\0\7" + bytes(rows[5][3])[4:]))) == [["sequence numbers aren't 0, 1, 2 and so on"]]
    assert told(change(1, data=bytearray(b"\0\0\0\5" + bytes(4)))) == [["acTL tells another number of frames"]]
    wide = bytes(rows[4][3])
    assert told(change(4, data=bytearray(wide[:4] + b"\0\0\0\4" + wide[8:]))) == [["a frame reaches beyond the canvas"]]
    assert "a frame control without data" in told(rows[:7] + rows[8:])[0]


def test_cropping_and_frame_controls(spark):
    frames = spark.createDataFrame([(1, 0, 2, 2, 0, 0, 1, 1, "none", "source"), (1, 1, 2, 2, -1, 1, 1, 1, "none", "source"), (1, 2, 1, 1, 5, 0, 1, 1, "none", "source")], FRAMES)
    px = spark.createDataFrame([(1, k, y, x, float(4 * k + 2 * y + x), 255.0) for k in (0, 1) for y in (0, 1) for x in (0, 1)] + [(1, 2, 0, 0, 9.0, 9.0)], "image_id long, frame long, y long, x long, c0 double, c1 double")
    f, p = an.cropped(frames, px, 2, 2)
    assert sorted((r.frame, r.w, r.h, r.x_off, r.y_off, r.blend) for r in f.collect()) == [(0, 2, 2, 0, 0, "source"), (1, 1, 1, 0, 1, "source"), (2, 1, 1, 0, 0, "over")]
    assert sorted((r.frame, r.y, r.x, r.c0, r.c1) for r in p.where("frame > 0").collect()) == [(1, 0, 0, 5.0, 255.0), (2, 0, 0, 0.0, 0.0)]
    with pytest.raises(Exception, match="needs an image with alpha"):
        an.cropped(frames, px.drop("c1"), 2, 2)[0].collect()
    with pytest.raises(Exception, match="larger than the canvas"):
        an.cropped(frames, px, 1, 2)[0].collect()
    assert [(r.frame, r.delay_num) for r in an.set_delay(f, -1, 7, 8).orderBy("frame").collect()] == [(0, 1), (1, 1), (2, 7)]
    assert [(r.frame, r.x_off) for r in an.set_offset(f, 1, 1, 0).orderBy("frame").collect()] == [(0, 0), (1, 1), (2, 0)]
    for bad in (lambda: an.set_delay(f, 3, 1, 1).collect(), lambda: an.set_delay(f, -3, 1, 1).collect()):
        with pytest.raises(Exception, match="no frame"):
            bad()
    for n, x in ((0, 0), (1, 2), (1, -1)):
        with pytest.raises(Exception, match="can't be moved"):
            an.set_offset(f, n, x, 0).collect()
    with pytest.raises(ValueError):
        an.set_delay(f, 0, 65536, 1)
    shown = an.canvas_at(f, p, 1, 2, 2, 2)
    assert sorted((r.y, r.x, r.c0) for r in shown.collect()) == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 5.0), (1, 1, 3.0)]


def test_frames_without_all_their_rows_raise(spark):
    frames, rows = clip(spark)
    for bad in (rows.where("frame <> 1"), rows.where("frame <> 2 or y > 0"), rows.where("frame <> 0 or y <> 0"), rows.unionByName(rows.where("frame = 0 and y = 0"))):
        with pytest.raises(Exception, match="lacks rows"):
            apng.encode(frames, bad, 1).collect()


def test_animated_files_with_chunks(spark):
    frames, rows = clip(spark)
    more = spark.createDataFrame([(5, 3, "tEXt", bytearray(b"k\0late"), None), (5, 1, "tEXt", bytearray(b"k\0one"), "after_IHDR"), (5, 2, "gAMA", bytearray(b"\0\0\0\7"), "after_IHDR"), (5, 0, "IHDR", bytearray(b""), None)], "image_id long, seq int, type string, data binary, pos string")
    im = codec.decode(apng.encode(frames, rows, 1, chunks=more).first().content)
    assert [t for t, *_ in im.chunks] == ["IHDR", "tEXt", "gAMA", "acTL", "fcTL", "IDAT", "fcTL", "fdAT", "fcTL", "fdAT", "tEXt", "IEND"] and im.warnings == []


def repair(spark, rows, schema):
    return [(r.seq, r.type, bytes(r.data), r.pos) for r in apng.repaired(spark.createDataFrame(rows, schema)).orderBy("seq").collect()]


def test_repair(spark):
    chunks = images.chunks(apng.encode(*clip(spark, 4), 1, n_plays=3)).drop("crc_ok")
    rows, schema = [tuple(r) for r in chunks.orderBy("seq").collect()], chunks.schema
    sound = [(r[1], r[2], bytes(r[3]), r[4]) for r in rows]
    assert repair(spark, rows, schema) == sound  # IHDR acTL fcTL IDAT and a control and data for each frame more
    without = lambda *k: repair(spark, [r for i, r in enumerate(rows) if i not in k], schema)
    kinds = lambda got: [t for _, t, _, _ in got]
    number = lambda got: [int.from_bytes(d[:4], "big") for _, t, d, _ in got if t in ("fcTL", "fdAT")]
    assert [c[1:] for c in without(1)] == [(t, d if t != "acTL" else d[:4] + bytes(4), p) for _, t, d, p in sound]  # plays are not known any more
    cut = without(7)  # the second frame's data: it and what follows go
    assert kinds(cut) == ["IHDR", "acTL", "fcTL", "IDAT", "fcTL", "fdAT", "IEND"] and cut[1][2] == b"\0\0\0\2\0\0\0\3" and number(cut) == [0, 1, 2]
    assert kinds(without(9)) == kinds(sound)[:8] + ["IEND"]  # a last control without data
    late = without(2)  # the picture's control: the picture is no frame
    assert kinds(late) == ["IHDR", "acTL", "IDAT"] + ["fcTL", "fdAT"] * 3 + ["IEND"] and number(late) == list(range(6)) and late[3][3] == "after_IDAT"
    still = ["IHDR", "IDAT", "IEND"]
    assert kinds(without(2, 4, 6, 8)) == still and kinds(without(5, 7, 9)) == still
    mixed = [(r[0], 100 - r[1] if r[2] in ("fcTL", "fdAT") and r[1] > 3 else r[1] + 200 * (r[2] == "IEND"), *r[2:]) for r in rows]
    assert [c[1:] for c in repair(spark, mixed, schema)] == [c[1:] for c in sound]
    wide = [r if i != 6 else (*r[:3], bytearray(bytes(r[3])[:4] + b"\0\0\0\x09" + bytes(r[3])[8:]), r[4]) for i, r in enumerate(rows)]
    assert kinds(repair(spark, wide, schema)) == ["IHDR", "acTL", "fcTL", "IDAT", "fcTL", "fdAT", "IEND"]
    plain = [r for r in rows if r[2] in still]
    assert kinds(repair(spark, plain, schema)) == still
    played = apng.create_frames(apng.repaired(spark.createDataFrame([r for i, r in enumerate(rows) if i != 7], schema)))
    assert sorted(r.frame for r in played.collect()) == [0, 1]


def test_checkpoints_and_streams_of_any_batch(spark):
    rng = np.random.default_rng(6)
    frames = spark.createDataFrame([(i, n, 4 if n == 0 else 2, 3 if n == 0 else 2, 0 if n == 0 else n % 3, 0 if n == 0 else n % 2, 1, 1, ["none", "background", "previous"][n % 3], ["source", "over"][n % 2]) for i in (1, 2) for n in range(23)], FRAMES)
    pixels = spark.createDataFrame([(i, n, y, x, float(rng.integers(0, 256)), float(rng.choice([0, 128, 255]))) for i in (1, 2) for n in range(23) for y in range(3 if n == 0 else 2) for x in range(4 if n == 0 else 2)], "image_id long, frame long, y long, x long, c0 double, c1 double")
    whole = {tuple(r[:4]): tuple(r[4:]) for r in an.composed(frames, pixels, 4, 3, 2).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {tuple(r[:4]): tuple(r[4:]) for r in an.composed(frames, pixels, 4, 3, 2).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    stored = an.checkpoints(frames, pixels, 4, 3, 8, 2)
    assert sorted({(r.image_id, r.frame) for r in stored.collect()}) == [(i, f) for i in (1, 2) for f in (7, 15)]
    for n in (0, 7, 8, 15, 20, 22, 50):
        want = {k: v for k, v in whole.items() if k[1] == n % 23}
        assert {tuple(r[:4]): tuple(r[4:]) for r in an.canvas_at(frames, pixels, n, 4, 3, 2, stored).collect()} == want
        assert {tuple(r[:4]): tuple(r[4:]) for r in an.canvas_at(frames, pixels, n, 4, 3, 2).collect()} == want


def test_pushed_frames(spark):
    frames, rows = clip(spark)
    pixels = rows.selectExpr("image_id", "frame", "y", "posexplode(vals) as (x, c0)").selectExpr("image_id", "frame", "y", "cast(x as long) as x", "c0")
    new = spark.createDataFrame([(5, 2, 2, 2, -1)], "image_id long, w long, h long, x_off long, y_off long")
    own = spark.createDataFrame([(5, y, x, float(10 * y + x)) for y in (0, 1) for x in (0, 1)], "image_id long, y long, x long, c0 double")
    f, p = an.push(frames, pixels, new, own)
    assert [tuple(r) for r in f.where("frame = 3").collect()] == [(5, 3, 1, 1, 2, 0, 1, 24, "none", "source")] and f.count() == 4
    assert [(r.y, r.x, r.c0) for r in p.where("frame = 3").collect()] == [(0, 0, 10.0)] and p.count() == pixels.count() + 1
    from pyspark.sql import functions as F

    for bad in (new.withColumn("delay_num", F.lit(70_000)), new.withColumn("dispose", F.lit("never")), new.withColumn("blend", F.lit("under"))):
        with pytest.raises(Exception, match="out of range"):
            an.push(frames, pixels, bad, own)[0].collect()
    with pytest.raises(Exception, match="larger"):
        an.push(frames, pixels, new.withColumn("w", F.lit(9)), own)[0].collect()
    with pytest.raises(ValueError):
        an.push(frames, pixels, new, own.withColumn("c1", F.lit(1.0)))
    with pytest.raises(Exception, match="needs an image with alpha"):
        an.push(frames, pixels, new.withColumn("x_off", F.lit(50)), own)[0].collect()
