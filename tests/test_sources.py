import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import bands, codec, datasource, images

SAMPLES = np.arange(6 * 4).reshape(6, 4, 1) % 251


def saved(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.png").write_bytes(content)
    return str(tmp_path)


def png(h, w, ancillary=(), **options):
    return codec.encode_png((np.arange(h * w * 3).reshape(h, w, 3) * 7) % 256, 8, 0, list(ancillary), **options)


def test_headers_are_read_in_as_many_bytes_whatever_the_size(spark, tmp_path):
    datasource.register(spark)
    long_text = [("tEXt", b"Comment\0" + b"x" * 100_000, "after_IHDR")]
    at = saved(tmp_path, small=png(2, 2), large=png(400, 300), texts=png(2, 2, long_text), key=png(2, 2, [("tRNS", bytes(6), "after_IHDR")]), broken=b"\x89PNG\r\n\x1a\n\0\0", other=b"GIF89a and so on")
    (tmp_path / "map.png").write_bytes(codec.encode_bmp(np.zeros((3, 5, 3))))
    rows = {os.path.basename(r.path)[:-4]: r for r in spark.read.format("raster_headers").load(at).collect()}
    assert (rows["small"].width, rows["large"].height, rows["large"].width, rows["large"].channels) == (2, 400, 300, 3)
    assert rows["small"].read_bytes == rows["large"].read_bytes < 64
    assert rows["texts"].read_bytes == rows["small"].read_bytes + 8  # the head of its chunk
    assert rows["key"].has_alpha and not rows["small"].has_alpha
    assert (rows["map"].format, rows["map"].width, rows["map"].height) == ("bmp", 5, 3)
    assert rows["broken"].error and rows["other"].error and rows["broken"].width is None
    whole = {r.image_id: r for r in images.headers(spark.createDataFrame([(1, bytearray(png(400, 300)))], "image_id long, content binary")).collect()}
    assert (whole[1].width, whole[1].height, whole[1].color_type) == (rows["large"].width, rows["large"].height, rows["large"].color_type)


def test_chunks_are_stepped_over(spark, tmp_path):
    datasource.register(spark)
    at = saved(tmp_path, a=png(40, 30, [("tEXt", b"k\0one", "after_IHDR"), ("tIME", bytes(7), "after_IDAT")]))
    rows = spark.read.format("raster_chunks").load(at).orderBy("seq").collect()
    assert [(r.type, r.pos) for r in rows] == [("IHDR", "after_IHDR"), ("tEXt", "after_IHDR"), ("IDAT", "after_IDAT"), ("tIME", "after_IDAT"), ("IEND", "after_IDAT")]
    assert rows[2].data is None and rows[2].length > 100 and rows[1].data == b"k\0one" and rows[1].crc_ok
    found = spark.read.format("raster_chunks").load(at).where("type in ('tEXt', 'tIME')")
    assert sorted(r.type for r in found.collect()) == ["tEXt", "tIME"]
    assert "type" in found._jdf.queryExecution().executedPlan().toString()
    reader = datasource.ChunkReader({"path": "file://" + at}, datasource.CHUNKS)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    other = GreaterThan(("length",), 3)
    assert list(reader.pushFilters([EqualTo(("type",), "tEXt"), other, In(("type",), ("tEXt", "tIME"))])) == [other] and reader.kinds == {"tEXt"}
    assert spark.read.format("raster_chunks").option("columns", "path,type,length").load(at).columns == ["path", "type", "length"]
    assert [r.type for r in spark.read.format("raster_chunks").option("skip_ancillary", "true").load(at).orderBy("seq").collect()] == ["IHDR", "IDAT", "IEND"]
    assert spark.read.format("raster_chunks").option("pixels", "true").load(at).where("type = 'IDAT'").first().crc_ok
    (tmp_path / "cut.png").write_bytes(png(4, 4)[:50])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("raster_chunks").load(at).collect()
    assert spark.read.format("raster_chunks").option("errors", "skip").load(at).count() == 5


def test_rows_of_many_files_come_in_few_batches(tmp_path):
    at = saved(tmp_path, **{f"f{k:03}": png(2, 2, [("tEXt", b"k\0%d" % k, "after_IHDR")]) for k in range(300)})
    reader = datasource.ChunkReader({"path": "file://" + at}, datasource.CHUNKS)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) == 2 and sum(b.num_rows for b in batches) == 1200
    assert [d for b in batches for d, t in zip(b.column(6).to_pylist(), b.column(2).to_pylist()) if t == "tEXt"] == [b"k\0%d" % k for k in range(300)]
    heads = datasource.HeaderReader({"path": "file://" + at})
    assert [b.num_rows for p in heads.partitions() for b in heads.read(p)] == [300]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    datasource.register(spark)
    files = spark.range(40).select(F.col("id").alias("image_id"), F.lit(bytearray(png(2, 2))).alias("content")).repartition(4)
    out = tmp_path / "out"
    fails = files.withColumn("content", F.when(F.col("image_id") == 33, F.raise_error(F.lit("no such file")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no such file"):
        fails.write.format("raster").mode("append").save(str(out))
    assert not out.exists() or os.listdir(out) == []
    files.write.format("raster").mode("append").save(str(out))
    assert len(os.listdir(out)) == 40 and not any(n.startswith("_") for n in os.listdir(out))
    files.limit(3).write.format("raster").mode("overwrite").save(str(out))
    assert len(os.listdir(out)) == 3
    with pytest.raises(Exception, match="one name"):
        files.withColumn("image_id", F.lit(1)).write.format("raster").mode("append").save(str(out))
    assert len(os.listdir(out)) == 3
    with pytest.raises(Exception, match="name"):
        files.select("content").write.format("raster").mode("append").save(str(out))


def test_bands_join_to_one_file(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = np.concatenate([np.arange(50 * 21 * 3).reshape(50, 21, 3) % 256, rng.integers(-300, 900, (27, 21, 3))]).astype(float)
    rows = spark.createDataFrame([(4, y, a[y].reshape(-1).tolist()) for y in range(77)], "image_id long, y long, vals array<double>").repartition(5)
    for depth in (8, 16):
        parts = bands.encode(rows, 3, band_rows=10, bit_depth=depth)
        assert [r.part for r in parts.orderBy("part").collect()] == list(range(-1, 9))
        content = b"".join(r.content for r in parts.orderBy("part").collect())
        im = codec.decode(content)
        assert im.warnings == [] and (im.samples == a.astype(int) % (1 << depth)).all()
        stream = b"".join(d for t, d, _ in codec.chunks_of(content) if t == "IDAT")
        assert zlib.decompress(stream)  # checks the sum of all bands
    bands.save(bands.encode(rows, 3, band_rows=10), str(tmp_path / "one"))
    assert os.listdir(tmp_path / "one") == ["4.png"] and (codec.decode((tmp_path / "one/4.png").read_bytes()).samples == a.astype(int) % 256).all()
    for bad in (rows.where("y <> 33"), rows.where("y < 20 or y >= 30"), rows.unionByName(rows.where("y = 5")), rows.withColumn("vals", F.when(F.col("y") == 40, F.slice("vals", 1, 3)).otherwise(F.col("vals")))):
        with pytest.raises(Exception, match="lacks rows"):
            bands.encode(bad, 3, band_rows=10).collect()


def test_images_with_gaps_raise(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 2, [3.0, 4.0])], "image_id long, y long, vals array<double>")
    uneven = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0])], "image_id long, y long, vals array<double>")
    for bad in (rows, uneven, rows.withColumn("y", F.lit(0))):
        with pytest.raises(Exception, match="lacks rows"):
            images.encode(bad, 1).collect()
