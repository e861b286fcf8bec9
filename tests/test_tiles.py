import numpy as np
import pytest

from rasterloom.operators import pixels as px
from rasterloom.operators import relations as rel
from rasterloom.operators import stencil as st
from rasterloom.operators import tiles


def image(spark, arrays):
    rows = [(k, y, x, *map(float, a[y, x])) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y long, x long, " + ", ".join(f"c{c} double" for c in range(arrays[0].shape[2])))


def read(df, shapes):
    out = [np.full(s, np.nan) for s in shapes]
    for r in df.collect():
        out[r.image_id][r.y, r.x] = [r[f"c{k}"] for k in range(shapes[0][2])]
    return out


def plain(a, kernel, border):
    kh, kw = kernel.shape
    h, w, _ = a.shape
    out = np.zeros(a.shape)
    for y in range(h):
        for x in range(w):
            for i in range(kh):
                for j in range(kw):
                    sy, sx = (int(tiles.border_index(np.array([v]), n, border)[0]) for v, n in ((y - kh // 2 + i, h), (x - kw // 2 + j, w)))
                    if sy >= 0 and sx >= 0:
                        out[y, x] += kernel[kh - 1 - i, kw - 1 - j] * a[sy, sx]
    return out


def test_borders():
    i = np.arange(-5, 9)
    assert tiles.border_index(i, 4, "replicate").tolist() == [0, 0, 0, 0, 0, 0, 1, 2, 3, 3, 3, 3, 3, 3]
    assert tiles.border_index(i, 4, "circular").tolist() == [3, 0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3, 0]
    assert tiles.border_index(i, 4, "symmetric").tolist() == [1, 2, 3, 2, 1, 0, 1, 2, 3, 2, 1, 0, 1, 2]
    assert tiles.border_index(i, 4, "zero").tolist() == [-1] * 5 + [0, 1, 2, 3] + [-1] * 5
    assert tiles.border_index(i, 1, "symmetric").tolist() == [0] * 14


@pytest.mark.parametrize("border", st.BORDERS)
def test_tiles_equal_whole_images_whatever_the_kernel(spark, border, monkeypatch):
    rng = np.random.default_rng(7)
    arrays = [rng.integers(0, 9, (h, w, 2)).astype(float) for h, w in ((9, 11), (1, 1), (4, 3), (13, 5))]
    img = image(spark, arrays)
    for shape in ((3, 3), (2, 5), (9, 1), (1, 12)):
        kernel = rng.integers(-3, 4, shape).astype(float)
        for side in (4, 64):
            kh, kw = shape
            got = tiles.stencil(img, (kh // 2, kh - 1 - kh // 2, kw // 2, kw - 1 - kw // 2), border, 0.0, tiles.weighted([kernel.tolist()] * 2), side)
            for a, b in zip(read(got, [a.shape for a in arrays]), arrays):
                np.testing.assert_array_equal(a, plain(b, kernel, border))


def test_running_extrema_of_any_width_equal_sliding_windows():
    rng = np.random.default_rng(8)
    for n in (1, 5, 16, 17):
        v = rng.normal(size=(2, 3, n))
        for width in range(1, n + 1):
            want = np.lib.stride_tricks.sliding_window_view(v, width, -1)
            np.testing.assert_array_equal(tiles.running(v, width, np.maximum, -np.inf), want.max(-1))
            np.testing.assert_array_equal(tiles.running(v, width, np.minimum, np.inf), want.min(-1))


def test_flat_elements_equal_their_cells(spark):
    rng = np.random.default_rng(9)
    arrays = [rng.integers(0, 99, (7, 13, 1)).astype(float)]
    img = image(spark, arrays)
    for h, w in ((1, 5), (4, 3), (1, 12)):
        flat = np.full((h, w), 2.0)
        for op, sign in ((st.dilate, 1), (st.erode, -1)):
            (got,) = read(op(img, flat.tolist()), [(7, 13, 1)])
            want = np.full((7, 13, 1), -np.inf * sign)
            for y in range(7):
                for x in range(13):
                    cells = [arrays[0][yy, xx, 0] + sign * 2.0 for i in range(h) for j in range(w) for yy, xx in [(y - sign * (i - h // 2), x - sign * (j - w // 2))] if 0 <= yy < 7 and 0 <= xx < 13]
                    want[y, x] = max(cells) if sign > 0 else min(cells)
            np.testing.assert_array_equal(got, want)


def test_shuffled_rows_follow_tiles_not_kernel_cells(spark):
    img = spark.range(128 * 128).selectExpr("0L as image_id", "id div 128 as y", "id % 128 as x", "cast(id % 7 as double) as c0", "128L as h", "128L as w")
    pieces = {}
    for k in (3, 31):
        out = st.convolve(img, [[1.0] * k] * k, "circular")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("MapInArrow") >= 2
        assert out.count() == 128 * 128


def test_order_operators_work_on_each_image(spark):
    rng = np.random.default_rng(10)
    arrays = [rng.integers(0, 5, (4, 6, 2)).astype(float) for _ in range(3)] + [np.full((2, 2, 2), 9.0)]
    img = image(spark, arrays)
    flat = [[(tuple(a[y, x]), y, x) for y in range(a.shape[0]) for x in range(a.shape[1])] for a in arrays]
    pick = lambda df: {k: [((r.c0, r.c1), r.y, r.x) for r in sorted((r for r in df.collect() if r.image_id == k), key=lambda r: r.i)] for k in range(4)}
    assert pick(rel.least(img, 5)) == {k: sorted(f)[:5] for k, f in enumerate(flat)}
    assert pick(rel.greatest(img, 5)) == {k: sorted(f, key=lambda p: (-p[0][0], -p[0][1], p[1:]))[:5] for k, f in enumerate(flat)}
    assert pick(rel.ranked(img)) == {k: sorted(f) for k, f in enumerate(flat)}
    assert "WindowGroupLimit" in rel.greatest(img, 5)._jdf.queryExecution().executedPlan().toString()
    holds = px.F.col("c0") < 4
    for op, keep in ((rel.take_while, lambda f, n: f[:n]), (rel.drop_while, lambda f, n: f[n:])):
        got = {k: sorted((r.y, r.x) for r in op(img, holds).collect() if r.image_id == k) for k in range(4)}
        assert got == {k: [p[1:] for p in keep(f, next((i for i, p in enumerate(f) if not p[0][0] < 4), len(f)))] for k, f in enumerate(flat)}
    assert sorted((r.image_id, r.y, r.x) for r in rel.take(img, 3, 5).collect()) == [(k, *f[i][1:]) for k, f in enumerate(flat) for i in range(5, min(8, len(f)))]


def test_distinct_colours_stop_at_the_limit(spark):
    img = spark.range(5000).selectExpr("id % 2 as image_id", "id div 2 as y", "0L as x", "cast(case when id % 2 = 0 then id % 10 else id end as double) as c0").repartition(6)
    assert sorted(map(tuple, rel.distinct_colors(img).collect())) == [(0, 5), (1, 257)]
    assert sorted(map(tuple, rel.palettable(img, 5).collect())) == [(0, True), (1, False)]
    assert rel.palettable(img.limit(0)).collect() == []
