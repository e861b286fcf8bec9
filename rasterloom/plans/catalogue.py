"""Registered queries of the raster operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks as ch
from ..functions import exif as ex
from ..functions import registry
from ..operators import animation as an
from ..operators import chunk_tables as ct
from ..operators import geometry as geo
from ..operators import pixels as px
from ..operators import relations as rel
from ..operators import stencil as st
from ..session import place, stored
from ..sources import apng, bands, datasource, images
from ..sources import generators as gen
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_E = "e AS (SELECT vec_id, label, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS p FROM embeddings), s AS (SELECT vec_id, label, p, floor((CAST(v AS DOUBLE) + 1) * 127.5) AS q FROM e)"
WALL = f"WITH {_E}, px AS (SELECT CAST(0 AS BIGINT) AS image_id, vec_id AS y, p AS x, q AS c0 FROM s)"
TILES = f"WITH {_E}, px AS (SELECT vec_id AS image_id, p // 8 AS y, p % 8 AS x, q AS c0 FROM s)"
RGBA = f"WITH {_E}, px AS (SELECT vec_id AS image_id, p // 16 AS y, (p // 4) % 4 AS x, " + ", ".join(f"max(q) FILTER (WHERE p % 4 = {k}) AS c{k}" for k in range(4)) + " FROM s GROUP BY ALL)"
AT = "image_id, y, x"
C4 = ["c0", "c1", "c2", "c3"]


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def wall(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(fx.wall(spark, d))


def sized(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(fx.sized_wall(spark, d))


def sized_tiles(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(fx.sized_tiles(spark, d))


def tiles(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(fx.tiles(spark, d))


def rgba(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(fx.rgba(spark, d))


def each(expr: str, names: list[str] = C4) -> str:
    """SELECT list of an expression of {c} for each channel."""
    return f"{AT}, " + ", ".join(f"{expr.format(c=c)} AS {c}" for c in names)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return px.mapped(df, lambda v: F.round(v, n))


# Constructors
add("const_image", tiles(lambda i: gen.constant_like(i, [0.0, 42.0, -1.0])), f"{TILES} SELECT {AT}, 0.0::DOUBLE AS c0, 42.0::DOUBLE AS c1, -1.0::DOUBLE AS c2 FROM px")
add("zeros_ones", tiles(lambda i: px.add(gen.constant_like(i, [0]), px.mul(gen.constant_like(i, [1]), i))), f"{TILES} SELECT * FROM px")
add("sequential_ramp", lambda s, d: gen.ramps(fx.table(s, d, "part").select(F.col("p_partkey").alias("image_id"), "p_size"), "p_size", -3, -0.5), "SELECT p_partkey AS image_id, CAST(0 AS BIGINT) AS y, i AS x, CAST(p_size - 0.5::DOUBLE * i AS DOUBLE) AS c0 FROM part, range(0, 1000) t(i) WHERE p_size - 0.5 * i >= -3")
add("gray_palette", wall(lambda i: rel.depalette(i, gen.gray_palette(i.sparkSession))), f"{WALL} SELECT {AT}, c0, c0 AS c1, c0 AS c2 FROM px")

_HUE = ["least(1, greatest(0, abs(mod(i / 256.0::DOUBLE * 6 + {k}, 6) - 3) - 1))".format(k=k) for k in (0, 4, 2)]
add("hue_palette", wall(lambda i: rel.depalette(i, gen.hue_palette(i.sparkSession))), f"{WALL}, pal AS (SELECT i, " + ", ".join(f"round_even(255 * {h}, 0) AS p{k}" for k, h in enumerate(_HUE)) + f" FROM range(256) t(i)) SELECT {AT}, p0 AS c0, p1 AS c1, p2 AS c2 FROM px LEFT JOIN pal ON c0 = i")
add("set_palette", tiles(lambda i: rel.set_palette(i, [0, 1, 2, 255, 9, 8])), f"{TILES} SELECT image_id, idx, c0, c1, c2 FROM (SELECT DISTINCT image_id FROM px), (VALUES (CAST(0 AS BIGINT), 0.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE), (1, 255, 9, 8)) v(idx, c0, c1, c2)")

# Projections
add("to_rows", tiles(rel.to_rows), f"{TILES} SELECT image_id, y, list(c0 ORDER BY x) AS vals FROM px GROUP BY image_id, y")
add("from_rows", lambda s, d: rel.from_rows(fx.tile_rows(s, d), 2), f"{TILES} SELECT image_id, y, x // 2 AS x, max(c0) FILTER (WHERE x % 2 = 0) AS c0, max(c0) FILTER (WHERE x % 2 = 1) AS c1 FROM px GROUP BY ALL")
add("get_channel", rgba(lambda i: px.get_channel(i, 2)), f"{RGBA} SELECT {AT}, c2 AS c0 FROM px")
add("set_channel", rgba(lambda i: px.set_channel(i, 1, px.get_channel(i, 3))), f"{RGBA} SELECT {AT}, c0, c3 AS c1, c2, c3 FROM px")
add("set_channel_number", rgba(lambda i: px.set_channel(i, 0, 7)), f"{RGBA} SELECT {AT}, 7.0::DOUBLE AS c0, c1, c2, c3 FROM px")
add("stack_channels", rgba(lambda i: px.stack(*(px.get_channel(i, k) for k in (3, 1, 0)))), f"{RGBA} SELECT {AT}, c3 AS c0, c1, c0 AS c2 FROM px")
add("to_gray", rgba(px.to_gray), f"{RGBA} SELECT {AT}, round(0.299e0 * c0 + 0.587e0 * c1 + 0.114e0 * c2) AS c0, c3 AS c1 FROM px")
add("to_rgb", rgba(px.to_rgb), f"{RGBA} SELECT {AT}, c0, c1, c2 FROM px")
add("to_rgba", tiles(px.to_rgba), f"{TILES} SELECT {AT}, c0, c0 AS c1, c0 AS c2, 255.0::DOUBLE AS c3 FROM px")
add("remove_alpha", rgba(px.remove_alpha), f"{RGBA} SELECT {AT}, c0, c1, c2 FROM px")
add("transpose", wall(geo.transpose), f"{WALL} SELECT image_id, x AS y, y AS x, c0 FROM px")
add("copy_window", wall(lambda i: geo.copy_window(i, 40, 100, 10, 20)), f"{WALL} SELECT image_id, y - 20 AS y, x - 10 AS x, c0 FROM px WHERE x BETWEEN 10 AND 40 AND y BETWEEN 20 AND 100")
add("index_slice", wall(lambda i: geo.pick(i, [-1, 0, 5], [3, -2])), f"{WALL}, z AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), g AS (SELECT a.n AS ny, ((a.v % h) + h) % h AS y, b.n AS nx, ((b.v % w) + w) % w AS x FROM z, (VALUES (0, -1), (1, 0), (2, 5)) a(n, v), (VALUES (0, 3), (1, -2)) b(n, v)) SELECT image_id, CAST(ny AS BIGINT) AS y, CAST(nx AS BIGINT) AS x, c0 FROM px JOIN g USING (y, x)")
add("move", wall(lambda i: geo.move(i, 3, -2)), f"{WALL} SELECT a.image_id, a.y, a.x, coalesce(b.c0, 0) AS c0 FROM px a LEFT JOIN px b ON b.y = a.y + 2 AND b.x = a.x - 3")
add("canvas", tiles(lambda i: geo.canvas(i, 10, 6)), f"{TILES}, i AS (SELECT DISTINCT image_id FROM px), g AS (SELECT image_id, y, x FROM i, range(6) a(y), range(10) b(x)) SELECT g.image_id, g.y, g.x, coalesce(c0, 0) AS c0 FROM g LEFT JOIN px USING (image_id, y, x)")
add("point_update", wall(lambda i: px.set_pixel(i, 3, 4, [9])), f"{WALL} SELECT {AT}, CASE WHEN x = 3 AND y = 4 THEN 9.0::DOUBLE ELSE c0 END AS c0 FROM px")
add("get_pixel", rgba(lambda i: px.get_pixel(i, 1, 2)), f"{RGBA} SELECT * FROM px WHERE y = 2 AND x = 1")
add("image_size", tiles(geo.sizes), f"{TILES} SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY image_id")

# Arithmetic
_OTHER = "px a JOIN (SELECT image_id, x AS y, y AS x, c0 AS d0 FROM px) b USING (image_id, y, x)"


def next_tile(i: DataFrame) -> DataFrame:
    return i.withColumn("image_id", F.col("image_id") - 1)


for _name, _f, _sql in [("add", px.add, "c0 + d0"), ("sub", px.sub, "c0 - d0"), ("mul", px.mul, "c0 * d0")]:
    add(f"{_name}_images", tiles(lambda i, f=_f: f(i, geo.transpose(i))), f"{TILES} SELECT {AT}, {_sql} AS c0 FROM {_OTHER}")
add("div_images", tiles(lambda i: rounded(px.divide(i, px.add(geo.transpose(i), 1)))), f"{TILES} SELECT {AT}, round(c0 / (d0 + 1), 6) AS c0 FROM {_OTHER}")
add("pow_images", tiles(lambda i: rounded(px.power(px.divide(i, 128), px.divide(geo.transpose(i), 128)), 5)), f"{TILES} SELECT {AT}, round(pow(c0 / 128, d0 / 128), 5) AS c0 FROM {_OTHER}")
add("atan2_images", tiles(lambda i: rounded(px.atan2(i, geo.transpose(i)))), f"{TILES} SELECT {AT}, round(atan2(c0, d0), 6) AS c0 FROM {_OTHER}")
add("add_scalar", rgba(lambda i: px.add(i, 3)), f"{RGBA} SELECT {each('{c} + 3')} FROM px")
add("mul_per_channel", rgba(lambda i: px.mul(i, [1, 2, 3, -1])), f"{RGBA} SELECT {AT}, c0, c1 * 2 AS c1, c2 * 3 AS c2, c3 * -1 AS c3 FROM px")
add("div_zero", rgba(lambda i: px.divide(px.sub(i, 127), 0)), f"{RGBA} SELECT " + each("CASE WHEN {c} > 127 THEN CAST('inf' AS DOUBLE) WHEN {c} < 127 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END") + " FROM px")
for _name, _sql in [("neg", "-({v})"), ("abs", "abs({v})"), ("round", "round({v})"), ("ceil", "ceil({v})"), ("floor", "floor({v})"), ("truncate", "trunc({v})")]:
    add(_name, rgba(lambda i, n=_name: px.unary(px.sub(px.mul(i, 0.37), 50), n)), f"{RGBA} SELECT " + each("(" + _sql.format(v="{c} * 0.37e0 - 50") + " + 0.0)") + " FROM px")
for _name in ("cos", "sin", "tan", "atan", "acos", "asin"):
    add(_name, rgba(lambda i, n=_name: rounded(px.unary(px.sub(px.divide(i, 127.5), 1), n))), f"{RGBA} SELECT " + each(f"round({_name}({{c}} / 127.5e0 - 1), 6)") + " FROM px")
add("rescale", tiles(lambda i: rounded(px.rescale(i, -1, 1))), f"{TILES} SELECT {AT}, round(CASE WHEN h = l THEN -1 ELSE (c0 - l) / (h - l) * 2 - 1 END, 6) AS c0 FROM px JOIN (SELECT image_id, min(c0) AS l, max(c0) AS h FROM px GROUP BY image_id) USING (image_id)")
add("normalize", tiles(px.normalize), f"{TILES} SELECT {AT}, round(c0 * 255 / h) AS c0 FROM px JOIN (SELECT image_id, max(c0) AS h FROM px GROUP BY image_id) USING (image_id)")
add("brightness", rgba(lambda i: rounded(px.brightness(i))), f"{RGBA} SELECT {AT}, round(0.2125e0 * c0 + 0.7154e0 * c1 + 0.0721e0 * c2, 6) AS c0 FROM px")

# Comparisons and predicates
for _name, _op in [("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("eq", "=")]:
    add(f"{_name}_images", tiles(lambda i, n=_name: px.compare(i, geo.transpose(i), n)), f"{TILES} SELECT {AT}, CAST(c0 {_op} d0 AS DOUBLE) AS c0 FROM {_OTHER}")
add("threshold_scalar", rgba(lambda i: px.compare(i, 128, "gt")), f"{RGBA} SELECT {each('CAST({c} > 128 AS DOUBLE)')} FROM px")
add("threshold_array", rgba(lambda i: px.compare(i, [100, 120, 130, 140], "ge")), f"{RGBA} SELECT {AT}, CAST(c0 >= 100 AS DOUBLE) AS c0, CAST(c1 >= 120 AS DOUBLE) AS c1, CAST(c2 >= 130 AS DOUBLE) AS c2, CAST(c3 >= 140 AS DOUBLE) AS c3 FROM px")
add("valid", tiles(lambda i: px.is_valid(px.sub(i, 90))), f"{TILES} SELECT image_id, bool_and(c0 - 90 BETWEEN 0 AND 255) AS valid FROM px GROUP BY image_id")
_MASK = "(VALUES " + ", ".join(f"({y}, {x}, {float(v)}::DOUBLE)" for y, r in enumerate(px.DITHER) for x, v in enumerate(r)) + ") m(my, mx, t)"
add("dither", wall(px.dither), f"{WALL} SELECT {AT}, CASE WHEN c0 > 255.0::DOUBLE / 17 * t THEN t ELSE 0 END AS c0 FROM px JOIN {_MASK} ON y % 4 = my AND x % 4 = mx")
add("select_pixels", rgba(lambda i: px.select(i, (F.col("c0") > F.col("c1")) & (F.col("c3") >= 100))), f"{RGBA} SELECT * FROM px WHERE c0 > c1 AND c3 >= 100")
add("any_all_none", tiles(lambda i: px.any_all_count(i, F.col("c0") > 160, F.col("c0") > 80, F.col("c0") > 140)), f'{TILES} SELECT image_id, bool_or(c0 > 160) AS "any", bool_and(c0 > 80) AS "all", CAST(count(*) FILTER (WHERE c0 > 140) AS BIGINT) AS n FROM px GROUP BY image_id')

# Joins and blending
add("paste", wall(lambda i: geo.paste(i, geo.copy_window(i, 0, 0, 9, 9), 20, 30)), f"{WALL} SELECT a.image_id, a.y, a.x, coalesce(b.c0, a.c0) AS c0 FROM px a LEFT JOIN px b ON b.y = a.y - 30 AND b.x = a.x - 20 AND b.y < 10 AND b.x < 10")
_SHIFT = "SELECT image_id - 1 AS image_id, y, x, c0 AS f0, c1 AS f1, c2 AS f2, CASE WHEN c3 > 140 THEN 255 WHEN c3 < 110 THEN 0 ELSE c3 END AS f3 FROM px"
_BLEND = ", ".join(f"CASE WHEN coalesce(f3, 0) = 0 THEN c{k} WHEN f3 = 255 THEN f{k} ELSE floor((f{k} * (f3 / 255.0::DOUBLE) + c{k} * (c3 / 255.0::DOUBLE) * (1 - f3 / 255.0::DOUBLE)) / (f3 / 255.0::DOUBLE + c3 / 255.0::DOUBLE * (1 - f3 / 255.0::DOUBLE))) END AS c{k}" for k in range(3))
add("alpha_over", rgba(lambda i: geo.alpha_over(next_tile(i).withColumn("c3", F.when(F.col("c3") > 140, 255.0).when(F.col("c3") < 110, 0.0).otherwise(F.col("c3"))), i)), f"{RGBA}, f AS ({_SHIFT}) SELECT {AT}, {_BLEND}, CASE WHEN coalesce(f3, 0) = 0 THEN c3 WHEN f3 = 255 THEN f3 ELSE floor(255 * (f3 / 255.0::DOUBLE + c3 / 255.0::DOUBLE * (1 - f3 / 255.0::DOUBLE))) END AS c3 FROM px LEFT JOIN f USING (image_id, y, x)")
add("alpha_under", rgba(lambda i: geo.alpha_under(i, next_tile(i).withColumn("c3", F.when(F.col("c3") > 140, 255.0).when(F.col("c3") < 110, 0.0).otherwise(F.col("c3"))))), f"{RGBA}, f AS ({_SHIFT}) SELECT {AT}, {_BLEND}, CASE WHEN coalesce(f3, 0) = 0 THEN c3 WHEN f3 = 255 THEN f3 ELSE floor(255 * (f3 / 255.0::DOUBLE + c3 / 255.0::DOUBLE * (1 - f3 / 255.0::DOUBLE))) END AS c3 FROM px LEFT JOIN f USING (image_id, y, x)")
add("trns_key", rgba(lambda i: px.stack(*(px.get_channel(rel.color_key(px.get_channel(px.unary(px.divide(i, 10), "floor"), 0), [12]), k) for k in (0, 1)))), f"{RGBA} SELECT {AT}, floor(c0 / 10) AS c0, CASE WHEN floor(c0 / 10) = 12 THEN 0.0::DOUBLE ELSE 255.0::DOUBLE END AS c1 FROM px")
_PAL = ", f AS (SELECT image_id, floor(c0 / 8) AS c0 FROM px), p AS (SELECT image_id, c0, min(y * 8 + x) AS place FROM (SELECT image_id, y, x, floor(c0 / 8) AS c0 FROM px) GROUP BY image_id, c0), i AS (SELECT image_id, c0, row_number() OVER (PARTITION BY image_id ORDER BY place) - 1 AS idx FROM p)"


def coarse(i: DataFrame) -> DataFrame:
    return px.unary(px.divide(i, 8), "floor")


add("palette_first_seen", tiles(lambda i: rel.palette(coarse(i))), f"{TILES}{_PAL} SELECT image_id, idx, c0 FROM i")
add("palette_indexed", tiles(lambda i: rel.to_indexed(coarse(i), rel.palette(coarse(i)))), f"{TILES}{_PAL} SELECT px.image_id, y, x, CAST(idx AS DOUBLE) AS c0 FROM px JOIN i ON i.image_id = px.image_id AND i.c0 = floor(px.c0 / 8)")
add("palette_expand", tiles(lambda i: rel.depalette(rel.to_indexed(coarse(i), rel.palette(coarse(i))), rel.palette(coarse(i)).withColumn("alpha", F.when(F.col("idx") < 2, F.col("idx") * 10.0)))), f"{TILES}{_PAL} SELECT px.image_id, y, x, i.c0, CASE WHEN idx < 2 THEN idx * 10.0::DOUBLE ELSE 255.0::DOUBLE END AS c1 FROM px JOIN i ON i.image_id = px.image_id AND i.c0 = floor(px.c0 / 8)")
add("palettable", rgba(rel.palettable), f"{RGBA} SELECT image_id, count(DISTINCT (c0, c1, c2)) <= 256 AS palettable FROM px GROUP BY image_id")


# Aggregates
add("minmax", rgba(rel.minmax), f"{RGBA} SELECT image_id, min(least(c0, c1, c2, c3)) AS low, max(greatest(c0, c1, c2, c3)) AS high FROM px GROUP BY image_id")
add("pixel_minmax", rgba(lambda i: rel.pixel_minmax(i).select("image_id", "low.*", F.col("high.c0").alias("h0"), F.col("high.c3").alias("h3"))), f"{RGBA}, m AS (SELECT image_id, min((c0, c1, c2, c3)) AS l, max((c0, c1, c2, c3)) AS h FROM px GROUP BY image_id) SELECT image_id, l[1] AS c0, l[2] AS c1, l[3] AS c2, l[4] AS c3, h[1] AS h0, h[4] AS h3 FROM m")
add("inject_sum", tiles(rel.inject), f"{TILES} SELECT image_id, sum(c0) AS total FROM px GROUP BY image_id")
add("tally", wall(rel.tally), f"{WALL} SELECT image_id, c0, count(*) AS n FROM px GROUP BY ALL")
add("uniq", wall(rel.uniq), f"{WALL} SELECT DISTINCT c0 FROM px")
add("group_by_label", lambda s, d: fx.samples(s, d).groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n"), F.sum("q").alias("total"), F.max("q").alias("high")), f"WITH {_E} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, sum(q) AS total, max(q) AS high FROM s GROUP BY label")
add("count_colors", rgba(rel.count_colors), f"{RGBA} SELECT image_id, count(DISTINCT (c0, c1, c2)) AS colors FROM px GROUP BY image_id")
add("channel_stats", rgba(rel.channel_stats), f"{RGBA} SELECT image_id, " + ", ".join(f"{n}(c{k}) AS {n}_c{k}" for k in range(4) for n in ("min", "max", "sum")) + " FROM px GROUP BY image_id")
add("histogram", wall(rel.histogram), f"{WALL} SELECT image_id, c0 AS value, count(*) AS n FROM px GROUP BY ALL")
add("fold_udaf", tiles(lambda i: rel.fold(i, F.lit(0.0), lambda a, v: (a * 31 + v) % 65521)), f"{TILES}, r AS (SELECT image_id, y, list_prepend(0.0::DOUBLE, list(c0 ORDER BY x)) AS v FROM px GROUP BY image_id, y) SELECT image_id, y, list_reduce(v, lambda a, b: (a * 31 + b) % 65521) AS value FROM r")

# Windows and order
_FLT = {"sub": "a", "up": "b", "average": "floor((a + b) / 2)", "paeth": "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END"}
for _name, _guess in _FLT.items():
    add(f"png_{_name}_filter", wall(lambda i, n=_name: rel.png_filter(i, n)), f"{WALL}, n AS (SELECT *, coalesce(lag(c0) OVER (PARTITION BY y ORDER BY x), 0) AS a, coalesce(lag(c0) OVER (PARTITION BY x ORDER BY y), 0) AS b FROM px), m AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY y ORDER BY x), 0) AS c FROM n) SELECT {AT}, (c0 - {_guess} + 256) % 256 AS c0 FROM m")
add("sub_defilter", wall(lambda i: rel.sub_defilter(rel.png_filter(i, "sub"))), f"{WALL} SELECT * FROM px")
add("with_index", tiles(rel.with_index), f"{TILES} SELECT image_id, y * 8 + x AS i, c0 FROM px")
add("each_cons", wall(rel.each_cons), f"{WALL} SELECT *, lead(c0) OVER (PARTITION BY y ORDER BY x) AS next FROM px")
add("each_slice", tiles(lambda i: rel.each_slice(i, 3)), f"{TILES} SELECT image_id, (y * 8 + x) // 3 AS slice, list(c0 ORDER BY y, x) AS values FROM px GROUP BY ALL")
_RUNS = ", o AS (SELECT image_id, y * 8 + x AS i, c0, lag(c0) OVER (PARTITION BY image_id ORDER BY y, x) AS b FROM px), r AS (SELECT *, sum(CASE WHEN {new} THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY i) - 1 AS run FROM o) SELECT image_id, CAST(run AS BIGINT) AS run, min(i) AS start, list(c0 ORDER BY i) AS values FROM r GROUP BY image_id, run"
add("chunk_while", sized_tiles(lambda i: rel.chunk_while(i, lambda a, b: F.floor(a / 40) == F.floor(b / 40))), TILES + _RUNS.format(new="b IS NULL OR floor(b / 40) <> floor(c0 / 40)"))
add("slice_when", sized_tiles(lambda i: rel.slice_when(i, lambda a, b: a > b)), TILES + _RUNS.format(new="b IS NULL OR b > c0"))
add("sort_pixels", wall(rel.sort_pixels), f"{WALL} SELECT * FROM px ORDER BY c0, y, x")
add("first_n", wall(lambda i: rel.first_n(i, 100)), f"{WALL} SELECT * FROM px ORDER BY image_id, y, x LIMIT 100")
add("drop_take", wall(lambda i: rel.first_n(i, 50, 70)), f"{WALL} SELECT * FROM px ORDER BY image_id, y, x LIMIT 50 OFFSET 70")
add("topk", wall(lambda i: rel.top_k(i, 25)), f"{WALL} SELECT * FROM px ORDER BY c0 DESC, image_id, y, x LIMIT 25")

_PLACE = "y * 8 + x"
add("greatest_of_each", tiles(lambda i: rel.greatest(i, 5)), f"{TILES} SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c0 DESC, y, x) - 1 AS i FROM px QUALIFY i < 5")
add("least_of_each", rgba(lambda i: rel.least(i, 3)), f"{RGBA} SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c0, c1, c2, c3, y, x) - 1 AS i FROM px QUALIFY i < 3")
add("first_of_each", tiles(lambda i: rel.take(i, 7, 5)), f"{TILES} SELECT * FROM px WHERE {_PLACE} BETWEEN 5 AND 11")
add("sorted_of_each", tiles(rel.ranked), f"{TILES} SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c0, y, x) - 1 AS i FROM px")
_FIRST = f", f AS (SELECT image_id, min({_PLACE}) FILTER (c0 <= 100) AS stop FROM px GROUP BY image_id)"
add("take_while", tiles(lambda i: rel.take_while(i, F.col("c0") > 100)), f"{TILES}{_FIRST} SELECT px.* FROM px JOIN f USING (image_id) WHERE stop IS NULL OR {_PLACE} < stop")
add("drop_while", tiles(lambda i: rel.drop_while(i, F.col("c0") > 100)), f"{TILES}{_FIRST} SELECT px.* FROM px JOIN f USING (image_id) WHERE {_PLACE} >= stop")
add("palettable_wall", wall(lambda i: rel.palettable(px.mapped_pixels(i, lambda a, x, y: [a, a * 64 + x, a], True), 256)), f"{WALL} SELECT image_id, count(DISTINCT (c0, d0)) <= 256 AS palettable FROM (SELECT *, c0 * 64 + x AS d0 FROM px) GROUP BY image_id")

# Stencils
KERNEL = [[1, 2, 0], [0, 3, -1], [4, 0, 5]]
_K = "(VALUES " + ", ".join(f"({i}, {j}, {v})" for i, r in enumerate(KERNEL) for j, v in enumerate(r)) + ") k(ky, kx, w)"
_BORDER = {"zero": "{i}", "replicate": "least(greatest({i}, 0), {n} - 1)", "circular": "(({i} % {n}) + {n}) % {n}", "symmetric": "least((({i} % (2 * ({n} - 1))) + 2 * ({n} - 1)) % (2 * ({n} - 1)), 2 * ({n} - 1) - (({i} % (2 * ({n} - 1))) + 2 * ({n} - 1)) % (2 * ({n} - 1)))"}


def _conv_sql(kernel: str, kh: int, kw: int, border: str, source: str = "px", digits: int | None = None, name: str = "c0") -> str:
    y, x = (_BORDER[border].format(i=f"(o.y - {k // 2} + ({k} - 1 - {c}))", n=n) for k, c, n in ((kh, "ky", "z.h"), (kw, "kx", "z.w")))
    x = x.replace("o.y", "o.x")
    total = "sum(k.w * coalesce(p.c0, 0))"
    return f"SELECT o.image_id, o.y, o.x, {f'round({total}, {digits})' if digits else f'CAST({total} AS DOUBLE)'} AS {name} FROM {source} o CROSS JOIN {kernel} CROSS JOIN z LEFT JOIN {source} p ON p.y = {y} AND p.x = {x} GROUP BY o.image_id, o.y, o.x"


_Z = ", z AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px)"
for _b in st.BORDERS:
    add(f"convolve_{_b}", sized(lambda i, b=_b: st.convolve(i, KERNEL, b)), f"{WALL}{_Z} " + _conv_sql(_K, 3, 3, _b))
LARGE = [[float((i * 7 + j * 3) % 5 - 2) for j in range(31)] for i in range(31)]
add("convolve_large", sized(lambda i: st.convolve(i, LARGE, "circular")), f"{WALL}{_Z} " + _conv_sql("(SELECT a.i AS ky, b.j AS kx, (a.i * 7 + b.j * 3) % 5 - 2 AS w FROM range(31) a(i), range(31) b(j)) k", 31, 31, "circular"))
_G = "(SELECT 0 AS ky, i AS kx, {v} AS w FROM (SELECT i, g / sum(g) OVER () AS g FROM (SELECT i, exp(-((i - {n}) ** 2) / (2.0::DOUBLE * {s} * {s})) AS g FROM range(2 * {n} + 1) t(i)))) k"
add("gaussian_kernel", sized(lambda i: rounded(st.convolve(i, [st.gaussian(1.5)], "replicate"), 5)), f"{WALL}{_Z} " + _conv_sql(_G.format(n=5, s="1.5", v="g"), 1, 11, "replicate", digits=5))
add("gaussian_deriv_kernel", sized(lambda i: px.mapped(st.convolve(i, [st.gaussian_deriv(1.0)], "circular"), lambda v: F.round(v, 4) + 0.0)), f"{WALL}{_Z}, r AS (" + _conv_sql(_G.format(n=4, s="1.0", v="-g * (i - 4)"), 1, 9, "circular", digits=4) + f") SELECT {AT}, c0 + 0.0 AS c0 FROM r")
add("disk_mask", sized(lambda i: st.convolve(i, gen.disk_element(3.5), "zero")), f"{WALL}{_Z} " + _conv_sql("(SELECT a.i AS ky, b.j AS kx, CASE WHEN sqrt((a.i - 4) ** 2 + (b.j - 4) ** 2) <= 3.5 THEN 1 ELSE 0 END AS w FROM range(9) a(i), range(9) b(j)) k", 9, 9, "zero"))
add("convolve_row", sized(lambda i: st.convolve(i, [[1, -2, 3, 4]], "circular")), f"{WALL}{_Z} " + _conv_sql("(VALUES (0, 0, 1), (0, 1, -2), (0, 2, 3), (0, 3, 4)) k(ky, kx, w)", 1, 4, "circular"))
add("convolve_col", sized(lambda i: st.convolve(i, [[1], [-2], [3], [4], [6]], "symmetric")), f"{WALL}{_Z} " + _conv_sql("(VALUES (0, 0, 1), (1, 0, -2), (2, 0, 3), (3, 0, 4), (4, 0, 6)) k(ky, kx, w)", 5, 1, "symmetric"))


def _values(v: list[float], row: bool) -> str:
    return "(VALUES " + ", ".join(f"({0 if row else i}, {i if row else 0}, {x!r}::DOUBLE)" for i, x in enumerate(v)) + ") k(ky, kx, w)"


def _two(a: list[float], row: bool, b: list[float], name: str) -> str:
    first = _conv_sql(_values(a, row), 1 if row else len(a), len(a) if row else 1, "replicate")
    return f"{name}1 AS ({first}), {name} AS (" + _conv_sql(_values(b, not row), len(b) if row else 1, 1 if row else len(b), "replicate", f"{name}1") + ")"


_GS, _DV = st.gaussian(1.0), st.gaussian_deriv(1.0)
add("blur", sized(lambda i: rounded(st.blur(i), 5)), f"{WALL}{_Z}, {_two(_GS, True, _GS, 'b')} SELECT {AT}, round(c0, 5) AS c0 FROM b")
_GRAD = f"{WALL}{_Z}, {_two(_DV, True, _GS, 'gx')}, {_two(_DV, False, _GS, 'gy')}"
add("gradient", sized(lambda i: px.mapped(st.gradient(i), lambda v: F.round(v, 4) + 0.0)), f"{_GRAD} SELECT gx.image_id, gx.y, gx.x, round(gx.c0, 4) + 0.0 AS c0, round(gy.c0, 4) + 0.0 AS c1 FROM gx JOIN gy USING (image_id, y, x)")
add("gradient_angle", sized(lambda i: rounded(px.get_channel(st.magnitude_and_angle(px.mapped(st.gradient(i), lambda v: F.round(v, 6) + 0.0)), 1), 4)), f"{_GRAD} SELECT gx.image_id, gx.y, gx.x, round(atan2(round(gy.c0, 6) + 0.0, round(gx.c0, 6) + 0.0), 4) AS c0 FROM gx JOIN gy USING (image_id, y, x)")
_PER = ", ".join(f"CAST(sum(k.w * {k + 1} * coalesce(p.c{k}, 0)) AS DOUBLE) AS c{k}" for k in range(4))
add("convolve_channels", rgba(lambda i: st.convolve(i, [[[v * (k + 1) for v in r] for r in KERNEL] for k in range(4)])), f"{RGBA} SELECT o.image_id, o.y, o.x, {_PER} FROM px o CROSS JOIN {_K} LEFT JOIN px p ON p.image_id = o.image_id AND p.y = o.y - 1 + 2 - ky AND p.x = o.x - 1 + 2 - kx GROUP BY o.image_id, o.y, o.x")
add("gradient_magnitude", sized(lambda i: px.get_channel(rounded(st.magnitude_and_angle(st.gradient(i)), 4), 0)), f"{_GRAD} SELECT gx.image_id, gx.y, gx.x, round(sqrt(gx.c0 ** 2 + gy.c0 ** 2), 4) AS c0 FROM gx JOIN gy USING (image_id, y, x)")

NONE = float("-inf")
CROSS = [[NONE, 1, NONE], [0, 2, 0], [NONE, 3, NONE]]
_SE = "(VALUES (-1, 0, 1.0::DOUBLE), (0, -1, 0), (0, 0, 2), (0, 1, 0), (1, 0, 3)) e(dy, dx, k)"
_DIL = "SELECT o.image_id, o.y, o.x, max(p.c0 + k) AS c0 FROM {s} o CROSS JOIN " + _SE + " JOIN {s} p ON p.y = o.y - dy AND p.x = o.x - dx GROUP BY o.image_id, o.y, o.x"
_ERO = "SELECT o.image_id, o.y, o.x, min(p.c0 - k) AS c0 FROM {s} o CROSS JOIN " + _SE + " JOIN {s} p ON p.y = o.y + dy AND p.x = o.x + dx GROUP BY o.image_id, o.y, o.x"
add("dilate", sized(lambda i: st.dilate(i, CROSS)), f"{WALL} {_DIL.format(s='px')}")
add("erode", sized(lambda i: st.erode(i, CROSS)), f"{WALL} {_ERO.format(s='px')}")
add("open", sized(lambda i: st.opened(i, CROSS)), f"{WALL}, q AS ({_ERO.format(s='px')}) {_DIL.format(s='q')}")
add("close", sized(lambda i: st.closed(i, CROSS)), f"{WALL}, q AS ({_DIL.format(s='px')}) {_ERO.format(s='q')}")


_WIDE = "(PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)"
add("dilate_wide", sized(lambda i: st.dilate(i, [[2.0] * 41])), f"{WALL} SELECT {AT}, max(c0) OVER {_WIDE} + 2 AS c0 FROM px")
add("erode_wide", sized(lambda i: st.erode(i, [[0.0] * 41])), f"{WALL} SELECT {AT}, min(c0) OVER {_WIDE} AS c0 FROM px")


def _resize_sql(sx: float, sy: float, nearest: bool) -> str:
    axis = lambda a, n, s: f"SELECT i AS t{a}, (i + 0.5) / {s}::DOUBLE - 0.5 AS f, {n} AS n FROM z, range(CAST(round({n} * {s}::DOUBLE) AS BIGINT)) r(i)"
    z = ", z AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px)"
    if nearest:
        near = "least(greatest(round(f), 0), n - 1)"
        return f"{TILES}{z}, ax AS ({axis('x', 'w', sx)}), ay AS ({axis('y', 'h', sy)}) SELECT image_id, ty AS y, tx AS x, c0 FROM px JOIN (SELECT tx, {near} AS sx FROM ax) ON x = sx JOIN (SELECT ty, {near} AS sy FROM ay) ON y = sy"
    taps = lambda a: f"SELECT t{a}, CASE WHEN floor(f) < 0 THEN ceil(f) ELSE floor(f) END AS lo, CASE WHEN ceil(f) > n - 1 THEN floor(f) ELSE ceil(f) END AS hi, f - floor(f) AS k FROM a{a}"
    both = lambda a: f"SELECT t{a}, lo AS s, CASE WHEN lo = hi THEN 1 ELSE 1 - k END AS k FROM taps{a} UNION ALL SELECT t{a}, hi AS s, k FROM taps{a} WHERE lo <> hi"
    return f"{TILES}{z}, ax AS ({axis('x', 'w', sx)}), ay AS ({axis('y', 'h', sy)}), tapsx AS ({taps('x')}), tapsy AS ({taps('y')}), kx AS ({both('x')}), ky AS ({both('y')}) SELECT image_id, ty AS y, tx AS x, round(sum(c0 * kx.k * ky.k), 6) AS c0 FROM px JOIN kx ON x = kx.s JOIN ky ON y = ky.s GROUP BY image_id, ty, tx"


add("resize_nearest", sized_tiles(lambda i: geo.resize(i, 2.5, method="nearest")), _resize_sql(2.5, 2.5, True))
add("resize_bilinear", sized_tiles(lambda i: rounded(geo.resize(i, 2))), _resize_sql(2, 2, False))
add("resize_xy", sized_tiles(lambda i: rounded(geo.resize(i, 1.7, 0.6))), _resize_sql(1.7, 0.6, False))
_COV = "least(greatest(10.5 - sqrt((x - 30.5) ** 2 + (y - 20.0) ** 2) + 0.5, 0), 1)"
add("draw_disk", wall(lambda i: rounded(geo.draw_disk(i, 30.5, 20, 10.5, [300]))), f"{WALL} SELECT {AT}, round({_COV} * 300 + (1 - {_COV}) * c0, 6) AS c0 FROM px")
_ALONG = "least(greatest(((x - 5.0::DOUBLE) * 45 + (y - 5.0::DOUBLE) * 25) / 2650, 0), 1)"
_LINE = f"least(greatest(2.0::DOUBLE - sqrt((x - 5.0::DOUBLE - {_ALONG} * 45) ** 2 + (y - 5.0::DOUBLE - {_ALONG} * 25) ** 2), 0), 1)"
add("draw_line", wall(lambda i: rounded(geo.draw_line(i, 5, 5, 50, 30, [300], 3))), f"{WALL} SELECT {AT}, round({_LINE} * 300 + (1 - {_LINE}) * c0, 6) AS c0 FROM px")

# Chunks
_T = "SELECT doc_id, text FROM documents"
add("text_roundtrip_tEXt", lambda s, d: fx.table(s, d, "documents").select("doc_id", ch.parse_text_chunk(ch.text_chunk(F.col("source"), F.col("text"))).alias("t")).select("doc_id", "t.*"), "SELECT doc_id, source AS keyword, text FROM documents")
add("text_roundtrip_iTXt", lambda s, d: fx.table(s, d, "conversations").select("conv_id", "turn", ch.parse_itext_chunk(ch.itext_chunk(F.lit("Comment"), F.lit("en"), F.col("role"), F.col("text"))).alias("t")).select("conv_id", "turn", "t.keyword", "t.language", "t.translated_keyword", "t.compressed", F.decode("t.data", "UTF-8").alias("text")), "SELECT conv_id, turn, 'Comment' AS keyword, 'en' AS language, role AS translated_keyword, false AS compressed, text FROM conversations")
add("text_roundtrip_zTXt", lambda s, d: fx.table(s, d, "documents").select("doc_id", ch.parse_ztext_chunk(ch.ztext_chunk(F.col("source"), F.col("text"))).alias("t")).select("doc_id", "t.*"), "SELECT doc_id, source AS keyword, CASE WHEN source IS NOT NULL AND text IS NOT NULL THEN CAST(0 AS BIGINT) END AS method, text FROM documents")
add("time_roundtrip", lambda s, d: fx.table(s, d, "events").select("event_id", ch.parse_time_chunk(ch.time_chunk(F.col("ts"))).cast("timestamp_ntz").alias("ts")), "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events")
add("phys_roundtrip", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", ch.parse_phys_chunk(ch.phys_chunk(F.col("o_orderkey"), F.col("o_custkey"), F.lit(1))).alias("p")).select("o_orderkey", "p.*"), "SELECT o_orderkey, o_orderkey AS x, o_custkey AS y, CAST(1 AS BIGINT) AS unit FROM orders")
add("offs_roundtrip", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", ch.parse_offs_chunk(ch.offs_chunk(-F.col("o_orderkey"), F.col("o_custkey"), F.lit(0))).alias("p")).select("o_orderkey", "p.*"), "SELECT o_orderkey, -o_orderkey AS x, o_custkey AS y, CAST(0 AS BIGINT) AS unit FROM orders")
add("gama_roundtrip", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", F.round(ch.parse_gamma_chunk(ch.gamma_chunk(F.col("o_orderkey") / 1000.0)), 5).alias("gamma"), F.round(ch.decoding_exponent(F.col("o_orderkey") + 1.0), 9).alias("exponent")), "SELECT o_orderkey, round(o_orderkey / 1000.0::DOUBLE, 5) AS gamma, round(1.0::DOUBLE / ((o_orderkey + 1.0::DOUBLE) * 2.2::DOUBLE), 9) AS exponent FROM orders")
add("chrm_roundtrip", lambda s, d: fx.table(s, d, "supplier").select("s_suppkey", F.transform(ch.parse_chroma_chunk(ch.chroma_chunk(*(F.col("s_suppkey") * (k + 1) / 100.0 for k in range(8)))), lambda v: F.round(v, 5)).alias("v")), "SELECT s_suppkey, [" + ", ".join(f"round(s_suppkey * {k + 1} / 100.0::DOUBLE, 5)" for k in range(8)) + "] AS v FROM supplier")
add("hist_roundtrip", lambda s, d: fx.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("v")).select("l_orderkey", ch.bytes_array(ch.pack_array(F.col("v"), 2), 2).alias("v")), "SELECT l_orderkey, list(l_suppkey ORDER BY l_suppkey) AS v FROM lineitem GROUP BY l_orderkey")
add("sbit_roundtrip", lambda s, d: fx.table(s, d, "part").select("p_partkey", ch.bytes_array(ch.pack_array(F.array(F.col("p_size").cast("bigint"), F.lit(5).cast("bigint")))).alias("v")), "SELECT p_partkey, [CAST(p_size AS BIGINT), 5] AS v FROM part")
add("bkgd_roundtrip", lambda s, d: fx.table(s, d, "part").select("p_partkey", ch.background(F.when(F.col("p_size") % 2 == 0, ch.uint(F.col("p_size"), 2)).otherwise(F.concat(ch.uint(F.col("p_size"), 2), ch.uint(F.lit(7), 2), ch.uint(F.lit(300), 2)))).alias("v")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [CAST(p_size AS BIGINT)] ELSE [p_size, 7, 300] END AS v FROM part")
add("frame_control", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", ch.parse_frame_control_chunk(ch.frame_control_chunk(F.col("o_orderkey"), F.lit(10), F.lit(20), F.lit(1), F.lit(2), F.pmod("o_custkey", F.lit(65536)), F.lit(24), F.when(F.col("o_custkey") % 2 == 0, "none").otherwise("previous"), F.lit("over"))).alias("f")).select("o_orderkey", "f.*"), "SELECT o_orderkey, o_orderkey AS seq, CAST(10 AS BIGINT) AS w, CAST(20 AS BIGINT) AS h, CAST(1 AS BIGINT) AS x_off, CAST(2 AS BIGINT) AS y_off, o_custkey % 65536 AS delay_num, CAST(24 AS BIGINT) AS delay_den, CASE WHEN o_custkey % 2 = 0 THEN 'none' ELSE 'previous' END AS dispose, 'over' AS blend FROM orders")
add("unknown_chunk", lambda s, d: fx.table(s, d, "pages").select("page_id", ch.parse_raw_chunk(ch.raw_chunk(F.lit("prVt"), F.encode("html", "UTF-8"))).alias("c")).select("page_id", "c.length", "c.type", "c.crc_ok", F.sha2("c.data", 256).alias("sha")), "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS length, 'prVt' AS type, true AS crc_ok, sha256(html) AS sha FROM pages")
add("chunk_flags", lambda s, d: images.chunks(images.encode(fx.tile_rows(s, d), 1, chunks=_named(s, d))).select("image_id", "seq", "type", ch.flags(F.col("type")).alias("f")).select("image_id", "seq", "type", "f.*"), "WITH c AS (SELECT vec_id AS image_id, k, t FROM embeddings, (VALUES (0, 'IHDR'), (2, 'IDAT'), (4, 'IEND')) c(k, t) UNION ALL SELECT vec_id, CASE vec_id % 3 WHEN 2 THEN 1 ELSE 3 END, ['prVt', 'tEXt', 'gAMA'][vec_id % 3 + 1] FROM embeddings) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY k) - 1 AS INTEGER) AS seq, t AS type, regexp_matches(t[1], '[a-z]') AS ancillary, regexp_matches(t[2], '[a-z]') AS private, regexp_matches(t[3], '[a-z]') AS reserved, regexp_matches(t[4], '[a-z]') AS safe FROM c")


def _named(s: SparkSession, d: str) -> DataFrame:
    """A chunk for each tile: private, a text, or a gamma, which stands before the pixels."""
    k = F.col("vec_id") % 3
    kind = F.get(F.array(F.lit("prVt"), F.lit("tEXt"), F.lit("gAMA")), k.cast("int"))
    pos = F.when(k == 2, "after_IHDR").otherwise("after_IDAT")
    return fx.table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(0).alias("seq"), kind.alias("type"), F.when(k == 1, F.lit(bytearray(b"k\0v"))).otherwise(ch.uint(F.lit(7), 4)).alias("data"), pos.alias("pos"))



def _spoilt(s: SparkSession, d: str) -> DataFrame:
    """Raw chunks of pages, the last byte of every third changed."""
    raw = ch.raw_chunk(F.lit("prVt"), F.encode("html", "UTF-8"))
    other = F.concat(F.substr(raw, F.lit(1), F.length(raw) - 1), F.unhex(F.when(F.hex(F.substr(raw, F.length(raw))) == "00", "01").otherwise("00")))
    return fx.table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, other).otherwise(raw).alias("raw"))


add("crc_check", lambda s, d: _spoilt(s, d).select("page_id", ch.parse_raw_chunk(F.col("raw"))["crc_ok"].alias("crc_ok")), "SELECT page_id, CASE WHEN html IS NOT NULL THEN page_id % 3 <> 0 END AS crc_ok FROM pages")
add("trns_roundtrip", lambda s, d: fx.table(s, d, "part").select("p_partkey", ch.background(F.concat(*(ch.uint(F.col("p_size") * k, 2) for k in (1, 20, 300)))).alias("key"), ch.bytes_array(ch.pack_array(F.array(F.col("p_size").cast("bigint"), F.lit(255).cast("bigint")))).alias("alphas")), "SELECT p_partkey, [CAST(p_size AS BIGINT), p_size * 20, p_size * 300] AS key, [CAST(p_size AS BIGINT), 255] AS alphas FROM part")
add("read_grayscale", lambda s, d: fx.table(s, d, "part").select("p_partkey", ch.read_grayscale(F.col("p_size").cast("bigint"), F.element_at(F.array(*map(F.lit, (1, 2, 4, 8, 16))), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("v")), "SELECT p_partkey, CAST(least(p_size, 256) * [255, 85, 17, 1, 1][p_partkey % 5 + 1] AS BIGINT) AS v FROM part")
#: A kind that a user adds: three numbers and a sound.
SOUND = registry.ChunkKind("auDi", lambda b: F.struct(ch.read_uint(b, 0, 4).alias("duration"), ch.read_uint(b, 4, 4).alias("delay"), ch.read_uint(b, 8, 4).alias("plays"), F.substr(b, F.lit(13)).alias("sound")), public=False, safe=True)


def _custom(s: SparkSession, d: str) -> DataFrame:
    registry.register(SOUND)
    data = F.concat(ch.uint(F.length("html"), 4), ch.uint(F.col("page_id") % 1000, 4), ch.uint(F.lit(3), 4), F.encode("html", "UTF-8"))
    chunks = fx.table(s, d, "pages").select(F.col("page_id").alias("image_id"), F.lit(0).alias("seq"), F.lit("auDi").alias("type"), data.alias("data"))
    return ct.parsed(chunks, "auDi").select(F.col("image_id").alias("page_id"), "value.duration", "value.delay", "value.plays", F.sha2("value.sound", 256).alias("sha"))


add("custom_chunk", _custom, "SELECT page_id, CAST(length(html) AS BIGINT) AS duration, page_id % 1000 AS delay, CASE WHEN html IS NOT NULL THEN CAST(3 AS BIGINT) END AS plays, sha256(html) AS sha FROM pages")


def _saved_texts(s: SparkSession, d: str) -> DataFrame:
    """The texts of all documents in three kinds of chunks of image files, read from the files."""
    docs = fx.table(s, d, "documents").where("text is not null and doc_id is not null").select(F.col("doc_id").alias("image_id"), F.col("text"), F.get(F.array(F.lit("plain"), F.lit("packed"), F.lit("wide")), (F.col("doc_id") % 3).cast("int")).alias("keyword"))
    none = s.createDataFrame([], "image_id long, seq int, type string, data binary, pos string")
    wide = docs.where("keyword = 'wide'").withColumns({"language": F.lit("xx"), "translated_keyword": F.lit("breit")})
    chunks = ct.add_text(ct.add_text(ct.add_text(none, docs.where("keyword = 'plain'")), docs.where("keyword = 'packed'"), compressed=True), wide, international=True)
    dot = docs.select("image_id", F.lit(0).cast("bigint").alias("y"), F.array(F.lit(7.0)).alias("vals"))
    return ct.texts(images.chunks(images.encode(dot, 1, chunks=chunks))).select(F.col("image_id").alias("doc_id"), "type", "keyword", "text", "language", "translated_keyword")


add("text_save_roundtrip", _saved_texts, "SELECT doc_id, ['tEXt', 'zTXt', 'iTXt'][doc_id % 3 + 1] AS type, ['plain', 'packed', 'wide'][doc_id % 3 + 1] AS keyword, text, CASE WHEN doc_id % 3 = 2 THEN 'xx' END AS language, CASE WHEN doc_id % 3 = 2 THEN 'breit' END AS translated_keyword FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")


def _exif(s: SparkSession, d: str) -> DataFrame:
    o, one = fx.table(s, d, "orders"), F.lit(1)
    stamp = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    ascii_ = lambda tag, c: (tag, 2, F.length(c) + 1, F.concat(F.encode(c, "US-ASCII"), F.unhex(F.lit("00"))))
    main = [ascii_(271, F.col("o_orderpriority")), (274, 3, one, ch.wrapped(F.col("o_orderkey") % 8 + 1, 2)), (282, 5, one, F.concat(ch.wrapped(F.col("o_custkey"), 4), ch.wrapped(F.lit(8), 4))), ascii_(306, stamp)]
    return o.select("o_orderkey", ex.block(main, [(37385, 3, one, ch.wrapped(F.col("o_orderkey") % 128, 2)), (40961, 3, one, ch.wrapped(one, 2))]).alias("data"))


_EXIF_ROWS = "(VALUES ('IFD0', 0, 271, 'Make', 2), ('IFD0', 1, 274, 'Orientation', 3), ('IFD0', 2, 282, 'XResolution', 5), ('IFD0', 3, 306, 'DateTime', 2), ('ExifIFD', 0, 37385, 'Flash', 3), ('ExifIFD', 1, 40961, 'ColorSpace', 3)) f(ifd, seq, tag, name, type)"
add("exif_fields", lambda s, d: ex.fields(_exif(s, d)).where("tag <> 34665").select("o_orderkey", "ifd", "seq", "tag", "name", "type", "count", F.get("numbers", F.lit(0)).alias("number"), "text"), f"SELECT o_orderkey, ifd, CAST(seq AS BIGINT) AS seq, CAST(tag AS BIGINT) AS tag, name, CAST(type AS BIGINT) AS type, CAST(CASE tag WHEN 271 THEN length(o_orderpriority) + 1 WHEN 306 THEN 20 ELSE 1 END AS BIGINT) AS count, CAST(CASE tag WHEN 274 THEN o_orderkey % 8 + 1 WHEN 282 THEN o_custkey / 8.0::DOUBLE WHEN 37385 THEN o_orderkey % 128 WHEN 40961 THEN 1 END AS DOUBLE) AS number, CASE tag WHEN 271 THEN o_orderpriority WHEN 306 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') WHEN 40961 THEN 'sRGB' END AS text FROM orders, {_EXIF_ROWS}")
add("exif_dates", lambda s, d: ex.fields(_exif(s, d)).where("name = 'DateTime'").select("o_orderkey", ex.moment(F.col("text")).cast("timestamp_ntz").alias("ts")), "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders")
add("exif_flash", lambda s, d: ex.fields(_exif(s, d)).where("name = 'Flash'").select("o_orderkey", ex.flash(F.get("numbers", F.lit(0))).alias("f")).select("o_orderkey", "f.*"), "SELECT o_orderkey, v & 1 = 1 AS fired, (v >> 1) & 3 AS returned, (v >> 3) & 3 AS mode, (v >> 5) & 1 = 1 AS absent, (v >> 6) & 1 = 1 AS red_eye FROM (SELECT o_orderkey, o_orderkey % 128 AS v FROM orders)")

# Image files
def _mixed_files(s: SparkSession, d: str) -> DataFrame:
    """PNG files, BMP files and files that are neither."""
    rows = rel.to_rows(px.to_rgb(fx.rgba(s, d)))
    part = lambda k: rows.where(F.col("image_id") % 3 == k)
    other = fx.table(s, d, "embeddings").where("vec_id % 3 = 2").select(F.col("vec_id").alias("image_id"), F.encode(F.lit("GIF89a"), "UTF-8").alias("content"))
    return images.encode(part(0), 3).unionByName(images.encode(part(1), 3, kind="bmp")).unionByName(other)


for _name, _level, _depth in [("png_roundtrip", 0, 8), ("png_roundtrip_level1", 1, 8), ("png_roundtrip_16bit", 0, 16)]:
    add(_name, lambda s, d, level=_level, depth=_depth: rel.from_rows(images.rows(images.encode(fx.tile_rows(s, d), 1, level=level, bit_depth=depth)), 1), f"{TILES} SELECT * FROM px")
add("png_roundtrip_rgba", lambda s, d: rel.from_rows(images.rows(images.encode(rel.to_rows(fx.rgba(s, d)), 4, level=1)), 4), f"{RGBA} SELECT * FROM px")
add("palette_png_roundtrip", lambda s, d: rel.from_rows(images.rows(images.encode(rel.to_rows(px.to_rgb(fx.rgba(s, d))), 3, level=1)), 3), f"{RGBA} SELECT {AT}, c0, c1, c2 FROM px")
add("bmp_roundtrip", lambda s, d: rel.from_rows(images.rows(images.encode(rel.to_rows(px.to_rgb(fx.rgba(s, d))), 3, kind="bmp")), 3), f"{RGBA} SELECT {AT}, c0, c1, c2 FROM px")
add("png_headers", lambda s, d: images.headers(images.encode(fx.tile_rows(s, d), 1)).select("image_id", "format", "width", "height", "bit_depth", "color_type", "channels", "interlace", "error"), f"{TILES} SELECT image_id, 'png' AS format, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, 8 AS bit_depth, 0 AS color_type, 1 AS channels, 0 AS interlace, CAST(NULL AS VARCHAR) AS error FROM px GROUP BY image_id")
add("chunk_list", lambda s, d: images.chunks(images.encode(fx.tile_rows(s, d), 1)).select("image_id", "seq", "type", "pos", "crc_ok"), "SELECT vec_id AS image_id, CAST(k AS INTEGER) AS seq, t AS type, p AS pos, true AS crc_ok FROM embeddings, (VALUES (0, 'IHDR', 'after_IHDR'), (1, 'IDAT', 'after_IDAT'), (2, 'IEND', 'after_IDAT')) c(k, t, p)")
add("file_types", lambda s, d: images.formats(_mixed_files(s, d)), "SELECT vec_id AS image_id, ['png', 'bmp', 'unknown'][vec_id % 3 + 1] AS format FROM embeddings")
add("decode_mixed", lambda s, d: rel.from_rows(images.rows(_mixed_files(s, d), errors="skip"), 3), f"{RGBA} SELECT {AT}, c0, c1, c2 FROM px WHERE image_id % 3 < 2")
def _scanned(s: SparkSession, d: str) -> DataFrame:
    """Files of up to 64 rows, saved to the shared folder and scanned by the data source."""
    lines = fx.wall_rows(s, d).select(F.expr("y div 64").alias("image_id"), (F.col("y") % 64).alias("y"), "vals")
    at = place(s, "scan")
    images.save(images.encode(lines, 1, level=1), at)
    datasource.register(s)
    files = s.read.format("raster").load(at).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint"))
    return rel.from_rows(files, 1)


add("file_scan", _scanned, f"WITH {_E} SELECT vec_id // 64 AS image_id, vec_id % 64 AS y, p AS x, q AS c0 FROM s")


def _wall_in_bands(s: SparkSession, d: str) -> DataFrame:
    """The whole wall as one file that many tasks deflate, read back."""
    at = place(s, "bands")
    bands.save(bands.encode(fx.wall_rows(s, d).withColumn("image_id", F.lit(0).cast("bigint")), 1, band_rows=32), at)
    datasource.register(s)
    return rel.from_rows(s.read.format("raster").load(at).withColumn("image_id", F.lit(0).cast("bigint")), 1)


add("wall_file_in_bands", _wall_in_bands, f"{WALL} SELECT * FROM px")


def _header_scan(s: SparkSession, d: str) -> DataFrame:
    """Headers of saved files of unequal sizes, of which a few bytes each are read."""
    lines = fx.wall_rows(s, d).select((F.col("y") % 7).alias("image_id"), F.expr("y div 7").alias("y"), "vals")
    at = place(s, "headers")
    images.save(images.encode(lines, 1), at)
    datasource.register(s)
    told = s.read.format("raster_headers").load(at)
    return told.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("image_id"), "format", "width", "height", "bit_depth", "color_type", "channels", "interlace", "has_alpha", "n_frames", "read_bytes", "error")


add("header_scan", _header_scan, "SELECT vec_id % 7 AS image_id, 'png' AS format, 64 AS width, CAST(count(*) AS INTEGER) AS height, 8 AS bit_depth, 0 AS color_type, 1 AS channels, 0 AS interlace, false AS has_alpha, CAST(NULL AS BIGINT) AS n_frames, CAST(2 + 8 + 8 + 13 + 8 AS BIGINT) AS read_bytes, CAST(NULL AS VARCHAR) AS error FROM embeddings GROUP BY vec_id % 7")


def _chunk_scan(s: SparkSession, d: str) -> DataFrame:
    """Compressed texts of saved files, read by a filter that reaches the reader."""
    docs = fx.table(s, d, "documents").where("text is not null and doc_id is not null").select(F.col("doc_id").alias("image_id"), "text", F.lit("packed").alias("keyword"))
    none = s.createDataFrame([], "image_id long, seq int, type string, data binary, pos string")
    dot = docs.select("image_id", F.lit(0).cast("bigint").alias("y"), F.array(F.lit(7.0)).alias("vals"))
    with_texts = ct.add_text(ct.add_text(none, docs, compressed=True), docs.withColumn("keyword", F.lit("plain")))
    at = place(s, "chunks")
    images.save(images.encode(dot, 1, chunks=with_texts), at)
    datasource.register(s)
    found = s.read.format("raster_chunks").load(at).where("type = 'zTXt'")
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("doc_id"), "type", "crc_ok", ch.parse_ztext_chunk(F.col("data"))["text"].alias("text"))


add("chunk_scan", _chunk_scan, "SELECT doc_id, 'zTXt' AS type, true AS crc_ok, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")
add("palette_files_depths", lambda s, d: images.headers(images.encode(rel.to_rows(px.to_rgb(fx.rgba(s, d))), 3, level=1)).select("image_id", "color_type", "bit_depth", "has_alpha", "n_frames"), "SELECT vec_id AS image_id, 3 AS color_type, 8 AS bit_depth, false AS has_alpha, CAST(NULL AS INTEGER) AS n_frames FROM embeddings")


def _small_depths(s: SparkSession, d: str) -> DataFrame:
    """Gray files of 1, 2 and 4 bits a sample, which say that they are two rows taller than they are."""
    depth = F.when(F.col("image_id") % 3 == 0, 1).when(F.col("image_id") % 3 == 1, 2).otherwise(4)
    packed = F.aggregate(F.transform("vals", lambda v: F.floor(v / 256 * F.pow(F.lit(2.0), depth)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a * F.pow(F.lit(2.0), depth).cast("bigint") + v)
    line = F.concat(F.lit(bytearray(b"\0")), F.unhex(F.lpad(F.hex(packed), depth * 2, "0")))
    whole = fx.tile_rows(s, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", line.alias("line")))).alias("l"))
    raw = lambda kind, data: ch.raw_chunk(F.lit(kind), data)
    head = F.concat(ch.uint(F.lit(8), 4), ch.uint(F.lit(10), 4), ch.uint(depth, 1), F.lit(bytearray(4)))
    stream = ch.deflate(F.unhex(F.array_join(F.transform("l.line", lambda x: F.hex(x)), "")))
    content = F.concat(F.lit(bytearray(b"\x89PNG\r\n\x1a\n")), raw("IHDR", head), raw("IDAT", stream), raw("IEND", F.lit(bytearray())))
    return whole.select("image_id", content.alias("content"))


add("png_small_depths", lambda s, d: rel.from_rows(images.rows(_small_depths(s, d)), 1), f"{TILES} SELECT {AT}, floor(c0 * [2, 4, 16][image_id % 3 + 1] / 256) AS c0 FROM px UNION ALL SELECT DISTINCT image_id, t.y, u.x, 0.0::DOUBLE FROM px, range(8, 10) t(y), range(8) u(x)")
add("png_interlaced", lambda s, d: rel.from_rows(images.rows(images.encode(fx.tile_rows(s, d), 1, level=1, interlace=True)), 1), f"{TILES} SELECT * FROM px")
add("png_wrapped_samples", lambda s, d: rel.from_rows(images.rows(images.encode(fx.tile_rows(s, d).withColumn("vals", F.transform("vals", lambda v: v * 3.5 - 300)), 1)), 1), f"{TILES} SELECT {AT}, ((trunc(c0 * 3.5::DOUBLE - 300) % 256) + 256) % 256 AS c0 FROM px")
add("skip_ancillary_read", lambda s, d: images.chunks(images.encode(fx.tile_rows(s, d), 1, chunks=_named(s, d)), skip_ancillary=True).select("image_id", "seq", "type"), "SELECT vec_id AS image_id, CAST(k AS INTEGER) AS seq, t AS type FROM embeddings, (VALUES (0, 'IHDR'), (1, 'IDAT'), (2, 'IEND')) c(k, t)")
add("skip_ancillary_save", lambda s, d: images.chunks(images.encode(fx.tile_rows(s, d), 1, chunks=_named(s, d), skip_ancillary=True)).select("image_id", "seq", "type"), "SELECT vec_id AS image_id, CAST(k AS INTEGER) AS seq, t AS type FROM embeddings, (VALUES (0, 'IHDR'), (1, 'IDAT'), (2, 'IEND')) c(k, t)")


def _spoilt_files(s: SparkSession, d: str) -> DataFrame:
    """Files of tiles of which every third has a wrong checksum at its end."""
    c = F.col("content")
    other = F.concat(F.substr(c, F.lit(1), F.length(c) - 1), F.lit(bytearray(b"\0")))
    return images.encode(fx.tile_rows(s, d), 1).select("image_id", F.when(F.col("image_id") % 3 == 0, other).otherwise(c).alias("content"))


def _checks(s: SparkSession, d: str) -> DataFrame:
    told = lambda skip, name: images.headers(_spoilt_files(s, d), skip_crc=skip).select("image_id", F.array_join("warnings", "; ").alias(name))
    return told(False, "checked").join(told(True, "skipped"), "image_id")


add("skip_crc", _checks, "SELECT vec_id AS image_id, CASE WHEN vec_id % 3 = 0 THEN 'the CRC of IEND doesn''t hold' ELSE '' END AS checked, '' AS skipped FROM embeddings")


def _backgrounds(s: SparkSession, d: str) -> DataFrame:
    """Backgrounds written into files of three channels and read from their headers."""
    rows = rel.to_rows(px.to_rgb(fx.rgba(s, d)))
    i = F.col("image_id")
    back = rows.select("image_id").distinct().select("image_id", F.lit(0).alias("seq"), F.lit("bKGD").alias("type"), ch.background_chunk(F.array(i % 256, (i * 7) % 256, F.lit(9).cast("bigint")), 3).alias("data"), F.lit("after_IHDR").alias("pos"))
    return images.headers(images.encode(rows, 3, chunks=back)).select("image_id", "background")


add("background_files", _backgrounds, "SELECT vec_id AS image_id, [CAST(vec_id % 256 AS INTEGER), CAST(vec_id * 7 % 256 AS INTEGER), 9] AS background FROM embeddings")


def _odd_chunks(s: SparkSession, d: str) -> DataFrame:
    """What is odd about chunks of orders: kinds that occur twice, colours after the pixels, units that aren't known."""
    o = fx.table(s, d, "orders").select("o_orderkey")
    kinds = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(p).alias("pos")) for t, p in (("gAMA", "after_IHDR"), ("tRNS", "after_IDAT"), ("gAMA", "after_IDAT"), ("pHYs", "after_IHDR"))))
    c = o.select(F.col("o_orderkey").alias("image_id"), F.posexplode(kinds).alias("seq", "c")).select("image_id", "seq", "c.type", "c.pos", F.when(F.col("c.type") == "pHYs", F.concat(ch.uint(F.lit(1), 4), ch.uint(F.lit(1), 4), ch.uint(F.col("image_id") % 3, 1))).otherwise(ch.uint(F.lit(5), 4)).alias("data"))
    return ct.diagnostics(c, o.select(F.col("o_orderkey").alias("image_id"), F.when(F.col("o_orderkey") % 2 == 0, 6).otherwise(2).alias("color_type")))


add("chunk_diagnostics", _odd_chunks, "SELECT o_orderkey AS image_id, CAST(k AS INTEGER) AS seq, t AS type, m AS message FROM orders, (VALUES (1, 'tRNS', 'stands after the pixel data', 0), (2, 'gAMA', 'occurs more than once', 0), (3, 'pHYs', 'has an unknown unit', 1), (1, 'tRNS', 'isn''t expected in an image with alpha', 2)) v(k, t, m, c) WHERE c = 0 OR (c = 1 AND o_orderkey % 3 = 2) OR (c = 2 AND o_orderkey % 2 = 0)")
add("row_slice", wall(lambda i: px.get_row(i, 0, 7)), f"{WALL} SELECT image_id, x, c0 FROM px WHERE y = 7")
add("copy_rectangle", tiles(lambda i: geo.copy(i, 2, 3, 20, 3)), f"{TILES} SELECT image_id, y - 3 AS y, x - 2 AS x, c0 FROM px WHERE x >= 2 AND y BETWEEN 3 AND 5")
add("chunk_maps", lambda s, d: ct.chunk_map(images.chunks(images.encode(fx.tile_rows(s, d), 1, chunks=_named(s, d)))).select("image_id", F.array_sort(F.map_keys("chunks")).alias("kinds")), "SELECT vec_id AS image_id, list_sort(['IDAT', 'IEND', 'IHDR', ['prVt', 'tEXt', 'gAMA'][vec_id % 3 + 1]]) AS kinds FROM embeddings")


def _own_fields(s: SparkSession, d: str) -> DataFrame:
    """A field of the user's own, told by a decoder of their own, in blocks of all orders."""
    o = fx.table(s, d, "orders")
    ex.register("ExifIFD", 50000, "Coolness", lambda raw, numbers, little: F.concat(F.get(numbers, F.lit(0)).cast("bigint").cast("string"), F.lit(" degrees")))
    try:
        data = ex.block([(274, 3, F.lit(1), ch.wrapped(F.lit(1), 2))], [(50000, 3, F.lit(1), ch.wrapped(F.col("o_orderkey") % 360, 2))])
        return ex.fields(o.select("o_orderkey", data.alias("data"))).where("ifd = 'ExifIFD'").select("o_orderkey", "name", "text")
    finally:
        ex.unregister("ExifIFD", 50000)


add("exif_own_field", _own_fields, "SELECT o_orderkey, 'Coolness' AS name, (o_orderkey % 360) || ' degrees' AS text FROM orders")


def _small_pictures(s: SparkSession, d: str) -> DataFrame:
    """Thumbnails of unequal lengths and both kinds of compression, out of blocks of all orders."""
    o, one, k = fx.table(s, d, "orders"), F.lit(1), F.col("o_orderkey")
    picture = F.encode(F.concat(F.repeat("o_orderpriority", (k % 5).cast("int")), k.cast("string")), "UTF-8")
    data = ex.block([(274, 3, one, ch.wrapped(k % 8 + 1, 2)), (282, 5, one, F.concat(ch.wrapped(k, 4), ch.wrapped(F.lit(8), 4)))], [(40961, 3, one, ch.wrapped(one, 2))], picture, F.when(k % 2 == 0, 6).otherwise(1))
    return ex.thumbnails(o.select("o_orderkey", data.alias("data")), "o_orderkey").withColumn("thumbnail", F.decode("thumbnail", "UTF-8"))


add("exif_thumbnail", _small_pictures, "SELECT o_orderkey, CAST(CASE o_orderkey % 2 WHEN 0 THEN 6 ELSE 1 END AS BIGINT) AS compression, repeat(o_orderpriority, o_orderkey % 5) || o_orderkey AS thumbnail FROM orders")


def _name_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Names in all cases of their letters, some a letter short, against flags that may not fit them."""
    o, k, c = fx.table(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    letter = lambda i: F.when(k % (2 << i) < 1 << i, "PrVt"[i].lower()).otherwise("PrVt"[i].upper())
    name = F.concat(*(letter(i) for i in range(3)), F.when(k % 11 == 0, "").otherwise(letter(3)))
    return o.select("o_orderkey", name.alias("name"), registry.conflict(name, c % 3 > 0, c % 2 == 0, c % 5 > 1).alias("conflict"))


_LETTERS = " || ".join(f"CASE WHEN {'o_orderkey % 11 = 0' if i == 3 else 'false'} THEN '' WHEN o_orderkey % {2 << i} < {1 << i} THEN '{c.lower()}' ELSE '{c.upper()}' END" for i, c in enumerate("prvt"))
_WANTED = ("o_custkey % 3 > 0", "o_custkey % 2 <> 0", "false", "o_custkey % 5 > 1")
_WRONG = " ".join(f"WHEN regexp_matches(name[{i}], '[a-z]') <> ({w}) THEN 'the {n} letter of ' || name || ' must be ' || CASE WHEN {w} THEN 'lower' ELSE 'upper' END || ' case'" for i, (n, w) in enumerate(zip(("first", "second", "third", "fourth"), _WANTED), 1))
add("chunk_name_conflicts", _name_conflicts, f"WITH n AS (SELECT o_orderkey, o_custkey, {_LETTERS} AS name FROM orders) SELECT o_orderkey, name, CASE WHEN length(name) < 4 THEN name || ' isn''t four letters' {_WRONG} END AS conflict FROM n")


def _critical(s: SparkSession, d: str) -> DataFrame:
    """Tiles' files, three of four with a chunk before or behind their header that no reader may pass by."""
    c, k = F.col("content"), F.col("image_id") % 4
    put = lambda at, kind, data: F.concat(F.substr(c, F.lit(1), F.lit(at)), ch.raw_chunk(F.lit(kind), F.lit(bytearray(data))), F.substr(c, F.lit(at + 1)))
    files = images.encode(fx.tile_rows(s, d), 1)
    content = F.when(k == 1, put(8, "CgBI", b"\0" * 4)).when(k == 2, put(33, "ABCD", b"")).when(k == 3, put(33, "PLTE", b"abc")).otherwise(c)
    return images.headers(files.select("image_id", content.alias("content"))).select("image_id", "error")


add("critical_chunks", _critical, "SELECT vec_id AS image_id, 'ChunkError: ' || [NULL, 'CgBI: a file of another format that poses as PNG', 'unknown critical chunk ABCD', 'a palette that is empty, late or of a gray image'][vec_id % 4 + 1] AS error FROM embeddings")
add("to_blob", rgba(lambda i: rel.to_blob(i, -3, 1, 2, 3)), f"{RGBA} SELECT image_id, flatten(list([c0, c1, c2, c3] ORDER BY y, x)) AS vals FROM px WHERE x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 3 GROUP BY image_id")
add("to_blob_without_alpha", rgba(lambda i: rel.to_blob(i, 1, -2, alpha=False)), f"{RGBA} SELECT image_id, flatten(list([c0, c1, c2] ORDER BY y, x)) AS vals FROM px WHERE x >= 1 AND y >= 2 GROUP BY image_id")


# Animations
def _frames(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") % 7).alias("delay_num"), (F.col("o_orderkey") % 3 * 10).alias("delay_den"))


_FR = "fr AS (SELECT o_custkey AS image_id, o_orderkey AS frame, o_orderkey % 7 AS delay_num, o_orderkey % 3 * 10 AS delay_den FROM orders)"
_AN = f"WITH {_E}, o AS (SELECT vec_id, CAST(label AS BIGINT) AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings), ap AS (SELECT o.image_id, frame, p // 8 AS y, p % 8 AS x, q AS c0 FROM s JOIN o USING (vec_id))"
add("animation_time", lambda s, d: an.animation_time(_frames(s, d)).withColumn("seconds", F.round("seconds", 6)), f"WITH {_FR} SELECT image_id, round(sum(delay_num / CASE WHEN delay_den = 0 THEN 100.0::DOUBLE ELSE delay_den END), 6) AS seconds, count(*) AS n_frames FROM fr GROUP BY image_id")
add("pop_frame", lambda s, d: an.pop_frame(_frames(s, d)), f"WITH {_FR} SELECT fr.* FROM fr WHERE frame < (SELECT max(f.frame) FROM fr f WHERE f.image_id = fr.image_id)")
add("push_frame", lambda s, d: an.push_frame(_frames(s, d), _frames(s, d).select("image_id").distinct().withColumns({"delay_num": F.lit(1).cast("bigint"), "delay_den": F.lit(24).cast("bigint")})), f"WITH {_FR} SELECT * FROM fr UNION ALL SELECT image_id, max(frame) + 1, 1, 24 FROM fr GROUP BY image_id")
add("jump_to_frame", lambda s, d: an.frame_at(fx.frame_pixels(s, d).select("image_id", "frame").distinct(), 1003), f"{_AN} SELECT image_id, frame FROM (SELECT DISTINCT image_id, frame FROM ap) WHERE frame = 1003 % (SELECT max(b.frame) + 1 FROM ap b WHERE b.image_id = ap.image_id)".replace("FROM (SELECT DISTINCT image_id, frame FROM ap)", "FROM (SELECT DISTINCT image_id, frame FROM ap) ap"))
add("apng_last_write", lambda s, d: an.last_write(fx.frame_pixels(s, d)), f"{_AN} SELECT image_id, y, x, arg_max(c0, frame) AS c0 FROM ap GROUP BY image_id, y, x")
add("apng_compose_source", lambda s, d: an.composed_source(fx.frame_pixels(s, d).withColumn("c0", F.when(F.col("c0") < 140, F.col("c0")))), f"{_AN} SELECT image_id, frame, y, x, last_value(CASE WHEN c0 < 140 THEN c0 END IGNORE NULLS) OVER (PARTITION BY image_id, y, x ORDER BY frame ROWS UNBOUNDED PRECEDING) AS c0 FROM ap")


def _played(dispose: str, blend: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        p = fx.frame_pixels(s, d).select("image_id", "frame", "y", "x", "c0", F.when((F.col("x") + F.col("frame")) % 3 == 0, 0.0).when((F.col("x") + F.col("frame")) % 3 == 1, 255.0).otherwise(128.0).alias("c1"))
        f = p.select("image_id", "frame").distinct().withColumns({"w": F.lit(8), "h": F.lit(8), "x_off": F.lit(0), "y_off": F.lit(0), "dispose": F.lit(dispose), "blend": F.lit(blend)})
        return an.composed(f, p, 8, 8, 2)

    return run


_AP2 = f"{_AN}, f AS (SELECT *, CASE (x + frame) % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 255.0::DOUBLE ELSE 128.0::DOUBLE END AS c1 FROM ap)"
add("apng_dispose_none", _played("none", "source"), f"{_AP2} SELECT image_id, frame, y, x, c0, c1 FROM f")
add("apng_dispose_background", _played("background", "over"), f"{_AP2} SELECT image_id, frame, y, x, CASE WHEN c1 = 0 THEN 0.0::DOUBLE ELSE c0 END AS c0, c1 FROM f")
def _clip(s: SparkSession, d: str) -> DataFrame:
    frames, p = fx.clips(s, d)
    return an.composed(frames, p, 8, 8, 2)


_CLIPS = f"{_AN}, fr AS (SELECT image_id, frame, CASE frame WHEN 0 THEN 8 ELSE 1 + frame % 8 END AS w, CASE frame WHEN 0 THEN 8 ELSE 1 + (frame * 3) % 8 END AS h, frame % 7 AS delay_num, frame % 3 * 10 AS delay_den, ['none', 'background', 'previous'][frame % 3 + 1] AS dispose, ['source', 'over'][frame % 2 + 1] AS blend FROM (SELECT DISTINCT image_id, frame FROM ap)), fo AS (SELECT image_id, frame, w, h, CASE frame WHEN 0 THEN 0 ELSE frame * 5 % (9 - w) END AS x_off, CASE frame WHEN 0 THEN 0 ELSE frame * 7 % (9 - h) END AS y_off, delay_num, delay_den, dispose, blend FROM fr), cp AS (SELECT image_id, frame, y, x, c0, CASE (x + frame) % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 255.0::DOUBLE ELSE 128.0::DOUBLE END AS c1 FROM ap JOIN fo USING (image_id, frame) WHERE x < w AND y < h)"
_FOLD = """, cells AS MATERIALIZED (SELECT fo.image_id, fo.frame, a.y, b.x, f0, f1, {dispose} AS dispose, {blend} AS blend, f1 IS NOT NULL AS covered FROM {frames} CROSS JOIN range(8) a(y) CROSS JOIN range(8) b(x) LEFT JOIN (SELECT image_id, frame, y, x, c0 AS f0, c1 AS f1 FROM {pixels}) p ON p.image_id = fo.image_id AND p.frame = fo.frame AND p.y = a.y - fo.y_off AND p.x = b.x - fo.x_off),
st(image_id, frame, y, x, c0, c1, s0, s1, d) AS (
  SELECT image_id, CAST(-1 AS BIGINT), y, x, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'none' FROM cells WHERE frame = 0
  UNION ALL
  SELECT image_id, frame, y, x,
    CASE WHEN NOT covered THEN b0 WHEN blend = 'source' OR f1 = 255 THEN f0 WHEN f1 = 0 THEN b0 ELSE floor((f0 * (f1 / 255.0::DOUBLE) + b0 * (b1 / 255.0::DOUBLE) * (1 - f1 / 255.0::DOUBLE)) / (f1 / 255.0::DOUBLE + b1 / 255.0::DOUBLE * (1 - f1 / 255.0::DOUBLE))) END,
    CASE WHEN NOT covered THEN b1 WHEN blend = 'source' OR f1 = 255 THEN f1 WHEN f1 = 0 THEN b1 ELSE floor(255 * (f1 / 255.0::DOUBLE + b1 / 255.0::DOUBLE * (1 - f1 / 255.0::DOUBLE))) END,
    b0, b1, CASE WHEN NOT covered THEN 'none' WHEN frame = 0 AND dispose = 'previous' THEN 'background' ELSE dispose END
  FROM (SELECT c.*, CASE st.d WHEN 'background' THEN 0 WHEN 'previous' THEN st.s0 ELSE st.c0 END AS b0, CASE st.d WHEN 'background' THEN 0 WHEN 'previous' THEN st.s1 ELSE st.c1 END AS b1
    FROM st JOIN cells c ON c.image_id = st.image_id AND c.frame = st.frame + 1 AND c.y = st.y AND c.x = st.x))
SELECT image_id, frame, y, x, c0, c1 FROM st WHERE frame >= 0"""
_RECURSIVE = _CLIPS.replace("WITH ", "WITH RECURSIVE ", 1)
_WHOLE = _AP2.replace("WITH ", "WITH RECURSIVE ", 1) + ", fo AS (SELECT DISTINCT image_id, frame, 0 AS x_off, 0 AS y_off FROM f)"
add("apng_dispose_previous", _played("previous", "over"), _WHOLE + _FOLD.format(frames="fo", pixels="f", dispose="'previous'", blend="'over'"))
add("apng_compose_over", _played("none", "over"), _WHOLE + _FOLD.format(frames="fo", pixels="f", dispose="'none'", blend="'over'"))
add("apng_play_parts", _clip, _RECURSIVE + _FOLD.format(frames="fo", pixels="cp", dispose="fo.dispose", blend="fo.blend"))


add("frame_delay_update", lambda s, d: an.set_delay(fx.clips(s, d)[0], 1, 5, 6).select("image_id", "frame", "delay_num", "delay_den"), f"{_CLIPS} SELECT image_id, frame, CASE WHEN frame = 1 THEN 5 ELSE delay_num END AS delay_num, CASE WHEN frame = 1 THEN 6 ELSE delay_den END AS delay_den FROM fo")
add("frame_offset_update", lambda s, d: an.set_offset(fx.clips(s, d)[0], -2, 0, 0).select("image_id", "frame", "x_off", "y_off"), f"{_CLIPS} SELECT image_id, frame, CAST(CASE WHEN frame = last - 1 THEN 0 ELSE x_off END AS BIGINT) AS x_off, CAST(CASE WHEN frame = last - 1 THEN 0 ELSE y_off END AS BIGINT) AS y_off FROM fo JOIN (SELECT image_id, max(frame) AS last FROM fo GROUP BY image_id) USING (image_id)")


def _clip_rows(p: DataFrame) -> DataFrame:
    return p.groupBy("image_id", "frame", "y").agg(F.sort_array(F.collect_list(F.struct("x", F.array("c0", "c1").alias("v")))).alias("l")).select("image_id", "frame", "y", F.flatten("l.v").alias("vals"))


def _clip_files(s: SparkSession, d: str) -> DataFrame:
    frames, p = fx.clips(s, d)
    return apng.encode(frames, _clip_rows(p), 2)


def _clip_pixels(s: SparkSession, d: str) -> DataFrame:
    return _frames_of(images.chunks(_clip_files(s, d)))[1]


def _clip_validity(s: SparkSession, d: str) -> DataFrame:
    """Files of which a third lost its acTL and a third a part of a frame."""
    c = images.chunks(_clip_files(s, d))
    last = F.max(F.when(F.col("type") == "fdAT", F.col("seq"))).over(Window.partitionBy("image_id"))
    k = F.col("image_id") % 3
    left = c.withColumn("_last", last).where(~((k == 1) & (F.col("type") == "acTL")) & ~((k == 2) & (F.col("seq") == F.col("_last"))))
    return apng.validity(left).select("image_id", "valid", F.array_join("reasons", "; ").alias("reasons"))


add("apng_file_roundtrip", _clip_pixels, f"{_CLIPS} SELECT image_id, frame, y, x, c0, c1 FROM cp")
add("apng_create_frames", lambda s, d: apng.create_frames(images.chunks(_clip_files(s, d))).drop("content"), f"{_CLIPS} SELECT image_id, frame, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(x_off AS BIGINT) AS x_off, CAST(y_off AS BIGINT) AS y_off, delay_num, delay_den, dispose, blend FROM fo")
add("apng_validity", _clip_validity, f"{_AN} SELECT DISTINCT image_id, image_id % 3 = 0 AS valid, CASE image_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'no acTL' ELSE 'a frame control without data' END AS reasons FROM ap")
add("apng_headers", lambda s, d: images.headers(_clip_files(s, d)).select("image_id", "width", "height", "has_alpha", "n_frames", "n_plays", F.array_join("warnings", "").alias("warnings"), "error"), f"{_AN} SELECT image_id, 8 AS width, 8 AS height, true AS has_alpha, CAST(max(frame) + 1 AS INTEGER) AS n_frames, 0 AS n_plays, '' AS warnings, CAST(NULL AS VARCHAR) AS error FROM ap GROUP BY image_id")


def _clips_with_chunks(s: SparkSession, d: str) -> DataFrame:
    """The chunks of animated files that hold a private chunk, a text or a gamma beside their frames."""
    frames, p = fx.clips(s, d)
    return images.chunks(apng.encode(frames, _clip_rows(p), 2, chunks=_named(s, d))).select("image_id", "seq", "type", "pos", "crc_ok")


add("apng_with_chunks", _clips_with_chunks, f"{_CLIPS}, i AS (SELECT DISTINCT image_id FROM fo), w AS (SELECT image_id, part, 0 AS n, type FROM i, (VALUES (0, 'IHDR'), (2, 'acTL'), (3, 'fcTL'), (4, 'IDAT'), (7, 'IEND')) c(part, type) UNION ALL SELECT image_id, 1, 0, 'gAMA' FROM i WHERE image_id % 3 = 2 UNION ALL SELECT image_id, 6, 0, ['prVt', 'tEXt'][image_id % 3 + 1] FROM i WHERE image_id % 3 < 2 UNION ALL SELECT image_id, 5, 2 * frame + k, ['fcTL', 'fdAT'][k + 1] FROM fo, range(2) t(k) WHERE frame > 0) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY part, n) - 1 AS INTEGER) AS seq, type, CASE WHEN part < 4 THEN 'after_IHDR' ELSE 'after_IDAT' END AS pos, true AS crc_ok FROM w")


def _cropped(s: SparkSession, d: str) -> DataFrame:
    frames, p = fx.clips(s, d)
    moved = frames.withColumns({"x_off": F.col("frame") % 17 - 8, "y_off": F.col("frame") % 13 - 6})
    return an.cropped(moved, p, 8, 8)[1]


add("apng_crop_frames", _cropped, f"{_CLIPS}, mv AS (SELECT image_id, frame, w, h, frame % 17 - 8 AS xo, frame % 13 - 6 AS yo FROM fo), ed AS (SELECT *, greatest(-xo, 0) AS l, greatest(-yo, 0) AS t, least(7 - xo, w - 1) AS r, least(7 - yo, h - 1) AS b FROM mv) SELECT image_id, frame, y - t AS y, x - l AS x, c0, c1 FROM cp JOIN ed USING (image_id, frame) WHERE l <= r AND t <= b AND x BETWEEN l AND r AND y BETWEEN t AND b UNION ALL SELECT image_id, frame, 0, 0, 0, 0 FROM ed WHERE l > r OR t > b")


def _pushed(s: SparkSession, d: str) -> DataFrame:
    """Each clip's first frame pushed again after the last, at places that may lie outside."""
    frames, p = fx.clips(s, d)
    i = F.col("image_id")
    first = frames.where("frame = 0").select("image_id", "w", "h", (i * 3 % 19 - 9).alias("x_off"), (i * 5 % 17 - 8).alias("y_off"), F.lit("previous").alias("dispose"))
    f, q = an.push(frames, p, first, p.where("frame = 0").drop("frame"))
    last = f.groupBy("image_id").agg(F.max("frame").alias("frame"))
    return q.join(f.join(last, ["image_id", "frame"]), ["image_id", "frame"]).select("image_id", "frame", "y", "x", "c0", "c1", "w", "h", "x_off", "y_off", "delay_num", "delay_den", "dispose", "blend")


add("apng_push_frame", _pushed, f"{_CLIPS}, ps AS (SELECT image_id, max(frame) + 1 AS frame, image_id * 3 % 19 - 9 AS xo, image_id * 5 % 17 - 8 AS yo FROM fo GROUP BY image_id), ed AS (SELECT *, greatest(-xo, 0) AS l, greatest(-yo, 0) AS t, least(7 - xo, 7) AS r, least(7 - yo, 7) AS b FROM ps), al AS (SELECT *, l > r OR t > b AS e FROM ed) SELECT image_id, al.frame, CASE WHEN e THEN 0 ELSE y - t END AS y, CASE WHEN e THEN 0 ELSE x - l END AS x, CASE WHEN e THEN 0 ELSE c0 END AS c0, CASE WHEN e THEN 0 ELSE c1 END AS c1, CASE WHEN e THEN 1 ELSE r - l + 1 END AS w, CASE WHEN e THEN 1 ELSE b - t + 1 END AS h, CASE WHEN e THEN 0 ELSE greatest(xo, 0) END AS x_off, CASE WHEN e THEN 0 ELSE greatest(yo, 0) END AS y_off, CAST(1 AS BIGINT) AS delay_num, CAST(24 AS BIGINT) AS delay_den, 'previous' AS dispose, CASE WHEN e THEN 'over' ELSE 'source' END AS blend FROM al JOIN cp USING (image_id) WHERE cp.frame = 0 AND CASE WHEN e THEN x = 0 AND y = 0 ELSE x BETWEEN l AND r AND y BETWEEN t AND b END")


def _jumped(s: SparkSession, d: str) -> DataFrame:
    """A jump that replays from the nearest of the canvases kept after every 16th frame."""
    frames, p = fx.clips(s, d)
    return an.canvas_at(frames, p, 1003, 8, 8, 2, stored=an.checkpoints(frames, p, 8, 8, 16, 2))


add("apng_checkpoint_jump", _jumped, _RECURSIVE + _FOLD.format(frames="fo", pixels="cp", dispose="fo.dispose", blend="fo.blend") + " AND frame = 1003 % (SELECT max(g.frame) + 1 FROM fo g WHERE g.image_id = st.image_id)")


def _broken(s: SparkSession, d: str) -> DataFrame:
    """The chunks of files of which some lost acTL, the last data, data in the middle, the first control or all controls, or have their frames in another order."""
    c = images.chunks(_clip_files(s, d)).drop("crc_ok")
    k, kind, n = F.col("image_id") % 7, F.col("type"), F.when(F.col("type").isin("fcTL", "fdAT"), ch.read_uint(F.col("data"), 0, 4))
    last = F.max(F.when(kind == "fdAT", F.col("seq"))).over(Window.partitionBy("image_id"))
    lost = ((k == 1) & (kind == "acTL")) | ((k == 2) & (kind == "fdAT") & (F.col("seq") == F.col("_last"))) | ((k == 3) & (kind == "fdAT") & (n == 8)) | ((k == 5) & (kind == "fcTL") & (n == 0)) | ((k == 6) & (kind == "fcTL"))
    turned = F.when((k == 4) & (F.col("seq") > 3) & n.isNotNull(), F.col("_last") + 4 - F.col("seq")).otherwise(F.col("seq")).cast("int")
    return stored(c.withColumn("_last", last).where(~lost).withColumn("seq", turned).drop("_last"), "broken-chunks")


_SCAN = """, an AS (SELECT image_id, 'fcTL' AS type, CASE frame WHEN 0 THEN 0 ELSE 2 * frame - 1 END AS n FROM fo UNION ALL SELECT image_id, 'fdAT', 2 * frame FROM fo WHERE frame > 0),
lo AS (SELECT * FROM an WHERE NOT ((image_id % 7 = 2 AND n = (SELECT max(b.n) FROM an b WHERE b.image_id = an.image_id)) OR (image_id % 7 = 3 AND n = 8) OR (image_id % 7 = 5 AND n = 0) OR (image_id % 7 = 6 AND type = 'fcTL'))),
od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n) AS k FROM lo),
sc(image_id, k, type, alive) AS (SELECT image_id, k, type, type = 'fcTL' FROM od WHERE k = 1
  UNION ALL SELECT od.image_id, od.k, od.type, sc.alive AND NOT (od.type = 'fcTL' AND sc.type = 'fcTL' AND od.k > 2) FROM sc JOIN od ON od.image_id = sc.image_id AND od.k = sc.k + 1),
al AS (SELECT *, lead(type) OVER (PARTITION BY image_id ORDER BY k) AS nx, count(*) FILTER (type = 'fdAT') OVER (PARTITION BY image_id) AS held FROM sc WHERE alive),
kp AS (SELECT image_id, type, k = 1 AND nx = 'fcTL' AS head, row_number() OVER (PARTITION BY image_id ORDER BY k) - 1 AS n FROM al WHERE held > 0 AND (type = 'fdAT' OR nx = 'fdAT' OR (k = 1 AND nx = 'fcTL'))),
w AS (SELECT image_id, 0 AS part, 0 AS pl, 'IHDR' AS type, CAST(NULL AS BIGINT) AS number, CAST(NULL AS BIGINT) AS n_frames FROM fo GROUP BY image_id UNION ALL SELECT image_id, 3, 0, 'IDAT', NULL, NULL FROM fo GROUP BY image_id UNION ALL SELECT image_id, 6, 0, 'IEND', NULL, NULL FROM fo GROUP BY image_id
  UNION ALL SELECT image_id, 1, 0, 'acTL', NULL, count(*) FILTER (type = 'fcTL') FROM kp GROUP BY image_id UNION ALL SELECT image_id, CASE WHEN head THEN 2 ELSE 4 END, n, type, n, NULL FROM kp)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY part, pl) - 1 AS INTEGER) AS seq, type, CASE WHEN part < 3 THEN 'after_IHDR' ELSE 'after_IDAT' END AS pos, CAST(number AS BIGINT) AS number, CAST(n_frames AS BIGINT) AS n_frames FROM w"""


def _repaired(s: SparkSession, d: str) -> DataFrame:
    kind, data = F.col("type"), F.col("data")
    return apng.repaired(_broken(s, d)).select("image_id", "seq", "type", "pos", F.when(kind.isin("fcTL", "fdAT"), ch.read_uint(data, 0, 4)).alias("number"), F.when(kind == "acTL", ch.read_uint(data, 0, 4)).alias("n_frames"))


add("apng_repair", _repaired, _RECURSIVE + _SCAN)


def _frames_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames and pixels of two channels of the chunks of animated files."""
    made = apng.create_frames(chunks)
    at = apng.frame_rows(made).select("image_id", "frame", "y", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("vals") / 2).cast("int") - 1), lambda i: F.slice("vals", i * 2 + 1, 2))).alias("x", "v"))
    return made.drop("content"), at.select("image_id", "frame", "y", F.col("x").cast("bigint").alias("x"), F.col("v")[0].alias("c0"), F.col("v")[1].alias("c1"))


add("apng_repair_play", lambda s, d: an.composed(*_frames_of(stored(apng.repaired(_broken(s, d)), "repaired-chunks")), 8, 8, 2), _RECURSIVE + ", kf AS (SELECT * FROM fo WHERE image_id % 7 IN (0, 1, 4) OR (image_id % 7 = 2 AND frame < (SELECT max(g.frame) FROM fo g WHERE g.image_id = fo.image_id)) OR (image_id % 7 = 3 AND frame < 4) OR (image_id % 7 = 5 AND frame > 0)), mv AS (SELECT * REPLACE (frame - CAST(image_id % 7 = 5 AS BIGINT) AS frame) FROM kf), mp AS (SELECT * REPLACE (cp.frame - CAST(image_id % 7 = 5 AS BIGINT) AS frame) FROM cp)" + _FOLD.format(frames="mv fo", pixels="mp", dispose="fo.dispose", blend="fo.blend"))

# Functions over pixels
add("apply_lambda_flat", rgba(lambda i: px.mapped(i, lambda v: v * v - 1)), f"{RGBA} SELECT {each('{c} * {c} - 1')} FROM px")
add("apply_lambda_nm", rgba(lambda i: px.mapped_pixels(i, lambda a, b, c, d: [a + b, c - d])), f"{RGBA} SELECT {AT}, c0 + c1 AS c0, c2 - c3 AS c1 FROM px")
add("map_with_coord", rgba(lambda i: px.mapped_pixels(i, lambda a, b, c, d, x, y: [a * (x + y), b, c * x, d], True)), f"{RGBA} SELECT {AT}, c0 * (x + y) AS c0, c1, c2 * x AS c2, c3 FROM px")
add("map_channels", rgba(lambda i: px.map_channels(i, lambda c: px.add(c, 1))), f"{RGBA} SELECT {each('{c} + 1')} FROM px")
