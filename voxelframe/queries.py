"""Queries over rasters made from the standard tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import maths, noise
from .operators import statistics as stats
from .operators.cosmics import detect, laplacian, min_contrast, segment
from .operators.resampling import CUBIC, LINEAR, NEAREST, Affinity, downsample, rotate, upsample, warp
from .operators.spectra import fourier_convolve, inverse_real_dft, real_dft
from .operators.stencil import (
    BinaryDilation,
    BinaryErosion,
    Constant,
    Convolution,
    Correlation,
    Dilation,
    Erosion,
    Mean,
    Median,
    Nearest,
    Periodic,
    along_axes,
    apply_filter,
    at_positions,
    filter_norm,
    gather,
    laplace,
    pad,
    prewitt,
    scharr,
    sobel,
)
from .plans.raster import Raster
from .plans.regions import Box, Grid, Mask, Positions, line
from .plans.scratch import scratch_path
from .plans.steps import Step, StepPipeline
from .sources.fits import read_fits, write_fits
from .streaming.chunks import chunk_totals, map_chunks, to_chunks, to_pixels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# -- rasters: components by vector, quantity by discount, hour by day, type by hour


def r1(spark: SparkSession, sf_dir: str) -> Raster:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x0", "v"))
    most = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
    return Raster(table.select(F.col("x0").cast("long").alias("x0"), F.col("vec_id").alias("x1"), F.col("v").cast("double").alias("v")), (64, most + 1))


def r2(spark: SparkSession, sf_dir: str) -> Raster:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x0, x1 = F.col("l_quantity").cast("long") - 1, F.round(F.col("l_discount") * 100).cast("long")
    return Raster(t.groupBy(x0.alias("x0"), x1.alias("x1")).agg(F.count(F.lit(1)).alias("v")), (50, 11))


def r3(spark: SparkSession, sf_dir: str) -> Raster:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    counted = t.groupBy(F.hour("ts").cast("long").alias("x0"), (F.dayofmonth("ts") - 1).cast("long").alias("x1")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Box.from_shape((24, 30)).positions(spark).join(counted, ["x0", "x1"], "left")
    return Raster(whole.select("x0", "x1", F.coalesce("_n", F.lit(0)).alias("v")), (24, 30))


R1 = "px AS (SELECT i - 1 AS x0, vec_id AS x1, embedding[i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) t(i)), dim AS (SELECT 64 AS s0, max(vec_id) + 1 AS s1 FROM embeddings)"
R2 = "px AS (SELECT l_quantity::BIGINT - 1 AS x0, round(l_discount * 100)::BIGINT AS x1, count(*) AS v FROM lineitem GROUP BY ALL), dim AS (SELECT 50 AS s0, 11 AS s1)"
R3 = """px AS (SELECT h.x0, d.x1, count(e.ts) AS v FROM (SELECT unnest(range(24)) AS x0) h CROSS JOIN (SELECT unnest(range(30)) AS x1) d
 LEFT JOIN events e ON hour(e.ts) = h.x0 AND day(e.ts) - 1 = d.x1 GROUP BY ALL), dim AS (SELECT 24 AS s0, 30 AS s1)"""


def rows(raster: Raster, value: Column | None = None) -> DataFrame:
    return raster.df.select(*raster.axes, (F.col("v") if value is None else value).alias("v"))


def _window(front: tuple[int, int], back: tuple[int, int]) -> str:
    """Rows d0, d1, n of a window, axis 0 fastest."""
    return f"w AS (SELECT a AS d0, b AS d1, (a - {front[0]}) + (b - {front[1]}) * {back[0] - front[0] + 1} AS n FROM range({front[0]}, {back[0] + 1}) q(a), range({front[1]}, {back[1] + 1}) r(b))"


NEAREST_SQL = ("least(greatest(a.x0 + w.d0, 0), s0 - 1)", "least(greatest(a.x1 + w.d1, 0), s1 - 1)")
PERIODIC_SQL = ("((a.x0 + w.d0) % s0 + s0) % s0", "((a.x1 + w.d1) % s1 + s1) % s1")
PLAIN_SQL = ("a.x0 + w.d0", "a.x1 + w.d1")


def _stencil(base: str, front: tuple[int, int], back: tuple[int, int], value: str, look: tuple[str, str] = NEAREST_SQL, join: str = "JOIN", where: str = "true", out: str = "a.x0, a.x1") -> str:
    """SQL of a filter: ``value`` aggregates b.v over the window; w.n numbers its positions."""
    return f"WITH {base}, {_window(front, back)} SELECT {out}, {value} AS v FROM px a CROSS JOIN dim CROSS JOIN w {join} px b ON b.x0 = {look[0]} AND b.x1 = {look[1]} WHERE {where} GROUP BY a.x0, a.x1, s0, s1"


B3 = Box((-1, -1), (1, 1))
W3 = ((-1, -1), (1, 1))
K9 = list(range(9))
CONV = "sum((8 - w.n)::DOUBLE * b.v)"


@query(_stencil(R1, *W3, CONV))
def conv3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Convolution(K9, B3), r1(spark, sf_dir), Nearest()))


@query(_stencil(R1, *W3, "sum((8 - w.n)::DOUBLE * coalesce(b.v, 0))", PLAIN_SQL, "LEFT JOIN"))
def conv3_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Convolution(K9, B3), r1(spark, sf_dir), Constant(0)))


@query(_stencil(R1, *W3, CONV, PERIODIC_SQL))
def conv3_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Convolution(K9, B3), r1(spark, sf_dir), Periodic()))


@query(_stencil(R1, *W3, CONV, PLAIN_SQL, where="a.x0 BETWEEN 1 AND s0 - 2 AND a.x1 BETWEEN 1 AND s1 - 2", out="a.x0 - 1 AS x0, a.x1 - 1 AS x1"))
def conv3_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Convolution(K9, B3), r1(spark, sf_dir)))


@query(_stencil(R2, *W3, CONV))
def conv3_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = r2(spark, sf_dir)
    return gather(Convolution(K9, B3), raster, raster.df.select("x0", "x1")).select("x0", "x1", "v")


@query(_stencil(R2, (-1, -1), (2, 0), "sum((w.n + 1)::DOUBLE * b.v)"))
def corr_even_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Correlation(list(range(1, 9)), Box((-1, -1), (2, 0))), r2(spark, sf_dir), Nearest()))


def _kernel(k: list[list[int]]) -> str:
    """Sum over the window of a 3 by 3 kernel given as rows of axis 1, seen as a correlation."""
    flat = ", ".join(str(x) for row in k for x in row)
    return f"sum(([{flat}])[(w.n + 1)::INTEGER]::DOUBLE * b.v)"


@query(_stencil(R2, *W3, _kernel([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])))
def sobel0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(sobel(0, [1], 2), r2(spark, sf_dir), Nearest()))


@query(_stencil(R2, *W3, _kernel([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])))
def sobel1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(sobel(1, [0], 2), r2(spark, sf_dir), Nearest()))


@query(_stencil(R2, *W3, _kernel([[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]])))
def prewitt0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(prewitt(0, [1], 2), r2(spark, sf_dir), Nearest()))


@query(_stencil(R2, *W3, _kernel([[3, 0, -3], [10, 0, -10], [3, 0, -3]])))
def scharr0_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(scharr(0, [1], 2, -1), r2(spark, sf_dir), Nearest()))


@query(_stencil(R2, *W3, _kernel([[0, 1, 0], [1, -4, 1], [0, 1, 0]])))
def laplace2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(laplace([0, 1], 2), r2(spark, sf_dir), Nearest()))


@query(_stencil(R2, *W3, "pow(abs(" + _kernel([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) + "), 2) + pow(abs(" + _kernel([[-1, -2, -1], [0, 0, 0], [1, 2, 1]]) + "), 2)"))
def sobel_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(filter_norm(2, sobel(0, [1], 2), sobel(1, [0], 2)), r2(spark, sf_dir), Nearest()))


@query(_stencil(R2, (-2, -2), (2, 2), "sum(([1, 2, 3, 2, 1])[(w.d0 + 3)::INTEGER]::DOUBLE * ([1, 2, 3, 2, 1])[(w.d1 + 3)::INTEGER] * b.v)"))
def separable5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(along_axes(Correlation, [1, 2, 3, 2, 1], [0, 1], 2), r2(spark, sf_dir), Nearest()))


@query(_stencil(R2, *W3, "min(b.v)::DOUBLE"))
def erosion3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Erosion(B3), r2(spark, sf_dir), Nearest()))


@query(_stencil(R2, *W3, "max(b.v)::DOUBLE", PERIODIC_SQL))
def dilation3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Dilation(B3), r2(spark, sf_dir), Periodic()))


@query(_stencil(R2, *W3, "round(avg(b.v), 6)"))
def mean3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Mean(B3), r2(spark, sf_dir), Nearest()), F.round("v", 6))


@query(_stencil(R2, *W3, "median(b.v)::DOUBLE"))
def median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Median(B3), r2(spark, sf_dir), Nearest()))


@query(_stencil(R3, *W3, "CASE WHEN min(CASE WHEN coalesce(b.v, 0) % 3 <> 0 THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE", PLAIN_SQL, "LEFT JOIN"))
def binary_erosion3(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = r3(spark, sf_dir).apply(lambda v: v % 3)
    return rows(apply_filter(BinaryErosion(B3), raster, Constant(0)))


@query(_stencil(R3, *W3, "CASE WHEN max(CASE WHEN b.v % 5 = 1 THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE", PLAIN_SQL))
def binary_dilation3(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = r3(spark, sf_dir).apply(lambda v: (v % 5 == 1).cast("int"))
    return rows(apply_filter(BinaryDilation(B3), raster, Constant(0)))


@query(_stencil(R3, (-2, -2), (2, 2), "max(b.v)::DOUBLE", where="w.d0 * w.d0 + w.d1 * w.d1 <= 4"))
def ball_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Dilation(Mask.ball(2, (0, 0))), r3(spark, sf_dir), Nearest()))


@query(_stencil(R3, *W3, CONV, where="(a.x0 - 1) % 3 = 0 AND (a.x1 - 1) % 4 = 0 AND a.x0 <= 22 AND a.x1 <= 28", out="(a.x0 - 1) // 3 AS x0, (a.x1 - 1) // 4 AS x1"))
def conv3_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(apply_filter(Convolution(K9, B3), r3(spark, sf_dir), Nearest(), Grid((1, 1), (22, 28), (3, 4))))


@query(f"WITH {R2}, {_window(*W3)}, p(ord, x0, x1) AS (VALUES (0, 0, 0), (1, 49, 10), (2, 7, 3), (3, 7, 3)) SELECT a.ord::BIGINT AS ord, a.x0::BIGINT AS x0, a.x1::BIGINT AS x1, {CONV} AS v FROM p a CROSS JOIN dim CROSS JOIN w JOIN px b ON b.x0 = {NEAREST_SQL[0]} AND b.x1 = {NEAREST_SQL[1]} GROUP BY ALL")
def conv3_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Positions.of(spark, [(0, 0), (49, 10), (7, 3), (7, 3)])
    return at_positions(Convolution(K9, B3), r2(spark, sf_dir), at).select("ord", "x0", "x1", "v")


@query(_stencil(R2, *W3, "round(sum(([-1/6, -2/3, -1/6, -2/3, 10/3, -2/3, -1/6, -2/3, -1/6])[(w.n + 1)::INTEGER]::DOUBLE * b.v), 6)"))
def cosmic_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(laplacian(r2(spark, sf_dir)), F.round("v", 6))


@query(f"""WITH {R2}, o(d0, d1) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
 c AS (SELECT a.x0, a.x1, min((n.v - a.v)::DOUBLE / n.v) AS c FROM px a CROSS JOIN o JOIN px n ON n.x0 = a.x0 + d0 AND n.x1 = a.x1 + d1 WHERE n.v % 4 = 0 GROUP BY ALL)
 SELECT x0, x1, round(coalesce(c, 1e6), 9) AS v FROM px LEFT JOIN c USING (x0, x1)""")
def cosmic_min_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = r2(spark, sf_dir)
    mask = raster.apply(lambda v: (v % 4 == 0).cast("int"))
    return rows(min_contrast(raster.apply(lambda v: v.cast("double")), mask), F.round(F.when(F.col("v") > 1e300, 1e6).otherwise(F.col("v")), 9))


@query(f"""WITH {R2}, o(d0, d1) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
 c AS (SELECT a.x0, a.x1, min((n.v - a.v)::DOUBLE / n.v) AS c FROM px a CROSS JOIN o JOIN px n ON n.x0 = a.x0 + d0 AND n.x1 = a.x1 + d1 WHERE n.v % 4 = 0 GROUP BY ALL)
 SELECT x0, x1, CASE WHEN v % 4 = 0 OR (c < -0.1 AND x0 BETWEEN 1 AND 48 AND x1 BETWEEN 1 AND 9) THEN 1 ELSE 0 END AS v FROM px LEFT JOIN c USING (x0, x1)""")
def cosmic_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = r2(spark, sf_dir)
    mask = raster.apply(lambda v: (v % 4 == 0).cast("int"))
    return rows(segment(raster.apply(lambda v: v.cast("double")), mask, -0.1))


_PSF = "([1, 2, 1, 2, 4, 2, 1, 2, 1])[(w.n + 1)::INTEGER]::DOUBLE"


@query(f"""WITH {R2}, {_window(*W3)},
 near AS (SELECT a.x0, a.x1, w.n, b.v FROM px a CROSS JOIN dim CROSS JOIN w JOIN px b ON b.x0 = {NEAREST_SQL[0]} AND b.x1 = {NEAREST_SQL[1]}),
 l AS (SELECT x0, x1, sum(([-1/6, -2/3, -1/6, -2/3, 10/3, -2/3, -1/6, -2/3, -1/6])[(w.n + 1)::INTEGER]::DOUBLE * v) AS v FROM near w GROUP BY ALL),
 q AS (SELECT x0, x1, min(v / {_PSF}) * sqrt(9 / sum(pow(v / {_PSF}, 2))) AS v FROM near w GROUP BY ALL),
 d AS (SELECT a.x0, a.x1, max(b.v) AS v FROM q a CROSS JOIN dim CROSS JOIN w JOIN q b ON b.x0 = {NEAREST_SQL[0]} AND b.x1 = {NEAREST_SQL[1]} GROUP BY ALL),
 t AS (SELECT -avg(abs(v)) * ln(0.4) AS t FROM l)
 SELECT l.x0, l.x1, CASE WHEN l.v > t AND d.v < 0.95 THEN 1 ELSE 0 END AS v FROM l JOIN d USING (x0, x1), t""")
def cosmic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(detect(r2(spark, sf_dir), [1.0, 2.0, 1.0, 2.0, 4.0, 2.0, 1.0, 2.0, 1.0], (3, 3), 0.2, 0.95))


@query(f"WITH {R2} SELECT x0, x1, v::INTEGER AS v FROM px")
def fits_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "image") + ".fits"
    write_fits(r2(spark, sf_dir), path, "x", "int32")
    return rows(read_fits(spark, path))


@query(f"WITH {R2}, t AS (SELECT sum(v) AS s FROM px) SELECT x1, round(sum(v) / any_value(s), 9) AS share FROM px, t GROUP BY x1")
def step_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = Step("pixels", lambda: r2(spark, sf_dir).df)
    whole = Step("whole", lambda df: df.agg(F.sum("v").alias("s")), [pixels])
    lines = Step("lines", lambda df: df.groupBy("x1").agg(F.sum("v").alias("line")), [pixels])
    shares = Step("shares", lambda a, b: a.crossJoin(b).select("x1", F.round(F.col("line") / F.col("s"), 9).alias("share")), [lines, whole])  # one row
    return StepPipeline().get(shares)


@query(f"WITH {R2} SELECT x0, x1, CASE WHEN x0 BETWEEN 10 AND 30 AND (x0 - 10) % 4 = 0 AND x1 BETWEEN 2 AND 8 AND x1 % 2 = 0 THEN (x0 - 10) // 4 + x1 ELSE v END AS v FROM px")
def view_write_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = Grid((10, 2), (30, 8), (4, 2))
    new = Raster.filled(spark, region.shape, 0).generate(lambda a, b: a + b * 2 + 2)
    return rows(r2(spark, sf_dir).write(new, region))


@query(f"WITH {R2} SELECT q.a + 3 AS x0, r.b + 2 AS x1, p.v FROM range(-3, 53) q(a), range(-2, 13) r(b), px p WHERE p.x0 = (q.a + 50) % 50 AND p.x1 = (r.b + 11) % 11")
def pad_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pad(r2(spark, sf_dir), Box((-3, -2), (52, 12)), Periodic()))


# -- regions and views


def _view(name: str, base: str, make: Callable[[Raster], DataFrame], sql: str, source: Callable[[SparkSession, str], Raster]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(source(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {base} {sql}"


_view("region_box", R1, lambda r: r.patch(Box((5, 10), (20, 99))).select("x0", "x1", "v"), "SELECT x0, x1, v FROM px WHERE x0 BETWEEN 5 AND 20 AND x1 BETWEEN 10 AND 99", r1)
_view("region_grid", R1, lambda r: rows(r.crop(Grid((1, 2), (60, 90), (3, 5)))), "SELECT (x0 - 1) // 3 AS x0, (x1 - 2) // 5 AS x1, v FROM px WHERE x0 BETWEEN 1 AND 60 AND x1 BETWEEN 2 AND 90 AND (x0 - 1) % 3 = 0 AND (x1 - 2) % 5 = 0", r1)
_view("region_line", R1, lambda r: r.patch(line((4, 3), 1, 200, 7)).select("x0", "x1", "v"), "SELECT x0, x1, v FROM px WHERE x0 = 4 AND x1 BETWEEN 3 AND 200 AND (x1 - 3) % 7 = 0", r1)
_view("region_mask", R2, lambda r: r.patch(Mask.ball(3, (20, 5))).select("x0", "x1", "v"), "SELECT x0, x1, v FROM px WHERE (x0 - 20) * (x0 - 20) + (x1 - 5) * (x1 - 5) <= 9", r2)
_view("region_positions", R2, lambda r: r.patch(Positions.of(r.df.sparkSession, [(3, 4), (0, 0), (3, 4)])).select("ord", "x0", "x1", "v"), "SELECT ord::BIGINT AS ord, px.x0, px.x1, v FROM px JOIN (VALUES (0, 3, 4), (1, 0, 0), (2, 3, 4)) t(ord, x0, x1) ON px.x0 = t.x0 AND px.x1 = t.x1", r2)
_view("view_section", R1, lambda r: rows(r.section(7)), "SELECT x0, v FROM px WHERE x1 = 7", r1)
_view("view_chunk", R1, lambda r: rows(r.chunk(3, 9)), "SELECT x0, x1 - 3 AS x1, v FROM px WHERE x1 BETWEEN 3 AND 9", r1)
_view("view_row", R2, lambda r: rows(r.row((-1,))), "SELECT x0, v FROM px WHERE x1 = 10", r2)
_view("view_profile", R2, lambda r: rows(r.profile(1, (4,))), "SELECT x1 AS x0, v FROM px WHERE x0 = 4", r2)
_view("view_reverse", R2, lambda r: rows(r.reverse()), "SELECT 49 - x0 AS x0, 10 - x1 AS x1, v FROM px", r2)
_view("view_write_through", R2, lambda r: rows(r.where_apply(Grid((0, 0), (49, 10), (2, 3)), lambda v: v * 10)), "SELECT x0, x1, CASE WHEN x0 % 2 = 0 AND x1 % 3 = 0 THEN v * 10 ELSE v END AS v FROM px", r2)
_view("tile_totals", R1, lambda r: stats.reduce_tiles(r, (16, 100)).withColumn("sum", F.round("sum", 6)), "SELECT x0 // 16 AS t0, x1 // 100 AS t1, count(*) AS n, round(sum(v), 6) AS sum, min(v) AS min, max(v) AS max FROM px GROUP BY ALL", r1)
_view("section_totals", R2, lambda r: r.sections(3).groupBy("t").agg(F.sum("v").alias("sum")), "SELECT x1 // 3 AS t, sum(v)::BIGINT AS sum FROM px GROUP BY ALL", r2)
_view("profile_totals", R2, lambda r: r.profiles(0).select("x1", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"), F.get("values", F.lit(3)).alias("fourth")), "SELECT x1, sum(v)::BIGINT AS sum, max(v) FILTER (x0 = 3) AS fourth FROM px GROUP BY ALL", r2)
_view("chunk_stream_form", R2, lambda r: to_pixels(map_chunks(to_chunks(r, (16, 4)), lambda v: v * 2), 2), "SELECT x0, x1, (v * 2)::DOUBLE AS v FROM px", r2)
_view("chunk_totals", R2, lambda r: chunk_totals(to_chunks(r, (16, 4))).select(F.get("front", F.lit(0)).alias("f0"), F.get("front", F.lit(1)).alias("f1"), "n", "sum", "min", "max"), "SELECT x0 // 16 * 16 AS f0, x1 // 4 * 4 AS f1, count(*) AS n, sum(v)::DOUBLE AS sum, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max FROM px GROUP BY ALL", r2)


# -- pixel-wise


@query(f"WITH {R2} SELECT x0, x1, v + 3 * (x0 - x1) AS plus, v - (x0 + 1) AS minus, v * x1 AS times, v / (x0 + 1)::DOUBLE AS quotient, v // (x0 + 1) AS whole, (x1 - v) % 7 AS odd, -v AS negative FROM px")
def pixel_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, x1, v = F.col("x0"), F.col("x1"), F.col("v")
    return r2(spark, sf_dir).df.select(
        "x0", "x1", (v + 3 * (x0 - x1)).alias("plus"), (v - (x0 + 1)).alias("minus"), (v * x1).alias("times"), maths.divide(v, x0 + 1).alias("quotient"),
        maths.divide_whole(v, x0 + 1).alias("whole"), maths.remainder(x1 - v, 7).alias("odd"), (-v).alias("negative"),
    )


_MATHS = {
    "cos": "cos(x)", "sin": "sin(x)", "tan": "tan(x)", "acos": "acos(u)", "asin": "asin(u)", "atan": "atan(x)", "cosh": "(exp(u) + exp(-u)) / 2", "sinh": "(exp(u) - exp(-u)) / 2", "tanh": "tanh(x)",
    "asinh": "asinh(x)", "acosh": "acosh(1 + abs(x))", "atanh": "atanh(u / 2)", "exp": "exp(x)", "exp2": "pow(2.0, x)", "expm1": "exp(x) - 1", "log": "ln(abs(x))", "log2": "log2(abs(x))", "log10": "log10(abs(x))",
    "log1p": "ln(1 + abs(x))", "sqrt": "sqrt(abs(x))", "cbrt": "cbrt(x)", "abs": "abs(x)", "floor": "floor(x * 10)", "ceil": "ceil(x * 10)", "trunc": "trunc(x * 10)", "round": "round(x * 10)",
    "tgamma": "gamma(1 + abs(x))", "lgamma": "lgamma(1 + abs(x))",
}
_ARGS = {"acos": "u", "asin": "u", "cosh": "u", "sinh": "u", "acosh": "1 + abs(x)", "atanh": "u / 2", "log": "abs(x)", "log2": "abs(x)", "log10": "abs(x)", "log1p": "abs(x)", "sqrt": "abs(x)", "floor": "x * 10", "ceil": "x * 10", "trunc": "x * 10", "round": "x * 10", "tgamma": "1 + abs(x)", "lgamma": "1 + abs(x)"}


@query(f"WITH {R1}, q AS (SELECT x0, x1, v AS x, tanh(v) AS u FROM px) SELECT x0, x1, " + ", ".join(f"round({e}, 7) + 0.0 AS {k}" for k, e in _MATHS.items()) + " FROM q")
def math_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = r1(spark, sf_dir).df.select("x0", "x1", F.col("v").alias("x"), F.tanh("v").alias("u"))
    return df.select("x0", "x1", *((F.round(maths.UNARY[k](F.expr(_ARGS.get(k, "x"))), 7) + 0.0).alias(k) for k in _MATHS))


@query(f"WITH {R1}, q AS (SELECT x0, x1, v AS x, embedding[64 - x0]::DOUBLE AS y FROM px JOIN embeddings ON vec_id = x1) SELECT x0, x1, greatest(x, y) AS hi, least(x, y) AS lo, greatest(x - y, 0.0) AS diff, round(atan2(x, y), 9) AS angle, round(pow(abs(x), y), 9) AS power, round(sqrt(x * x + y * y), 9) AS long_side FROM q")
def math_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = r1(spark, sf_dir)
    b = Raster(a.df.select((63 - F.col("x0")).alias("x0"), "x1", "v"), a.shape)
    both = a.apply(lambda x, y: F.struct(x.alias("x"), y.alias("y")), b)
    x, y = F.col("v.x"), F.col("v.y")
    f = maths.BINARY
    return both.df.select("x0", "x1", f["max"](x, y).alias("hi"), f["min"](x, y).alias("lo"), f["fdim"](x, y).alias("diff"), F.round(f["atan2"](x, y), 9).alias("angle"), F.round(f["pow"](F.abs(x), y), 9).alias("power"), F.round(f["hypot"](x, y), 9).alias("long_side"))


@query(f"WITH {R2}, q AS (SELECT x0, x1, v::DOUBLE AS re, (x0 - x1)::DOUBLE AS im FROM px) SELECT x0, x1, re, im, round(sqrt(re * re + im * im), 6) AS modulus, round(atan2(im, re), 9) AS argument, re * re + im * im AS squared, re * re - im * im AS square_re, 2 * re * im AS square_im FROM q")
def complex_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = r2(spark, sf_dir).df.select("x0", "x1", maths.complex_of(F.col("v"), F.col("x0") - F.col("x1")).alias("z"))
    v = F.col("z")
    square = maths.complex_multiply(v, v)
    return z.select("x0", "x1", maths.real(v).alias("re"), maths.imag(v).alias("im"), F.round(maths.modulus(v), 6).alias("modulus"), F.round(maths.argument(v), 9).alias("argument"), maths.squared_modulus(v).alias("squared"), maths.real(square).alias("square_re"), maths.imag(square).alias("square_im"))


# -- statistics


@query(f"WITH {R2} SELECT count(*) AS n, min(v) AS min, max(v) AS max, sum(v)::DOUBLE AS sum, round(avg(v), 9) AS mean, round(var_samp(v), 6) AS variance, round(stddev_samp(v), 6) AS stdev FROM px")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.summary(r2(spark, sf_dir))
    return s.select("n", "min", "max", "sum", F.round("mean", 9).alias("mean"), F.round("variance", 6).alias("variance"), F.round("stdev", 6).alias("stdev"))


@query(f"WITH {R2} SELECT round(quantile_cont(v::DOUBLE, 0.1), 6) AS q10, round(quantile_cont(v::DOUBLE, 0.5), 6) AS q50, round(quantile_cont(v::DOUBLE, 0.97), 6) AS q97 FROM px")
def stats_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.quantile_row(r2(spark, sf_dir), {"q10": 0.1, "q50": 0.5, "q97": 0.97})
    return got.select(*(F.round(n, 6).alias(n) for n in ("q10", "q50", "q97")))


@query(f"WITH {R2}, m AS (SELECT median(v)::DOUBLE AS m FROM px) SELECT any_value(m) AS median, median(abs(v - m))::DOUBLE AS mad FROM px, m")
def stats_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mad(r2(spark, sf_dir))


EDGES = (-10.0, -0.5, 0.0, 60.0, 90.0, 99.5, 110.0, 130.0)


@query(f"WITH {R2}, e AS (SELECT unnest(range(7))::INTEGER AS bin, unnest({list(EDGES[:-1])})::DOUBLE AS low, unnest({list(EDGES[1:])})::DOUBLE AS high) SELECT bin, low, high, count(v) AS n FROM e LEFT JOIN px ON v >= low AND (v < high OR (bin = 6 AND v = high)) GROUP BY ALL")
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(r2(spark, sf_dir), EDGES)


@query(f"WITH {R2} SELECT sum(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS n0, sum(abs(v))::DOUBLE AS n1, sum(v * v)::DOUBLE AS n2, (SELECT sum(pow(a.v - b.v, 2)) FROM px a JOIN px b ON b.x0 = 49 - a.x0 AND b.x1 = 10 - a.x1)::DOUBLE AS d2 FROM px")
def stats_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = r2(spark, sf_dir)
    found = [*(stats.norm(a, p) for p in (0, 1, 2)), stats.distance(a, a.reverse(), 2)]
    return spark.createDataFrame([tuple(map(float, found))], "n0 double, n1 double, n2 double, d2 double")


# -- resampling

_AXIS = {
    LINEAR: "list_value(struct_pack(o := 0, w := 1 - {d}), struct_pack(o := 1, w := {d}))",
    CUBIC: "list_value(struct_pack(o := -1, w := (-{d} + 2 * {d} * {d} - {d} * {d} * {d}) / 2), struct_pack(o := 0, w := (2 - 5 * {d} * {d} + 3 * {d} * {d} * {d}) / 2), struct_pack(o := 1, w := ({d} + 4 * {d} * {d} - 3 * {d} * {d} * {d}) / 2), struct_pack(o := 2, w := ({d} * {d} * {d} - {d} * {d}) / 2))",
}


def _warp_sql(method: str, y0: str, y1: str) -> str:
    return f"""WITH {R2}, y AS (SELECT x0, x1, {y0} AS y0, {y1} AS y1 FROM px),
     d AS (SELECT x0, x1, floor(y0)::BIGINT AS f0, floor(y1)::BIGINT AS f1, y0 - floor(y0) AS d0, y1 - floor(y1) AS d1 FROM y),
     t AS (SELECT x0, x1, f0, d1, f1, unnest({_AXIS[method].format(d="d0")}) AS a FROM d), u AS (SELECT *, unnest({_AXIS[method].format(d="d1")}) AS b FROM t)
     SELECT u.x0, u.x1, round(sum(a.w * b.w * px.v), 6) AS v FROM u CROSS JOIN dim JOIN px ON px.x0 = least(greatest(f0 + a.o, 0), s0 - 1) AND px.x1 = least(greatest(f1 + b.o, 0), s1 - 1) GROUP BY ALL"""


@query(_warp_sql(LINEAR, "x0 - 1.25", "x1 + 0.5"))
def warp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(warp(r2(spark, sf_dir), Affinity.translation([1.25, -0.5]), LINEAR), F.round("v", 6))


@query(_warp_sql(CUBIC, "24.5 + (x0 - 24.5) / 1.25", "5.0 + (x1 - 5.0) / 1.25"))
def warp_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(warp(r2(spark, sf_dir), Affinity.scaling([1.25, 1.25], [24.5, 5.0]), CUBIC), F.round("v", 6))


@query(f"WITH {R3} SELECT a.x0, a.x1, b.v::DOUBLE AS v FROM px a CROSS JOIN dim JOIN px b ON b.x0 = least(greatest(trunc(11.5 + (a.x1 - 14.5) + 0.5)::BIGINT, 0), s0 - 1) AND b.x1 = least(greatest(trunc(14.5 - (a.x0 - 11.5) + 0.5)::BIGINT, 0), s1 - 1)")
def rotate90_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(rotate(r3(spark, sf_dir), 90, method=NEAREST))


@query(f"WITH {R2} SELECT q.a AS x0, r.b AS x1, v::DOUBLE AS v FROM range(0, 100) q(a), range(0, 22) r(b), px WHERE px.x0 = least(trunc(q.a / 2.0 + 0.5)::BIGINT, 49) AND px.x1 = least(trunc(r.b / 2.0 + 0.5)::BIGINT, 10)")
def upsample2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(upsample(r2(spark, sf_dir), 2))


@query(f"WITH {R2} SELECT q.a AS x0, px.x1, v::DOUBLE AS v FROM range(0, 25) q(a), px WHERE px.x0 = q.a * 2")
def downsample2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(downsample(r2(spark, sf_dir), 2, [0]))


# -- spectra


@query(f"WITH {R1}, k AS (SELECT unnest(range(33)) AS k) SELECT k.k AS x0, px.x1, round(sum(v * cos(2 * pi() * k.k * x0 / 64)), 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() * k.k * x0 / 64)), 6) + 0.0 AS im FROM px, k GROUP BY ALL")
def dft_axis0(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = real_dft(r1(spark, sf_dir), axes=[0])
    return got.df.select("x0", "x1", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


@query(f"WITH {R2} SELECT x0, x1, v::DOUBLE AS v FROM px")
def dft_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = r2(spark, sf_dir)
    return rows(inverse_real_dft(real_dft(raster), raster.shape), F.round("v", 6))


@query(f"WITH {R2}, s AS (SELECT a.x0, a.x1, sum(b.v * c.v)::DOUBLE AS v FROM px a CROSS JOIN dim CROSS JOIN (SELECT * FROM px WHERE x0 < 3 AND x1 < 2) b JOIN px c ON c.x0 = (a.x0 - b.x0 + s0) % s0 AND c.x1 = (a.x1 - b.x1 + s1) % s1 GROUP BY ALL) SELECT * FROM s")
def fourier_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = r2(spark, sf_dir)
    kernel = raster.apply(lambda v: F.when((F.col("x0") < 3) & (F.col("x1") < 2), v).otherwise(0))
    return rows(fourier_convolve(raster, kernel), F.round("v", 3))


# -- noise

_U = "(('0x' || substr(md5('{seed}:{stream}:' || (x0 + 50 * x1)), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"WITH {R2} SELECT x0, x1, round(v + 10.0 * {_U.format(seed=4, stream=0)}, 9) AS v FROM px")
def noise_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(noise.apply_noise(r2(spark, sf_dir), noise.UniformNoise(0, 10, seed=4)), F.round("v", 9))


@query(f"WITH {R2} SELECT x0, x1, round(v + 1.5 + 2.0 * sqrt(-2 * ln(1 - {_U.format(seed=5, stream=0)})) * cos(2 * pi() * {_U.format(seed=5, stream=1)}), 7) AS v FROM px")
def noise_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(noise.apply_noise(r2(spark, sf_dir), noise.GaussianNoise(1.5, 2.0, seed=5)), F.round("v", 7))


@query(f"WITH {R2} SELECT x0, x1, CASE WHEN {_U.format(seed=6, stream=0)} < 0.1 THEN 0 WHEN {_U.format(seed=6, stream=0)} < 0.1 + 0.2 THEN 255 ELSE v END AS v FROM px")
def noise_impulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(noise.apply_noise(r2(spark, sf_dir), noise.ImpulseNoise({0: 0.1, 255: 0.2}, seed=6)), F.col("v").cast("long"))


@query(f"""WITH {R2}, u AS (SELECT x0, x1, (v % 500)::DOUBLE AS m, {_U.format(seed=7, stream=0)} AS u FROM px),
 k AS (SELECT x0, x1, m, u, unnest(range(0, (m + 12 * sqrt(m) + 31)::BIGINT)) AS k FROM u),
 c AS (SELECT x0, x1, u, k, sum(exp(k * ln(m) - m - lgamma(k + 1.0))) OVER (PARTITION BY x0, x1 ORDER BY k) AS c FROM k)
 SELECT x0, x1, min(k)::DOUBLE AS v FROM c WHERE c > u GROUP BY x0, x1""")
def noise_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(noise.apply_noise(r2(spark, sf_dir).apply(lambda v: v % 500), noise.PoissonNoise(seed=7)))


# -- generation


@query("SELECT (i % 5)::BIGINT AS x0, (i // 5 % 6)::BIGINT AS x1, (i // 30)::BIGINT AS x2, 3 + 2 * i AS ramp, round(1.0 + 8.0 * i / 209, 9) AS line FROM range(0, 210) t(i)")
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ramp, rise = Raster.range(spark, (5, 6, 7), 3, 2), Raster.linspace(spark, (5, 6, 7), 1, 9)
    return ramp.df.withColumnRenamed("v", "ramp").join(rise.df.withColumnRenamed("v", "line"), ["x0", "x1", "x2"]).select("x0", "x1", "x2", "ramp", F.round("line", 9).alias("line"))
