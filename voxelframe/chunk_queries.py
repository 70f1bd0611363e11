"""Queries in chunk form, and over rasters with holes, each with SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import noise
from .operator_queries import _C, _HEX, _S, _add, _complex
from .operators import statistics as stats
from .operators.chunk_warp import resample_chunks, warp_chunks
from .operators.growing import grow
from .operators.resampling import CUBIC, LINEAR, NEAREST, Affinity, center_of, warp
from .operators.spectra import complex_dft, inverse_complex_dft, inverse_real_dft, real_dft
from .operators.stencil import Constant, Convolution, Dilation, Erosion, Extrapolation, Filter, Mean, Median, Nearest, Periodic, apply_filter
from .operators.summed_area import box_sums, summed_area
from .plans.raster import Raster
from .plans.regions import Box, Grid, Mask
from .plans.scratch import scratch_path
from .plans.spans import Spans
from .queries import B3, CONV, K9, NEAREST_SQL, PERIODIC_SQL, PLAIN_SQL, R1, R2, R3, W3, _stencil, _warp_sql, r1, r3, rows
from .sources.chunk_store import cut_chunks, morton, read_chunks, write_chunks
from .sources.fits import read_fits, read_fits_chunks, write_fits
from .streaming.chunks import combine_chunks, filter_chunks, to_chunks, to_pixels

#: Tiles small enough that every raster has several along each axis.
TILE = (16, 4)


def _seen(chunks: DataFrame, digits: int = 6) -> DataFrame:
    return to_pixels(chunks, 2).select("x0", "x1", F.round("v", digits).alias("v"))


# -- warps


def _warped(map_: Callable[[Raster], Affinity], method: str, region: Box | None = None) -> Callable[[Raster], DataFrame]:
    return lambda r: _seen(warp_chunks(to_chunks(r, TILE), map_(r), r.shape, TILE, method, region=region))


_add("chunk_warp_linear", _warped(lambda r: Affinity.translation([1.25, -0.5]), LINEAR), _warp_sql(LINEAR, "x0 - 1.25", "x1 + 0.5"))
_add("chunk_warp_cubic", _warped(lambda r: Affinity.scaling([1.25, 1.25], center_of(r)), CUBIC), _warp_sql(CUBIC, "24.5 + (x0 - 24.5) / 1.25", "5.0 + (x1 - 5.0) / 1.25"))
_add("chunk_warp_region", _warped(lambda r: Affinity.translation([1.25, -0.5]), LINEAR, Box((10, 2), (20, 6))), f"SELECT * FROM ({_warp_sql(LINEAR, 'x0 - 1.25', 'x1 + 0.5')}) WHERE x0 BETWEEN 10 AND 20 AND x1 BETWEEN 2 AND 6")
_add(
    "chunk_warp_turned",
    lambda r: _seen(warp_chunks(to_chunks(r, TILE), Affinity.rotation_radians(0.3, 2, center=center_of(r)), r.shape, TILE), 5),
    _warp_sql(LINEAR, f"24.5 + {_C!r}::DOUBLE * (x0 - 24.5) + {_S!r}::DOUBLE * (x1 - 5.0)", f"5.0 - {_S!r}::DOUBLE * (x0 - 24.5) + {_C!r}::DOUBLE * (x1 - 5.0)").replace(", 6) AS v", ", 5) AS v"),
)
_add("chunk_turn90_nearest", lambda r: _seen(warp_chunks(to_chunks(r, (7, 8)), Affinity.rotation(90, 2, center=center_of(r)), r.shape, (7, 8), NEAREST)), f"WITH {R3} SELECT a.x0, a.x1, b.v::DOUBLE AS v FROM px a CROSS JOIN dim JOIN px b ON b.x0 = least(greatest(trunc(11.5 + (a.x1 - 14.5) + 0.5)::BIGINT, 0), s0 - 1) AND b.x1 = least(greatest(trunc(14.5 - (a.x0 - 11.5) + 0.5)::BIGINT, 0), s1 - 1)", r3)
_add("chunk_upsample", lambda r: _seen(resample_chunks(to_chunks(r, TILE), (2, 2), r.shape, TILE)), f"WITH {R2} SELECT q.a AS x0, r.b AS x1, v::DOUBLE AS v FROM range(0, 100) q(a), range(0, 22) r(b), px WHERE px.x0 = least(trunc(q.a / 2.0 + 0.5)::BIGINT, 49) AND px.x1 = least(trunc(r.b / 2.0 + 0.5)::BIGINT, 10)")

# -- filters


def _filtered(f: Filter, how: Extrapolation) -> Callable[[Raster], DataFrame]:
    return lambda r: to_pixels(filter_chunks(to_chunks(r, (16, 50)), f, r.shape, (16, 50), how), 2)


_add("chunk_conv3", _filtered(Convolution(K9, B3), Nearest()), _stencil(R1, *W3, CONV), r1)
_add("chunk_conv3_periodic", _filtered(Convolution(K9, B3), Periodic()), _stencil(R1, *W3, CONV, PERIODIC_SQL), r1)
_add("chunk_median3_constant", _filtered(Median(B3), Constant(0.25)), _stencil(R1, *W3, "median(coalesce(b.v, 0.25))::DOUBLE", PLAIN_SQL, "LEFT JOIN"), r1)
_add(
    "chunk_dilation_of_large_numbers",
    lambda r: to_pixels(filter_chunks(to_chunks(r.apply(lambda v: v + 2**60), TILE, "bigint"), Dilation(B3), r.shape, TILE), 2),
    _stencil(R2, *W3, f"max(b.v) + {2**60}"),
)
_add("chunk_sum_of_large_numbers", lambda r: to_pixels(combine_chunks(*(to_chunks(r.apply(lambda v, k=k: v + k * 2**60), TILE, "bigint") for k in (1, 2)), lambda a, b: a + b), 2), f"WITH {R2} SELECT x0, x1, 2 * v + {3 * 2**60} AS v FROM px")

# -- rasters with holes: what lacks a pixel is NaN, shown as -1

_HOLE = "(7 * x0 + x1) % 13"
_R2H = f"{R2}, h AS (SELECT * FROM px WHERE {_HOLE} <> 0)"


def _holed(r: Raster) -> Raster:
    return Raster(r.df.where(f"{_HOLE} <> 0"), r.shape)


def _told(r: Raster) -> DataFrame:
    return rows(r, F.when(F.isnan("v"), -1.0).otherwise(F.round("v", 6)))


def _holed_warp_sql() -> str:
    value = "round(sum(a.w * b.w * px.v), 6)"
    sql = _warp_sql(LINEAR, "x0 - 1.25", "x1 + 0.5").replace(R2, _R2H).replace("JOIN px ON", "LEFT JOIN h px ON")
    return sql.replace(value, f"coalesce(CASE WHEN count(px.v) = count(*) THEN {value} END, -1.0)")


_HOLED_SUM = f"CASE WHEN count(*) FILTER (w.n <> 8 AND b.v IS NULL) > 0 THEN -1.0 ELSE {CONV} END"  # the last weight is 0
_add("holes_warp", lambda r: _told(warp(_holed(r), Affinity.translation([1.25, -0.5]), LINEAR)), _holed_warp_sql())
_add("holes_added", lambda r: _told(_holed(r).apply(lambda a, b: (a + b).cast("double"), Raster(r.df.where("x0 <> 3"), r.shape))), f"WITH {R2} SELECT x0, x1, CASE WHEN {_HOLE} = 0 OR x0 = 3 THEN -1.0 ELSE (2 * v)::DOUBLE END AS v FROM px WHERE {_HOLE} <> 0 OR x0 <> 3")
_add("holes_filtered", lambda r: _told(apply_filter(Convolution(K9, B3), _holed(r), Nearest())), _stencil(_R2H, *W3, _HOLED_SUM, NEAREST_SQL, "LEFT JOIN").replace("LEFT JOIN px b", "LEFT JOIN h b"))
_add(
    "holes_in_chunks",
    lambda r: _told(Raster(to_pixels(filter_chunks(to_chunks(r, TILE).where("front[0] <> 16 OR front[1] <> 4"), Convolution(K9, B3), r.shape, TILE, Nearest()), 2), r.shape)),
    _stencil(f"{R2}, h AS (SELECT * FROM px WHERE NOT (x0 BETWEEN 16 AND 31 AND x1 BETWEEN 4 AND 7))", *W3, _HOLED_SUM, NEAREST_SQL, "LEFT JOIN").replace("LEFT JOIN px b", "LEFT JOIN h b"),
)

# -- selection

_EXTREME = "CASE WHEN x0 = 0 THEN 'NaN'::DOUBLE WHEN x0 = 1 THEN -1e300 * v WHEN x0 = 2 THEN 1e-310 * v ELSE v * (x0 - 25) * 1e-3 END"


def _extreme(r: Raster) -> Raster:
    return r.apply(lambda v: F.when(F.col("x0") == 0, math.nan).when(F.col("x0") == 1, -1e300 * v).when(F.col("x0") == 2, 1e-310 * v).otherwise(v * (F.col("x0") - 25) * 1e-3))


_add(
    "nth_of_extremes",
    lambda r: r.df.sparkSession.createDataFrame([(k, math.isnan(v), 0.0 if math.isnan(v) else float(v)) for k in (0, 5, 11, 12, 270, 300, 538, 539, 549) for v in [stats.nth(_extreme(r), k)]], "k int, missing boolean, v double"),
    f"WITH {R2}, e AS (SELECT {_EXTREME} AS v FROM px), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM e) SELECT k::INTEGER AS k, isnan(v) AS missing, CASE WHEN isnan(v) THEN 0.0 ELSE v END AS v FROM o WHERE k IN (0, 5, 11, 12, 270, 300, 538, 539, 549)",
)

# -- large windows: their cost doesn't grow with the side

_WIDE = Box((-6, -3), (5, 4))
_add("dilation_12_by_8", lambda r: rows(apply_filter(Dilation(_WIDE), r, Nearest())), _stencil(R2, _WIDE.front, _WIDE.back, "max(b.v)::DOUBLE"))
_add("erosion_of_a_wide_ball", lambda r: rows(apply_filter(Erosion(Mask.ball(4, (0, 0))), r, Periodic())), _stencil(R3, (-4, -4), (4, 4), "min(b.v)::DOUBLE", PERIODIC_SQL, where="w.d0 * w.d0 + w.d1 * w.d1 <= 16"), r3)
_add("mean_12_by_8", lambda r: rows(apply_filter(Mean(_WIDE), r, Nearest()), F.round("v", 6)), _stencil(R2, _WIDE.front, _WIDE.back, "round(avg(b.v), 6)"))
_add("median_12_by_8", lambda r: rows(apply_filter(Median(_WIDE), r, Constant(0))), _stencil(R2, _WIDE.front, _WIDE.back, "median(coalesce(b.v, 0))::DOUBLE", PLAIN_SQL, "LEFT JOIN"))
_add("dilation_decimated", lambda r: rows(apply_filter(Dilation(_WIDE), r, Nearest(), Grid((1, 1), (22, 28), (3, 4)))), _stencil(R3, _WIDE.front, _WIDE.back, "max(b.v)::DOUBLE", where="(a.x0 - 1) % 3 = 0 AND (a.x1 - 1) % 4 = 0 AND a.x0 <= 22 AND a.x1 <= 28", out="(a.x0 - 1) // 3 AS x0, (a.x1 - 1) // 4 AS x1"), r3)

# -- sums of boxes, from a summed-area table


def _sums(r: Raster, kind: str = "bigint") -> DataFrame:
    return summed_area(to_chunks(r, TILE, kind), r.shape, TILE)


_add("summed_area_table", lambda r: to_pixels(_sums(r), 2), f"WITH {R2} SELECT a.x0, a.x1, sum(b.v)::BIGINT AS v FROM px a JOIN px b ON b.x0 <= a.x0 AND b.x1 <= a.x1 GROUP BY ALL")
_add(
    "sums_of_boxes",
    lambda r: box_sums(_sums(r), r.df.where("v % 3 = 0").selectExpr("x0", "x1", "x0 - 17 AS f0", "x0 + 4 AS b0", "x1 - 1 AS f1", "x1 + 5 AS b1"), r.shape, TILE, ["x0", "x1"]),
    f"WITH {R2} SELECT a.x0, a.x1, sum(b.v)::BIGINT AS sum FROM px a JOIN px b ON b.x0 BETWEEN a.x0 - 17 AND a.x0 + 4 AND b.x1 BETWEEN a.x1 - 1 AND a.x1 + 5 WHERE a.v % 3 = 0 GROUP BY ALL",
)

# -- growing

_add(
    "cosmic_grown",
    lambda r: rows(grow(r.apply(lambda v: v.cast("double")), r.apply(lambda v: (v % 16 == 0).cast("int")), -0.01, (16, 4))),
    f"""WITH RECURSIVE {R2}, o(d0, d1) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
    g AS (SELECT x0, x1, v FROM px WHERE v % 16 = 0 UNION
          SELECT p.x0, p.x1, p.v FROM g CROSS JOIN o JOIN px p ON p.x0 = g.x0 + d0 AND p.x1 = g.x1 + d1 WHERE p.x0 BETWEEN 1 AND 48 AND p.x1 BETWEEN 1 AND 9 AND g.v <> 0 AND (g.v - p.v)::DOUBLE / g.v < -0.01)
    SELECT px.x0, px.x1, CASE WHEN g.x0 IS NULL THEN 0 ELSE 1 END AS v FROM px LEFT JOIN g ON g.x0 = px.x0 AND g.x1 = px.x1""",
)

# -- long lines: cut in two axes, or turned into convolutions

_LINE1 = f"WITH {R1}, n AS (SELECT s1 AS n FROM dim), k AS (SELECT unnest(range(0, (SELECT n // 2 + 1 FROM n))) AS k)"
_ANGLE = "(2 * pi() * ((k.k * px.x1) % n.n) / n.n)"
_add(
    "dft_long_lines",
    lambda r: real_dft(r, axes=[1], line=16).df.select("x0", "x1", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im")),
    f"{_LINE1} SELECT px.x0, k.k AS x1, round(sum(v * cos({_ANGLE})), 6) + 0.0 AS re, round(-sum(v * sin({_ANGLE})), 6) + 0.0 AS im FROM px, k, n GROUP BY ALL",
    r1,
)
_add("dft_prime_lines", lambda r: rows(inverse_real_dft(real_dft(r, line=8), r.shape, line=8), F.round("v", 6)), f"WITH {R2} SELECT x0, x1, v::DOUBLE AS v FROM px")
_add("dft_complex_back", lambda r: inverse_complex_dft(complex_dft(_complex(r), line=9), line=9).df.select("x0", "x1", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im")), f"WITH {R2} SELECT x0, x1, v::DOUBLE AS re, (x0 - x1)::DOUBLE AS im FROM px")

# -- stores


def _kept_in_order(r: Raster) -> str:
    path = scratch_path(r.df.sparkSession, "chunks")
    write_chunks(to_chunks(r, (16, 25)), path, (16, 25), row_group=1 << 14)
    return path


_add("store_box", lambda r: to_pixels(cut_chunks(read_chunks(r.df.sparkSession, _kept_in_order(r)), Box((20, 30), (40, 60))), 2), f"WITH {R1} SELECT x0 - 20 AS x0, x1 - 30 AS x1, v FROM px WHERE x0 BETWEEN 20 AND 40 AND x1 BETWEEN 30 AND 60", r1)
_add("store_grid", lambda r: to_pixels(cut_chunks(read_chunks(r.df.sparkSession, _kept_in_order(r)), Grid((1, 2), (60, 90), (3, 5))), 2), f"WITH {R1} SELECT (x0 - 1) // 3 AS x0, (x1 - 2) // 5 AS x1, v FROM px WHERE x0 BETWEEN 1 AND 60 AND x1 BETWEEN 2 AND 90 AND (x0 - 1) % 3 = 0 AND (x1 - 2) % 5 = 0", r1)
_add("morton_keys", lambda r: r.df.select("x0", "x1", morton([F.col("x0"), F.col("x1")]).alias("key")), f"WITH {R2} SELECT x0, x1, list_sum([((x0 >> b) & 1) * (1::BIGINT << (2 * b)) + ((x1 >> b) & 1) * (1::BIGINT << (2 * b + 1)) FOR b IN range(0, 8)])::BIGINT AS key FROM px")

# -- masks as run lengths


def _runs(r: Raster, flag: str) -> Spans:
    return Spans.of_flags(r.apply(lambda v: F.expr(flag).cast("int")))


_THIRD, _BALL = "v % 3 = 0", "((x0 - 20) * (x0 - 20) + (x1 - 5) * (x1 - 5) <= 16)"


def _ball(r: Raster) -> Spans:
    return Spans.of_region(r.df.sparkSession, Mask.ball(4, (20, 5)))


_add("spans_selected", lambda r: _runs(r, _THIRD).select(r).select("x0", "x1", "v"), f"WITH {R2} SELECT x0, x1, v FROM px WHERE {_THIRD}")
_add("spans_union", lambda r: (_runs(r, _THIRD) | _ball(r)).select(r).select("x0", "x1", "v"), f"WITH {R2} SELECT x0, x1, v FROM px WHERE {_THIRD} OR {_BALL}")
_add("spans_difference", lambda r: (_runs(r, _THIRD) - _ball(r)).select(r).select("x0", "x1", "v"), f"WITH {R2} SELECT x0, x1, v FROM px WHERE {_THIRD} AND NOT {_BALL}")
_add("spans_moved_in_box", lambda r: (_ball(r).translate((3, -2)) & Box((20, 1), (26, 6))).positions(), f"WITH {R2} SELECT x0, x1 FROM px WHERE (x0 - 23) * (x0 - 23) + (x1 - 3) * (x1 - 3) <= 16 AND x0 BETWEEN 20 AND 26 AND x1 BETWEEN 1 AND 6")
_add("spans_written", lambda r: rows(_runs(r, _THIRD).apply(r, lambda v: v * 10)), f"WITH {R2} SELECT x0, x1, CASE WHEN {_THIRD} THEN v * 10 ELSE v END AS v FROM px")
_add("spans_lengths", lambda r: _runs(r, _THIRD).df.select("x1", "low", "high"), f"WITH {R2}, f AS (SELECT x0, x1, x0 - row_number() OVER (PARTITION BY x1 ORDER BY x0) AS g FROM px WHERE {_THIRD}) SELECT x1, min(x0) AS low, max(x0) AS high FROM f GROUP BY x1, g")

# -- regions that are told of rasters

_add(
    "bounding_box_of_mask",
    lambda r: r.df.sparkSession.createDataFrame([(*_runs(r, "v % 7 = 3").box().front, *_runs(r, "v % 7 = 3").box().back)], "f0 long, f1 long, b0 long, b1 long"),
    f"WITH {R2} SELECT min(x0) AS f0, min(x1) AS f1, max(x0) AS b0, max(x1) AS b1 FROM px WHERE v % 7 = 3",
)
_add("positions_clamped", lambda r: r.df.select("x0", "x1", *(c.alias(n) for c, n in zip(Box((10, 2), (30, 8)).clamp_columns([F.col("x0"), F.col("x1")]), ("y0", "y1"), strict=True))), f"WITH {R2} SELECT x0, x1, least(greatest(x0, 10), 30)::BIGINT AS y0, least(greatest(x1, 2), 8)::BIGINT AS y1 FROM px")
_add("affine_algebra", lambda r: _seen(warp_chunks(to_chunks(r, TILE), (((Affinity.identity(2, center_of(r)) * 2.0) / [1.6, 1.6]) + [1.0, 0.0]) - [1.0, 0.0], r.shape, TILE, CUBIC)), _warp_sql(CUBIC, "24.5 + (x0 - 24.5) / 1.25", "5.0 + (x1 - 5.0) / 1.25"))

# -- draws

_N = noise.TRIES
_LOG = "(CASE WHEN k > 15 THEN m * ((k - m) / m) - k * ln(1 + (k - m) / m) - 0.5 * ln(2 * pi() * k) - (1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)) ELSE k * ln(m) - m - lgamma(k + 1) END)"
_DRAW = "(('0x' || substr(md5('7:' || ({stream}) || ':' || i), 1, 13))::BIGINT / 4503599627370496.0)"
_add(
    "noise_poisson_rejection",
    lambda r: rows(noise.apply_noise(r, noise.RejectionPoissonNoise(seed=7))),
    f"""WITH {R2}, p AS (SELECT x0, x1, x0 + 50 * x1 AS i, v::DOUBLE AS m FROM px),
    t AS (SELECT *, unnest(range(0, {_N})) AS t, 0.931::DOUBLE + 2.53::DOUBLE * sqrt(m) AS b, -0.059::DOUBLE + 0.02483::DOUBLE * (0.931::DOUBLE + 2.53::DOUBLE * sqrt(m)) AS a FROM p WHERE m >= 10),
    d AS (SELECT *, {_DRAW.format(stream="2 * t")} - 0.5 AS u, {_DRAW.format(stream="2 * t + 1")} AS w FROM t),
    e AS (SELECT *, 0.5 - abs(u) AS room, floor((2 * a / (0.5 - abs(u)) + b) * u + m + 0.43::DOUBLE) AS k FROM d),
    f AS (SELECT *, (room >= 0.07 AND w <= 0.9277::DOUBLE - 3.6224::DOUBLE / (b - 2)) OR (k >= 0 AND NOT (room < 0.013 AND w > room) AND ln(w) + ln(1.1239::DOUBLE + 1.1328::DOUBLE / (b - 3.4::DOUBLE)) - ln(a / (room * room) + b) <= CASE WHEN k >= 0 THEN {_LOG} END) AS taken FROM e),
    s AS (SELECT x0, x1, m, {_DRAW.format(stream="0")} AS u, unnest(range(0, (m + 12 * sqrt(m) + 31)::BIGINT)) AS k FROM p WHERE m < 10),
    c AS (SELECT x0, x1, u, k, sum(exp(k * ln(m) - m - lgamma(k + 1.0))) OVER (PARTITION BY x0, x1 ORDER BY k) AS c FROM s)
    SELECT x0, x1, arg_min(k, t)::DOUBLE AS v FROM f WHERE taken GROUP BY x0, x1 UNION ALL SELECT x0, x1, min(k)::DOUBLE FROM c WHERE c > u GROUP BY x0, x1""",
)

# -- generated rasters beside those of tables

_add("range_added", lambda r: rows(r.apply(lambda v, w: v + w, Raster.range(r.df.sparkSession, r.shape, 3, 2))), f"WITH {R2} SELECT x0, x1, v + 3 + 2 * (x0 + 50 * x1) AS v FROM px")
_add("line_subtracted", lambda r: rows(r.apply(lambda v, w: v - w, Raster.linspace(r.df.sparkSession, r.shape, 1, 9)), F.round("v", 9)), f"WITH {R2} SELECT x0, x1, round(v - (1.0 + 8.0 * (x0 + 50 * x1) / 549), 9) AS v FROM px")
_add("fill_scaled", lambda r: rows(r.apply(lambda v, w: v * w, Raster.filled(r.df.sparkSession, r.shape, F.lit(7)))), f"WITH {R2} SELECT x0, x1, v * 7 AS v FROM px")
_add("random_added", lambda r: rows(r.apply(lambda v, w: v + w, noise.random_raster(r.df.sparkSession, r.shape, -1.0, 3.0, 8)), F.round("v", 9)), f"WITH {R2} SELECT x0, x1, round(v + (-1.0 + 4.0 * {_HEX.format(seed=8, i='(x0 + 50 * x1)')}), 9) AS v FROM px")


def _related(r: Raster) -> DataFrame:
    a, b = (_runs(r, f).box() for f in ("v % 7 = 3", "v % 7 = 3 AND x0 BETWEEN 5 AND 30 AND x1 < 9"))
    held = [b <= a, a <= b, b < a, a >= b, a > b, a == b, a != b, b.front in a, a.back in b, a[(1, 1)] in a]
    return r.df.sparkSession.createDataFrame([(k, bool(x)) for k, x in enumerate(held)], "k int, holds boolean")


_add(
    "box_relations_of_masks",
    _related,
    f"""WITH {R2}, m AS (SELECT * FROM px WHERE v % 7 = 3), a AS (SELECT min(x0) AS f0, min(x1) AS f1, max(x0) AS b0, max(x1) AS b1 FROM m), b AS (SELECT min(x0) AS g0, min(x1) AS g1, max(x0) AS c0, max(x1) AS c1 FROM m WHERE x0 BETWEEN 5 AND 30 AND x1 < 9),
    t AS (SELECT g0 >= f0 AND g1 >= f1 AND c0 <= b0 AND c1 <= b1 AS inside, f0 >= g0 AND f1 >= g1 AND b0 <= c0 AND b1 <= c1 AS around, g0 > f0 AND g1 > f1 AND c0 < b0 AND c1 < b1 AS within, (f0, f1, b0, b1) = (g0, g1, c0, c1) AS same, b0 BETWEEN g0 AND c0 AND b1 BETWEEN g1 AND c1 AS corner, f0 + 1 <= b0 AND f1 + 1 <= b1 AS next FROM a, b)
    SELECT unnest(range(0, 10))::INTEGER AS k, unnest([inside, around, within, inside, within, same, NOT same, inside, corner, next]) AS holds FROM t""",
)

# -- files


def _filed(r: Raster) -> str:
    path = scratch_path(r.df.sparkSession, "image") + ".fits"
    write_fits(r, path, kind="float64")
    return path


_add("fits_box", lambda r: rows(read_fits(r.df.sparkSession, _filed(r), region=Box((5, 20), (40, 90)), section=500)), f"WITH {R1} SELECT x0, x1, v FROM px WHERE x0 BETWEEN 5 AND 40 AND x1 BETWEEN 20 AND 90", r1)
_add("fits_chunks", lambda r: to_pixels(read_fits_chunks(r.df.sparkSession, _filed(r), section=500), 2), f"WITH {R1} SELECT x0, x1, v FROM px", r1)
