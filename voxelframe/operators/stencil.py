"""Filters: functions of a window around each pixel, run tile by tile with a halo.

Every pixel goes to its own tile and to the neighbours whose halo it lies in, so one shuffle of little more than the
raster feeds all windows of a tile, and NumPy slides them. ``gather`` is the plain alternative for a few positions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, FractionalType, IntegralType

from ..plans.errors import SizeError
from ..plans.raster import Raster
from ..plans.regions import Box, Grid, Mask, Position, Positions, axes

#: Pixels of a tile, about.
TILE = 1 << 16
#: Values whose medians are taken at once.
MEDIAN_HELD = 1 << 21


# -- values outside the domain


@dataclass(frozen=True)
class Constant:
    value: float = 0.0


@dataclass(frozen=True)
class Nearest:
    pass


@dataclass(frozen=True)
class Periodic:
    pass


Extrapolation = Constant | Nearest | Periodic


def rewrite(cols: Sequence[Column], domain: Box, how: Extrapolation) -> list[Column]:
    """Where to look for the value at any integer position; a constant is put in after the lookup."""
    if isinstance(how, Nearest):
        return domain.clamp_columns(cols)
    if isinstance(how, Periodic):
        return [F.pmod(c - f, F.lit(n)) + f for c, f, n in zip(cols, domain.front, domain.shape, strict=True)]
    return list(cols)


# -- filters


class Filter:
    """A window, and what to make of the values in it. ``a * b`` runs a first, then b; ``a + b`` adds their results."""

    window: Box | Mask
    #: Whether results for whole numbers are whole numbers, kept in 64 bits.
    whole = False

    @property
    def reach(self) -> Box:
        return self.window.box()

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        """Results for ``values`` (axes in raster order), which cover the output grown by ``reach``; every ``step``-th one."""
        raise NotImplementedError

    def column(self, values: Column) -> Column:
        """The result for an array column of the window's values, axis 0 fastest; by default ``slide`` on one window at a time."""
        shape, one = self.reach.shape, (1,) * self.reach.dimension

        @pandas_udf(DoubleType())
        def run(windows: pd.Series) -> pd.Series:
            got = [float(self.slide(np.asarray(w, float).reshape(shape, order="F"), one).reshape(-1)[0]) for w in windows]
            return pd.Series(got, dtype="float64")

        return _with_nan(run(values), values)

    def taps(self, values: np.ndarray, step: Position) -> list[np.ndarray]:
        """For each position of the window the values seen there, one per output."""
        reach = self.reach
        sizes = [(n - r) // s + 1 for n, r, s in zip(values.shape, reach.shape, step, strict=True)]
        at = lambda w: tuple(slice(x - f, x - f + (n - 1) * s + 1, s) for x, f, n, s in zip(w, reach.front, sizes, step, strict=True))
        return [values[at(w)] for w in self.window]

    def __mul__(self, other: Filter) -> Filter:
        return Sequential([*_stages(self), *_stages(other)])

    def __add__(self, other: Filter) -> Filter:
        return Aggregate(lambda *parts: reduce(np.add, parts), [self, other])


def _with_nan(made: Column, values: Column) -> Column:
    # NaN comes back from pandas as null.
    return F.when(values.isNotNull(), F.coalesce(made, F.lit(math.nan)))


def _stages(f: Filter) -> list[Filter]:
    return f.stages if isinstance(f, Sequential) else [f]


def running_extreme(values: np.ndarray, width: int, axis: int, op: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours along an axis, at a cost that doesn't grow with ``width``.

    The axis is cut into blocks of ``width``; a window is the end of one block and the start of the next, so it is the
    extreme of a running one from the right and one from the left (van Herk, Gil and Werman).
    """
    if width == 1:
        return values
    lines = np.moveaxis(values, axis, -1)
    n = lines.shape[-1]
    padded = np.concatenate([lines, np.repeat(lines[..., -1:], -n % width, axis=-1)], axis=-1)
    blocks = padded.reshape(*padded.shape[:-1], -1, width)
    left = op.accumulate(blocks, axis=-1).reshape(padded.shape)
    right = op.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(op(right[..., : n - width + 1], left[..., width - 1 : n]), -1, axis)


def running_sum(values: np.ndarray, width: int, axis: int) -> np.ndarray:
    """Sum of each ``width`` neighbours along an axis, by sums of doubled widths: nothing is taken off again, so no digits are lost and NaN stays where it is."""
    lines = np.moveaxis(values, axis, -1)
    n, out, done, power, sums = lines.shape[-1] - width + 1, None, 0, 1, lines
    while True:
        if width & power:
            part = sums[..., done : done + n]
            out, done = part if out is None else out + part, done + power
        if done == width:
            return np.moveaxis(out, -1, axis)
        sums = sums[..., :-power] + sums[..., power:]
        power *= 2


def _stepped(values: np.ndarray, step: Position) -> np.ndarray:
    return values[tuple(slice(None, None, s) for s in step)]


def extreme(values: np.ndarray, window: Box | Mask, step: Position, op: np.ufunc) -> np.ndarray:
    """The extreme over a window: axis by axis for a box; for a mask over its lines along axis 0, one running extreme for each length of line."""
    if isinstance(window, Box):
        for axis, width in enumerate(window.shape):
            values = running_extreme(values, width, axis, op)
        return _stepped(values, step)
    front, sizes = window.box().front, tuple(n - w + 1 for n, w in zip(values.shape, window.box().shape, strict=True))
    by_width: dict[int, list[Position]] = {}
    line: list[Position] = []
    for p in [*window, None]:
        if line and (p is None or p[1:] != line[-1][1:] or p[0] != line[-1][0] + 1):
            by_width.setdefault(len(line), []).append(line[0])
            line = []
        if p is not None:
            line.append(p)
    out = None
    for width, starts in by_width.items():
        runs = running_extreme(values, width, 0, op)
        for p in starts:
            part = runs[tuple(slice(x - f, x - f + n) for x, f, n in zip(p, front, sizes, strict=True))]
            out = part if out is None else op(out, part)
    return _stepped(out, step)


@dataclass
class Correlation(Filter):
    """Sum of kernel values times window values."""

    values: Sequence[float]
    window: Box | Mask

    def __post_init__(self) -> None:
        if len(self.values) != self.window.size:
            raise SizeError(len(self.values), self.window.size)

    @property
    def weights(self) -> list[float]:
        return [float(k) for k in self.values]

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        taps = self.taps(values, step)
        out = np.zeros(taps[0].shape)
        for k, tap in zip(self.weights, taps, strict=True):
            if k:
                out += k * tap
        return out

    def column(self, values: Column) -> Column:
        pairs = F.zip_with(values, F.array(*map(F.lit, self.weights)), lambda v, k: v * k)
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


@dataclass
class Convolution(Correlation):
    """A correlation with the values in reverse order over the same window."""

    @property
    def weights(self) -> list[float]:
        return [float(k) for k in reversed(self.values)]


@dataclass
class Mean(Filter):
    window: Box | Mask

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        if isinstance(self.window, Box):
            sums = values.astype(float)
            for axis, width in enumerate(self.window.shape):
                sums = running_sum(sums, width, axis)
            return _stepped(sums, step) / self.window.size
        taps = self.taps(values, step)
        return reduce(np.add, taps) / len(taps)

    def column(self, values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


@dataclass
class Median(Filter):
    """The middle value, or the mean of the two middle ones."""

    window: Box | Mask

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        # The windows of some lines at a time, so that no more than a few tiles are held.
        taps = self.taps(values, step)
        lines = max(1, MEDIAN_HELD // max(1, len(taps) * math.prod(taps[0].shape[1:])))
        return np.concatenate([np.median(np.stack([t[k : k + lines] for t in taps], axis=-1), axis=-1, overwrite_input=True) for k in range(0, len(taps[0]), lines)])

    def column(self, values: Column) -> Column:
        n, s = self.window.size, F.array_sort(values)
        return (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2.0


@dataclass
class Erosion(Filter):
    """The least value; whole numbers stay whole, so 64-bit ones lose no digits."""

    window: Box | Mask
    whole = True

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        return extreme(values, self.window, step, np.minimum)

    def column(self, values: Column) -> Column:
        return F.array_min(values)


@dataclass
class Dilation(Filter):
    window: Box | Mask
    whole = True

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        return extreme(values, self.window, step, np.maximum)

    def column(self, values: Column) -> Column:
        return F.array_max(values)


@dataclass
class BinaryErosion(Filter):
    """1 where every value is other than 0."""

    window: Box | Mask

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        return extreme(values != 0, self.window, step, np.logical_and).astype(float)

    def column(self, values: Column) -> Column:
        return F.forall(values, lambda v: v != 0).cast("double")


@dataclass
class BinaryDilation(Filter):
    window: Box | Mask

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        return extreme(values != 0, self.window, step, np.logical_or).astype(float)

    def column(self, values: Column) -> Column:
        return F.exists(values, lambda v: v != 0).cast("double")


@dataclass
class Custom(Filter):
    """Any function of an array whose first axis runs over the window."""

    window: Box | Mask
    function: Callable[[np.ndarray], np.ndarray]

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        return self.function(np.stack(self.taps(values, step)))

    def column(self, values: Column) -> Column:
        @pandas_udf(DoubleType())
        def run(windows: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(self.function(np.stack(windows.to_list(), axis=-1).astype(float)), float), dtype="float64")

        return _with_nan(run(values), values)


def _template(values: Sequence[float], window: Box | Mask) -> np.ndarray:
    if len(values) != window.size:
        raise SizeError(len(values), window.size)
    return np.asarray(values, float)


def pearson(template: Sequence[float], window: Box | Mask) -> Custom:
    """Correlation coefficient of the window's values with a template."""
    t = _template(template, window)
    t = t - t.mean()

    def run(n: np.ndarray) -> np.ndarray:
        d = n - n.mean(axis=0)
        with np.errstate(all="ignore"):
            return np.tensordot(t, d, 1) / np.sqrt((t @ t) * (d * d).sum(axis=0))

    return Custom(window, run)


def quotient(template: Sequence[float], window: Box | Mask) -> Custom:
    """min(n / t) * sqrt(count / sum((n / t) ** 2)): 1 where the values are a multiple of the template."""
    t = _template(template, window)

    def run(n: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            q = n / t.reshape(-1, *[1] * (n.ndim - 1))
            return q.min(axis=0) * np.sqrt(len(t) / (q * q).sum(axis=0))

    return Custom(window, run)


@dataclass
class Sequential(Filter):
    """Filters one after the other; the input is extended once, by the sum of the windows."""

    stages: list[Filter]
    window: Box = field(init=False)

    def __post_init__(self) -> None:
        self.window = reduce(Box.grow, (f.reach for f in self.stages))

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        for f in self.stages[:-1]:
            values = f.slide(values, (1,) * values.ndim)
        return self.stages[-1].slide(values, step)


@dataclass
class Aggregate(Filter):
    """Several filters of one input, combined pixel by pixel."""

    combine: Callable[..., np.ndarray]
    parts: list[Filter]
    window: Box = field(init=False)

    def __post_init__(self) -> None:
        self.window = reduce(Box.__or__, (f.reach for f in self.parts))

    def slide(self, values: np.ndarray, step: Position) -> np.ndarray:
        def cut(f: Filter) -> np.ndarray:
            ends = zip(f.reach.front, self.window.front, f.reach.back, self.window.back, values.shape, strict=True)
            return values[tuple(slice(a - b, n - (d - c)) for a, b, c, d, n in ends)]

        return self.combine(*(f.slide(cut(f), step) for f in self.parts))


def filter_norm(p: int, *parts: Filter) -> Aggregate:
    """Sum of |result| ** p over the filters, not rooted."""
    return Aggregate(lambda *got: reduce(np.add, (((g != 0).astype(float) if p == 0 else np.abs(g) ** p) for g in got)), list(parts))


# -- makers


def centred(shape: Sequence[int]) -> Box:
    """The window of a kernel given by shape: its origin is element (n - 1) // 2."""
    return Box.from_shape(shape, [-((n - 1) // 2) for n in shape])


def along(kind: type[Correlation], values: Sequence[float], axis: int, dimension: int) -> Correlation:
    """A 1-D kernel along one axis; its window runs from -(n // 2) to n - n // 2 - 1."""
    n = len(values)
    front = tuple(-(n // 2) if k == axis else 0 for k in range(dimension))
    return kind(values, Box(front, tuple(n - n // 2 - 1 if k == axis else 0 for k in range(dimension))))


def along_axes(kind: type[Correlation], values: Sequence[float], chosen: Sequence[int], dimension: int) -> Filter:
    """The same 1-D kernel along several axes in turn."""
    return reduce(Filter.__mul__, [along(kind, values, k, dimension) for k in chosen])


def gradient(smooth: Sequence[float], axis: int, across: Sequence[int], dimension: int, sign: float = 1) -> Filter:
    """Differences along ``axis`` (kernel sign, 0, -sign), smoothed along the axes ``across``."""
    first = along(Convolution, [sign, 0, -sign], axis, dimension)
    return reduce(Filter.__mul__, [along(Convolution, smooth, k, dimension) for k in across], first)


def prewitt(axis: int, across: Sequence[int], dimension: int, sign: float = 1) -> Filter:
    return gradient([1, 1, 1], axis, across, dimension, sign)


def sobel(axis: int, across: Sequence[int], dimension: int, sign: float = 1) -> Filter:
    return gradient([1, 2, 1], axis, across, dimension, sign)


def scharr(axis: int, across: Sequence[int], dimension: int, sign: float = 1) -> Filter:
    return gradient([3, 10, 3], axis, across, dimension, sign)


def laplace(chosen: Sequence[int], dimension: int, sign: float = 1) -> Filter:
    """The sum of second differences (sign, -2 sign, sign) along any number of axes."""
    parts = [along(Convolution, [sign, -2 * sign, sign], k, dimension) for k in chosen]
    return parts[0] if len(parts) == 1 else Aggregate(lambda *got: reduce(np.add, got), parts)


def impulse_response(f: Filter) -> np.ndarray:
    """The filter's result around a single 1 in zeros, axes in raster order."""
    window = f.reach
    # The output runs over the mirrored window; the 1 stands at its origin.
    values = np.zeros(tuple(2 * n - 1 for n in window.shape))
    values[tuple(n - 1 for n in window.shape)] = 1.0
    return f.slide(values, (1,) * window.dimension)


# -- application


def _tile_shape(shape: Sequence[int]) -> Position:
    """Sides of about equal length with TILE pixels together, longer where another axis is short."""
    out, left = [0] * len(shape), TILE
    for done, k in enumerate(sorted(range(len(shape)), key=lambda k: shape[k])):
        side = max(1, int(round(left ** (1 / (len(shape) - done)))))
        out[k] = max(1, min(shape[k], side))
        left = max(1, left // out[k])
    return tuple(out)


def apply_filter(f: Filter, raster: Raster, how: Extrapolation | None = None, region: Grid | None = None, tile: Sequence[int] | None = None) -> Raster:
    """Filter a raster.

    Without ``how`` only pixels whose whole window lies in the domain are computed, and coordinates of the (smaller)
    result start at 0. With it the result has the raster's domain. ``region``, a box or grid of pixels to compute, gives
    a result of its shape, starting at 0; a grid's pixels alone are evaluated. A missing pixel is NaN; a filter that
    keeps whole numbers whole, which have none, raises an error for it.
    """
    domain, n = raster.domain, raster.dimension
    out = region if region is not None else domain if how is not None else domain.shrink(f.reach)
    if out.size == 0 or not out.box() <= (domain if how is not None else domain.shrink(f.reach)):
        raise SizeError(out, domain if how is not None else domain.shrink(f.reach))
    # Values taken over from the border must be at hand even if the window doesn't hold its own centre.
    reach = f.reach | Box((0,) * n, (0,) * n)
    tile = tuple(tile) if tile else _tile_shape(out.shape)
    counts = [-(-s // t) for s, t in zip(out.shape, tile, strict=True)]
    whole = f.whole and isinstance(raster.df.schema["v"].dataType, IntegralType) and (not isinstance(how, Constant) or float(how.value).is_integer())
    number = "long" if whole else "double"
    df = raster.df.select(*raster.axes, F.col("v").cast(number).alias("v"))
    if isinstance(how, Periodic):
        for a, size, lo, hi in zip(raster.axes, raster.shape, reach.front, reach.back, strict=True):
            turns = -(-(hi - lo) // size)
            shifts = [size * m for m in range(-turns, turns + 1)]
            df = df.withColumn("_m", F.explode(F.array(*map(F.lit, shifts)))).withColumn(a, F.col(a) + F.col("_m")).drop("_m")
    for k, (a, t) in enumerate(zip(raster.axes, tile, strict=True)):
        first, last, s = out.front[k], counts[k] - 1, out.step[k]
        span = s * t
        y = F.col(a)
        df = df.where(y.between(first + reach.front[k], out.back[k] + reach.back[k]))
        least = F.greatest(F.ceil((y - first - s * (t - 1) - reach.back[k]) / span), F.lit(0))
        most = F.least(F.floor((y - first - reach.front[k]) / span), F.lit(last))
        df = df.withColumn("_lo", least).withColumn("_hi", most).where("_lo <= _hi").withColumn(f"t{k}", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    names, keys = axes(n), [f"t{k}" for k in range(n)]
    rebased = region is not None or how is None
    fill = how.value if isinstance(how, Constant) else 0 if whole else math.nan
    kind = np.int64 if whole else np.float64

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        lows = [a * t for a, t in zip(at, tile, strict=True)]
        sizes = [min(t, s - lo) for t, s, lo in zip(tile, out.shape, lows, strict=True)]
        front = [o + s * lo for o, s, lo in zip(out.front, out.step, lows, strict=True)]
        back = [x + s * (m - 1) for x, s, m in zip(front, out.step, sizes, strict=True)]
        halo = Box(tuple(front), tuple(back)).grow(reach)
        held = halo if isinstance(how, Periodic) else halo & domain
        if whole and rows.num_rows != held.size:
            raise SizeError(rows.num_rows, held.size)
        # What the domain should have but lacks is NaN, never taken for border.
        values = np.zeros(held.shape, kind) if whole else np.full(held.shape, math.nan)
        values[tuple(rows[a].to_numpy() - o for a, o in zip(names, held.front, strict=True))] = rows["v"].to_numpy()
        pads = [(a - b, c - d) for a, b, c, d in zip(held.front, halo.front, halo.back, held.back, strict=True)]
        if any(map(any, pads)):
            values = np.pad(values, pads, "edge") if isinstance(how, Nearest) else np.pad(values, pads, constant_values=fill)
        trim = tuple(slice(a - b, m - (d - c)) for a, b, c, d, m in zip(f.reach.front, reach.front, f.reach.back, reach.back, halo.shape, strict=True))
        got = f.slide(values[trim], out.step)
        grid = np.indices(got.shape).reshape(n, -1)
        base = lows if rebased else front
        scale = [1] * n if rebased else out.step
        return pa.table([*(pa.array(g * s + b, pa.int64()) for g, s, b in zip(grid, scale, base, strict=True)), pa.array(got.reshape(-1).astype(kind))], [*names, "v"])

    made = df.groupBy(*keys).applyInArrow(run, ", ".join(f"{a} long" for a in names) + f", v {number}")
    return Raster(made, out.shape, () if rebased else raster.front)


def apply_complex(values: Sequence[complex], window: Box | Mask, raster: Raster, how: Extrapolation | None = None, kind: type[Correlation] = Correlation) -> Raster:
    """A correlation (with the conjugates of ``values``) or convolution (with ``values``) of a complex raster, structs of re and im.

    Four real filters; their results meet by position.
    """
    sign = -1 if kind is Correlation else 1
    parts = {p: replace(raster, df=raster.df.select(*raster.axes, F.col(f"v.{p}").alias("v"))) for p in ("re", "im")}
    run = lambda p, of: apply_filter(kind([of(complex(k)) for k in values], window), parts[p], how)
    real, imag = lambda k: k.real, lambda k: sign * k.imag
    re = run("re", real).apply(lambda a, b: a - b, run("im", imag))
    im = run("im", real).apply(lambda a, b: a + b, run("re", imag))
    return re.apply(lambda a, b: F.struct(a.alias("re"), b.alias("im")), im)


def gather(f: Filter, raster: Raster, at: DataFrame, how: Extrapolation = Nearest()) -> DataFrame:
    """``at`` (x0, … and any other columns) with the filter's result ``v`` at each row, by joins alone.

    For a few positions, or a sequence of them with repeats; ``at`` needs no particular order.
    """
    names = raster.axes
    marked = at.withColumn("_id", F.monotonically_increasing_id())
    window = list(f.window)
    taps = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(d).alias(f"d{j}") for j, d in enumerate(w))) for k, w in enumerate(window)))
    seen = marked.select("_id", *names, F.explode(taps).alias("_t"))
    moved = rewrite([F.col(a) + F.col(f"_t.d{j}") for j, a in enumerate(names)], raster.domain, how)
    asked = seen.select("_id", F.col("_t.k").alias("_k"), *(c.alias(a) for c, a in zip(moved, names, strict=True)))
    found = asked.join(raster.df.select(*names, F.col("v").cast("double").alias("_v"), F.lit(True).alias("_hit")), names, "left")
    missing = F.lit(math.nan)
    if isinstance(how, Constant):
        missing = F.when(raster.domain.predicate(), missing).otherwise(F.lit(float(how.value)))
    value = F.when(F.col("_hit"), F.col("_v")).otherwise(missing)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_k", value.alias("_v")))), lambda s: s["_v"])
    return marked.join(found.groupBy("_id").agg(ordered.alias("_n")), "_id").withColumn("v", f.column(F.col("_n"))).drop("_id", "_n")


def at_positions(f: Filter, raster: Raster, positions: Positions, how: Extrapolation = Nearest()) -> DataFrame:
    """(ord, x0, …, v) for a sequence of positions."""
    return gather(f, raster, positions.df, how)


@dataclass(frozen=True)
class Extrapolated:
    """A raster continued beyond its domain; ``parent`` is the raster itself."""

    parent: Raster
    how: Extrapolation = Nearest()

    def __getitem__(self, at: Position) -> object:
        """The value at any position."""
        p = Box(tuple(at), tuple(at))
        return pad(self.parent, p, self.how).df.first()["v"]

    def copy(self, box: Box) -> Raster:
        return pad(self.parent, box, self.how)

    def filtered(self, f: Filter) -> Raster:
        return apply_filter(f, self.parent, self.how)


def dont_extrapolate(values: Extrapolated | Raster) -> Raster:
    """The raster without its continuation."""
    return values.parent if isinstance(values, Extrapolated) else values


def pad(raster: Raster, box: Box, how: Extrapolation = Nearest()) -> Raster:
    """A copy of any box, beyond the domain too, coordinates starting at 0. A missing pixel is NaN, or an error where values have none."""
    spark = raster.df.sparkSession
    wanted = box.positions(spark)
    moved = rewrite([F.col(a) for a in raster.axes], raster.domain, how)
    asked = wanted.select(*(F.col(a).alias(f"_{a}") for a in raster.axes), *(c.alias(a) for c, a in zip(moved, raster.axes, strict=True)))
    found = asked.join(raster.df.withColumn("_hit", F.lit(True)), raster.axes, "left")
    real = isinstance(raster.df.schema["v"].dataType, FractionalType)
    missing = F.lit(math.nan) if real else F.raise_error(F.lit("size: the raster lacks a position, and its values have no NaN"))
    outside = F.lit(how.value) if isinstance(how, Constant) else missing
    value = F.when(F.col("_hit"), F.col("v")).when(raster.domain.predicate(), missing).otherwise(outside)
    return Raster(found.select(*((F.col(f"_{a}") - f).alias(a) for a, f in zip(raster.axes, box.front, strict=True)), value.alias("v")), box.shape)

