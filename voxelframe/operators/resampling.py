"""Values at real positions, affine warps, up- and downsampling: coordinates are rewritten, then looked up by joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import SizeError
from ..plans.raster import Raster
from ..plans.regions import Box, Grid, axes
from .stencil import Constant, Extrapolation, Nearest, rewrite

NEAREST, LINEAR, CUBIC = "nearest", "linear", "cubic"


def _weights(method: str, d: Column) -> list[tuple[int, Column]]:
    """(offset from the floor, weight) along one axis for the fraction ``d``."""
    if method == LINEAR:
        return [(0, 1 - d), (1, d)]
    d2, d3 = d * d, d * d * d
    return [(-1, (-d + 2 * d2 - d3) / 2), (0, (2 - 5 * d2 + 3 * d3) / 2), (1, (d + 4 * d2 - 3 * d3) / 2), (2, (d3 - d2) / 2)]


def interpolate(raster: Raster, at: DataFrame, coords: Sequence[str], method: str = LINEAR, how: Extrapolation = Nearest(), key: Sequence[str] = ()) -> DataFrame:
    """The columns ``key`` of ``at`` (which must tell its rows apart) with the value ``v`` at the real coordinates ``coords``.

    Nearest takes x + 1/2 truncated toward zero. Linear weighs 2, cubic (Catmull and Rom) 4 neighbours an axis; every
    neighbour outside the domain is found by ``how``, so nothing is read past an edge.
    """
    n = raster.dimension
    names = raster.axes
    if method == NEAREST:
        whole = [(F.col(c) + 0.5).cast("long") for c in coords]
        asked = at.select(*key, *(c.alias(f"_{a}") for c, a in zip(whole, names, strict=True)))
        moved = rewrite([F.col(f"_{a}") for a in names], raster.domain, how)
        asked = asked.select(*key, *(c.alias(a) for c, a in zip(moved, names, strict=True)))
        return _lookup(asked, raster, how).select(*key, F.col("_v").alias("v"))
    floors = at.select(*key, *(F.floor(c).alias(f"_f{k}") for k, c in enumerate(coords)), *((F.col(c) - F.floor(c)).alias(f"_d{k}") for k, c in enumerate(coords)))
    lanes = [_weights(method, F.col(f"_d{k}")) for k in range(n)]
    taps = []
    for chosen in product(*lanes):
        weight = chosen[0][1]
        for _, w in chosen[1:]:
            weight = weight * w
        taps.append(F.struct(*(F.lit(o).cast("long").alias(f"o{k}") for k, (o, _) in enumerate(chosen)), weight.alias("w")))
    spread = floors.withColumn("_t", F.explode(F.array(*taps)))
    moved = rewrite([F.col(f"_f{k}") + F.col(f"_t.o{k}") for k in range(n)], raster.domain, how)
    asked = spread.select(*key, *(c.alias(a) for c, a in zip(moved, names, strict=True)), F.col("_t.w").alias("_w"))
    return _lookup(asked, raster, how).groupBy(*key).agg(F.sum(F.col("_w") * F.col("_v")).alias("v"))


def _lookup(asked: DataFrame, raster: Raster, how: Extrapolation) -> DataFrame:
    """``asked`` with ``_v`` at its coordinates. What the domain should have but lacks is NaN, so null values stay null."""
    values = raster.df.select(*raster.axes, F.col("v").cast("double").alias("_value"), F.lit(True).alias("_hit"))
    found = asked.join(values, raster.axes, "left")
    missing = F.lit(float("nan"))
    if isinstance(how, Constant):
        missing = F.when(raster.domain.predicate(), missing).otherwise(F.lit(float(how.value)))
    return found.withColumn("_v", F.when(F.col("_hit"), F.col("_value")).otherwise(missing))


@dataclass(frozen=True)
class Affinity:
    """y = shift + center + matrix (x - center); operators put a further map behind."""

    matrix: np.ndarray
    shift: np.ndarray
    center: np.ndarray

    @classmethod
    def identity(cls, dimension: int, center: Sequence[float] | None = None) -> Affinity:
        return cls(np.eye(dimension), np.zeros(dimension), np.asarray(center if center is not None else np.zeros(dimension), float))

    @classmethod
    def translation(cls, by: Sequence[float]) -> Affinity:
        return cls.identity(len(by)) + by

    @classmethod
    def scaling(cls, factors: Sequence[float], center: Sequence[float] | None = None) -> Affinity:
        return cls.identity(len(factors), center) * factors

    @classmethod
    def rotation(cls, degrees: float, dimension: int, from_axis: int = 0, to_axis: int = 1, center: Sequence[float] | None = None) -> Affinity:
        return cls.identity(dimension, center).rotate(degrees, from_axis, to_axis)

    def __add__(self, by: Sequence[float] | float) -> Affinity:
        return replace(self, shift=self.shift + np.broadcast_to(np.asarray(by, float), self.shift.shape))

    def __sub__(self, by: Sequence[float] | float) -> Affinity:
        return self + -np.broadcast_to(np.asarray(by, float), self.shift.shape)

    def _then(self, m: np.ndarray) -> Affinity:
        return replace(self, matrix=m @ self.matrix, shift=m @ self.shift)

    def __mul__(self, by: Sequence[float] | float) -> Affinity:
        return self._then(np.diag(np.broadcast_to(np.asarray(by, float), self.shift.shape)))

    def __truediv__(self, by: Sequence[float] | float) -> Affinity:
        return self * (1.0 / np.broadcast_to(np.asarray(by, float), self.shift.shape))

    def rotate(self, degrees: float, from_axis: int = 0, to_axis: int = 1) -> Affinity:
        """Turn from one axis towards another; whole quarter turns are exact."""
        quarter = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}
        c, s = quarter.get(degrees % 360, (math.cos(math.radians(degrees)), math.sin(math.radians(degrees))))
        m = np.eye(len(self.shift))
        m[from_axis, from_axis] = m[to_axis, to_axis] = c
        m[to_axis, from_axis], m[from_axis, to_axis] = s, -s
        return self._then(m)

    @classmethod
    def rotation_radians(cls, angle: float, dimension: int, from_axis: int = 0, to_axis: int = 1, center: Sequence[float] | None = None) -> Affinity:
        return cls.identity(dimension, center).rotate_radians(angle, from_axis, to_axis)

    def rotate_radians(self, angle: float, from_axis: int = 0, to_axis: int = 1) -> Affinity:
        m = np.eye(len(self.shift))
        m[from_axis, from_axis] = m[to_axis, to_axis] = math.cos(angle)
        m[to_axis, from_axis], m[from_axis, to_axis] = math.sin(angle), -math.sin(angle)
        return self._then(m)

    def inverse(self) -> Affinity:
        m = np.linalg.inv(self.matrix)
        return replace(self, matrix=m, shift=-m @ self.shift)

    def __call__(self, x: Sequence[float]) -> np.ndarray:
        return self.shift + self.center + self.matrix @ (np.asarray(x, float) - self.center)

    def arrays(self, coords: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The map of arrays of coordinates that broadcast against one another, computed in the order of ``columns``."""
        out = []
        for row, t, c in zip(self.matrix, self.shift, self.center, strict=True):
            value = np.array(float(t + c))
            for a, x, o in zip(row, coords, self.center, strict=True):
                if a:
                    value = value + (x - float(o)) * float(a)
            out.append(value)
        return out

    def columns(self, cols: Sequence[Column]) -> list[Column]:
        """The map as expressions; the matrix becomes literals, zero terms vanish."""
        out = []
        for row, t, c in zip(self.matrix, self.shift, self.center, strict=True):
            terms = [(col - float(o)) * float(a) if o else col.cast("double") * float(a) for a, col, o in zip(row, cols, self.center, strict=True) if a]
            value = F.lit(float(t + c))
            for term in terms:
                value = value + term
            out.append(value)
        return out


def center_of(raster: Raster) -> list[float]:
    return [(f + b) / 2 for f, b in zip(raster.domain.front, raster.domain.back, strict=True)]


def warp(raster: Raster, map_: Affinity, method: str = LINEAR, how: Extrapolation = Nearest(), region: Grid | None = None) -> Raster:
    """Each pixel of the domain (or of a box within it) takes the value at its preimage."""
    out = region if region is not None else raster.domain
    names = axes(raster.dimension)
    back = map_.inverse().columns([F.col(a) for a in names])
    at = out.positions(raster.df.sparkSession).select(*names, *(c.alias(f"_y{k}") for k, c in enumerate(back)))
    renamed = at.select(*(F.col(a).alias(f"_o{k}") for k, a in enumerate(names)), *(f"_y{k}" for k in range(len(names))))
    got = interpolate(raster, renamed, [f"_y{k}" for k in range(len(names))], method, how, [f"_o{k}" for k in range(len(names))])
    return Raster(got.select(*(F.col(f"_o{k}").alias(a) for k, a in enumerate(names)), "v"), out.shape, out.front)


def translate(raster: Raster, by: Sequence[float], method: str = LINEAR, how: Extrapolation = Nearest()) -> Raster:
    return warp(raster, Affinity.translation(by), method, how)


def scale(raster: Raster, factors: Sequence[float] | float, method: str = LINEAR, how: Extrapolation = Nearest()) -> Raster:
    return warp(raster, Affinity.identity(raster.dimension, center_of(raster)) * factors, method, how)


def rotate(raster: Raster, degrees: float, from_axis: int = 0, to_axis: int = 1, method: str = LINEAR, how: Extrapolation = Nearest()) -> Raster:
    return warp(raster, Affinity.rotation(degrees, raster.dimension, from_axis, to_axis, center_of(raster)), method, how)


def rotate_radians(raster: Raster, angle: float, from_axis: int = 0, to_axis: int = 1, method: str = LINEAR, how: Extrapolation = Nearest()) -> Raster:
    return warp(raster, Affinity.rotation_radians(angle, raster.dimension, from_axis, to_axis, center_of(raster)), method, how)


def resample(raster: Raster, factors: Sequence[float], method: str = NEAREST, how: Extrapolation = Nearest()) -> Raster:
    """out[p] = in(p / factor) for a shape of shape * factor, truncated; no smoothing is done."""
    shape = tuple(int(s * f) for s, f in zip(raster.shape, factors, strict=True))
    if min(shape) < 1:
        raise SizeError(shape, "a pixel or more on every axis")
    names = raster.axes
    at = Box.from_shape(shape).positions(raster.df.sparkSession).select(
        *(F.col(a).alias(f"_o{k}") for k, a in enumerate(names)), *((F.col(a) / float(f) + o).alias(f"_y{k}") for k, (a, f, o) in enumerate(zip(names, factors, raster.front, strict=True)))
    )
    keys = [f"_o{k}" for k in range(len(names))]
    got = interpolate(raster, at, [f"_y{k}" for k in range(len(names))], method, how, keys)
    return Raster(got.select(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True)), "v"), shape)


def _factors(raster: Raster, factor: float, chosen: Sequence[int] | None) -> list[float]:
    return [factor if chosen is None or k in chosen else 1.0 for k in range(raster.dimension)]


def upsample(raster: Raster, factor: float, chosen: Sequence[int] | None = None, method: str = NEAREST) -> Raster:
    return resample(raster, _factors(raster, factor, chosen), method)


def downsample(raster: Raster, factor: float, chosen: Sequence[int] | None = None, method: str = NEAREST) -> Raster:
    return resample(raster, [1 / f for f in _factors(raster, factor, chosen)], method)


@dataclass(frozen=True)
class Matrix:
    """A small matrix on the driver."""

    rows: np.ndarray = field(default_factory=lambda: np.eye(2))

    @classmethod
    def identity(cls, n: int) -> Matrix:
        return cls(np.eye(n))

    @classmethod
    def diagonal(cls, values: Sequence[float]) -> Matrix:
        return cls(np.diag(np.asarray(values, float)))

    def determinant(self) -> float:
        return float(np.linalg.det(self.rows))

    def inverse(self) -> Matrix:
        return Matrix(np.linalg.inv(self.rows))

    def __getitem__(self, at: tuple[int, int]) -> float:
        return float(self.rows[at])
