"""A raster as a DataFrame: one row per pixel, coordinate columns x0, x1, … and a value column v."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from .errors import SizeError
from .regions import Box, Grid, Position, Positions, Region, axes, linear_index


def pixel() -> Column:
    """The value column."""
    return F.col("v")


@dataclass(frozen=True)
class Raster:
    """``df`` has a row (x0, …, v) for every position of the box ``shape`` from ``front``; nothing runs until it is asked for.

    Missing data are NaN, as there is no null in an array of numbers. Arithmetic on columns of one frame stays one
    projection, so a chain of operators costs what a hand-fused loop would.
    """

    df: DataFrame
    shape: Position
    front: Position = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "shape", tuple(int(s) for s in self.shape))
        object.__setattr__(self, "front", tuple(self.front) or (0,) * len(self.shape))
        if missing := {*self.axes, "v"} - set(self.df.columns):
            raise SizeError(sorted(self.df.columns), f"columns {sorted(missing)} too")

    # -- construction

    @classmethod
    def filled(cls, spark: SparkSession, shape: Sequence[int], value: Column | float = 0.0, front: Sequence[int] = ()) -> Raster:
        """``value`` may be an expression of the coordinates and of ``idx``, the linear index."""
        box = Box.from_shape(shape, front or None)
        made = spark.range(box.size).select(F.col("id").alias("idx"), *box.decode(F.col("id")))
        return cls(made.select(*axes(len(shape)), (value if isinstance(value, Column) else F.lit(value)).alias("v")), tuple(shape), tuple(front))

    @classmethod
    def range(cls, spark: SparkSession, shape: Sequence[int], least: float = 0, step: float = 1) -> Raster:
        """least + step * index; exact for whole numbers, without the drift of repeated addition for others."""
        return cls.filled(spark, shape, F.lit(least) + F.lit(step) * F.col("idx"))

    @classmethod
    def linspace(cls, spark: SparkSession, shape: Sequence[int], least: float, most: float) -> Raster:
        n = int(np.prod(shape))
        step = (most - least) / (n - 1) if n > 1 else 0.0
        return cls.filled(spark, shape, F.when(F.col("idx") == n - 1, F.lit(float(most))).otherwise(F.lit(float(least)) + F.lit(step) * F.col("idx")))

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray) -> Raster:
        """``array`` with its axes reversed: NumPy's last axis becomes axis 0. For arrays that fit the driver."""
        shape = array.shape[::-1]
        flat = spark.createDataFrame(pa.table({"idx": np.arange(array.size), "v": np.ascontiguousarray(array).reshape(-1)}))
        return cls(flat.select(*Box.from_shape(shape).decode(F.col("idx")), "v"), shape)

    @classmethod
    def from_values(cls, spark: SparkSession, values: Sequence[object], shape: Sequence[int]) -> Raster:
        """Values in linear order; raises SizeError unless they fill the shape."""
        if len(values) != int(np.prod(shape)):
            raise SizeError(len(values), int(np.prod(shape)))
        flat = spark.createDataFrame(list(enumerate(values)), ["idx", "v"])
        return cls(flat.select(*Box.from_shape(shape).decode(F.col("idx")), "v"), tuple(shape))

    @classmethod
    def from_dataframe(cls, df: DataFrame, coords: Sequence[Column], value: Column, shape: Sequence[int], front: Sequence[int] = ()) -> Raster:
        return cls(df.select(*(c.cast("long").alias(f"x{k}") for k, c in enumerate(coords)), value.alias("v")), tuple(shape), tuple(front))

    # -- metadata

    @property
    def dimension(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return axes(len(self.shape))

    @property
    def domain(self) -> Box:
        return Box.from_shape(self.shape, self.front)

    @property
    def size(self) -> int:
        return self.domain.size

    def index(self) -> Column:
        return linear_index(self.shape, front=self.front)

    def check(self) -> Raster:
        """Raises SizeError unless every position of the domain has exactly one row."""
        row = self.df.agg(F.count(F.lit(1)), F.countDistinct(*self.axes), F.count(F.when(self.domain.predicate(), 1))).first()
        if not row[0] == row[1] == row[2] == self.size:
            raise SizeError(tuple(row), self.size)
        return self

    # -- values

    def apply(self, f: Callable[..., Column], *others: Raster) -> Raster:
        """``f(v, v of the others…)`` at every position; others must have the same domain.

        A position that one of the rasters lacks is NaN in the result; where that has no NaN (whole numbers, structs),
        it raises an error when the job runs.
        """
        df, cols, met = self.df, [pixel()], None
        for k, other in enumerate(others):
            if (other.shape, other.front) != (self.shape, self.front):
                raise SizeError((other.shape, other.front), (self.shape, self.front))
            if other.df is self.df:
                cols.append(pixel())
                continue
            if met is None:
                df, met = df.withColumn("_hit", F.lit(True)), F.col("_hit").isNotNull()
            df = df.join(other.df.select(*self.axes, F.col("v").alias(f"_v{k}"), F.lit(True).alias(f"_hit{k}")), self.axes, "full")
            cols.append(F.col(f"_v{k}"))
            met = met & F.col(f"_hit{k}").isNotNull()
        value = f(*cols)
        if met is not None:
            real = isinstance(df.select(value.alias("v")).schema["v"].dataType, FractionalType)
            missing = F.lit(float("nan")) if real else F.raise_error(F.lit("size: a raster lacks a position, and the result has no NaN"))
            value = F.when(met, value).otherwise(missing)
        return replace(self, df=df.select(*self.axes, value.alias("v")))

    def generate(self, f: Callable[..., Column], *inputs: Raster) -> Raster:
        """Like ``apply`` without the raster's own values; without inputs ``f`` gets the coordinate columns."""
        if not inputs:
            return replace(self, df=self.df.select(*self.axes, f(*map(F.col, self.axes)).alias("v")))
        return inputs[0].apply(f, *inputs[1:])

    def fill(self, value: Column | float) -> Raster:
        return self.apply(lambda v: value if isinstance(value, Column) else F.lit(value))

    def where_apply(self, region: Region, f: Callable[[Column], Column]) -> Raster:
        """``f`` within a region, the rest unchanged: what writing through a view does."""
        return self.apply(lambda v: F.when(region.predicate(), f(v)).otherwise(v))

    def write(self, values: Raster, region: Grid) -> Raster:
        """This raster with a box's or grid's pixels taken from ``values``, a raster of the region's shape (from 0)."""
        if values.shape != region.shape:
            raise SizeError(values.shape, region.shape)
        moved = [(F.col(a) * s + f).alias(a) for a, s, f in zip(self.axes, region.step, region.front, strict=True)]
        new = values.df.select(*moved, F.col("v").alias("_w"), F.lit(True).alias("_hit"))
        joined = self.df.join(new, self.axes, "left")
        return replace(self, df=joined.select(*self.axes, F.when(F.col("_hit"), F.col("_w")).otherwise(pixel()).alias("v")))

    def reverse(self) -> Raster:
        """Values in reverse linear order; the same as mirroring every axis."""
        flipped = [(F.lit(2 * f + n - 1) - F.col(a)).alias(a) for a, n, f in zip(self.axes, self.shape, self.front, strict=True)]
        return replace(self, df=self.df.select(*flipped, "v"))

    # -- regions and views

    def patch(self, region: Region) -> DataFrame:
        """Rows of a region: a predicate for boxes, grids and masks; a join, in the given order and with repeats, for positions."""
        if isinstance(region, Positions):
            return region.df.join(self.df, self.axes).select("ord", *self.axes, "v")
        return self.df.where(region.predicate())

    def crop(self, region: Grid) -> Raster:
        """A raster of its own of a box or grid within the domain; a grid's steps become 1. Coordinates start at 0."""
        if not region.box() <= self.domain:
            raise SizeError(region, self.domain)
        cols = [((F.col(a) - f) / s).cast("long").alias(a) for a, f, s in zip(self.axes, region.front, region.step, strict=True)]
        return Raster(self.df.where(region.predicate()).select(*cols, "v"), region.shape)

    def keep_axes(self, kept: Sequence[int], at: Box) -> Raster:
        """The cut ``at`` with only the ``kept`` axes; the others must have a single coordinate there."""
        if any(n != 1 for k, n in enumerate(at.shape) if k not in kept):
            raise SizeError(at.shape, "one coordinate on every axis left out")
        cols = [(F.col(f"x{k}") - at.front[k]).alias(f"x{j}") for j, k in enumerate(kept)]
        return Raster(self.df.where(at.predicate()).select(*cols, "v"), tuple(at.shape[k] for k in kept))

    def is_contiguous(self, box: Box, dimension: int) -> bool:
        """Whether the first ``dimension`` axes of ``box`` are a stretch of linear indices: all but the last of them whole."""
        whole = all(box.length(k) == self.shape[k] for k in range(dimension - 1))
        return whole and all(box.length(k) == 1 for k in range(dimension, self.dimension))

    def slice(self, box: Box, dimension: int) -> Raster:
        if not self.is_contiguous(box, dimension):
            raise SizeError(box, f"a contiguous box of dimension {dimension}")
        return self.keep_axes(range(dimension), box)

    def _last(self, front: int, back: int) -> Box:
        d = self.domain
        return Box((*d.front[:-1], front), (*d.back[:-1], back))

    def chunk(self, front: int, back: int) -> Raster:
        """A range of the last axis, all axes kept."""
        return self.crop(self._last(front, back))

    def section(self, at: int) -> Raster:
        """One coordinate of the last axis, which goes."""
        return self.keep_axes(range(self.dimension - 1), self._last(at, at))

    def profile(self, axis: int, at: Sequence[int]) -> Raster:
        """The line along ``axis`` through a position of the other axes; negative coordinates count from the end."""
        p = self.domain.wrap((*at[:axis], 0, *at[axis:]))
        d = self.domain
        box = Box(tuple(d.front[k] if k == axis else x for k, x in enumerate(p)), tuple(d.back[k] if k == axis else x for k, x in enumerate(p)))
        return self.keep_axes([axis], box)

    def row(self, at: Sequence[int]) -> Raster:
        return self.profile(0, at)

    def tiled(self, tile: Sequence[int]) -> DataFrame:
        """Rows with the tile's coordinates t0, …; group by them to work tile by tile. Tiles at the upper edges are smaller."""
        cols = [F.floor((F.col(a) - f) / t).cast("long").alias(f"t{k}") for k, (a, f, t) in enumerate(zip(self.axes, self.front, tile, strict=True))]
        return self.df.select(*cols, *self.axes, "v")

    def sections(self, thickness: int = 1) -> DataFrame:
        """Rows with the number of their section (or chunk of ``thickness``) of the last axis."""
        return self.df.withColumn("t", F.floor((F.col(self.axes[-1]) - self.front[-1]) / thickness).cast("long"))

    def profiles(self, axis: int = 0) -> DataFrame:
        """One row per line along ``axis``: the other coordinates and the line's values in order."""
        others = [a for a in self.axes if a != f"x{axis}"]
        line = F.sort_array(F.collect_list(F.struct(f"x{axis}", "v")))
        return self.df.groupBy(*others).agg(F.transform(line, lambda s: s["v"]).alias("values"))

    # -- access

    def at(self, p: Sequence[int]) -> object:
        """One value; negative coordinates count from the end; raises OutOfBoundsError beyond the domain."""
        q = self.domain.wrap(p)
        return self.df.where(Box(q, q).predicate()).first()["v"]

    def to_numpy(self) -> np.ndarray:
        """For rasters that fit the driver; axes in NumPy's order."""
        got = self.df.select(self.index().alias("idx"), "v").toArrow()
        out = np.empty(self.size, got["v"].to_numpy().dtype)
        out[got["idx"].to_numpy()] = got["v"].to_numpy()
        return out.reshape(self.shape[::-1])

    def elided(self, most: int = 7) -> str:
        """"[a, b, c ... x, y, z]" in linear order, in full up to ``most`` values; only the ends are fetched."""
        idx = self.index()
        ends = self.df.select(idx.alias("i"), "v").where((F.col("i") < 3) | (F.col("i") >= self.size - 3) | F.lit(self.size <= most))
        shown = [str(r["v"]) for r in ends.orderBy("i").collect()]
        return "[" + (", ".join(shown) if self.size <= most else ", ".join(shown[:3]) + " ... " + ", ".join(shown[-3:])) + "]"

    def linear_neighbours(self) -> DataFrame:
        """Rows with their linear index and value, in no order: the form for 1-D windows over lines."""
        return self.df.select(self.index().alias("idx"), *self.axes, "v")


def scan_order(df: DataFrame, n: int) -> DataFrame:
    """Rows in linear order (axis 0 fastest)."""
    return df.orderBy(*reversed(axes(n)))


def same(a: Raster, b: Raster) -> bool:
    """Equal shapes and equal values everywhere; NaN differs from everything, itself included."""
    if (a.shape, a.front) != (b.shape, b.front):
        return False
    both = a.df.join(b.df.withColumnRenamed("v", "_w"), a.axes, "full")
    alike = F.coalesce((pixel() == F.col("_w")) & ~F.coalesce(F.isnan(pixel().cast("double")), F.lit(False)), F.lit(False))
    return not both.where(~alike).limit(1).count()
