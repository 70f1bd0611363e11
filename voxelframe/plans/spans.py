"""Masks of any size as run lengths: a table of stretches along axis 0, sorted out and met by joins, never a list on the driver.

A row (x1, …, cell, low, high) is a stretch of flagged positions of the line x1, …; stretches end at multiples of
``CELL``, so a line, however long, is worked on in many tasks, and a row of a raster finds its stretch by equality of
line and cell. Within a cell stretches don't touch one another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import SizeError
from .raster import Raster
from .regions import Box, Grid, Mask, axes

#: Positions of a cell along axis 0.
CELL = 1 << 16


@dataclass(frozen=True)
class Spans:
    """Flagged positions of ``dimension`` axes."""

    df: DataFrame
    dimension: int

    @property
    def lines(self) -> list[str]:
        return axes(self.dimension)[1:]

    # -- construction

    @classmethod
    def of_stretches(cls, df: DataFrame, dimension: int) -> Spans:
        """From rows (x1, …, low, high) of stretches in any order, that may overlap."""
        lines = axes(dimension)[1:]
        first, last = F.floor(F.col("low") / CELL), F.floor(F.col("high") / CELL)
        cut = df.where("low <= high").select(*lines, "low", "high", F.explode(F.sequence(first, last)).alias("cell"))
        cut = cut.select(*lines, "cell", F.greatest("low", F.col("cell") * CELL).alias("low"), F.least("high", F.col("cell") * CELL + CELL - 1).alias("high"))
        return cls(_swept(cut.select(*lines, "cell", "low", "high", F.lit(1).alias("a"), F.lit(0).alias("b")), lines, lambda a, b: a > 0), dimension)

    @classmethod
    def of_positions(cls, df: DataFrame, dimension: int) -> Spans:
        """From rows (x0, …), repeats included."""
        return cls.of_stretches(df.select(*axes(dimension)[1:], F.col("x0").alias("low"), F.col("x0").alias("high")), dimension)

    @classmethod
    def of_flags(cls, mask: Raster) -> Spans:
        """The positions of a raster whose value isn't 0."""
        return cls.of_positions(mask.df.where("v <> 0"), mask.dimension)

    @classmethod
    def of_region(cls, spark: SparkSession, region: Grid | Mask) -> Spans:
        """A box's lines, or the positions of a grid or mask."""
        if isinstance(region, Box):
            rest = Box((0, *region.front[1:]), (0, *region.back[1:])).positions(spark)
            return cls.of_stretches(rest.select(*axes(region.dimension)[1:], F.lit(region.front[0]).cast("long").alias("low"), F.lit(region.back[0]).cast("long").alias("high")), region.dimension)
        return cls.of_positions(region.positions(spark), region.dimension)

    # -- algebra

    def _with(self, other: Spans, keep: Callable[[Column, Column], Column]) -> Spans:
        if other.dimension != self.dimension:
            raise SizeError(other.dimension, self.dimension)
        cols = [*self.lines, "cell", "low", "high"]
        a, b = (s.df.select(*cols, F.lit(x).alias("a"), F.lit(1 - x).alias("b")) for s, x in ((self, 1), (other, 0)))
        return Spans(_swept(a.union(b), self.lines, keep), self.dimension)

    def __or__(self, other: Spans) -> Spans:
        return self._with(other, lambda a, b: (a > 0) | (b > 0))

    def __and__(self, other: Spans | Box) -> Spans:
        """The positions in both; a box is a condition and a cut, without a shuffle."""
        if isinstance(other, Spans):
            return self._with(other, lambda a, b: (a > 0) & (b > 0))
        inside = self.df.where((F.col("low") <= other.back[0]) & (F.col("high") >= other.front[0]))
        for name, f, b in zip(self.lines, other.front[1:], other.back[1:], strict=True):
            inside = inside.where(F.col(name).between(f, b))
        return Spans(inside.withColumn("low", F.greatest("low", F.lit(other.front[0]))).withColumn("high", F.least("high", F.lit(other.back[0]))), self.dimension)

    def __sub__(self, other: Spans) -> Spans:
        return self._with(other, lambda a, b: (a > 0) & (b == 0))

    def __xor__(self, other: Spans) -> Spans:
        return self._with(other, lambda a, b: (a > 0) != (b > 0))

    def translate(self, by: Sequence[int]) -> Spans:
        moved = self.df.select(*((F.col(x) + d).alias(x) for x, d in zip(self.lines, by[1:], strict=True)), *((F.col(c) + by[0]).alias(c) for c in ("low", "high")))
        return Spans.of_stretches(moved, self.dimension)

    def mirror(self) -> Spans:
        """Every position's negative."""
        flipped = self.df.select(*((-F.col(x)).alias(x) for x in self.lines), (-F.col("high")).alias("low"), (-F.col("low")).alias("high"))
        return Spans.of_stretches(flipped, self.dimension)

    # -- use

    def size(self) -> int:
        return self.df.agg(F.coalesce(F.sum(F.col("high") - F.col("low") + 1), F.lit(0))).first()[0]

    def box(self) -> Box | None:
        """The smallest box with all positions, or none."""
        sides = [F.min("low"), *map(F.min, self.lines)], [F.max("high"), *map(F.max, self.lines)]
        row = self.df.agg(*sides[0], *sides[1]).first()
        return None if row[0] is None else Box(tuple(row[: self.dimension]), tuple(row[self.dimension :]))

    def positions(self) -> DataFrame:
        """(x0, …) of all positions."""
        return self.df.select(F.explode(F.sequence("low", "high")).alias("x0"), *self.lines).select(*axes(self.dimension))

    def select(self, raster: Raster) -> DataFrame:
        """The rows of a raster at flagged positions: a join by line and cell, and the stretch as a range; stretches of a cell are disjoint, so no row comes twice."""
        if raster.dimension != self.dimension:
            raise SizeError(raster.dimension, self.dimension)
        cell = F.floor(F.col("x0") / CELL).alias("_cell")
        rows = raster.df.select("*", cell)
        spans = self.df.select(*(F.col(x).alias(f"_{x}") for x in self.lines), "cell", "low", "high")
        on = (F.col("_cell") == F.col("cell")) & F.col("x0").between(F.col("low"), F.col("high"))
        for x in self.lines:
            on = on & (F.col(x) == F.col(f"_{x}"))
        return rows.join(spans, on, "left_semi").drop("_cell")

    def apply(self, raster: Raster, f: Callable[[Column], Column]) -> Raster:
        """``f`` at flagged positions, the rest unchanged."""
        hit = self.select(raster).select(*raster.axes, F.lit(True).alias("_hit"))
        joined = raster.df.join(hit, raster.axes, "left")
        return Raster(joined.select(*raster.axes, F.when(F.col("_hit"), f(F.col("v"))).otherwise(F.col("v")).alias("v")), raster.shape, raster.front)


def _swept(rows: DataFrame, lines: Sequence[str], keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Stretches of each cell where ``keep`` holds for how many stretches of the first and the second kind cover a position."""
    ends = rows.select(*lines, "cell", F.explode(F.array(F.struct(F.col("low").alias("at"), "a", "b"), F.struct((F.col("high") + 1).alias("at"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))).alias("end"))
    steps = ends.select(*lines, "cell", "end.*").groupBy(*lines, "cell", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    along = Window.partitionBy(*lines, "cell").orderBy("at")
    seen = steps.withColumns({"a": F.sum("a").over(along), "b": F.sum("b").over(along)}).withColumn("on", keep(F.col("a"), F.col("b")))
    turns = seen.withColumn("was", F.coalesce(F.lag("on").over(along), F.lit(False))).where("on <> was")
    return turns.withColumn("high", F.lead("at").over(along) - 1).where("on").select(*lines, "cell", F.col("at").alias("low"), "high")
