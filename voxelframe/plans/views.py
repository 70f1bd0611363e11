"""Views: a region of a raster, or a raster continued beyond its edges, that know what they were taken from."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from .errors import OutOfBoundsError
from .raster import Raster
from .regions import Box, Grid, Mask, Position, Region


@dataclass(frozen=True)
class Patch:
    """The pixels of ``region`` of a raster; nothing is read until ``df`` is used."""

    parent: Raster
    region: Region

    @property
    def df(self) -> DataFrame:
        """Rows (x0, …, v) in the raster's coordinates."""
        return self.parent.patch(self.region)

    def __rshift__(self, by: Sequence[int] | int) -> Patch:
        """The region moved by a vector, over the same raster."""
        return replace(self, region=self.region + by)

    def __lshift__(self, by: Sequence[int] | int) -> Patch:
        return replace(self, region=self.region - by)

    def crop(self, box: Box) -> Patch:
        """The part of the region that lies in ``box``, both in the raster's coordinates."""
        return replace(self, region=self.region & box)

    def position(self, at: Sequence[int]) -> Position:
        """Where the ``at``-th position along each axis lies, counted from the region's front."""
        if not isinstance(self.region, Grid):
            raise OutOfBoundsError(tuple(at), self.region)
        p = self.region[at]
        if p not in self.region:
            raise OutOfBoundsError(tuple(at), self.region)
        return p

    def __getitem__(self, at: Sequence[int]) -> object:
        """One value, by its position relative to the region's front."""
        return self.parent.at(self.position(at))

    def apply(self, f: Callable[[Column], Column]) -> Raster:
        """The whole raster with ``f`` applied within the region: what writing through the view does."""
        return self.parent.where_apply(self.region, f)

    def fill(self, value: Column | float) -> Raster:
        from pyspark.sql import functions as F

        return self.apply(lambda v: value if isinstance(value, Column) else F.lit(value).cast(self.parent.df.schema["v"].dataType))

    def copy(self) -> Raster:
        """A raster of its own, coordinates from 0."""
        if isinstance(self.region, Grid):
            return self.parent.crop(self.region)
        raise TypeError("only boxes and grids have the shape of a raster")


def patch(raster: Raster, region: Grid | Mask) -> Patch:
    return Patch(raster, region)


def rasterize(view: object) -> Raster:
    """The raster that a view was taken from, however deep; a raster itself as it is."""
    while not isinstance(view, Raster):
        view = view.parent
    return view
