"""Regions of integer positions: boxes, grids, lines, masks and sequences.

A region knows its bounds on the driver and turns into a predicate on coordinate columns (evaluated at the scan) or into
a DataFrame of its positions (generated on the executors). Bounds are inclusive; axis 0 runs fastest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import OutOfBoundsError, SizeError

Position = tuple[int, ...]


def axes(n: int) -> list[str]:
    return [f"x{k}" for k in range(n)]


def _add(a: Sequence[int], b: Sequence[int] | int, sign: int = 1) -> Position:
    b = (b,) * len(a) if isinstance(b, int) else b
    if len(a) != len(b):
        raise SizeError(len(b), len(a))
    return tuple(x + sign * y for x, y in zip(a, b, strict=True))


def zeros(n: int) -> Position:
    return (0,) * n


def ones(n: int) -> Position:
    return (1,) * n


def infinite(n: int) -> tuple[float, ...]:
    return (math.inf,) * n


def is_zero(v: Sequence[float]) -> bool:
    return all(x == 0 for x in v)


def is_one(v: Sequence[float]) -> bool:
    return all(x == 1 for x in v)


def is_infinite(v: Sequence[float]) -> bool:
    return all(x == math.inf for x in v)


def extend(v: Sequence[int], n: int, filler: Sequence[int]) -> Position:
    """``v`` with further coordinates from ``filler``, up to ``n`` of them."""
    return (*v, *filler[len(v) : n])


@dataclass(frozen=True)
class Grid:
    """Every ``step``-th position of a box along each axis; the back is trimmed onto the lattice."""

    front: Position
    back: Position
    step: Position

    def __post_init__(self) -> None:
        if not len(self.front) == len(self.back) == len(self.step) or any(s < 1 for s in self.step):
            raise SizeError((self.front, self.back, self.step), "equal dimensions and positive steps")
        object.__setattr__(self, "back", tuple(f + (b - f) // s * s for f, b, s in zip(self.front, self.back, self.step, strict=True)))

    @property
    def dimension(self) -> int:
        return len(self.front)

    @property
    def shape(self) -> Position:
        return tuple(max(0, (b - f) // s + 1) for f, b, s in zip(self.front, self.back, self.step, strict=True))

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def length(self, axis: int) -> int:
        return self.shape[axis]

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: Sequence[int]) -> Position:
        """The position ``at`` steps from the front."""
        return tuple(f + s * p for f, s, p in zip(self.front, self.step, at, strict=True))

    def __iter__(self) -> Iterator[Position]:
        lanes = [range(f, b + 1, s) for f, b, s in zip(self.front, self.back, self.step, strict=True)]
        return (p[::-1] for p in product(*lanes[::-1]))

    def __contains__(self, p: Sequence[int]) -> bool:
        return all(f <= x <= b and (x - f) % s == 0 for x, f, b, s in zip(p, self.front, self.back, self.step, strict=True))

    def box(self) -> Box:
        return Box(self.front, self.back)

    def predicate(self, cols: Sequence[Column] | None = None) -> Column:
        cols = cols or [F.col(a) for a in axes(self.dimension)]
        parts = [c.between(f, b) for c, f, b in zip(cols, self.front, self.back, strict=True)]
        parts += [(c - f) % s == 0 for c, f, s in zip(cols, self.front, self.step, strict=True) if s > 1]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def positions(self, spark: SparkSession) -> DataFrame:
        """(x0, …) of all positions, decoded from their numbers, so no part of it is made on the driver."""
        return spark.range(self.size).select(*self.decode(F.col("id")))

    def decode(self, index: Column) -> list[Column]:
        """Coordinate columns of the ``index``-th position."""
        out, stride = [], 1
        for k, n in enumerate(self.shape):
            # (index - index % stride) is a multiple of stride, so the quotient is exact below 2 ** 53 positions.
            at = ((index - index % stride) / stride).cast("long") if stride > 1 else index
            at = at % n if k < self.dimension - 1 else at
            out.append((at * self.step[k] + self.front[k]).cast("long").alias(f"x{k}"))
            stride *= max(n, 1)
        return out

    def translate(self, by: Sequence[int] | int, sign: int = 1) -> Grid:
        return replace(self, front=_add(self.front, by, sign), back=_add(self.back, by, sign))

    __add__ = translate

    def __sub__(self, by: Sequence[int] | int) -> Grid:
        return self.translate(by, -1)

    def __neg__(self) -> Grid:
        """Mirrored through the origin, with fronts before backs."""
        return replace(self, front=tuple(-b for b in self.back), back=tuple(-f for f in self.front))

    def __and__(self, box: Box) -> Grid:
        """The grid's own positions within ``box``."""
        front = tuple(f + max(0, -(-(a - f) // s)) * s for f, s, a in zip(self.front, self.step, box.front, strict=True))
        return replace(self, front=front, back=tuple(map(min, self.back, box.back)))

    def project(self, axis: int) -> Grid:
        """The front but for ``axis``, which keeps its extent."""
        return replace(self, back=tuple(b if k == axis else f for k, (f, b) in enumerate(zip(self.front, self.back, strict=True))))


@dataclass(frozen=True)
class Box(Grid):
    """All positions from ``front`` to ``back``."""

    step: Position = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "step", (1,) * len(self.front))
        if len(self.front) != len(self.back):
            raise SizeError(len(self.back), len(self.front))

    @classmethod
    def from_shape(cls, shape: Sequence[int], front: Sequence[int] | None = None) -> Box:
        front = tuple(front) if front is not None else (0,) * len(shape)
        return cls(front, tuple(f + s - 1 for f, s in zip(front, shape, strict=True)))

    @classmethod
    def from_center(cls, radius: Sequence[int] | int, center: Sequence[int]) -> Box:
        return cls(_add(center, radius, -1), _add(center, radius))

    @classmethod
    def whole(cls, dimension: int) -> Box:
        """From 0 without end: meets any domain in all of it."""
        return cls((0,) * dimension, (2**63 - 1,) * dimension)

    def box(self) -> Box:
        return self

    def __and__(self, other: Box) -> Box:
        return Box(tuple(map(max, self.front, other.front)), tuple(map(min, self.back, other.back)))

    def __or__(self, other: Box) -> Box:
        """The smallest box that holds both."""
        return Box(tuple(map(min, self.front, other.front)), tuple(map(max, self.back, other.back)))

    def grow(self, window: Box) -> Box:
        """Bounds of all sums with the window's positions."""
        return Box(_add(self.front, window.front), _add(self.back, window.back))

    def shrink(self, window: Box) -> Box:
        """Positions around which the whole window stays within the box."""
        return Box(_add(self.front, window.front, -1), _add(self.back, window.back, -1))

    def __le__(self, other: Box) -> bool:
        return all(a >= b for a, b in zip(self.front, other.front, strict=True)) and all(a <= b for a, b in zip(self.back, other.back, strict=True))

    def __lt__(self, other: Box) -> bool:
        return all(a > b for a, b in zip(self.front, other.front, strict=True)) and all(a < b for a, b in zip(self.back, other.back, strict=True))

    def __ge__(self, other: Box) -> bool:
        return other <= self

    def __gt__(self, other: Box) -> bool:
        return other < self

    def project(self, axis: int) -> Box:
        return Box(self.front, tuple(b if k == axis else f for k, (f, b) in enumerate(zip(self.front, self.back, strict=True))))

    def extend(self, front: Sequence[int], back: Sequence[int]) -> Box:
        return Box((*self.front, *front), (*self.back, *back))

    def insert(self, axis: int, front: int, back: int) -> Box:
        return Box((*self.front[:axis], front, *self.front[axis:]), (*self.back[:axis], back, *self.back[axis:]))

    def erase(self, axis: int) -> Box:
        return Box(self.front[:axis] + self.front[axis + 1 :], self.back[:axis] + self.back[axis + 1 :])

    def clamp(self, p: Sequence[int]) -> Position:
        return tuple(min(max(x, f), b) for x, f, b in zip(p, self.front, self.back, strict=True))

    def clamp_columns(self, cols: Sequence[Column]) -> list[Column]:
        return [F.least(F.greatest(c, F.lit(f)), F.lit(b)) for c, f, b in zip(cols, self.front, self.back, strict=True)]

    def wrap(self, p: Sequence[int]) -> Position:
        """Negative coordinates count from the end; raises OutOfBoundsError beyond either."""
        out = []
        for k, (x, n) in enumerate(zip(p, self.shape, strict=True)):
            if not -n <= x < n:
                raise OutOfBoundsError(f"coordinate {k}", x, (-n, n - 1))
            out.append(self.front[k] + x % n)
        return tuple(out)


def line(front: Sequence[int], axis: int, back: int, step: int = 1) -> Grid:
    """Positions from ``front`` along one axis up to ``back``."""
    n = len(front)
    return Grid(tuple(front), tuple(back if k == axis else x for k, x in enumerate(front)), tuple(step if k == axis else 1 for k in range(n)))


def span(front: int, back: int, step: int = 1) -> Grid:
    """A one-dimensional progression."""
    return Grid((front,), (back,), (step,))


@dataclass(frozen=True)
class Mask:
    """Positions of a box for which a flag holds; the flag is an expression of the coordinates, or a set of positions."""

    bounds: Box
    flag: Callable[[list[Column]], Column] | None = None
    points: frozenset[Position] | None = None

    @classmethod
    def of(cls, points: Iterable[Position]) -> Mask:
        kept = frozenset(map(tuple, points))
        lanes = list(zip(*kept, strict=True))
        return cls(Box(tuple(map(min, lanes)), tuple(map(max, lanes))), None, kept)

    @classmethod
    def from_flags(cls, box: Box, flags: Sequence[bool]) -> Mask:
        """One flag for each position of the box, axis 0 fastest."""
        if len(flags) != box.size:
            raise SizeError(len(flags), box.size)
        return cls(box, None, frozenset(p for p, f in zip(box, flags, strict=True) if f))

    @classmethod
    def ball(cls, radius: float, center: Sequence[int], power: float = 2) -> Mask:
        """Positions whose distances d to the centre fulfil sum |d|^power <= radius^power; power 0 counts non-zero d (at most one)."""
        return Ball(Box.from_center(math.floor(radius), center), radius=radius, power=power)

    @property
    def dimension(self) -> int:
        return self.bounds.dimension

    def __iter__(self) -> Iterator[Position]:
        return (p for p in self.bounds if p in self)

    def __contains__(self, p: Sequence[int]) -> bool:
        if p not in self.bounds:
            return False
        if self.points is not None:
            return tuple(p) in self.points
        raise TypeError("membership of a mask of columns is only known on the executors")

    def __len__(self) -> int:
        return len(self.points) if self.points is not None else sum(1 for _ in self)

    size = property(__len__)

    def box(self) -> Box:
        return self.bounds

    def predicate(self, cols: Sequence[Column] | None = None) -> Column:
        cols = list(cols or [F.col(a) for a in axes(self.dimension)])
        if self.flag is not None:
            return self.bounds.predicate(cols) & self.flag(cols)
        # For a few positions; many are a table of their own (see Positions), joined to the raster.
        key = F.struct(*cols)
        kind = "struct<" + ",".join(f"{a}:bigint" for a in axes(self.dimension)) + ">"
        return self.bounds.predicate(cols) & key.cast(kind).isin(*(F.struct(*(F.lit(x).cast("long") for x in p)).cast(kind) for p in sorted(self.points)))

    def positions(self, spark: SparkSession) -> DataFrame:
        return self.bounds.positions(spark).where(self.predicate())

    def translate(self, by: Sequence[int] | int, sign: int = 1) -> Mask:
        move = (by,) * self.dimension if isinstance(by, int) else tuple(by)
        flag = (lambda cols, f=self.flag: f([c - sign * d for c, d in zip(cols, move, strict=True)])) if self.flag else None
        points = frozenset(_add(p, move, sign) for p in self.points) if self.points is not None else None
        return Mask(self.bounds.translate(move, sign), flag, points)

    __add__ = translate

    def __sub__(self, by: Sequence[int] | int) -> Mask:
        return self.translate(by, -1)

    def __neg__(self) -> Mask:
        flag = (lambda cols, f=self.flag: f([-c for c in cols])) if self.flag else None
        points = frozenset(tuple(-x for x in p) for p in self.points) if self.points is not None else None
        return Mask(Box(tuple(-b for b in self.bounds.back), tuple(-f for f in self.bounds.front)), flag, points)

    def __and__(self, box: Box) -> Mask:
        return Mask(self.bounds & box, self.flag, frozenset(p for p in self.points if p in box) if self.points is not None else None)


@dataclass(frozen=True)
class Ball(Mask):
    """A mask told by arithmetic on the distances to its centre, on the driver and on columns alike, so its size costs nothing."""

    radius: float = 0
    power: float = 2

    @property
    def most(self) -> float:
        return 1 if self.power == 0 else self.radius**self.power

    @property
    def center(self) -> Position:
        return tuple((f + b) // 2 for f, b in zip(self.bounds.front, self.bounds.back, strict=True))

    def __contains__(self, p: Sequence[int]) -> bool:
        away = _add(p, self.center, -1)
        return p in self.bounds and sum((x != 0) if self.power == 0 else abs(x) ** self.power for x in away) <= self.most

    def __len__(self) -> int:
        return sum(1 for _ in self)

    size = property(__len__)

    def predicate(self, cols: Sequence[Column] | None = None) -> Column:
        cols = list(cols or [F.col(a) for a in axes(self.dimension)])
        away = [c - x for c, x in zip(cols, self.center, strict=True)]
        part = lambda d: F.when(d != 0, 1).otherwise(0) if self.power == 0 else d * d if self.power == 2 else F.pow(F.abs(d), F.lit(self.power))
        return self.bounds.predicate(cols) & (reduce(lambda a, b: a + b, map(part, away)) <= self.most)

    def translate(self, by: Sequence[int] | int, sign: int = 1) -> Ball:
        return replace(self, bounds=self.bounds.translate(by, sign))

    __add__ = translate

    def __neg__(self) -> Ball:
        return replace(self, bounds=-self.bounds)

    def __and__(self, box: Box) -> Mask:
        return Mask(self.bounds & box, None, frozenset(p for p in self if p in box))


@dataclass(frozen=True)
class Positions:
    """Positions in a given order, repeats kept: a DataFrame with columns ord, x0, …"""

    df: DataFrame
    dimension: int

    @classmethod
    def of(cls, spark: SparkSession, points: Sequence[Position]) -> Positions:
        n = len(points[0])
        rows = [(k, *map(int, p)) for k, p in enumerate(points)]
        return cls(spark.createDataFrame(rows, "ord long, " + ", ".join(f"{a} long" for a in axes(n))), n)

    def positions(self, spark: SparkSession | None = None) -> DataFrame:
        return self.df

    def translate(self, by: Sequence[int] | int) -> Positions:
        move = (by,) * self.dimension if isinstance(by, int) else by
        return Positions(self.df.withColumns({a: F.col(a) + d for a, d in zip(axes(self.dimension), move, strict=True)}), self.dimension)

    def bounding_box(self) -> Box:
        row = self.df.agg(*(f(a) for a in axes(self.dimension) for f in (F.min, F.max))).first()
        return Box(tuple(row[::2]), tuple(row[1::2]))


Region = Grid | Mask | Positions


def linear_index(shape: Sequence[int], cols: Sequence[Column] | None = None, front: Sequence[int] | None = None) -> Column:
    """x0 + s0 * (x1 + s1 * (…)), as a column."""
    cols = cols or [F.col(a) for a in axes(len(shape))]
    front = front or (0,) * len(shape)
    out, stride = F.lit(0).cast("long"), 1
    for c, n, f in zip(cols, shape, front, strict=True):
        out = out + (c - f) * stride
        stride *= n
    return out


def index_of(shape: Sequence[int], p: Sequence[int]) -> int:
    out, stride = 0, 1
    for x, n in zip(p, shape, strict=True):
        out += x * stride
        stride *= n
    return out


def shape_size(shape: Sequence[int]) -> int:
    return math.prod(shape) if all(n > 0 for n in shape) else 0
