"""Warps and resampling of rasters in chunk form.

A tile of the result needs the source pixels in the box around its preimage. Every source chunk sends the tiles whose
boxes it meets what they need of it, so the raster is shuffled about once, and a tile is one gather in NumPy, whatever
the number of neighbours that the interpolation weighs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..plans.errors import SizeError
from ..plans.regions import Box
from ..streaming.chunks import assemble, exchange, tile_box, turns
from .resampling import CUBIC, LINEAR, NEAREST, Affinity
from .stencil import Constant, Extrapolation, Nearest, Periodic

#: Neighbours from the floor of a coordinate, least and most, by method. Nearest truncates toward zero.
SPAN = {NEAREST: (0, 2), LINEAR: (0, 1), CUBIC: (-1, 2)}
#: A tile's preimage may have this many times its pixels; beyond it tiles are made smaller.
SPREAD = 4
#: Room for rounding when boxes are compared.
EPS = 1e-6

Map = Callable[[Sequence[np.ndarray]], list[np.ndarray]]


def _weights(method: str, d: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(offset from the floor, weight) along one axis for the fractions ``d``."""
    if method == LINEAR:
        return [(0, 1 - d), (1, d)]
    d2, d3 = d * d, d * d * d
    return [(-1, (-d + 2 * d2 - d3) / 2), (0, (2 - 5 * d2 + 3 * d3) / 2), (1, (d + 4 * d2 - 3 * d3) / 2), (2, (d3 - d2) / 2)]


def _bounds(map_: Map, low: Sequence[float], high: Sequence[float]) -> tuple[list[float], list[float]]:
    """Least and greatest coordinates of the image of a box: those of its corners, as the map is affine."""
    corners = np.array(list(itertools.product(*zip(low, high, strict=True))), float).T
    image = [np.broadcast_to(x, corners.shape[1:]) for x in map_(list(corners))]
    return [float(x.min()) for x in image], [float(x.max()) for x in image]


def _needed(back: Map, box: Box, method: str, domain: Box, how: Extrapolation) -> Box:
    """The source pixels that a box of the result is made of; empty if all of them are a constant."""
    low, high = _bounds(back, box.front, box.back)
    lo, hi = SPAN[method]
    around = Box(tuple(math.floor(x - EPS) + lo for x in low), tuple(math.floor(x + EPS) + hi for x in high))
    if isinstance(how, Nearest):
        clamp = lambda p: tuple(min(max(x, f), b) for x, f, b in zip(p, domain.front, domain.back, strict=True))
        return Box(clamp(around.front), clamp(around.back))
    return around & domain if isinstance(how, Constant) else around


def sample(values: np.ndarray, held: Box, at: Sequence[np.ndarray], method: str, domain: Box, how: Extrapolation) -> np.ndarray:
    """Interpolated values at real coordinates, from the values of ``held``, the pixels that they need."""

    def look(places: Sequence[np.ndarray]) -> np.ndarray:
        if isinstance(how, Nearest):
            places = [np.clip(p, f, b) for p, f, b in zip(places, domain.front, domain.back, strict=True)]
        local = [p - f for p, f in zip(places, held.front, strict=True)]
        if not isinstance(how, Constant):
            return values[tuple(local)]
        inside = np.array(True)
        for p, f, b in zip(places, domain.front, domain.back, strict=True):
            inside = inside & (p >= f) & (p <= b)
        if not values.size:
            return np.full(np.broadcast_shapes(*(p.shape for p in places)), float(how.value))
        return np.where(inside, values[tuple(np.clip(p, 0, n - 1) for p, n in zip(local, values.shape, strict=True))], float(how.value))

    if method == NEAREST:
        return look([np.trunc(y + 0.5).astype(np.int64) for y in at])
    floors = [np.floor(y) for y in at]
    lanes = [_weights(method, y - f) for y, f in zip(at, floors, strict=True)]
    whole = [f.astype(np.int64) for f in floors]
    out = np.zeros(np.broadcast_shapes(*(y.shape for y in at)))
    for chosen in itertools.product(*lanes):
        weight = chosen[0][1]
        for _, w in chosen[1:]:
            weight = weight * w
        out = out + weight * look([p + o for p, (o, _) in zip(whole, chosen, strict=True)])
    return out


def _resampled(chunks: DataFrame, back: Map, forth: Map, shape: Sequence[int], tile: Sequence[int], method: str, how: Extrapolation, out: Box) -> DataFrame:
    """``out`` with the values at the images of its positions under ``back``; ``forth`` is the inverse."""
    if method not in SPAN:
        raise ValueError(f"method {method}: {', '.join(SPAN)}")
    domain, (lo, hi) = Box.from_shape(shape), SPAN[method]
    low, high = _bounds(back, out.front, out.back)
    cut = [min(t, n) for t, n in zip(tile, out.shape, strict=True)]
    while max(cut) > 1 and math.prod(b - a + 1 + hi - lo for a, b in zip(*_bounds(back, (0,) * len(cut), [c - 1 for c in cut]), strict=True)) > SPREAD * math.prod(tile):
        longest = cut.index(max(cut))
        cut[longest] = -(-cut[longest] // 2)
    counts = [-(-n // c) for n, c in zip(out.shape, cut, strict=True)]
    seen_from = Box(tuple(math.floor(x - EPS) + lo for x in low), tuple(math.floor(x + EPS) + hi for x in high))

    def wanted(at: Sequence[int]) -> Box:
        return _needed(back, tile_box(at, out.shape, cut) + out.front, method, domain, how)

    def send(own: Box) -> Iterator[tuple[Sequence[int], Box, Sequence[int]]]:
        for by in turns(own, seen_from, domain, how):
            moved = own + by
            # Coordinates whose neighbours lie in the chunk; beyond an edge, all that are continued from it.
            start = [low[k] if isinstance(how, Nearest) and own.front[k] == 0 else max(low[k], moved.front[k] - hi) for k in range(len(cut))]
            stop = [high[k] if isinstance(how, Nearest) and own.back[k] == domain.back[k] else min(high[k], moved.back[k] - lo + 1) for k in range(len(cut))]
            if any(a > b + EPS for a, b in zip(start, stop, strict=True)):
                continue
            first, last = _bounds(forth, start, stop)
            lanes = [range(max(0, int(a - o - 1) // c), min(n, int(math.ceil(b - o + 1)) // c + 1)) for a, b, o, c, n in zip(first, last, out.front, cut, counts, strict=True)]
            for at in itertools.product(*lanes):
                part = wanted(at) & moved
                if min(part.shape) > 0:
                    yield at, part - by, by

    def make(box: Box, parts: list[tuple[list[int], np.ndarray]]) -> np.ndarray:
        box = box + out.front
        held = _needed(back, box, method, domain, how)
        values = assemble(held, parts, np.dtype(float)) if min(held.shape) > 0 else np.zeros((0,) * len(cut))
        at = back(np.ix_(*(np.arange(f, b + 1, dtype=float) for f, b in zip(box.front, box.back, strict=True))))
        return np.broadcast_to(sample(values, held, at, method, domain, how), box.shape)

    return exchange(chunks, out.shape, cut, send, make, np.dtype(float), out.front)


def warp_chunks(chunks: DataFrame, map_: Affinity, shape: Sequence[int], tile: Sequence[int], method: str = LINEAR, how: Extrapolation = Nearest(), region: Box | None = None) -> DataFrame:
    """Each pixel of the domain (or of a box) takes the value at its preimage, for chunks of a raster of ``shape`` from 0.

    The result is cut into tiles of ``tile``, or smaller ones where the map shrinks the raster so much that a tile's
    preimage would be large. A missing pixel is NaN, and so is all that weighs it.
    """
    return _resampled(chunks, map_.inverse().arrays, map_.arrays, shape, tile, method, how, region if region is not None else Box.from_shape(shape))


def resample_chunks(chunks: DataFrame, factors: Sequence[float], shape: Sequence[int], tile: Sequence[int], method: str = NEAREST, how: Extrapolation = Nearest()) -> DataFrame:
    """out[p] = in(p / factor) for a shape of shape * factor, truncated; no smoothing is done."""
    size = tuple(int(s * f) for s, f in zip(shape, factors, strict=True))
    if min(size) < 1:
        raise SizeError(size, "a pixel or more on every axis")
    back = lambda x: [c / float(f) for c, f in zip(x, factors, strict=True)]
    forth = lambda y: [c * float(f) for c, f in zip(y, factors, strict=True)]
    return _resampled(chunks, back, forth, shape, tile, method, how, Box.from_shape(size))
