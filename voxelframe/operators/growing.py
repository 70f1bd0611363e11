"""Growing a mask through an image to its end, tile by tile.

Within a tile the mask is flooded at once. Between tiles there are two ways. Neighbours that would flag each other form
components; their parts in single tiles, joined across the borders as a small graph of a node for each part, are reached
all together, however many tiles they wind through. What spreads in one direction only is handed on across borders,
round by round. A round reads the tiles that got something new and writes positions at their borders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import SizeError
from ..plans.raster import Raster
from ..plans.regions import Box
from ..plans.scratch import scratch_path
from ..streaming.chunks import assemble, exchange, tile_box, to_chunks
from .stencil import _tile_shape

#: Positions at borders up to this many go to every task; beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


class Tile:
    """A tile with a margin of one pixel: where flags spread from each pixel, in each direction, and the pixels of its own."""

    def __init__(self, image: np.ndarray, mask: np.ndarray, held: Box, own: Box, domain: Box, threshold: float) -> None:
        self.shape, self.held, self.domain = image.shape, held, domain
        inner = [np.arange(f, b + 1) for f, b in zip(held.front, held.back, strict=True)]
        may = np.ones(image.shape, bool)
        mine = np.ones(image.shape, bool)
        for k, x in enumerate(inner):
            line = [None if j != k else slice(None) for j in range(len(inner))]
            may &= ((x > domain.front[k]) & (x < domain.back[k]))[tuple(line)]
            mine &= ((x >= own.front[k]) & (x <= own.back[k]))[tuple(line)]
        strides = np.cumprod([1, *self.shape[:-1]])
        self.mine, self.seeds = mine.ravel(order="F"), (mask != 0).ravel(order="F") & mine.ravel(order="F")
        #: (step in linear index, whether a flag spreads that way from each pixel), for both ways along every axis in turn.
        self.ways: list[tuple[int, np.ndarray]] = []
        for k, stride in enumerate(strides.tolist()):
            for sign in (-1, 1):
                spreads = np.zeros(image.shape, bool)
                here = tuple(slice(1 if sign < 0 else None, None if sign < 0 else -1) if j == k else slice(None) for j in range(image.ndim))
                there = tuple(slice(None if sign < 0 else 1, -1 if sign < 0 else None) if j == k else slice(None) for j in range(image.ndim))
                with np.errstate(all="ignore"):
                    n = image[here]
                    spreads[here] = ((n - image[there]) / n < threshold) & (n != 0) & may[there]
                self.ways.append((sign * stride, spreads.ravel(order="F")))

    def number(self, at: np.ndarray) -> np.ndarray:
        """Linear indices in the domain of places in the tile."""
        coords = np.unravel_index(at, self.shape, order="F")
        out, stride = np.zeros(len(at), np.int64), 1
        for c, f, o, n in zip(coords, self.held.front, self.domain.front, self.domain.shape, strict=True):
            out += (c + f - o) * stride
            stride *= n
        return out

    def place(self, numbers: np.ndarray) -> np.ndarray:
        coords = np.unravel_index(numbers, self.domain.shape, order="F")
        return np.ravel_multi_index([c + o - f for c, o, f in zip(coords, self.domain.front, self.held.front, strict=True)], self.shape, order="F")

    def flooded(self, more: np.ndarray) -> np.ndarray:
        """The tile's own pixels that are flagged in the end, from its mask and ``more`` places."""
        seen = self.seeds.copy()
        seen[more] = True
        front = np.flatnonzero(seen)
        while len(front):
            found = []
            for step, spreads in self.ways:
                to = front[spreads[front]] + step
                to = to[self.mine[to] & ~seen[to]]
                seen[to] = True
                found.append(to)
            front = np.unique(np.concatenate(found))
        return seen

    def across(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(own place, neighbour's place in another tile, whether flags spread both ways), where they spread from the first to the second."""
        for k, (step, spreads) in enumerate(self.ways):
            at = np.flatnonzero(self.mine & spreads)
            at = at[~self.mine[at + step]]
            yield at, at + step, self.ways[k ^ 1][1][at + step]

    def parts(self) -> np.ndarray:
        """For each own pixel the least place of the pixels that it is joined with by flags spreading both ways."""
        label = np.arange(self.mine.size)
        pairs = []
        for k, (step, spreads) in enumerate(self.ways[1::2]):
            at = np.flatnonzero(spreads & self.mine)
            at = at[self.mine[at + step] & self.ways[2 * k][1][at + step]]
            pairs.append((at, at + step))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while len(a):
            # Hook the greater root to the less one, then let every pixel point to its root.
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            np.minimum.at(label, high, low)
            while not np.array_equal(jumped := label[label], label):
                label = jumped
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        return label


def _roots(edges: DataFrame) -> DataFrame:
    """(part, root): the least part of each connected set of ``edges`` (a, b). Rounds grow with the logarithm of the longest path."""
    edges = _stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    label = edges.select(F.col("a").alias("part")).distinct().withColumn("root", F.col("part"))
    label = _stored(label, "labels")
    while True:
        near = edges.join(label.select(F.col("part").alias("b"), F.col("root").alias("seen")), "b").groupBy(F.col("a").alias("part")).agg(F.min("seen").alias("seen"))
        # The least root among neighbours is told to the part and to its root, which then jumps to its own root's root.
        told = label.join(near, "part").select("part", "root", F.least("root", "seen").alias("new"))
        wishes = told.select("part", "new").union(told.select(F.col("root").alias("part"), "new")).groupBy("part").agg(F.min("new").alias("root"))
        wishes = _stored(wishes, "labels")
        jumped = wishes.join(wishes.select(F.col("part").alias("root"), F.col("root").alias("up")), "root", "left").select("part", F.least("root", F.coalesce("up", "root")).alias("root"))
        new = _stored(jumped, "labels")
        if new.join(label.withColumnRenamed("root", "old"), "part").where("root <> old").isEmpty():
            return new
        label = new


def grow(image: Raster, mask: Raster, threshold: float, tile: Sequence[int] | None = None) -> Raster:
    """The mask with all that rounds of ``segment`` would ever add: what is flagged, or reached from it by steps between direct neighbours n, p with (n - p) / n < ``threshold``.

    As in ``segment`` pixels at the edge of the image only stay as they are, and no flag spreads from a 0 or a NaN, or
    to a NaN. Image and mask must have every pixel.
    """
    if (image.shape, image.front) != (mask.shape, mask.front):
        raise SizeError((mask.shape, mask.front), (image.shape, image.front))
    n, base = image.dimension, image.crop(image.domain)
    domain, tile = base.domain, tuple(tile) if tile else _tile_shape(image.shape)
    counts = [-(-s // t) for s, t in zip(domain.shape, tile, strict=True)]
    layers = base.df.select(*base.axes, F.lit(0).cast("long").alias(f"x{n}"), F.col("v").cast("double").alias("v"))
    layers = layers.union(mask.crop(mask.domain).df.select(*base.axes, F.lit(1).cast("long").alias(f"x{n}"), F.col("v").cast("double").alias("v")))
    both = Box.from_shape((*domain.shape, 2))
    margin = Box((*(-1,) * n, 0), (*(1,) * n, 0))

    def send(own: Box) -> Iterator[tuple[Sequence[int], Box, Sequence[int]]]:
        at = [f // t for f, t in zip(own.front, tile, strict=False)]
        for k in range(2 * n + 1):
            # A flag spreads along axes, so corners aren't needed; the tile itself, and two neighbours an axis.
            to = [a + (1 if k % 2 else -1) * (j == k // 2) if k < 2 * n else a for j, a in enumerate(at)]
            if all(0 <= a < c for a, c in zip(to, counts, strict=True)):
                part = tile_box([*to, 0], both.shape, (*tile, 2)).grow(margin) & own
                if min(part.shape) > 0:
                    yield [*to, 0], part, (0,) * (n + 1)

    def make(box: Box, parts: list[tuple[list[int], np.ndarray]]) -> np.ndarray:
        held = box.grow(margin) & both
        return np.pad(assemble(held, parts, np.dtype(float)), [(a - b, c - d) for a, b, c, d in zip(held.front, box.grow(margin).front, box.grow(margin).back, held.back, strict=True)], constant_values=math.nan)

    tiles = exchange(to_chunks(Raster(layers, both.shape), (*tile, 2)), both.shape, (*tile, 2), send, make, np.dtype(float))
    number, stride = F.lit(0).cast("long"), 1
    for k, (t, c) in enumerate(zip(tile, counts, strict=True)):
        number = number + (F.get("front", F.lit(k)) / t).cast("long") * stride
        stride *= c
    # The blocks with their margins; their fronts are those of the tiles.
    tiles = _stored(tiles.select(number.alias("tile"), "front", "shape", "values"), "tiles")

    def opened(front: list[int], shape: list[int], values: np.ndarray) -> Tile:
        block = values.reshape(shape, order="F")
        own = Box(tuple(front[:n]), tuple(f + s - 3 for f, s in zip(front[:n], shape, strict=False)))
        return Tile(block[..., 0], block[..., 1], own.grow(Box((-1,) * n, (1,) * n)), own, domain, threshold)

    def each(batches: Iterator[pa.RecordBatch], seeds: bool) -> Iterator[tuple[Tile, np.ndarray]]:
        for batch in batches:
            for k in range(batch.num_rows):
                opened_ = opened(batch["front"][k].as_py(), batch["shape"][k].as_py(), batch["values"][k].values.to_numpy())
                more = np.array(batch["seeds"][k].as_py() or [], np.int64) if seeds else np.zeros(0, np.int64)
                yield opened_, opened_.place(more) if len(more) else more

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(at, part, own): parts that own or border on a position at a tile's edge across which flags spread both ways."""
        for t, _ in each(batches, False):
            label = t.parts()
            for here, there, mutual in t.across():
                here, there = here[mutual], there[mutual]
                part = t.number(label[here])
                for at, own in ((t.number(there), False), (t.number(here), True)):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part), pa.array(np.full(len(at), own))], ["at", "part", "own"])

    spread = _stored(tiles.mapInArrow(links, "at long, part long, own boolean").distinct(), "links")
    owner = spread.where("own").select("at", F.col("part").alias("b"))
    roots = _stored(_roots(spread.where("NOT own").select("at", F.col("part").alias("a")).join(owner, "at").select("a", "b")), "roots")
    # Positions at the edges, by the root of their part: what is told of one is told of all.
    at_edge = _stored(owner.join(roots, F.col("b") == F.col("part")).select("at", "root", F.col("part").alias("rep")), "edges")

    def flood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(at, own): flagged positions at the tile's edge, and those that flags spread to in other tiles."""
        for t, more in each(batches, True):
            seen = t.flooded(more)
            for here, there, _ in t.across():
                told = seen[here]
                for at, own in ((t.number(here[told]), True), (t.number(there[told]), False)):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), own))], ["at", "own"])

    strides = [math.prod(domain.shape[:k]) for k in range(n)]
    steps = [math.prod(counts[:k]) for k in range(n)]
    where = " + ".join(f"((at div {s}) % {size}) div {t} * {step}" for s, size, t, step in zip(strides, domain.shape, tile, steps, strict=True))

    def dealt(seeds: DataFrame) -> DataFrame:
        """Tiles that have seeds, with these."""
        by_tile = seeds.groupBy(F.expr(where).alias("tile")).agg(F.collect_set("at").alias("seeds"))
        return tiles.join(_few(_stored(by_tile, "seeds")), "tile").select("front", "shape", "values", "seeds")

    def tell(rows: DataFrame) -> DataFrame:
        """Positions to be flagged in other tiles after a round: across borders, and one for each part of a root that was reached."""
        told = _stored(rows.mapInArrow(flood, "at long, own boolean").distinct(), "told")
        reached = told.where("own").join(at_edge, "at").select("root").distinct()
        return told.where("NOT own").select("at").union(at_edge.join(_few(_stored(reached, "reached")), "root").select(F.col("rep").alias("at"))).distinct()

    known = _stored(tell(tiles.select("front", "shape", "values", F.lit(None).cast("array<long>").alias("seeds"))), "known")
    new = known
    while not new.isEmpty():
        active = known.join(new.select(F.expr(where).alias("tile")).distinct(), F.expr(where) == F.col("tile"), "left_semi")
        new = _stored(tell(dealt(active)).join(known, "at", "left_anti"), "new")
        known = _stored(known.union(new), "known")

    names, origin = image.axes, image.front

    def painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, more in each(batches, True):
            seen = t.flooded(more)
            at = np.flatnonzero(t.mine)
            coords = [c + f + o for c, f, o in zip(np.unravel_index(at, t.shape, order="F"), t.held.front, origin, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in coords), pa.array(seen[at].astype(np.int32))], [*names, "v"])

    by_tile = known.groupBy(F.expr(where).alias("tile")).agg(F.collect_set("at").alias("seeds"))
    whole = tiles.join(_few(_stored(by_tile, "seeds")), "tile", "left").select("front", "shape", "values", "seeds")
    return Raster(whole.mapInArrow(painted, ", ".join(f"{a} long" for a in names) + ", v int"), image.shape, image.front)
