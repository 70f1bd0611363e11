"""FITS images as a Spark data source, ``spark.read.format("fits")``.

An image unit is cut into sections, boxes that are one stretch of the file each; a partition is a section or a run of
small ones, so a large file is read by many tasks, and only the bytes of the sections that are asked for. Writing puts each section at its own
place of a file of known size. The driver sees headers alone, never a pixel.
"""

from __future__ import annotations

import fnmatch
import math
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..plans.errors import FileFormatError, PathMissingError, PathTakenError, SizeError
from ..plans.raster import Raster
from ..plans.regions import Box, axes

BLOCK, CARD = 2880, 80
# Fixed values of the format: BITPIX by NumPy type; unsigned types are stored shifted by BZERO.
BITPIX = {"uint8": 8, "int16": 16, "int32": 32, "int64": 64, "float32": -32, "float64": -64}
SHIFTED = {"int8": ("uint8", -128), "uint16": ("int16", 1 << 15), "uint32": ("int32", 1 << 31), "uint64": ("int64", 1 << 63)}
SPARK_TYPES = {"uint8": "smallint", "int8": "tinyint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}
#: Pixels of a section, at most; of a batch of rows; bytes copied at once.
SECTION, BATCH, COPY = 1 << 20, 1 << 18, 1 << 26
#: Tasks that an image is read by, at least, if it has as many sections; each reads SECTION pixels or one section, at most.
TASKS = 64
#: Bits of whole numbers, not below zero, that a type holds.
BITS = {"uint8": 8, "int8": 7, "uint16": 16, "int16": 15, "uint32": 32, "int32": 31, "uint64": 64, "int64": 63, "float32": 24, "float64": 53}
_NUMPY = {"double": "float64", "float": "float32", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64"}
_ARROW = {"double": pa.float64(), "float": pa.float32(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}


# -- stores and headers


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path within it."""
    if re.match(r"file:/+", path) or not re.match(r"[a-z][a-z0-9+.-]+:", path):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", path) if path.startswith("file:") else os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def _found(path: str) -> list[str]:
    """The files at a path: itself, those of a folder, or those that a pattern in its last part fits; in order."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    folder, pattern = (at, "*") if info.type == pafs.FileType.Directory else os.path.split(at)
    root = path[: len(path) - len(at)] if path.endswith(at) else ""
    inside = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(root + f.path for f in inside if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", ".")))


@dataclass
class Unit:
    """An image unit: shape, stored type, offset of its values, where its data lie in the file."""

    shape: tuple[int, ...]
    stored: str
    zero: int
    at: int

    @property
    def kind(self) -> str:
        return next((k for k, v in SHIFTED.items() if self.zero and v == (self.stored, self.zero)), self.stored)

    def values(self, raw: bytes) -> np.ndarray:
        stored = np.frombuffer(raw, np.dtype(self.stored).newbyteorder(">"))
        if not self.zero:
            return stored.astype(self.stored)
        if self.kind == self.stored:
            raise FileFormatError(f"offset {self.zero} of {self.stored}")
        if self.kind == "uint64":
            return stored.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        return (stored.astype(np.int64) + self.zero).astype(self.kind)


def _header(read: Callable[[int, int], bytes], at: int) -> tuple[dict[str, str], int]:
    """Keywords of the header at ``at``, and where its data begin."""
    told: dict[str, str] = {}
    while True:
        block = read(at, BLOCK)
        if len(block) < BLOCK:
            raise FileFormatError("the header has no end")
        at += BLOCK
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return told, at
            if card[8:10] == "= ":
                told.setdefault(key, card[10:].split("/")[0].strip())


def units(path: str) -> list[Unit]:
    """The image units of a file; only its headers are read."""
    store, inside = _store(path)
    with store.open_input_file(inside) as file:
        read, size = (lambda at, n: file.read_at(n, at)), file.size()
        if read(0, 9) != b"SIMPLE  =":
            raise FileFormatError(f"not a FITS file: {path}")
        out, at = [], 0
        while at < size:
            told, at = _header(read, at)
            bits = int(told["BITPIX"])
            shape = tuple(int(told[f"NAXIS{k + 1}"]) for k in range(int(told["NAXIS"])))
            if float(told.get("BSCALE", "1")) != 1:
                raise FileFormatError("scaled values are not supported")
            out.append(Unit(shape, next(k for k, b in BITPIX.items() if b == bits), int(float(told.get("BZERO", "0"))), at))
            at += -(-(math.prod(shape) * abs(bits) // 8 if shape else 0) // BLOCK) * BLOCK
    return out


@dataclass(frozen=True)
class _Cut:
    """How a shape is cut into sections: ``lanes`` are their ranges along the axis that is cut and the ones above it."""

    shape: tuple[int, ...]
    axis: int
    below: int
    thick: int
    lanes: tuple[range, ...]

    @classmethod
    def of(cls, shape: Sequence[int], most: int, wanted: Box | None = None) -> _Cut:
        """All sections of at most ``most`` pixels, or those that meet a box."""
        cut, below = 0, 1
        while cut < len(shape) - 1 and below * shape[cut] <= most:
            below *= shape[cut]
            cut += 1
        thick = max(1, most // below)
        inside = Box.from_shape(shape) if wanted is None else Box.from_shape(shape) & wanted
        steps = [thick, *(1 for _ in shape[cut + 1 :])]
        lanes = [range(f // t, b // t + 1) if inside.size else range(0) for f, b, t in zip(inside.front[cut:], inside.back[cut:], steps, strict=True)]
        return cls(tuple(shape), cut, below, thick, tuple(lanes))

    def __len__(self) -> int:
        return math.prod(map(len, self.lanes))

    def section(self, k: int) -> tuple[int, Box]:
        """First linear index and box of the k-th section."""
        at, *high = (int(lane[x]) for lane, x in zip(self.lanes, np.unravel_index(k, [len(x) for x in self.lanes], order="F"), strict=True))
        low, start, above = self.shape[: self.axis], at * self.thick, int(np.ravel_multi_index(high, self.shape[self.axis + 1 :], order="F")) if high else 0
        stop = min(start + self.thick, self.shape[self.axis])
        return (above * self.shape[self.axis] + start) * self.below, Box((*(0 for _ in low), start, *high), (*(s - 1 for s in low), stop - 1, *high))


def sections(shape: Sequence[int], most: int = SECTION) -> Iterator[tuple[int, Box]]:
    """(first linear index, box) of the sections of a shape: whole lower axes, a stretch of one axis, one coordinate of the higher ones."""
    cut = _Cut.of(shape, most)
    yield from map(cut.section, range(len(cut)))


# -- reading


class _Run(InputPartition):
    """Sections ``start`` to ``stop`` of an image unit."""

    def __init__(self, path: str, unit: Unit, cut: _Cut, start: int, stop: int) -> None:
        self.path, self.unit, self.cut, self.start, self.stop = path, unit, cut, start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str], kind: str) -> None:
        self.path, self.kind = path, kind
        self.hdu, self.most = int(options.get("hdu", "0")), int(options.get("section", SECTION))
        self.chunks, self.named = options.get("form", "pixels") == "chunks", options.get("named", "true") == "true"
        self.dimension = int(options["dimension"]) if "dimension" in options else None
        self.box = [tuple(map(int, side.split(","))) for side in options["box"].split(":")] if "box" in options else None

    def unit(self, path: str) -> Unit:
        found = units(path)
        if self.hdu >= len(found) or (self.dimension is not None and len(found[self.hdu].shape) != self.dimension):
            raise FileFormatError(f"{path} has no image of dimension {self.dimension} at {self.hdu}")
        return found[self.hdu]

    def partitions(self) -> Sequence[InputPartition]:
        files = _found(self.path)
        with ThreadPoolExecutor(16) as pool:
            told = list(pool.map(self.unit, files))
        wanted = None if self.box is None else Box(*self.box)
        out: list[InputPartition] = []
        for path, unit in zip(files, told, strict=True):
            if not unit.shape or not math.prod(unit.shape):
                continue
            cut = _Cut.of(unit.shape, self.most, wanted)
            # Small sections share a task, so tasks grow with the pixels and not with their cut.
            many = max(1, min(-(-len(cut) // TASKS), SECTION // (cut.below * min(cut.thick, unit.shape[cut.axis]))))
            out += [_Run(path, unit, cut, k, min(k + many, len(cut))) for k in range(0, len(cut), many)]
        return out

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        unit, width = partition.unit, np.dtype(partition.unit.stored).itemsize
        store, inside = _store(partition.path)
        found = map(partition.cut.section, range(partition.start, partition.stop))
        with store.open_input_file(inside) as file:
            if self.chunks:
                held: list[tuple[Box, np.ndarray]] = []
                pixels = 0
                for first, box in found:
                    if pixels + box.size > BATCH and held:
                        yield _chunk_rows(held)
                        held, pixels = [], 0
                    held.append((box, unit.values(file.read_at(box.size * width, unit.at + first * width)).astype(np.float64)))
                    pixels += box.size
                if held:
                    yield _chunk_rows(held)
                return
            names = axes(len(unit.shape))
            for first, size in _stretches(found):
                for start in range(first, first + size, BATCH):
                    n = min(BATCH, first + size - start)
                    part = unit.values(file.read_at(n * width, unit.at + start * width))
                    coords = np.unravel_index(np.arange(start, start + n), unit.shape, order="F")
                    v = pa.array(part.tolist(), _ARROW[self.kind]) if self.kind == "decimal(20,0)" else pa.array(part.astype(_NUMPY[self.kind]))
                    path = [pa.array([partition.path]).take(pa.array(np.zeros(n, np.int32)))] if self.named else []
                    yield pa.RecordBatch.from_arrays([*path, *(pa.array(c, pa.int64()) for c in coords), v], [*(["path"] if self.named else []), *names, "v"])


def _stretches(found: Iterable[tuple[int, Box]]) -> Iterator[tuple[int, int]]:
    """(first linear index, pixels) of sections, those joined that follow one another in the file."""
    first, size = 0, 0
    for start, box in found:
        if size and start != first + size:
            yield first, size
            size = 0
        first, size = (first, size + box.size) if size else (start, box.size)
    if size:
        yield first, size


def _chunk_rows(held: Sequence[tuple[Box, np.ndarray]]) -> pa.RecordBatch:
    boxes, values = zip(*held, strict=True)
    cols = [pa.array([list(x) for x in side], pa.list_(pa.int64())) for side in ([b.front for b in boxes], [b.shape for b in boxes])]
    flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values)))
    return pa.RecordBatch.from_arrays([*cols, flat], ["front", "shape", "values"])


# -- writing


@dataclass
class _Written(WriterCommitMessage):
    pixels: int


class _Writer(DataSourceArrowWriter):
    """Puts rows (idx, v), in ascending order within a section, at their places.

    Where the store has files that can be written at any place, all tasks write to one file; elsewhere every stretch
    is a file of its own, named by its first index, and ``write_fits`` joins them. What a task writes depends on its rows alone, so it may be
    done again.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind, self.at, self.size = options["path"], options["kind"], int(options["at"]), int(options["size"])
        self.placed = options["placed"] == "true"

    def check(self, v: np.ndarray) -> None:
        """Raises an error where the type doesn't hold a value, which a cast would wrap around."""
        least, most = v.min(), v.max()
        held = np.iinfo(self.kind)
        if least != least or not held.min <= int(least) <= int(most) <= held.max:
            raise FileFormatError(f"{self.kind} doesn't hold {least} to {most}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        stored, zero = SHIFTED.get(self.kind, (self.kind, 0))
        big = np.dtype(stored).newbyteorder(">")
        store, inside = _store(self.path)
        file = os.open(inside, os.O_WRONLY) if self.placed else None
        held: list[bytes] = []
        first, after, done = -1, -1, 0

        def flush() -> None:
            if held and file is not None:
                raw, at = memoryview(b"".join(held)), self.at + first * big.itemsize
                while len(raw):
                    wrote = os.pwrite(file, raw, at)
                    raw, at = raw[wrote:], at + wrote
            elif held:
                with store.open_output_stream(f"{inside}/{first:020d}") as out:
                    out.write(b"".join(held))
            held.clear()

        try:
            for batch in iterator:
                idx, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                if len(v) and "int" in self.kind:
                    self.check(v)
                v = (v.astype(object) - zero).astype(stored) if zero and self.kind == "uint64" else (v.astype(np.int64) - zero).astype(stored) if zero else v.astype(stored)
                cuts = np.flatnonzero(np.diff(idx) != 1) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(idx)], strict=True):
                    if a == b:
                        continue
                    if idx[a] == after - 1 or not 0 <= idx[a] <= idx[b - 1] < self.size:
                        raise SizeError(f"a pixel twice or outside at {idx[a]}", "one row for every position")
                    if idx[a] != after or (after - first) * big.itemsize >= COPY // 8:
                        flush()
                        first = int(idx[a])
                    held.append(v[a:b].astype(big).tobytes())
                    after = int(idx[b - 1]) + 1
                    done += int(b - a)
            flush()
        finally:
            if file is not None:
                os.close(file)
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        done = sum(m.pixels for m in messages if m is not None)
        if done != self.size:
            raise SizeError(done, self.size)


class FitsSource(DataSource):
    """``format("fits")``. Reading: ``path`` (a file, a folder or a pattern), ``hdu``, ``form`` (pixels or chunks), ``kind`` (a
    Spark type, by default that of the file), ``section`` (pixels), ``box`` ("0,0:9,9": only sections that meet it),
    ``named`` (whether pixel rows have their path). Writing is for ``write_fits``.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        if self.options.get("form", "pixels") == "chunks":
            return "front array<long>, shape array<long>, values array<double>"
        kind, n = self.options.get("kind"), self.options.get("dimension")
        if not kind or not n:
            files = _found(self.options["path"])
            if not files:
                raise PathMissingError(self.options["path"])
            unit = units(files[0])[int(self.options.get("hdu", "0"))]
            kind, n = kind or SPARK_TYPES[unit.kind], n or len(unit.shape)
        named = "path string, " if self.options.get("named", "true") == "true" else ""
        return named + "".join(f"{a} long, " for a in axes(int(n))) + f"v {kind}"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], dict(self.options), schema["v"].dataType.simpleString() if "v" in schema.names else "double")

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _source(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(FitsSource)
    return spark.read.format("fits").options(path=path, **options).load()


def _files(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(where):
        raise PathMissingError(path)
    return spark.read.format("binaryFile").load(path).select("path")


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, hdu, shape, kind) of every image unit under ``path``; tasks read headers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["path"].to_pylist():
                rows = [{"path": name, "hdu": k, "shape": list(u.shape), "kind": u.kind} for k, u in enumerate(units(name))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("hdu", pa.int32()), ("shape", pa.list_(pa.int64())), ("kind", pa.string())]))

    return _files(spark, path).mapInArrow(run, "path string, hdu int, shape array<long>, kind string")


def read_pixels(spark: SparkSession, path: str, dimension: int, hdu: int = 0, kind: str = "double") -> DataFrame:
    """(path, x0, …, v) of one image unit of every file under ``path`` (patterns and folders too); a task reads a section."""
    if not _found(path):
        raise PathMissingError(path)
    return _source(spark, path, hdu=hdu, kind=kind, dimension=dimension)


def _one(path: str, hdu: int) -> Unit:
    files = _found(path)
    if not files:
        raise PathMissingError(path)
    found = units(files[0]) if len(files) == 1 else []
    if hdu >= len(found):
        raise FileFormatError(f"{path} has no image unit {hdu}")
    return found[hdu]


def read_fits(spark: SparkSession, path: str, hdu: int = 0, kind: str | None = None, region: Box | None = None, section: int = SECTION) -> Raster:
    """The raster of one file; ``kind`` casts the pixels, by default they keep the type of the file.

    With a ``region`` only the sections that meet it are read, and the raster is that box, at its place.
    """
    unit = _one(path, hdu)
    options = {"hdu": hdu, "kind": kind or SPARK_TYPES[unit.kind], "dimension": len(unit.shape), "named": "false", "section": section}
    if region is None:
        return Raster(_source(spark, path, **options), unit.shape)
    inside = region & Box.from_shape(unit.shape)
    if not inside.size:
        raise SizeError(region, unit.shape)
    met = _source(spark, path, **options, box=":".join(",".join(map(str, side)) for side in (inside.front, inside.back)))
    return Raster(met.where(inside.predicate()), inside.shape, inside.front)


def read_fits_chunks(spark: SparkSession, path: str, hdu: int = 0, section: int = SECTION) -> DataFrame:
    """The raster of one file, a row (front, shape, values) per section."""
    _one(path, hdu)
    return _source(spark, path, hdu=hdu, form="chunks", section=section)


def to_planes(raster: Raster, kind: str) -> Raster:
    """Whole numbers as digits that ``kind`` holds, along a further axis, the lowest first; the highest has the sign.

    As many digits as the least and the greatest value need, so numbers that fit have one.
    """
    bits, signed = BITS[kind], not kind.startswith("u")
    value = F.col("v").cast("long")
    told = raster.df.agg(F.min(value), F.max(value)).first()
    least, most = (x or 0 for x in told)
    if least < 0 and not signed:
        raise FileFormatError(f"{kind} doesn't hold {least}")
    n = 1
    while not -(1 << bits) <= least >> bits * (n - 1) <= most >> bits * (n - 1) < 1 << bits:
        n += 1
    digits = [F.shiftright(value, bits * k) if k == n - 1 else F.shiftright(value, bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(n)]
    rows = raster.df.select(*raster.axes, F.posexplode(F.array(*digits)).alias("_plane", "v"))
    return Raster(rows.select(*raster.axes, F.col("_plane").cast("long").alias(f"x{raster.dimension}"), "v"), (*raster.shape, n), (*raster.front, 0))


def from_planes(raster: Raster, kind: str) -> Raster:
    """The whole numbers whose digits ``to_planes`` gave."""
    *axes_, plane = raster.axes
    shape, front = raster.shape[:-1], raster.front[:-1]
    if raster.shape[-1] == 1:
        return Raster(raster.df.select(*axes_, F.col("v").cast("long").alias("v")), shape, front)
    part = F.call_function("shiftleft", F.col("v").cast("long"), (F.col(plane) * BITS[kind]).cast("int"))
    return Raster(raster.df.groupBy(*axes_).agg(F.sum(part).alias("v")), shape, front)


def _card(key: str, value: str) -> bytes:
    return f"{key:<8}= {value:>20}".ljust(CARD).encode("ascii")


def _head(shape: tuple[int, ...], kind: str, first: bool) -> bytes:
    stored, zero = SHIFTED.get(kind, (kind, 0))
    cards = [_card("SIMPLE", "T") if first else f"XTENSION= '{'IMAGE':<8}'".ljust(CARD).encode("ascii"), _card("BITPIX", str(BITPIX[stored])), _card("NAXIS", str(len(shape)))]
    cards += [_card(f"NAXIS{k + 1}", str(n)) for k, n in enumerate(shape)]
    cards += [_card("EXTEND", "T")] if first else [_card("PCOUNT", "0"), _card("GCOUNT", "1")]
    cards += [_card("BSCALE", "1"), _card("BZERO", str(zero))] if zero else []
    raw = b"".join([*cards, b"END".ljust(CARD)])
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def _copied(spark: SparkSession, source: str, target: str, size: int) -> None:
    """The first ``size`` bytes of a file into another, by many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = _store(source)
        file = os.open(_store(target)[1], os.O_WRONLY)
        try:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    with store.open_input_file(inside) as old:
                        raw, at = memoryview(old.read_at(min(COPY, size - k * COPY), k * COPY)), k * COPY
                    while len(raw):
                        wrote = os.pwrite(file, raw, at)
                        raw, at = raw[wrote:], at + wrote
                yield batch
        finally:
            os.close(file)

    n = -(-size // COPY)
    spark.range(0, n, 1, n).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def _joined(spark: SparkSession, old: str | None, head: bytes, parts: str, target: str, size: int) -> None:
    """One file of the old one, a header, the parts in order, and the padding; one task streams them, as such stores write files from front to back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (store, inside), done = _store(target), 0
            with store.open_output_stream(inside) as out:
                for k, name in enumerate([*([old] if old else []), None, *_found(parts)]):
                    if name is None:
                        out.write(head)
                        done = 0
                        continue
                    from_, at = _store(name)
                    with from_.open_input_stream(at) as part:
                        while piece := part.read(COPY // 8):
                            out.write(piece)
                            done += len(piece)
                out.write(b"\0" * (-done % BLOCK))
            yield batch

    spark.range(0, 1, 1, 1).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def write_fits(raster: Raster, path: str, mode: str = "x", kind: str = "float64", placed: bool | None = None) -> None:
    """Write a raster: ``x`` a new file, ``w`` over an old one, ``a`` as a further image unit of an existing file.

    Pixels are shuffled to their sections and written by the executors; a raster that misses a position or has one
    twice raises an error and leaves what was there. The new file stands beside the old one until it is whole, then
    takes its name. ``placed``: whether tasks write at their places of one file, by default wherever the store is a
    file system; otherwise each writes files of its own, which one task joins.
    """
    if mode not in ("x", "w", "a"):
        raise ValueError(f"mode {mode}: x, w or a")
    if kind not in SPARK_TYPES:
        raise FileFormatError(f"FITS has no {kind} images")
    spark = raster.df.sparkSession
    store, inside = _store(path)
    there = store.get_file_info(inside).type != pafs.FileType.NotFound
    if mode == "x" and there:
        raise PathTakenError(path)
    if mode == "a" and not there:
        raise PathMissingError(path)
    placed = isinstance(store, pafs.LocalFileSystem) if placed is None else placed
    head, old = _head(raster.shape, kind, mode != "a"), store.get_file_info(inside).size if mode == "a" else 0
    width, part = np.dtype(SHIFTED.get(kind, (kind, 0))[0]).itemsize, path + ".part"
    new, data = _store(part)[1], old + len(head)
    rows = raster.df.select(raster.index().cast("long").alias("idx"), "v")
    ordered = rows.withColumn("section", F.expr(f"idx div {SECTION}")).repartition("section").sortWithinPartitions("section", "idx").select("idx", "v")
    spark.dataSource.register(FitsSource)
    try:
        if placed:
            with open(new, "wb") as file:
                file.truncate(data + -(-raster.size * width // BLOCK) * BLOCK)
                file.seek(old)
                file.write(head)
            if old:
                _copied(spark, path, part, old)
        else:
            store.create_dir(new)
        ordered.write.format("fits").mode("append").options(path=part, kind=kind, at=data, size=raster.size, placed=str(placed).lower()).save()
        if not placed:
            _joined(spark, path if mode == "a" else None, head, part, path + ".joined", raster.size * width)
            store.delete_dir(new)
            new = _store(path + ".joined")[1]
    except BaseException:
        info = store.get_file_info(new)
        if info.type == pafs.FileType.Directory:
            store.delete_dir(new)
        elif info.type == pafs.FileType.File:
            store.delete_file(new)
        raise
    if there and not isinstance(store, pafs.LocalFileSystem):
        store.delete_file(inside)
    store.move(new, inside)
