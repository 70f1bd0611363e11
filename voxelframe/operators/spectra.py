"""Discrete Fourier transforms, one axis after the other; values are structs of re and im.

Spark gathers the lines of an axis, NumPy transforms a batch of lines at once. A line longer than ``LINE`` is cut in two
axes and transformed along one, then the other (the four-step transform), as often as its factors need; lengths without
factors become convolutions of a length that has them. Meanwhile a value is a row (i, re, im), i counting the values of a
line without gap, line after line, so a step is one shuffle and one sort by a whole number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import complex_multiply, complex_of
from ..plans.errors import SizeError
from ..plans.raster import Raster

#: Values of a line that one task transforms whole.
LINE = 1 << 20


#: A function of places and complex values; it may leave values out.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class _Lines:
    """Rows (i, re, im) that ``make`` makes of those of ``df``, and what is done to them on the way, within the same task."""

    df: DataFrame
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]] | None = None
    steps: tuple[Step, ...] = ()

    def then(self, step: Step) -> _Lines:
        return replace(self, steps=(*self.steps, step))

    def rows(self) -> DataFrame:
        make, steps = self.make or _read, self.steps
        if self.make is None and not steps:
            return self.df

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, z in make(batches):
                for step in steps:
                    i, z = step(i, z)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.ascontiguousarray(z.real)), pa.array(np.ascontiguousarray(z.imag) if np.iscomplexobj(z) else np.zeros(len(z)))], ["i", "re", "im"])

        return self.df.mapInArrow(run, "i long, re double, im double")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        i, re, im = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield i, re + 1j * im


def _pass(lines: _Lines, n: int, kind: str, size: int, have: Callable[[np.ndarray], np.ndarray] | None = None) -> _Lines:
    """Transform lines of ``n`` values: fft, ifft (not scaled), rfft (keeps n // 2 + 1 terms) or irfft (to ``size`` real terms, as re, scaled).

    i is line * n + place, then line * ``size`` + place. ``have``: how many values the given lines have, the rest being 0.
    """
    names = ["i", "re"] if kind == "rfft" else ["i", "re", "im"]
    turn = {"fft": np.fft.fft, "ifft": lambda z: np.fft.ifft(z, norm="forward"), "rfft": np.fft.rfft, "irfft": lambda z: np.fft.irfft(z, size)}[kind]

    def made(cols: list[np.ndarray], last: bool) -> tuple[tuple[np.ndarray, np.ndarray] | None, list[np.ndarray]]:
        """What comes of the whole lines, and the rows that are left."""
        line, place = np.divmod(cols[0], n)
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        if not last:
            first, stop = first[:-1], int(first[-1])
            line, place, cols, rest = line[:stop], place[:stop], [c[:stop] for c in cols], [c[stop:] for c in cols]
        else:
            rest = [c[:0] for c in cols]
        if not len(first):
            return None, rest
        lengths, number = np.diff(np.append(first, len(line))), line[first]
        if (lengths != (n if have is None else have(number))).any() or (place != np.arange(len(place)) - np.repeat(first, lengths)).any():
            raise SizeError("a line that lacks a value, or has one twice", n)
        values = cols[1] if kind == "rfft" else cols[1] + 1j * cols[2]
        if have is None:
            whole = values.reshape(-1, n)
        else:
            whole = np.zeros((len(first), n), values.dtype)
            whole[np.repeat(np.arange(len(first)), lengths), place] = values
        return ((number[:, None] * size + np.arange(size)).ravel(), turn(whole).ravel()), rest

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in held) > max(n, 1 << 16):
                out, rest = made([np.concatenate(c) for c in zip(*held, strict=True)], False)
                held = [rest]
                if out is not None:
                    yield out
        if sum(len(x[0]) for x in held):
            yield made([np.concatenate(c) for c in zip(*held, strict=True)], True)[0]

    return _Lines(lines.rows().select(*names).repartition(_div("i", n)).sortWithinPartitions("i"), make)


def _div(x: Column | str, n: int) -> Column:
    return F.call_function("div", F.col(x) if isinstance(x, str) else x, F.lit(n).cast("long"))


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        while n % k == 0:
            out.append(k)
            n //= k
        k += 1
    return out + [n] * (n > 1)


def _leaves(n: int, line: int) -> list[int]:
    """Lengths whose product is ``n``, few and alike: of at most ``line``, the greatest first, then primes above it."""
    primes = _primes(n)
    left, out = math.prod(p for p in primes if p <= line), []
    while left > 1:
        parts = {1}
        for p in _primes(left):
            parts |= {x * p for x in parts if x * p <= line}
        steps = next(k for k in range(1, 64) if line**k >= left)
        wanted = [x for x in parts if x**steps >= left]
        out.append(min(wanted) if wanted else max(parts))
        left //= out[-1]
    return sorted(out, reverse=True) + [p for p in primes if p > line]


def _length_for(n: int, line: int) -> int:
    """A length of at least 2 n - 1 that is cheap to transform: the fewest steps times values."""
    found, least = [], 2 * n - 1
    numbers = [1]
    for p in (2, 3, 5, 7):
        numbers = [x * p**k for x in numbers for k in range((4 * n).bit_length()) if x * p**k < 4 * n]
    for m in numbers:
        if m >= least:
            leaves = _leaves(m, line)
            # Every line of the first step then has a value that isn't padding.
            if m // leaves[0] <= n:
                found.append((m * len(leaves), m))
    return min(found)[1]


def _turn(parts: np.ndarray, n: int, sign: int) -> np.ndarray:
    """exp(sign * 2 pi i * parts / n) for whole ``parts``, which are reduced first, so nothing is lost in long lines."""
    return np.exp((sign * 2j * math.pi / n) * (parts % n))


def _folded(lines: _Lines, n: int, short: int) -> _Lines:
    """Lines of n = ``short`` * long as those of every long-th value."""
    long = n // short
    return lines.then(lambda i, z: ((i // n * long + i % long) * short + i % n // long, z))


def _rest(first: _Lines, n: int, short: int, kept: int, sign: int, leaves: list[int], line: int) -> _Lines:
    """What follows the transform of ``_folded`` lines, of which ``kept`` terms are there: turned, transformed over the rest; i is (line * kept + c) * long + d for term c + short * d."""
    long = n // short

    def turned(i: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, c = i // kept % long, i % kept
        return (i // (kept * long) * kept + c) * long + b, z * _turn(b * c, n, sign)

    return _fft(first.then(turned), long, sign, leaves, line)


def _fft(lines: _Lines, n: int, sign: int, leaves: list[int], line: int, have: int | None = None) -> _Lines:
    """Complex transform of lines of ``n`` values by its leaves, not scaled; of the values only the first ``have`` are there, the others being 0."""
    kind = "ifft" if sign > 0 else "fft"
    if len(leaves) == 1:
        if n > line:
            return _chirped(lines, n, sign, line)
        return _pass(lines, n, kind, n, None if have is None else lambda number: np.full(len(number), have))
    short = leaves[0]
    long, folded = n // short, _folded(lines, n, short)
    if short > line:
        first = _chirped(folded, short, sign, line)
    else:
        first = _pass(folded, short, kind, short, None if have is None else lambda number: -((number % long - have) // long))
    done = _rest(first, n, short, short, sign, leaves[1:], line)
    return done.then(lambda i, z: (i // n * n + i % n // long + short * (i % long), z))


def _real(lines: _Lines, n: int, line: int) -> _Lines:
    """The first n // 2 + 1 terms of long real lines: the first step keeps half of its terms, the others being conjugates."""
    leaves, size = _leaves(n, line), n // 2 + 1
    short = leaves[0]
    long, half = n // short, short // 2 + 1
    if short > line:
        return _fft(lines, n, -1, leaves, line).then(lambda i, z: ((i // n * size + i % n)[i % n < size], z[i % n < size]))
    done = _rest(_pass(_folded(lines, n, short), short, "rfft", half), n, short, half, -1, leaves[1:], line)

    def told(i: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = i // long % half
        k = c + short * (i % long)
        low = 2 * k <= n
        found = low | (c != 0) & (2 * c != short)
        return (i // (half * long) * size + np.where(low, k, n - k))[found], np.where(low, z, z.conj())[found]

    return done.then(told)


def _wave(i: np.ndarray, n: int, m: int, sign: int) -> np.ndarray:
    """The chirp that lines of ``n`` values are convolved with, as a periodic line of ``m``. Half of j * j turns of n parts: j * j parts of 2 n."""
    away = np.minimum(i, m - i)
    return np.where(away < n, _turn(away * away, 2 * n, -sign), 0)


@lru_cache(4)
def _spectrum(n: int, m: int, sign: int) -> np.ndarray:
    return np.fft.fft(_wave(np.arange(m), n, m, sign))


def _chirped(lines: _Lines, n: int, sign: int, line: int) -> _Lines:
    """Lines whose length has no good factors, as a convolution with a chirp, of a length that has them (Bluestein)."""
    m = _length_for(n, line)
    leaves = _leaves(m, line)

    def before(i: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = i % n
        return i // n * m + j, z * _turn(j * j, 2 * n, sign)

    def after(i: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, z = i[i % m < n], z[i % m < n]
        j = i % m
        return i // m * n + j, z * _turn(j * j, 2 * n, sign) / m

    spectrum = _fft(lines.then(before), m, -1, leaves, line, n)
    if m <= LINE:
        # It depends on the lengths alone; every task makes it.
        product = spectrum.then(lambda i, z: (i, z * _spectrum(n, m, sign)[i % m]))
    else:
        wave = _Lines(lines.df.sparkSession.range(m).select(F.col("id").alias("i"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))
        other = _fft(wave.then(lambda i, z: (i, _wave(i, n, m, sign))), m, -1, leaves, line).rows().select(F.col("i").alias("_x"), complex_of(F.col("re"), F.col("im")).alias("_w"))
        met = spectrum.rows().join(other, F.col("i") % m == F.col("_x")).select("i", complex_multiply(complex_of(F.col("re"), F.col("im")), F.col("_w")).alias("v"))
        product = _Lines(met.select("i", "v.re", "v.im"))
    return _fft(product, m, 1, leaves, line).then(after)


def _along(raster: Raster, axis: int, kind: str, length: int, line: int) -> Raster:
    """Transform along ``axis``: fft, ifft, rfft (keeps n // 2 + 1 terms) or irfft (to ``length`` real terms, as re)."""
    shape, name, line = raster.shape, f"x{axis}", max(line, 8)
    n, i = length if kind == "irfft" else shape[axis], F.col("i")
    size = n // 2 + 1 if kind == "rfft" else n
    if kind == "irfft" and n > line:
        # The other half are the conjugates; the terms that are their own have no imaginary part.
        own = (F.col(name) == 0) | (2 * F.col(name) == n)
        half = raster.df.select(*raster.axes, F.when(own, complex_of(F.col("v.re"))).otherwise(F.col("v")).alias("v"))
        rest = half.where(~own).withColumn(name, n - F.col(name)).withColumn("v", complex_of(F.col("v.re"), -F.col("v.im")))
        whole = Raster(half.unionByName(rest), tuple(n if k == axis else s for k, s in enumerate(shape)))
        return _along(whole, axis, "ifft", 0, line).apply(lambda v: complex_of(v["re"]))
    above, stride = F.lit(0).cast("long"), 1
    coords = {}
    for k, (a, s) in enumerate(zip(raster.axes, shape, strict=True)):
        if k != axis:
            above = above + F.col(a) * stride
            coords[a] = _div(_div(i, size), stride) % s
            stride *= s
    coords[name] = i % size
    lines = _Lines(raster.df.select((above * shape[axis] + F.col(name)).alias("i"), F.col("v.re").alias("re"), F.col("v.im").alias("im")))
    if n <= line:
        made = _pass(lines, shape[axis], kind, size)
    else:
        made = _real(lines, n, line) if kind == "rfft" else _fft(lines, n, 1 if kind == "ifft" else -1, _leaves(n, line), line)
    if kind == "ifft":
        made = made.then(lambda i, z: (i, z / n))
    return Raster(made.rows().select(*(coords[a].alias(a) for a in raster.axes), F.struct("re", "im").alias("v")), tuple(size if k == axis else s for k, s in enumerate(shape)))


def _complex(raster: Raster) -> Raster:
    based = raster.crop(raster.domain)
    return based if raster.df.schema["v"].dataType.typeName() == "struct" else based.apply(lambda v: complex_of(v))


def complex_dft(raster: Raster, line: int | None = None) -> Raster:
    """Forward, sign -, not scaled."""
    out = _complex(raster)
    for axis in range(raster.dimension):
        out = _along(out, axis, "fft", 0, line or LINE)
    return out


def inverse_complex_dft(raster: Raster, line: int | None = None) -> Raster:
    """Normalised by the number of pixels."""
    out = _complex(raster)
    for axis in range(raster.dimension):
        out = _along(out, axis, "ifft", 0, line or LINE)
    return out


def real_dft(raster: Raster, axes: Sequence[int] | None = None, line: int | None = None) -> Raster:
    """Forward of a real raster, not scaled; the first axis keeps n // 2 + 1 terms, the rest being their conjugates. Over all axes, or over some: line by line."""
    first, *others = axes if axes is not None else range(raster.dimension)
    out = _along(_complex(raster), first, "rfft", 0, line or LINE)
    for axis in others:
        out = _along(out, axis, "fft", 0, line or LINE)
    return out


def inverse_real_dft(spectrum: Raster, shape: tuple[int, ...], line: int | None = None) -> Raster:
    """The real raster of ``shape``; normalised."""
    if spectrum.shape != (shape[0] // 2 + 1, *shape[1:]):
        raise SizeError(spectrum.shape, (shape[0] // 2 + 1, *shape[1:]))
    out = _complex(spectrum)
    for axis in range(len(shape) - 1, 0, -1):
        out = _along(out, axis, "ifft", 0, line or LINE)
    return _along(out, 0, "irfft", shape[0], line or LINE).apply(lambda v: v["re"])


def fourier_convolve(a: Raster, b: Raster) -> Raster:
    """Periodic convolution of two real rasters of one shape."""
    spectrum = real_dft(a).apply(complex_multiply, real_dft(b))
    return inverse_real_dft(spectrum, a.shape)


def derivative(raster: Raster, axis: int = 0, period: float | None = None) -> Raster:
    """Derivative of a periodic raster along an axis; ``period`` is the length of the axis in the unit wanted (n by default)."""
    n = raster.shape[axis]
    unit = 2 * math.pi / (period or n)
    x = F.col(f"x{axis}")
    k = F.when(x * 2 < n, x).when(x * 2 == n, F.lit(0)).otherwise(x - n) * unit
    spectrum = real_dft(raster).apply(lambda v: complex_of(-k * v["im"], k * v["re"]))
    return inverse_real_dft(spectrum, raster.shape)


class DftPlan:
    """A transform of one kind and shape, to be applied to any raster of that shape."""

    def __init__(self, shape: tuple[int, ...], kind: str = "real") -> None:
        self.shape, self.kind = tuple(shape), kind

    @property
    def normalization_factor(self) -> int:
        return math.prod(self.shape)

    def transform(self, raster: Raster) -> Raster:
        if raster.shape != self.shape:
            raise SizeError(raster.shape, self.shape)
        return real_dft(raster) if self.kind == "real" else complex_dft(raster)

    def inverse(self, spectrum: Raster, normalize: bool = True) -> Raster:
        out = inverse_real_dft(spectrum, self.shape) if self.kind == "real" else inverse_complex_dft(spectrum)
        if normalize:
            return out
        n = float(self.normalization_factor)
        return out.apply(lambda v: v * n if self.kind == "real" else complex_of(v["re"] * n, v["im"] * n))

    def compose(self, f: Callable[[Column], Column], normalize: bool = True) -> Callable[[Raster], Raster]:
        """There, ``f`` on the terms (their coordinates are at hand as x0, …), and back, as one function of rasters."""
        return lambda raster: self.inverse(self.transform(raster).apply(f), normalize)
