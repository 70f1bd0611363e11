"""Random values keyed by pixel: a value depends on seed and index alone, never on partitioning or on other pixels.

Each noise can be drawn (``draw``) or applied to values (``perturb``). Uniforms come from a hash that other engines
have too.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.raster import Raster


#: The largest Poisson mean that is drawn at once.
AT_ONCE = 500.0


def uniform(seed: int, index: Column, stream: int | Column = 0) -> Column:
    """A number in [0, 1) with 52 random bits."""
    number = stream if isinstance(stream, Column) else F.lit(stream)
    text = F.concat_ws(":", F.lit(str(seed)), number.cast("string"), index.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def gaussian(seed: int, index: Column, stream: int = 0) -> Column:
    """A standard normal number, by Box and Muller from two uniforms."""
    u, w = uniform(seed, index, 2 * stream), uniform(seed, index, 2 * stream + 1)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * w)


@dataclass(frozen=True)
class UniformNoise:
    """Reals from ``least`` (included) to ``most`` (excluded), or whole numbers with both ends; applied by adding."""

    least: float = 0.0
    most: float = 1.0
    whole: bool = False
    seed: int = 0

    def draw(self, index: Column) -> Column:
        u = uniform(self.seed, index)
        if self.whole:
            return (F.floor(u * (int(self.most) - int(self.least) + 1)) + int(self.least)).cast("long")
        return F.lit(float(self.least)) + u * float(self.most - self.least)

    def perturb(self, v: Column, index: Column) -> Column:
        return v + self.draw(index)


@dataclass(frozen=True)
class GaussianNoise:
    mean: float = 0.0
    stdev: float = 1.0
    whole: bool = False
    seed: int = 0

    def draw(self, index: Column) -> Column:
        drawn = F.lit(float(self.mean)) + gaussian(self.seed, index) * float(self.stdev)
        return drawn.cast("long") if self.whole else drawn

    def perturb(self, v: Column, index: Column) -> Column:
        return v + self.draw(index)


@dataclass(frozen=True)
class PoissonNoise:
    """Draws with a mean; applied as shot noise, where each value is the mean of its own draw.

    Draws by inversion: the least k at which the summed probabilities reach a uniform number of the pixel. A mean above
    ``AT_ONCE`` is the sum of equal smaller ones with a number each, so nothing underflows and all of it stays an
    expression. A pixel's result depends on seed, index and its value only; below 0 and for NaN it is NaN.
    """

    mean: float = 1.0
    seed: int = 0

    def draw(self, index: Column) -> Column:
        return self.perturb(F.lit(float(self.mean)), index)

    def perturb(self, v: Column, index: Column) -> Column:
        mean = v.cast("double")
        parts = F.greatest(F.ceil(mean / AT_ONCE), F.lit(1)).cast("int")
        share = mean / parts
        # Beyond this k the rest of the probability is below any uniform number's grain.
        most = F.ceil(share + 12 * F.sqrt(share) + 30).cast("int")
        empty = F.struct(F.exp(-share).alias("p"), F.exp(-share).alias("sum"), F.lit(0).alias("k"))

        def one(stream: Column) -> Column:
            u = uniform(self.seed, index, stream)
            step = lambda a, k: F.when(a["sum"] > u, a).otherwise(F.struct((a["p"] * share / k).alias("p"), (a["sum"] + a["p"] * share / k).alias("sum"), k.alias("k")))
            return F.aggregate(F.sequence(F.lit(1), most), empty, step, lambda a: a["k"])

        drawn = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda a, s: a + one(s)).cast("double")
        return F.when(mean >= 0, F.when(mean == math.inf, F.lit(math.inf)).otherwise(F.when(~F.isnan(mean), drawn).otherwise(F.lit(math.nan)))).otherwise(F.when(v.isNotNull(), F.lit(math.nan)))


#: Means from which rejection is used, and the tries that are made: each fails with a chance below 0.3, all with less than 1e-20.
REJECTED_FROM, TRIES = 10.0, 40
# Hörmann's constants of transformed rejection with squeeze (1993), for means of 10 and more.
SLOPE, SHAPE, TURN, SQUEEZE = (0.931, 2.53), (-0.059, 0.02483), (1.1239, 1.1328, 3.4), (0.9277, 3.6224, 2.0)


def log_poisson(k: Column, mean: Column) -> Column:
    """The logarithm of the chance of ``k`` for k >= 0, without the difference of large numbers that its plain form has."""
    x = (k - mean) / mean
    # Stirling's series beyond the factorials that are exact.
    rest = 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)
    far = mean * x - k * F.log1p(x) - 0.5 * F.ln(2 * math.pi * k) - rest
    return F.when(k > 15, far).otherwise(k * F.ln(mean) - mean - F.ln(F.factorial(F.least(F.greatest(k, F.lit(0)), F.lit(20)).cast("int")).cast("double")))


@dataclass(frozen=True)
class RejectionPoissonNoise(PoissonNoise):
    """Poisson draws whose time doesn't grow with the mean: by rejection from 10 on, by inversion below.

    A try takes two uniform numbers of its own, keyed by seed, index and the number of the try, so a pixel's result
    depends on nothing else. The first try that is accepted counts.
    """

    def perturb(self, v: Column, index: Column) -> Column:
        mean = F.least(v.cast("double"), F.lit(1e300))
        b = F.sqrt(mean) * SLOPE[1] + SLOPE[0]
        a = b * SHAPE[1] + SHAPE[0]
        turn, squeeze = F.lit(TURN[1]) / (b - TURN[2]) + TURN[0], F.lit(SQUEEZE[0]) - F.lit(SQUEEZE[1]) / (b - SQUEEZE[2])

        def tried(try_: Column) -> Column:
            """The try's number, or null if it is refused."""
            u, w = uniform(self.seed, index, 2 * try_) - 0.5, uniform(self.seed, index, 2 * try_ + 1)
            room = F.lit(0.5) - F.abs(u)
            k = F.floor((2 * a / room + b) * u + mean + 0.43).cast("double")
            held = F.ln(w) + F.ln(turn) - F.ln(a / (room * room) + b) <= log_poisson(k, mean)
            return F.when((room >= 0.07) & (w <= squeeze), k).when((k < 0) | ((room < 0.013) & (w > room)), None).when(held, k)

        drawn = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda found, try_: F.when(found.isNotNull(), found).otherwise(tried(try_)))
        large = (mean >= REJECTED_FROM) & ~F.isnan(mean) & (v.cast("double") < math.inf)
        return F.when(large, drawn).otherwise(super().perturb(F.when(large, F.lit(1.0)).otherwise(v.cast("double")), index))


@dataclass(frozen=True)
class ImpulseNoise:
    """Replaces values with given probabilities, in ascending order of value; the rest stays. Sums above 1 are scaled to 1."""

    chances: Mapping[float, float]
    seed: int = 0

    @classmethod
    def salt_and_pepper(cls, salt: float, pepper: float, most: float = 1.0, least: float = 0.0, seed: int = 0) -> ImpulseNoise:
        return cls({most: salt, least: pepper}, seed)

    def draw(self, index: Column) -> Column:
        return self.perturb(F.lit(0.0), index)

    def perturb(self, v: Column, index: Column) -> Column:
        u, below, scale = uniform(self.seed, index), 0.0, max(1.0, sum(self.chances.values()))
        out = None
        for value in sorted(self.chances):
            below += self.chances[value] / scale
            hit = u < below
            out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
        return v if out is None else out.otherwise(v)


def complex_draw(noise: UniformNoise | GaussianNoise, index: Column) -> Column:
    """Independent draws for the real and the imaginary part."""
    other = type(noise)(**{**noise.__dict__, "seed": noise.seed + 1_000_003})
    return F.struct(noise.draw(index).cast("double").alias("re"), other.draw(index).cast("double").alias("im"))


def apply_noise(raster: Raster, noise: UniformNoise | GaussianNoise | PoissonNoise | ImpulseNoise) -> Raster:
    index = raster.index()
    return raster.apply(lambda v: noise.perturb(v, index))


def draw_noise(raster: Raster, noise: UniformNoise | GaussianNoise | PoissonNoise | ImpulseNoise) -> Raster:
    index = raster.index()
    return raster.generate(lambda *_: noise.draw(index))


def random_raster(spark: SparkSession, shape: Sequence[int], least: float = 0.0, most: float = 1.0, seed: int = 0, whole: bool = False) -> Raster:
    """Uniform values."""
    return Raster.filled(spark, shape, UniformNoise(least, most, whole, seed).draw(F.col("idx")))
