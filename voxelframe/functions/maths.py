"""Pixel functions with IEEE and C semantics where Spark's own differ.

Spark raises on zero division, gives null for logarithms of non-positive numbers, returns integers from floor and ceil
(NaN becomes 0 there), and orders NaN above all. The functions here follow the floating-point standard instead. They
are expressions, so they fuse into one projection; only logb leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

EXACT = float(1 << 53)


def _nan() -> Column:
    return F.lit(math.nan)


def _inf() -> Column:
    return F.lit(math.inf)


def _d(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def is_nan(x: Column) -> Column:
    return F.isnan(_d(x))


def negative(x: Column) -> Column:
    """The sign bit, set for -0.0 too."""
    return (_d(x) < 0) | ((_d(x) == 0) & (_d(x).cast("string") == "-0.0"))


# -- arithmetic


def divide(a: Column, b: Column | float) -> Column:
    """Floating division; x / 0 is infinite or NaN."""
    a, b = _d(a), _d(b)
    at_zero = F.when(is_nan(a) | (a == 0), _nan()).otherwise(F.when(negative(a) == negative(b), _inf()).otherwise(-_inf()))
    return F.when(b == 0, at_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def divide_whole(a: Column, b: Column | int) -> Column:
    """Whole division, truncated toward zero, exact for all 64-bit numbers; null for a zero divisor, which has no whole result."""
    b = (b if isinstance(b, Column) else F.lit(b)).cast("long")
    return F.call_function("div", a.cast("long"), F.nullif(b, F.lit(0).cast("long")))


def remainder(a: Column, b: Column | float) -> Column:
    """Remainder with the dividend's sign; NaN for a zero divisor of floating values, null for a whole one."""
    b = b if isinstance(b, Column) else F.lit(b)
    return a % F.nullif(b, F.lit(0))


def fmod(a: Column, b: Column | float) -> Column:
    a, b = _d(a), _d(b)
    return F.when((b == 0) | is_nan(a) | is_nan(b) | (F.abs(a) == _inf()), _nan()).otherwise(F.when(F.abs(b) == _inf(), a).otherwise(a % F.nullif(b, F.lit(0.0))))


def maximum(a: Column, b: Column | float) -> Column:
    """The first operand unless it is less than the second; so NaN in front stays and NaN behind is passed over."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(_less(a, b), b).otherwise(a)


def minimum(a: Column, b: Column | float) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(_less(b, a), b).otherwise(a)


def _less(a: Column, b: Column) -> Column:
    return (a < b) & ~is_nan(a) & ~is_nan(b)


def fdim(a: Column, b: Column | float) -> Column:
    a, b = _d(a), _d(b)
    return F.when(is_nan(a) | is_nan(b), _nan()).otherwise(F.when(a > b, a - b).otherwise(F.lit(0.0)))


# -- rounding


def _rounded(x: Column, f: Callable[[Column], Column]) -> Column:
    x = _d(x)
    return F.when(is_nan(x) | (F.abs(x) >= EXACT), x).otherwise(f(x))


def floor(x: Column) -> Column:
    return _rounded(x, lambda v: F.floor(v).cast("double"))


def ceil(x: Column) -> Column:
    return _rounded(x, lambda v: F.ceil(v).cast("double"))


def trunc(x: Column) -> Column:
    return _rounded(x, lambda v: F.signum(v) * F.floor(F.abs(v)).cast("double"))


def round_half_away(x: Column) -> Column:
    return _rounded(x, lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5).cast("double"))


# -- logarithms


def _log(x: Column, f: Callable[[Column], Column], pole: float = 0.0) -> Column:
    x = _d(x)
    return F.when(is_nan(x) | (x < pole), _nan()).otherwise(F.when(x == pole, -_inf()).otherwise(f(x)))


def log(x: Column) -> Column:
    return _log(x, F.log)


def log2(x: Column) -> Column:
    return _log(x, F.log2)


def log10(x: Column) -> Column:
    return _log(x, F.log10)


def log1p(x: Column) -> Column:
    return _log(x, F.log1p, -1.0)


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), _d(x))


@pandas_udf(DoubleType())
def _exponent(x: pd.Series) -> pd.Series:
    v = np.abs(x.to_numpy(np.float64))
    with np.errstate(all="ignore"):
        out = np.frexp(v)[1] - 1.0
    return pd.Series(np.where(v == 0, -np.inf, np.where(np.isfinite(v), out, np.abs(v))))


def _kept_nan(result: Column, x: Column) -> Column:
    """NaN comes back from pandas as null; only nulls that went in are nulls."""
    return F.coalesce(result, F.when(x.isNotNull(), _nan()))


def logb(x: Column) -> Column:
    """The binary exponent: -inf for 0, inf for infinities, NaN for NaN."""
    return _kept_nan(_exponent(_d(x)), x)


def ilogb(x: Column) -> Column:
    """``logb`` as an integer; null for 0, infinities and NaN."""
    e = logb(x)
    return F.when(is_nan(e) | (F.abs(e) == _inf()), F.lit(None)).otherwise(e).cast("int")


# -- hyperbolic, powers


def asinh(x: Column) -> Column:
    """Odd by construction: Spark's own loses large negative numbers."""
    return F.signum(_d(x)) * F.asinh(F.abs(_d(x)))


def abspow(x: Column, p: int) -> Column:
    """|x| ** p, and for p = 0 whether x isn't 0."""
    return F.when(x != 0, 1.0).otherwise(0.0) if p == 0 else F.pow(F.abs(_d(x)), F.lit(float(p)))


# -- special functions


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Highest power first."""
    return reduce(lambda sum_, c: sum_ * x + c, coefficients[1:], F.lit(coefficients[0]))


# Cody's rational approximations (1969), highest power first, for |x| up to 0.46875, up to 4, and beyond.
NEAR = [1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3], [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
MIDDLE = (
    [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
    [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3],
)
FAR = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4], [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _ratio(x: Column, parts: tuple[Sequence[float], Sequence[float]]) -> Column:
    return _polynomial(x, parts[0]) / _polynomial(x, parts[1])


def _erf_near(x: Column) -> Column:
    return x * _ratio(x * x, NEAR)


def _erfc_beyond(size: Column) -> Column:
    """erfc for ``size`` > 0.46875; the rounding of its square is taken care of by splitting off a part of four bits behind the point."""
    coarse = F.floor(size * 16) / 16
    bell = F.exp(-coarse * coarse) * F.exp(-(size - coarse) * (size + coarse))
    inverse = F.lit(1.0) / (size * size)
    far = (F.lit(1 / math.sqrt(math.pi)) - inverse * _ratio(inverse, FAR)) / size
    return F.when(size > 28, 0.0).when(size <= 4, bell * _ratio(size, MIDDLE)).otherwise(bell * far)


def erf(x: Column) -> Column:
    x = _d(x)
    far = F.signum(x) * (1 - _erfc_beyond(F.abs(x)))
    return F.when(F.isnan(x), x).when(F.abs(x) <= 0.46875, _erf_near(x)).otherwise(far)


def erfc(x: Column) -> Column:
    x = _d(x)
    far = _erfc_beyond(F.abs(x))
    return F.when(F.isnan(x), x).when(F.abs(x) <= 0.46875, 1 - _erf_near(x)).when(x > 0, far).otherwise(2 - far)


# Lanczos coefficients for g = 7 and nine terms.
LANCZOS_G = 7.0
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def _lanczos(z: Column) -> Column:
    """The sum for gamma(z + 1), z > -1/2."""
    return reduce(lambda sum_, k: sum_ + F.lit(LANCZOS[k]) / (z + k), range(1, len(LANCZOS)), F.lit(LANCZOS[0]))


def _sine_of_turns(x: Column) -> Column:
    """sin(pi x), exact in its zeros."""
    return F.sin((x - F.rint(x)) * math.pi) * F.when(F.rint(x) % 2 == 0, 1.0).otherwise(-1.0)


def tgamma(x: Column) -> Column:
    """The gamma function; NaN for negative whole numbers and -inf, infinite with the sign of a zero."""
    x = _d(x)
    low = x < 0.5
    # Both sides stay within what doubles hold: beyond 172 the result is infinite, below -185 it is 0.
    z = F.greatest(F.least(F.when(low, -x).otherwise(x - 1), F.lit(190.0)), F.lit(-0.5))
    t = z + LANCZOS_G + 0.5
    # Squared at the end, as the power alone would pass what doubles hold.
    found = F.pow(F.pow(t, (z + 0.5) / 2) * F.exp(-t / 2), F.lit(2.0)) * _lanczos(z) * math.sqrt(2 * math.pi)
    found = F.when(z > 170.7, _inf()).otherwise(found)
    whole = F.when((x == F.floor(x)) & (x >= 1) & (x <= 21), F.factorial((F.least(F.greatest(x, F.lit(1.0)), F.lit(21.0)) - 1).cast("int")).cast("double"))
    mirrored = F.lit(math.pi) / (F.nullif(_sine_of_turns(x), F.lit(0.0)) * found)
    pole = F.when(negative(x), -_inf()).otherwise(_inf())
    result = F.when(F.isnan(x), x).when(x == _inf(), x).when(x == 0, pole).when((x < 0) & (x == F.floor(x)), _nan())
    return result.otherwise(F.coalesce(whole, F.when(low, F.when(x < -185, 0.0).otherwise(mirrored)).otherwise(found)))


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function's absolute value; infinite at its poles."""
    x = _d(x)
    low = x < 0.5
    z = F.when(low, -x).otherwise(x - 1)
    held = F.greatest(z, F.lit(-0.5))
    t = held + LANCZOS_G + 0.5
    found = (held + 0.5) * F.ln(t) - t + F.ln(_lanczos(held) * math.sqrt(2 * math.pi))
    mirrored = F.ln(F.lit(math.pi) / F.nullif(F.abs(_sine_of_turns(x)), F.lit(0.0))) - found
    result = F.when(F.isnan(x), x).when(F.abs(x) == _inf(), _inf()).when((x <= 0) & (x == F.floor(x)), _inf()).when((x == 1) | (x == 2), 0.0)
    return result.otherwise(F.when(low, mirrored).otherwise(found))


#: Functions of one value by name.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "ceil": ceil, "floor": floor, "trunc": trunc, "round": round_half_away,
    "cos": lambda x: F.cos(_d(x)), "sin": lambda x: F.sin(_d(x)), "tan": lambda x: F.tan(_d(x)),
    "acos": lambda x: F.acos(_d(x)), "asin": lambda x: F.asin(_d(x)), "atan": lambda x: F.atan(_d(x)),
    "cosh": lambda x: F.cosh(_d(x)), "sinh": lambda x: F.sinh(_d(x)), "tanh": lambda x: F.tanh(_d(x)),
    "acosh": lambda x: F.when(_d(x) < 1, _nan()).otherwise(F.acosh(_d(x))), "asinh": asinh,
    "atanh": lambda x: F.when(F.abs(_d(x)) > 1, _nan()).when(F.abs(_d(x)) == 1, F.signum(_d(x)) * _inf()).otherwise(F.atanh(_d(x))),
    "exp": lambda x: F.exp(_d(x)), "exp2": exp2, "expm1": lambda x: F.expm1(_d(x)),
    "log": log, "log2": log2, "log10": log10, "log1p": log1p, "logb": logb, "ilogb": ilogb,
    "sqrt": lambda x: F.sqrt(_d(x)), "cbrt": lambda x: F.cbrt(_d(x)),
    "erf": erf, "erfc": erfc, "tgamma": tgamma, "lgamma": lgamma,
    "negate": lambda x: -x, "increment": lambda x: x + 1, "decrement": lambda x: x - 1,
}

#: Functions of two values by name.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b,
    "divide": divide, "divide_whole": divide_whole, "remainder": remainder, "fmod": fmod,
    "max": maximum, "min": minimum, "fdim": fdim,
    "atan2": lambda a, b: F.atan2(_d(a), _d(b)), "pow": lambda a, b: F.pow(_d(a), _d(b)), "hypot": lambda a, b: F.hypot(_d(a), _d(b)),
}


# -- complex values: structs of re and im


def complex_of(re: Column, im: Column | float = 0.0) -> Column:
    return F.struct(_d(re).alias("re"), _d(im).alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def modulus(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def argument(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def squared_modulus(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def conjugate(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


# -- channels


def weighted_sum(channels: list[Column], weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, (c * w for c, w in zip(channels, weights, strict=True)))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and value (both 0 to 1) of channels from 0 to 255, as a struct."""
    r, g, b = (_d(c) / 255.0 for c in (r, g, b))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    spread = F.nullif(most - least, F.lit(0.0))
    sector = F.when(most == r, (g - b) / spread).when(most == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
    hue = F.coalesce(F.pmod(sector * 60.0, F.lit(360.0)), F.lit(0.0))
    return F.struct(hue.alias("h"), F.coalesce((most - least) / F.nullif(most, F.lit(0.0)), F.lit(0.0)).alias("s"), most.alias("v"))
