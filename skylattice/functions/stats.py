"""Normal tails as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the normal quantile (fixed values, published).
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
_LOW = 0.02425


def _poly(c: tuple, x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + k
    return out


def normal_isf(p: Column) -> Column:
    """Sigma of a one-sided p-value: infinite for p of 0 and minus infinite for p of 1."""
    q = 1 - p
    r = (q - 0.5) * (q - 0.5)
    middle = (q - 0.5) * _poly(_A, r) / (_poly(_B, r) * r + 1)
    low = F.sqrt(-2 * F.ln(F.greatest(q, F.lit(1e-320))))
    high = F.sqrt(-2 * F.ln(F.greatest(p, F.lit(1e-320))))
    tail = lambda t: _poly(_C, t) / (_poly(_D, t) * t + 1)
    inside = F.when(q < _LOW, tail(low)).when(p < _LOW, -tail(high)).otherwise(middle)
    return F.when(p <= 0, F.lit(float("inf"))).when(p >= 1, F.lit(float("-inf"))).otherwise(inside)


def normal_sf(z: Column) -> Column:
    """Upper tail of the normal law: a power series in the middle, a continued fraction beyond 2.5."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) * 0.3989422804014327
    series = F.lit(1.0)
    for k in range(39, -1, -1):
        series = 1 + x * x / (2 * k + 3) * series
    series = x * series
    fraction = x
    for k in range(30, 0, -1):
        fraction = x + k / fraction
    upper = F.when(x < 2.5, 0.5 - density * series).otherwise(density / fraction)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def p_to_sigma(p: Column) -> Column:
    return normal_isf(p)
