"""Column expressions: logarithms, log-sum-exp, gamma, uniforms from hashes, binning, argmax."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")
#: Coefficients of Lanczos' approximation with g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def safe_ln(x: Column) -> Column:
    """ln with ln(0) = -inf; null for null and negative values."""
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(F.ln(x))


def lgamma(x: Column) -> Column:
    """ln of the gamma function for x > 0."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + k)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def lse_array(a: Column) -> Column:
    """log-sum-exp of an array of doubles; -inf if all are, or if it is empty."""
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(top.isNull() | (top == NEG_INF), F.lit(NEG_INF)).otherwise(top + F.ln(total))


def argmax_index(a: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) that depends on the parts only, never on partitioning: the first 32 bits of an md5."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_index(weights: Column, u: Column) -> Column:
    """The first place (0-based) at which the cumulative weights exceed u times their sum."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    step = F.aggregate(
        weights,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("at")),
        lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["i"] + 1).alias("i"), F.when((s["at"] < 0) & (s["sum"] + x > u * total), s["i"]).otherwise(s["at"]).alias("at")),
    )["at"]
    return F.when(step < 0, F.size(weights) - 1).otherwise(step)


def bin_right_closed(x: Column, edges: list[float]) -> Column:
    """How many inner edges lie below x: a bin has its right edge, and the outer bins what is beyond. Null stays null, NaN is above all."""
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1])) if len(edges) > 2 else F.expr("cast(array() as array<double>)")
    return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: x > e)))


def bin_digitize(x: Column, edges: list[float]) -> Column:
    """How many distinct edges are at or below x."""
    return F.when(x.isNotNull(), sum((x >= F.lit(float(e))).cast("int") for e in sorted(set(edges))))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; -inf becomes null and -0.0 becomes 0.0."""
    return F.when((x == NEG_INF) | F.isnan(x), F.lit(None)).otherwise(F.round(x, digits) + 0.0)
