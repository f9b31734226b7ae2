"""Numeric expressions that plans share.  All take and return columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounds halves towards +infinity; ``F.round`` takes them away from zero."""
    return F.floor(x + F.lit(0.5))


def half_up_to(x: Column, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    return half_up(x * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)


def dot(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, the lengths differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(fine, dot(a, b) / norms).otherwise(F.lit(0.0))


def steps(x: Column, bounds: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first bound that x doesn't exceed."""
    out = None
    for bound, value in bounds:
        out = F.when(x <= bound, F.lit(value)) if out is None else out.when(x <= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def tiers(x: Column, floors: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first floor that x reaches."""
    out = None
    for floor, value in floors:
        out = F.when(x >= floor, F.lit(value)) if out is None else out.when(x >= floor, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def nearest_rank(p: float, x: Column) -> Column:
    """An aggregate: the value at rank ceil(p * n) of the ordered values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x._jc.toString()})")


def confidence_level(score: Column) -> Column:
    return tiers(score, [(0.8, "high"), (0.5, "medium"), (0.3, "low")], "uncertain")


def decayed(heat: Column, factor: float, elapsed: Column, interval: float) -> Column:
    return heat * F.pow(F.lit(factor), elapsed / F.lit(interval))


def false_positive_rate(bits: int, hashes: int, items: Column) -> Column:
    """Of a Bloom filter."""
    return F.pow(1 - F.exp(-F.lit(float(hashes)) * items / F.lit(float(bits))), F.lit(float(hashes)))


def optimal_bits(items: Column, rate: float) -> Column:
    return F.ceil(-items * F.log(F.lit(rate)) / F.pow(F.log(F.lit(2.0)), 2))


def optimal_hashes(bits: Column, items: Column) -> Column:
    return F.greatest(F.lit(1), half_up(bits / items * F.log(F.lit(2.0))))
