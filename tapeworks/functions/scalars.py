"""Scalar expressions: non-finite handling, activations, quantisation."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def clipped(x: Column, bound: float = 8.0) -> Column:
    """NaN and null become 0, infinities the bound, the rest is held within it, in that order."""
    return F.greatest(F.least(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(bound)), F.lit(-bound))


def softplus(x: Column) -> Column:
    """ln(1 + e^x), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def huber(x: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(x) <= delta, 0.5 * x * x).otherwise(delta * (F.abs(x) - 0.5 * delta))


def at_least(x: Column, floor: float) -> Column:
    return F.greatest(x, F.lit(floor))


def ratio(a: Column, b: Column, floor: float = EPS) -> Column:
    """a / b with b held above a positive floor."""
    return a / at_least(b, floor)


def cents(price: Column, scale: float = 100.0) -> Column:
    """A price in hundredths, halves to even."""
    return F.rint(price * scale).cast("long")


def r6(x: Column) -> Column:
    """Six decimals and no negative zero, for comparable results."""
    return F.round(x, 6) + F.lit(0.0)


def z_score(q: float) -> float:
    """The normal quantile, a constant of the plan."""
    return NormalDist().inv_cdf(min(max(q, 1e-4), 1 - 1e-4))


def decay(halflife: float) -> float:
    """What remains of an average after one step."""
    return 0.5 ** (1.0 / halflife)


def inverse_softplus(y: float) -> float:
    return math.log(math.expm1(max(y, 1e-6)))
