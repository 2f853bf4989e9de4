"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in kilometres (fixed value).
EARTH_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Decay of a hop h out of k.
DECAYS = {
    "none": lambda h, k: F.lit(1.0),
    "exponential": lambda h, k: F.pow(F.lit(0.9), h),
    "inverse": lambda h, k: 1 / h.cast("double"),
    "inverse_square": lambda h, k: 1 / (h * h).cast("double"),
    "logarithmic": lambda h, k: 1 / (1 + F.ln(h.cast("double"))),
    "linear": lambda h, k: F.greatest(F.lit(0.0), 1 - (h - 1) / k.cast("double")),
}


def decay(name: str, h: Column, k: int | Column) -> Column:
    if name not in DECAYS:
        raise ValueError(f"unknown decay {name!r}: one of {sorted(DECAYS)}")
    return DECAYS[name](h, F.lit(k) if isinstance(k, int) else k)


def ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: by 0, NaN for 0 and an infinity for the rest (plain division is an error there)."""
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))
