"""Vector expressions on array columns; all sums are taken in double precision, JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, z: s + z)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a, n=None) -> Column:
    """The vector over its norm (1e-12 at least), as floats."""
    n = norm(a) if n is None else n
    return F.transform(a, lambda v: (v.cast("double") / F.greatest(n, F.lit(1e-12))).cast("float"))


def cosine_distance(a, b, clip: bool = True) -> Column:
    d = dot(a, b)
    return 1 - (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)) if clip else d)


def affinity(a, b) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) + 1) / 2))


def fused(a, b) -> Column:
    """Unit-normalised sum of two vectors."""
    return unit(F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")))


def finite(a) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def confident(best, second, max_distance: float, margin: float) -> Column:
    """The gate: near enough, and far enough ahead of the runner-up (none: infinitely far)."""
    return (best <= max_distance) & (F.round(F.coalesce(second, F.lit(float("inf"))) - best, 9) >= margin)
