"""Vector functions as Column expressions over array<float> or array<double>; sums are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance of a norm from 1, absolute and relative, that counts as unit length.
NORM_TOLERANCE, NORM_RELATIVE = 1e-3, 1e-5


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_finite(v: Column) -> Column:
    """No entry is null, NaN or infinite; null for a null vector is false."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return F.coalesce(F.forall(v, fine), F.lit(False))


def l2_normalize(v: Column) -> Column:
    """Unit vector; null for a vector that is empty, not finite or zero."""
    # Bound to a lambda's variable, the norm is taken once and not for every entry.
    scaled = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))
    return F.when(is_finite(v), F.element_at(scaled, 1))


def is_unit(v: Column) -> Column:
    return is_finite(v) & (F.abs(norm(v) - 1) <= NORM_TOLERANCE + NORM_RELATIVE)


def is_query(v: Column, dimensions: int) -> Column:
    return F.coalesce((F.size(v) == dimensions) & is_finite(v) & (norm(v) > 0), F.lit(False))
