"""Number formatting and small arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with two decimals; 0 where there is no whole."""
    share = F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
    return F.concat(F.format_string("%.2f", share), F.lit("%"))


def mib(size: Column) -> Column:
    return size / F.lit(1024.0 * 1024.0)


#: 2^27 + 1 splits a double into two halves whose products with small whole numbers are exact.
_HALVES = 134217729.0


def fixed(c: Column, digits: int) -> Column:
    """The double's own value, not its shortest decimal form, with ``digits`` decimals; a tie goes to the
    even digit. Spark's formatting would give 2.675 as 2.68, though the double is a little less."""
    scale = float(10**digits)

    def text(x: Column) -> Column:
        size = F.abs(x)
        high = size * _HALVES - (size * _HALVES - size)
        low = size - high
        whole = F.floor(high * scale + low * scale).cast("double")
        # Exact, as the first difference and both products are; the sign of the sum is right.
        over = (high * scale - whole - 0.5) + low * scale
        odd = F.pmod(whole, F.lit(2.0)) == 1
        n = (whole + F.when((over > 0) | ((over == 0) & odd), 1.0).otherwise(0.0)).cast("bigint")
        body = n.cast("string")
        if digits:
            base = F.lit(10**digits)
            body = F.concat(((n - n % base) / base).cast("bigint").cast("string"), F.lit("."), F.lpad((n % base).cast("string"), digits, "0"))
        return F.concat(F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise(""), body)

    plain = F.format_string(f"%.{digits}f", c.cast("double"))
    # Beyond this the product with the scale is not exact, and Spark's own formatting is taken.
    small = ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < float(1 << 50))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(small, F.element_at(F.transform(F.array(c.cast("double")), text), 1)).otherwise(plain)


def at_least(c: Column, floor: float) -> Column:
    """c >= floor, false for null and NaN (in Spark NaN is larger than any number)."""
    return F.coalesce(~F.isnan(c.cast("double")) & (c >= floor), F.lit(False))
