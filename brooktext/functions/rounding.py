"""Rounding on the exact binary value with ties to even, which no built-in does, as column expressions.

A double is rarely the decimal that it is printed as, so that 0.0625 lies on a tie of thousandths and 0.0005 does not. What the
product with 1000 loses is computed too (the double is split into two halves, whose products with 1000 are exact), and
decides where the rounded product lies on a tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double's 53 bits into halves.
_SPLIT = float((1 << 27) + 1)
#: From here on a double has no digits beyond the third.
_WHOLE = float(1 << 43)


def exact_round3(x: Column) -> Column:
    """Three digits. Null, NaN and infinities stay as they are."""
    high = x * _SPLIT - (x * _SPLIT - x)
    product = x * 1000.0
    lost = (high * 1000.0 - product) + (x - high) * 1000.0  # exactly 1000 * x - product
    floor = F.floor(product).cast("double")
    part = product - floor
    up = (part > 0.5) | ((part == 0.5) & ((lost > 0) | ((lost == 0) & (floor % 2 != 0))))
    nearest = F.when(up, floor + 1).otherwise(floor) / 1000.0
    return F.when(F.abs(x) < _WHOLE, F.when((nearest == 0) & (x < 0), F.lit(-0.0)).otherwise(nearest)).otherwise(x)


def exact_round3_sql(x: str) -> str:
    """The same arithmetic as SQL; x: an expression of type DOUBLE, which is named once."""
    steps = f"SELECT x_, x_ * 1000 AS p_, x_ * {_SPLIT:.0f}::DOUBLE - (x_ * {_SPLIT:.0f}::DOUBLE - x_) AS h_ FROM (SELECT ({x})::DOUBLE AS x_)"
    parts = f"SELECT x_, floor(p_) AS f_, p_ - floor(p_) AS r_, (h_ * 1000 - p_) + (x_ - h_) * 1000 AS e_ FROM ({steps})"
    return f"(SELECT CASE WHEN abs(x_) < {_WHOLE:.0f} THEN (f_ + CASE WHEN r_ > 0.5 OR r_ = 0.5 AND (e_ > 0 OR e_ = 0 AND f_ % 2 <> 0) THEN 1 ELSE 0 END) / 1000 ELSE x_ END FROM ({parts}))"
