"""Element-wise column builders with one missing value: NULL.

Every builder keeps NaN and infinities out of its result, so NULL is the only
missing marker that downstream ranks, windows and aggregates ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def finite(x) -> Column:
    """NULL out NaN and +-inf."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def abs_(x) -> Column:
    return F.abs(col(x))


def log_(x) -> Column:
    x = col(x)
    return F.when(x > 0, F.ln(x))


def sqrt_(x) -> Column:
    x = col(x)
    return F.when(x >= 0, F.sqrt(x))


def sign(x) -> Column:
    return F.signum(col(x))


def signed_power(x, p: float) -> Column:
    if not 0.1 <= abs(p) <= 5:
        raise ValueError("the exponent must be between 0.1 and 5 in absolute value")
    x = col(x)
    body = F.signum(x) * F.pow(F.abs(x), F.lit(float(p)))
    return F.when(x != 0, body).otherwise(F.when(x == 0, F.lit(0.0) if p > 0 else F.lit(None)))


def add(x, y) -> Column:
    return finite(col(x) + col(y))


def sub(x, y) -> Column:
    return finite(col(x) - col(y))


def mul(x, y) -> Column:
    return finite(col(x) * col(y))


def div(x, y) -> Column:
    """NULL for a zero denominator."""
    return finite(col(x) / F.nullif(col(y), F.lit(0.0)))


def neg(x) -> Column:
    return -col(x)


def _both(x, y, value: Column) -> Column:
    return F.when(col(x).isNotNull() & col(y).isNotNull(), value)


def max2(x, y) -> Column:
    return _both(x, y, F.greatest(col(x), col(y)))


def min2(x, y) -> Column:
    return _both(x, y, F.least(col(x), col(y)))


def gt(x, y) -> Column:
    return (col(x) > col(y)).cast("double")


def lt(x, y) -> Column:
    return (col(x) < col(y)).cast("double")


def ge(x, y) -> Column:
    return (col(x) >= col(y)).cast("double")


def le(x, y) -> Column:
    return (col(x) <= col(y)).cast("double")


def fill_na(x, c) -> Column:
    return F.coalesce(col(x), F.lit(float(c)))


def where(c, a, b) -> Column:
    """``a`` where c > 0, ``b`` elsewhere, missing where the condition is missing."""
    c = col(c)
    return F.when(c > 0, col(a)).when(c.isNotNull(), col(b))


def ratio_pos(num, den) -> Column:
    """num / den for a strictly positive denominator."""
    return F.when(col(den) > 0, col(num) / F.nullif(col(den), F.lit(0.0)))


def growth(now, before) -> Column:
    return ratio_pos(now, before) - 1


def change(now, before) -> Column:
    """Relative change, missing when the earlier value is zero."""
    return div(now, before) - 1


def compare(op: Column, x: Column, lo: Column, hi: Column) -> Column:
    """Condition test with the operator in the data."""
    return (
        F.when(op == ">", x > lo)
        .when(op == ">=", x >= lo)
        .when(op == "<", x < lo)
        .when(op == "<=", x <= lo)
        .when(op == "between", x.between(lo, hi))
    )


def half_life_decay(age, half_life: float) -> Column:
    return F.exp(-F.ln(F.lit(2.0)) * col(age) / F.lit(float(half_life)))


def _pair(x, y) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def corr(x, y, over=None) -> Column:
    """Pearson correlation of the complete pairs; missing where a side does not vary."""
    a, b = _pair(x, y)
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return finite(at(F.covar_pop(a, b)) / F.nullif(F.sqrt(at(F.var_pop(a)) * at(F.var_pop(b))), F.lit(0.0)))


def slope(y, x) -> Column:
    """Least-squares slope of y on x over the complete pairs."""
    a, b = _pair(y, x)
    return div(F.covar_pop(a, b), F.var_pop(b))


def r(x, digits: int = 6) -> Column:
    """Report rounding."""
    return F.round(col(x).cast("double"), digits)


def flag(x: Column) -> Column:
    """0/1 integer of a condition, missing counts as 0."""
    return F.coalesce(x, F.lit(False)).cast("int")


def day(x) -> Column:
    return F.date_format(col(x), "yyyy-MM-dd")
