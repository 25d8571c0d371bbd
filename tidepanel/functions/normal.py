"""Normal distribution as column arithmetic, with the same formulas as SQL text.

The upper tail is a series for x up to 3 and a continued fraction of the Mills ratio beyond; both
are exact to double precision there.  The quantile starts from a rational guess and takes three
Newton steps.  A value used several times is bound once, as the variable of a one-element transform.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, LEVELS, STEPS = 40, 30, 3
_ROOT = 1 / math.sqrt(2 * math.pi)
# Rational guess of the quantile (Abramowitz and Stegun 26.2.23).
GUESS_TOP = (2.515517, 0.802853, 0.010328)
GUESS_BOTTOM = (1.0, 1.432788, 0.189269, 0.001308)


def _bind(x: Column, f) -> Column:
    return F.element_at(F.transform(F.array(x), f), 1)


def _density(x: Column) -> Column:
    return _ROOT * F.exp(-x * x / 2)


def _upper(x: Column) -> Column:
    """Upper tail of x >= 0."""
    y, series, tail = x * x, F.lit(1.0), x
    for k in range(TERMS, 0, -1):
        series = 1 + y / float(2 * k + 1) * series
    for k in range(LEVELS, 0, -1):
        tail = x + float(k) / F.greatest(tail, F.lit(1e-9))
    return F.when(x <= 3, 0.5 - _density(x) * x * series).otherwise(_density(x) / F.greatest(tail, F.lit(1e-9)))


def cdf(x: Column) -> Column:
    size = _bind(F.abs(x.cast("double")), _upper)
    return F.when(x >= 0, 1 - size).when(x < 0, size)


def sf(x: Column) -> Column:
    return cdf(-x.cast("double"))


def _poly(c, t):
    out = c[-1]
    for a in reversed(c[:-1]):
        out = out * t + a
    return out


def ppf(p: Column) -> Column:
    """Quantile; missing outside (0, 1)."""

    def newton(z: Column, q: Column) -> Column:
        return z + (_upper(z) - q) / _density(z)

    ok = (p > 0) & (p < 1)
    q = F.when(ok, F.least(p, 1 - p)).cast("double")  # the quantile's size is found from the smaller tail
    guess = _bind(F.sqrt(-2 * F.ln(q)), lambda t: F.greatest(t - _poly(GUESS_TOP, t) / _poly(GUESS_BOTTOM, t), F.lit(0.0)))
    size = F.aggregate(F.array(*[q] * STEPS), guess, newton)
    return F.when(ok, size * F.when(p < 0.5, -1.0).otherwise(1.0))


def sql_cdf(x: str) -> str:
    y, series, tail = "v * v", "1.0::DOUBLE", "v"
    for k in range(TERMS, 0, -1):
        series = f"(1 + {y} / {2 * k + 1}.0::DOUBLE * {series})"
    for k in range(LEVELS, 0, -1):
        tail = f"(v + {k}.0::DOUBLE / greatest({tail}, 1e-9))"
    upper = f"CASE WHEN v <= 3 THEN 0.5::DOUBLE - {_ROOT}::DOUBLE * exp(-v * v / 2) * v * {series} ELSE {_ROOT}::DOUBLE * exp(-v * v / 2) / greatest({tail}, 1e-9) END"
    size = f"list_transform([abs({x})::DOUBLE], lambda v: {upper})[1]"
    return f"CASE WHEN {x} >= 0 THEN 1 - {size} WHEN {x} < 0 THEN {size} END"


def sql_ppf(p: str) -> str:
    """The same guess and Newton steps."""
    top = f"({GUESS_TOP[0]}::DOUBLE + {GUESS_TOP[1]}::DOUBLE * t + {GUESS_TOP[2]}::DOUBLE * t * t)"
    bottom = f"(1 + {GUESS_BOTTOM[1]}::DOUBLE * t + {GUESS_BOTTOM[2]}::DOUBLE * t * t + {GUESS_BOTTOM[3]}::DOUBLE * t * t * t)"
    q = f"least({p}, 1 - ({p}))"
    z = f"list_transform([sqrt(-2 * ln({q}))], lambda t: t - {top} / {bottom})[1]"
    for i in range(STEPS):
        z = f"list_transform([{z}], lambda z{i}: z{i} + (1 - ({sql_cdf(f'z{i}')}) - {q}) / ({_ROOT}::DOUBLE * exp(-z{i} * z{i} / 2)))[1]"
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN ({z}) * CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END END"
