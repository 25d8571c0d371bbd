"""Trailing time-series operators: columns over (code, pos) of a dense grid.

A window covers the last n grid rows of a code, so its size is bounded by n and
a partition by the calendar length.  Every builder needs all n values unless a
smaller minimum is given.  Window functions do not nest; put inner operators in
an earlier ``withColumns`` layer (see ``layers``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import _pair, col, corr, div, finite

def by_code():
    return W.partitionBy("code").orderBy("pos")


def trailing(n: int, skip: int = 0):
    return by_code().rowsBetween(-(n - 1) - skip, -skip)


def layers(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    return df


def _need(x, n: int, value: Column, least: int | None = None) -> Column:
    return F.when(F.count(col(x)).over(trailing(n)) >= (least or n), value)


def ts_mean(x, n, least=None) -> Column:
    return _need(x, n, F.avg(col(x)).over(trailing(n)), least)


def ts_std(x, n, least=None) -> Column:
    return _need(x, n, F.stddev_samp(col(x)).over(trailing(n)), least)


def ts_std_pop(x, n, least=None) -> Column:
    return _need(x, n, F.stddev_pop(col(x)).over(trailing(n)), least)


def ts_sum(x, n, least=None) -> Column:
    return _need(x, n, F.sum(col(x)).over(trailing(n)), least)


def ts_max(x, n, least=None) -> Column:
    return _need(x, n, F.max(col(x)).over(trailing(n)), least)


def ts_min(x, n, least=None) -> Column:
    return _need(x, n, F.min(col(x)).over(trailing(n)), least)


def ts_rank(x, n) -> Column:
    """Average-tie percentile of the current value among the last n."""
    x = col(x)
    seen = F.collect_list(x).over(trailing(n))
    lower = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    return _need(x, n, (lower + (equal + 1) / F.lit(2.0)) / F.lit(float(n)))


def ts_delay(x, n) -> Column:
    return F.lag(col(x), n).over(by_code())


def ts_lead(x, n) -> Column:
    return F.lead(col(x), n).over(by_code())


def ts_delta(x, n) -> Column:
    return col(x) - ts_delay(x, n)


def ts_zscore(x, n) -> Column:
    return div(col(x) - ts_mean(x, n), ts_std(x, n))


def ts_decay_linear(x, n) -> Column:
    """Weights n for the newest value down to 1 for the oldest."""
    x = col(x)
    seen = F.collect_list(x).over(trailing(n))
    total = F.aggregate(
        F.arrays_zip(seen.alias("v"), F.sequence(F.lit(1), F.lit(n)).alias("w")),
        F.lit(0.0),
        lambda acc, e: acc + e["v"] * e["w"],
    )
    return _need(x, n, total / F.lit(n * (n + 1) / 2.0))


def ts_corr(x, y, n, least=None) -> Column:
    a, b = _pair(x, y)
    return _need(a, n, corr(a, b, trailing(n)), least)


def ts_cov(x, y, n, least=None) -> Column:
    a, b = _pair(x, y)
    return _need(a, n, F.covar_samp(a, b).over(trailing(n)), least)


def ts_beta(x, m, n, least) -> Column:
    """Population beta of x on m over the pairs of the window."""
    a, b = _pair(x, m)
    w = trailing(n)
    return _need(a, n, div(F.covar_pop(a, b).over(w), F.var_pop(b).over(w)), least)


def ts_skew(x, n, least) -> Column:
    """Bias-corrected skewness."""
    x = col(x)
    w = trailing(n)
    c = F.count(x).over(w)
    g = finite(F.skewness(x).over(w))
    return F.when((c >= least) & (c > 2), g * F.sqrt(c * (c - 1)) / (c - 2))


def ffill(x) -> Column:
    return F.last(col(x), ignorenulls=True).over(by_code().rowsBetween(W.unboundedPreceding, 0))


def ts_return(x, n: int = 1) -> Column:
    return div(x, ts_delay(x, n)) - 1


def ema_reset(df: DataFrame, x: str, half_life: float, out: str) -> DataFrame:
    """Exponential smoothing that a missing value resets: s_t = a x_t + (1-a) s_(t-1), s_0 = x_0.

    The recursion runs per code over its stretches of present values, at most one
    calendar of rows.
    """
    alpha = 1 - 2 ** (-1 / half_life)
    keep = df.select("code", "pos", x)

    def smooth(pdf):
        pdf = pdf.sort_values("pos")
        run = pdf[x].isna().cumsum()
        ok = pdf[x].notna()
        s = pdf.loc[ok].groupby(run[ok])[x].transform(lambda v: v.ewm(alpha=alpha, adjust=False).mean())
        return pdf[["code", "pos"]].assign(**{out: s})

    code_type = df.schema["code"].dataType.simpleString()
    return keep.groupBy("code").applyInPandas(smooth, f"code {code_type}, pos int, {out} double")
